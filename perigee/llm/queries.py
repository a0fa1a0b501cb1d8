"""Queries over the given tables, one per operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm import (
    bpe_stream, cover_dedup, decontaminate, filter_audit, html_text, learned_partitions, mixing, quality, sharding, simhash, suffix_levels,
    toxicity, variants,
)
from perigee.session import materialize


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(doc_id: str, by: int):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(by))


def _held_out(by: int, remainder: int):
    """Whether labels of the row are kept from training; rows without an id have none and count as not held out."""
    return F.coalesce(_remainder("doc_id", by) == remainder, F.lit(False)).alias("held_out")


def op1_learned_partitions(spark, sf_dir):
    return learned_partitions.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_histogram_shards(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    h, d = sharding.sort_key(F.col("text"), F.col("doc_id"))
    rows = materialize(docs.select(
        "doc_id", sharding.size_of(F.col("text")).alias("size"), F.crc32("text").alias("text_crc32"), h.alias("h"), d.alias("d")
    ), "shard-rows")
    placed = sharding.shard(rows, rows.select("h", "d", "size"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_suffix_levels(spark, sf_dir):
    found = suffix_levels.removed_bytes(_read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256"
    )


def op4_cover_anchors(spark, sf_dir):
    found = cover_dedup.removed_words(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_source_mix(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    rows = materialize(docs.select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.seeded_key(F.col("doc_id"), F.col("text")).alias("key"),
        F.monotonically_increasing_id().alias("id"),
    ), "mix-docs")
    found = mixing.times_taken(rows, mixing.plan(rows.select("source", "size", "key")))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op6_decontaminate(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    found = decontaminate.contamination(_read(spark, sf_dir, "benchmark"), docs)
    ids = F.array_sort(F.transform(F.col("found.items"), lambda i: i.cast("string")))
    return found.select(
        "row.doc_id", "found.n_words", decontaminate.words_in(F.col("found.spans")).alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"),
    )


def op7_toxicity(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    labels = _read(spark, sf_dir, "labels").where(_remainder("doc_id", 4) != 2)
    score = toxicity.fit(docs, labels).score(spark, F.col("text"))
    return docs.select("doc_id", _held_out(4, 2), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int")
    )


def op8_quality(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    rows = materialize(docs.select("doc_id", quality.statistics(F.col("text")).alias("x")), "statistics")
    labels = _read(spark, sf_dir, "labels").where(_remainder("doc_id", 5) != 0)
    model = quality.fit(rows.join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id"))
    return rows.select("doc_id", _held_out(5, 0), model.score(F.col("x")).alias("score")).withColumn(
        "predicted", (F.col("score") >= quality.THRESHOLD).cast("int")
    )


def op9_visible_text(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    return pages.select("page_id", html_text.visible_text(F.col("html")).alias("text")).withColumn("n_chars", F.length("text"))


def op10_simhash(spark, sf_dir):
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op11_spelling_variants(spark, sf_dir):
    return variants.variants_of(_read(spark, sf_dir, "documents"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_stream_bpe(spark, sf_dir, vocabulary: str | None = None):
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    coder = bpe_stream.Coder(spark, vocabulary)
    docs = _read(spark, sf_dir, "documents").select("doc_id", coder.encode(F.col("text")).alias("ids"))
    return docs.select("doc_id", "ids", coder.decode(F.col("ids")).alias("decoded")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    f.__name__: f for f in (
        op1_learned_partitions, op2_histogram_shards, op3_suffix_levels, op4_cover_anchors, op5_source_mix, op6_decontaminate, op7_toxicity, op8_quality,
        op9_visible_text, op10_simhash, op11_spelling_variants, op12_filter_audit, op13_stream_bpe,
    )
}
