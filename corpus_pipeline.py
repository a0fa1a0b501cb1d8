"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Every stage works on all rows its predecessor kept.  All but the last return the columns of
``documents``; the last adds ``shard`` and ``slot``.  The stages have no SQL form (a trained classifier,
XXH64 fingerprints and seeded md5 order among them): ``ORACLE_SQL`` is None, and tests compare each
stage with a brute-force version.

Defined results: NULL and empty texts have a score, are near-duplicates of each other and share no window with a
benchmark item.  Very long texts are worked on whole.  Repeated rows are exact copies: one of them passes the
near-duplicate stage.  An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm import decontaminate, mixing, sharding, simhash, toxicity
from perigee.session import materialize, prepare

ORACLE_SQL = None
SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below the threshold; learns from all labels whose documents are there."""
    prepare(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(model.score(spark, docs["text"]) < toxicity.THRESHOLD)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by fingerprints of three-word shingles within two bits the row with the smallest doc_id."""
    prepare(spark)
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no window of words with a benchmark item."""
    prepare(spark)
    found = decontaminate.contamination(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs)
    return found.where(F.size("found.spans") == 0).select(*(F.col(f"row.`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: repeated, once, or not at all."""
    prepare(spark)
    return mixing.mix(docs)


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it."""
    prepare(spark)
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_into_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
