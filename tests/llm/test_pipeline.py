"""The corpus pipeline: each stage against its operator's rule, and the whole on a given table."""

import corpus_pipeline as cp
from conftest_llm import words
from test_decontaminate import expected
from test_simhash import groups, print_of
import random

SF = "/root/testdata/sf0.001"


def smallest_of_each_group(rows):
    """By comparison of all pairs: the smallest doc_id of each group of texts within two bits."""
    prints = [(r.doc_id, print_of(r.text)) for r in sorted(rows, key=lambda r: r.doc_id)]
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i][1] ^ prints[j][1]).bit_count() <= 2]
    return [prints[i][0] for i in sorted(set(groups(len(prints), pairs)))]


def test_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in cp.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    before = docs
    for name, stage in cp.STAGES:
        after = stage(spark, before, SF).persist()
        if name != "sharding":
            assert after.columns == columns
        else:
            assert after.columns == [*columns, "shard", "slot"] and after.count() == before.count()
        if name != "mixing":
            assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in after.collect()) == smallest_of_each_group(before.collect())
        if name == "decontamination":
            rows = before.collect()
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            clean = [r.doc_id for r, (_, hit, _) in zip(rows, expected([r.text for r in rows], items)) if not hit]
            assert sorted(clean) == sorted(r.doc_id for r in after.collect())
        if name == "mixing":
            assert max(r["count"] for r in after.groupBy("doc_id").count().collect()) <= 3
        before = after


def test_run_is_repeatable(spark):
    rows = [sorted(map(tuple, cp.run(spark, SF).select("doc_id", "shard", "slot").collect())) for _ in range(2)]
    assert rows[0] and rows[0] == rows[1]


def test_extra_columns_nulls_and_empty_tables(spark, documents):
    rng = random.Random(1)
    docs = documents([(i, words(rng, 30), "s") for i in range(20)] + [(50, None, None), (51, "", "s"), (None, "x y", "t")])
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert set(out.columns) >= set(docs.columns)
        out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
