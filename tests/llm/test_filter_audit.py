"""The filter audit against a loop over rows, orders and steps."""

import itertools
import random

from conftest_llm import words
from pyspark.sql import functions as F

from perigee.llm import filter_audit as fa

LABELS = "doc_id long, quality int, toxic int, row string"


def by_hand(rows, labels):
    judged = []
    for doc_id, text, lang in rows:
        text = text or ""
        found = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
        fails = {
            "A": len(found) < 200, "B": 100 * len(set(found)) < 50 * len(found), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in rows),
        }
        mine = [] if doc_id is None else [x for x in labels if x[0] == doc_id]
        judged.append((lang or "", {f for f, bad in fails.items() if bad}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {j[0] for j in judged}:
        of = [j for j in judged if j[0] == part]
        steps, total = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            alive, gone = of, []
            for i, f in enumerate(order):
                hit, kept = [j for j in alive if f in j[1]], [j for j in alive if f not in j[1]]
                total[f] += len(hit)
                steps.append([
                    part, order, i + 1, len(kept), len(hit), sum(f in j[1] for j in gone), sum(j[1] == {f} for j in of),
                    sum(j[2] for j in hit), sum(j[3] for j in hit), f,
                ])
                alive, gone = kept, gone + hit
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def a_table(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = words(rng, rng.choice([5, 150, 199, 200, 201, 260]), rng.choice([20, 100, 3000]))
        if rng.random() < 0.3:
            text += rng.choice([" #", " A$", "|", " ÄÖÜ", " É&"])
        if rng.random() < 0.3:
            text = text.replace("w", "W")
        if rows and rng.random() < 0.4:
            text = rng.choice(rows)[1]
        rows.append((rng.choice([i, i, i, 7, None]), text, rng.choice(["en", "de", None, ""])))
    rows += [(500, None, "en"), (501, "", "en"), (None, "", "fr"), (502, words(rng, 20000), None), rows[0], rows[0]]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for r in rows if rng.random() < 0.7] + [(9999, 1, 1)]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 3, "x", 1) for r in rows], "doc_id long, text string, lang string, row int, filter string, part int")
    return docs, spark.createDataFrame([(*x, "r") for x in labels], LABELS)


def test_audit_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(fa, "HEAVY", 30)
    rows, labels = a_table(4)
    found = fa.audit_documents(*frames(spark, rows, labels))
    assert found.columns == [
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    ]
    assert sorted(map(tuple, found.collect())) == by_hand(rows, labels)


def test_a_third_of_all_rows_with_one_text(spark):
    rng = random.Random(6)
    rows = [(i, "the same text" if i % 3 == 0 else words(rng, 9), "en") for i in range(300)]
    docs, labels = frames(spark, rows, [])
    assert sorted(map(tuple, fa.audit_documents(docs, labels).collect())) == by_hand(rows, [])


def test_empty_table(spark):
    docs, labels = frames(spark, [], [])
    assert fa.audit_documents(docs, labels).count() == 0


def test_other_filters(spark):
    rows = spark.range(60).select(F.col("id").alias("row"), F.lit("p").alias("part"))
    failing = None
    for f, by in (("x", 2), ("y", 3), ("z", 5)):
        one = rows.where(F.col("row") % by == 0).select(F.lit(f).alias("filter"), "row", "part", F.lit(False).alias("good"), F.lit(True).alias("toxic"))
        failing = one if failing is None else failing.unionAll(one)
    found = {(r.filter_order, r.step): r for r in fa.audit(rows, fa.by_filter(failing), ["x", "y", "z"]).collect()}
    assert len(found) == 18
    assert [found["zyx", i].kept for i in (1, 2, 3)] == [48, 32, 16] and found["zyx", 3].redundant == 14
    assert found["xyz", 1].shapley == 2 * 30 + 20 + 24 + 2 * 16 and found["xyz", 2].toxic_lost == 10


def test_the_plan_has_a_join_per_filter_not_per_prefix(spark, monkeypatch):
    monkeypatch.setattr(fa, "PIECE_ROWS", 10)
    rng = random.Random(8)
    # Numbers of no row, repeated ones and NULL among the failing rows.
    wrong = [(rng.choice("vwxyz"), rng.choice([*range(50), None]), rng.choice(["p", "q"]), rng.random() < 0.5, rng.random() < 0.2) for _ in range(180)]
    rows = spark.range(40).select(F.col("id").alias("row"))
    failing = fa.by_filter(spark.createDataFrame(wrong, "filter string, row long, part string, good boolean, toxic boolean"))
    counts = fa.joined_counts(rows, failing, list("vwxyz"))
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 6
    expected = {}
    for n in range(5):
        for prefix in itertools.combinations("vwxyz", n):
            alive = set(range(40)) - {w[1] for w in wrong if w[0] in prefix}
            for f, row, part, good, toxic in wrong:
                if row in alive:
                    old = expected.get(("".join(prefix), f, part), (0, 0, 0))
                    expected["".join(prefix), f, part] = (old[0] + 1, old[1] + good, old[2] + toxic)
    assert {(r.prefix, r.filter, r.part): (r.removed, r.good_lost, r.toxic_lost) for r in counts.collect()} == expected
