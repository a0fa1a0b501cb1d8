"""How filters interact: what each removes, repeats or costs at any place in any order.

A filter is the relation of the rows that fail it, stored as one table of row numbers per filter.  What a filter removes after a
prefix are its failing rows, left-semi joined with all rows and left-anti joined with the table of each filter in the prefix; the
rest of its failing rows are redundant there.
A prefix acts as a set, so n filters need 2**n - 1 prefixes for their n! orders.  A failing row meets all of them in one chain of joins: it
stands there once for each prefix without its filter, and the table of a filter takes away those whose prefix holds the filter.  So the
plan has a join per filter, not per prefix, and a driver holds little of it.  All joins meet on the row number: every table is
dealt by it once, and only counts by part leave that partitioning.

Duplicates are a filter as well (``repeated_rows``): rows whose text stands in a row of smaller id.  A text that more than
one row in a thousand holds meets its rows by broadcast (there are fewer than a thousand of such texts), all others by a shuffled join.

Defined results: a NULL part is the empty part and a NULL condition is no failure.  A NULL id fails no duplicate test and
makes no other row fail; rows of equal id and text do not fail by each other.  Repeated label rows of one id count as a loss if any of them does; labels
without a row have no effect.  An empty table has no parts and gives an empty result.  Rows are told apart by a number given when they
are first written, so repeated rows are counted as often as they stand there; other columns are not looked at.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perigee.session import materialize, pieces_of, scratch_path

WORD = r"[^\x20\x09-\x0D]+"
HEAVY = 1000
# Failing rows of a piece, each of which stands there once a prefix.
PIECES, PIECE_ROWS = 8, 100_000
LEAST_WORDS = 200
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FAILING = ["filter", "row", "part", "good", "toxic"]


def text_statistics(text: Column) -> Column:
    """Words, distinct words, code points and capitals of a text, and whether it holds a sign."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    points = F.length(text)
    return F.struct(
        F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("distinct"), points.alias("points"),
        (points - F.length(F.translate(text, CAPITALS, ""))).alias("capitals"), text.rlike(r"[#$%&*|]").alias("signs"),
    )


def text_failures(s: Column) -> dict[str, Column]:
    """The filters on one text, by its statistics: short, repetitive, loud, with signs."""
    return {
        "A": s["words"] < LEAST_WORDS,
        "B": 100 * s["distinct"].cast("long") < 50 * s["words"].cast("long"),
        "C": 100 * s["capitals"].cast("long") > 3 * s["points"].cast("long"),
        "D": s["signs"],
    }


def repeated_rows(rows: DataFrame, total: int) -> DataFrame:
    """(row) of ``rows`` (row, doc_id, text_key) whose text_key also stands in a row of smaller doc_id."""
    firsts = rows.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    firsts = materialize(firsts.where("first < last").select("text_key", "first", "n"), "audit-firsts")
    heavy = F.broadcast(firsts.where(F.col("n") > total / HEAVY).select("text_key", "first"))
    light = firsts.where(F.col("n") <= total / HEAVY).select("text_key", "first")
    often = rows.join(heavy, "text_key").where("doc_id > first")
    seldom = rows.join(heavy, "text_key", "left_anti").join(light, "text_key").where("doc_id > first")
    return often.select("row").unionByName(seldom.select("row"))


def losses(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, good, toxic) of the rows (row, doc_id) whose label says that their removal is a loss."""
    flags = labels.groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    ).where("good OR toxic")
    return rows.where("doc_id IS NOT NULL").select("row", "doc_id").join(flags, "doc_id").select("row", "good", "toxic")


def by_filter(failing: DataFrame) -> DataFrame:
    """The rows (filter, row, part, good, toxic) stored as one table per filter."""
    path = scratch_path(failing.sparkSession, "audit-failing")
    failing.select(FAILING).write.partitionBy("filter").parquet(path)
    return failing.sparkSession.read.schema(failing.select(FAILING).schema).parquet(path).select(FAILING)


def _steps(parts: DataFrame, filters: list[str]) -> DataFrame:
    """Each row of ``parts`` with all orders of the filters, step by step: the filter, and what stands before it as a sorted text."""
    orders = F.split(F.lit(",".join(map("".join, itertools.permutations(filters)))), ",")
    each = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    order, step = F.col("filter_order"), F.col("step")
    earlier = F.split(F.substring(order, F.lit(1), step - 1), "")
    return each.withColumns({"filter": F.substring(order, step, F.lit(1)), "prefix": F.array_join(F.array_sort(earlier), "")})


def joined_counts(rows: DataFrame, failing: DataFrame, filters: list[str]) -> DataFrame:
    """(prefix, filter, part, removed, good_lost, toxic_lost) for each set of earlier filters, by joins on row.

    ``rows`` has (row), ``failing`` (filter, row, part, good, toxic), stored by filter.
    """
    prefixes = ["".join(prefix) for n in range(len(filters)) for prefix in itertools.combinations(sorted(filters), n)]
    dealt = failing.repartition(pieces_of(failing, PIECES, PIECE_ROWS), "row").join(rows.select("row"), "row", "left_semi")
    here = dealt.select(F.explode(F.array(*map(F.lit, prefixes))).alias("prefix"), *FAILING).where(~F.col("prefix").contains(F.col("filter")))
    for f in filters:
        gone = failing.where(F.col("filter") == f).select(F.col("row").alias("gone"))
        here = here.join(gone, (F.col("row") == F.col("gone")) & F.col("prefix").contains(f), "left_anti")
    return here.groupBy("prefix", "filter", "part").agg(
        F.count("*").alias("removed"), F.count_if("good").alias("good_lost"), F.count_if("toxic").alias("toxic_lost")
    )


def audit(rows: DataFrame, failing: DataFrame, filters: list[str]) -> DataFrame:
    """One row per part, order of the filters and step.

    ``rows`` has (row, part); ``failing`` (filter, row, part, good, toxic), stored by filter.  Filters have one-letter names.
    """
    counts = materialize(joined_counts(rows, failing, filters), "audit-counts")
    parts = rows.groupBy("part").agg(F.count("*").alias("total"))
    all_fails = counts.where("prefix = ''").select("filter", "part", F.col("removed").alias("fails"))
    alone = counts.where(F.length("prefix") == len(filters) - 1).select("filter", "part", F.col("removed").alias("unique_fails"))
    joined = _steps(parts, filters).join(counts, ["prefix", "filter", "part"], "left")
    for one in (all_fails, alone):
        joined = joined.join(one, ["filter", "part"], "left")
    values = ["removed", "unique_fails", "good_lost", "toxic_lost"]
    joined = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in [*values, "fails"]})
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    return joined.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("removed").over(so_far)).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), *values[1:],
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the four filters on texts and of the duplicate filter (E) over all documents, by language."""
    judged = docs.select(
        "doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), text_statistics(F.col("text")).alias("s"),
        F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("text_key"),
    )
    rules = text_failures(F.col("s"))
    fails = F.array_compact(F.array(*(F.when(rule, F.lit(f)) for f, rule in rules.items())))
    rows = materialize(judged.select(F.monotonically_increasing_id().alias("row"), "doc_id", "part", "text_key", fails.alias("fails")), "audit-rows")
    again = repeated_rows(rows.select("row", "doc_id", "text_key"), rows.count()).select("row", F.lit("E").alias("repeats"))
    flags = losses(rows, labels)
    known = rows.select("row", "part", "fails").join(again, "row", "left").join(flags, "row", "left")
    each = known.select(
        F.explode(F.array_compact(F.concat("fails", F.array("repeats")))).alias("filter"), "row", "part",
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )
    return audit(rows.select("row", "part"), by_filter(each), [*rules, "E"])
