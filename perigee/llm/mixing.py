"""Mixing sources to target weights by capped water-filling.

All sources share the words of the corpus by weight.  A source whose share exceeds
``max_epochs`` times its own words is clamped there and the excess goes to the others by weight,
until none is above.  With sources ordered by the level at which they clamp, that fixed point is
one pass of running sums.  A source is then read ``whole`` times, and once more up to a cut in a
seeded order of its documents, chosen so that the words taken come nearest to its target.

Only per-source rows and 4,096 sums per source travel; the documents meet the finished table of
sources in a join that Spark sizes from its files.

Defined results: NULL texts have no words and are taken as 0 words; a NULL source is a source, the
last one.  Rows that agree in source, id and text share their place in the seeded order; where the cut falls among them,
as many of them are taken as come nearest to the target, in the order in which they were written down.  An empty table mixes
to an empty table; sources without words have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.session import materialize

MAX_EPOCHS = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
CELL_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Place of a document in the seeded order; rows of one place have one size."""
    text = F.md5(F.coalesce(text, F.lit("")))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text))


def cyclic_weights(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights dealt in turn to the sources in code point order, NULL last; one row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    dealt = F.array(*map(F.lit, weights))[rank % len(weights)]
    return sizes.withColumn("weight", dealt)


def water_fill(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight)."""
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("clamps_at"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * max_epochs
    levels = sizes.withColumn("clamps_at", cap.cast("double") / F.col("weight")).withColumns({
        "free_words": F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "free_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    }).withColumn("level", F.col("free_words").cast("double") / F.col("free_weight"))
    # The first level that its own source can take is the level of all from there on.
    fits = F.col("level") <= F.col("clamps_at")
    final = F.min(F.when(fits, F.struct("clamps_at", "level"))).over(everything)["level"]
    shared = F.col("weight") * final
    target = F.when(F.col("clamps_at") < final, cap.cast("double")).otherwise(F.least(shared, cap.cast("double")))
    return levels.withColumn("target", target).select("source", "source_size", "weight", "target")


def plan(rows: DataFrame, weights=cyclic_weights, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target, whole, cut, share) from (source, size, key) rows.

    A document is taken ``whole`` times, and once more if its key is below ``cut`` (NULL: no words to take).  Of the rows at
    the cut itself ``share`` are taken once more.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(water_fill(weights(sizes), max_epochs), "mix-targets").withColumn(
        "whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    cell = F.substring("key", 1, CELL_DIGITS)
    cells = rows.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("cell_size"))
    upto = Window.partitionBy("source").orderBy("cell")
    cells = cells.withColumn("start", F.sum("cell_size").over(upto) - F.col("cell_size"))
    same_source = F.col("c.source").eqNullSafe(F.col("t.source"))
    # The cell in which the rest is used up; documents within it are looked at one by one.
    crossing = materialize(
        cells.alias("c").join(targets.alias("t"), same_source)
        .where((F.col("start") <= F.col("rest")) & (F.col("start") + F.col("cell_size") > F.col("rest")))
        .select("c.source", "cell", "start", "rest"), "mix-crossing",
    )
    inside = rows.withColumn("cell", cell).alias("r").join(
        crossing.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.cell") == F.col("c.cell"))
    )
    per_key = inside.groupBy("r.source", "c.start", "c.rest", "key").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    end = F.col("start") + F.sum("size").over(Window.partitionBy("source").orderBy("key"))
    per_key = per_key.withColumns({"end": end, "one": F.col("size") / F.col("n")})
    # A row is taken if its middle is not past the rest; the rows of a key stand one after the other.
    fitting = F.floor(F.try_divide(F.col("rest") - F.col("end") + F.col("size"), F.col("one")) + 0.5)
    share = F.greatest(F.lit(0), F.least(F.coalesce(fitting, F.lit(0)), F.col("n") - 1)).cast("long")
    past = F.when(F.col("end") - F.col("one") / 2 > F.col("rest"), F.struct("key", share.alias("share")))
    # A cell that is used up by its last document but one half of a word has its cut just above it.
    cuts = per_key.withColumn("past", past).groupBy("source").agg(F.min("past").alias("past"), F.max("key").alias("last")).select(
        "source", F.coalesce("past.key", F.concat("last", F.lit("~"))).alias("cut"), F.coalesce("past.share", F.lit(0)).alias("share")
    )
    planned = targets.alias("t").join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    return materialize(planned.select("t.source", "source_size", "weight", "target", "whole", "cut", "share"), "mix-plan")


def epochs(key: Column, whole: Column, cut: Column) -> Column:
    """How often a document with this key is taken, from the plan of its source; rows at the cut are looked at apart."""
    return whole + F.coalesce(key < cut, F.lit(False)).cast("int")


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``number`` (from 1, gapless in each source) to written rows with an ``id``; no task numbers more than one piece."""
    rows = rows.withColumn("piece", F.shiftright("id", 33))
    counts = rows.groupBy("source", "piece").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", "piece", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("source", "piece").orderBy("id"))
    joined = rows.withColumn("inside", inside).alias("r").join(
        starts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.piece") == F.col("s.piece")))
    return joined.select("r.*", (F.col("inside") + F.col("start")).alias("number")).drop("inside", "piece")


def times_taken(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Adds the plan's columns and ``times`` to written rows with (source, key, id); ids as ``monotonically_increasing_id`` makes them."""
    joined = rows.alias("r").join(planned.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select(
        "r.*", *(f"p.{c}" for c in planned.columns if c != "source"))
    joined = joined.withColumn("times", epochs(F.col("key"), F.col("whole"), F.col("cut")).cast("int"))
    if planned.where("share > 0").isEmpty():
        return joined
    at_cut = F.coalesce((F.col("share") > 0) & (F.col("key") == F.col("cut")), F.lit(False))
    split = _numbered(joined.where(at_cut))
    split = split.withColumn("times", F.col("times") + (F.col("number") <= F.col("share")).cast("int")).drop("number")
    return joined.where(~at_cut).unionByName(split)


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    rows = materialize(docs.select(
        "source", word_count(F.col("text")).alias("size"), seeded_key(F.col("doc_id"), F.col("text"), seed).alias("key")
    ), "mix-rows")
    planned = plan(rows)
    taken = docs.alias("d").join(planned.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    key = seeded_key(F.col("d.doc_id"), F.col("d.text"), seed)
    copy = max(docs.columns, key=len, default="") + "_copy"

    def repeated(found: DataFrame, own: list, times: Column) -> DataFrame:
        return found.select(*own, F.explode(F.array_repeat(F.lit(0), times)).alias(copy)).drop(copy)

    times = epochs(key, F.col("p.whole"), F.col("p.cut")).cast("int")
    if planned.where("share > 0").isEmpty():
        return repeated(taken, ["d.*"], times)
    at_cut = F.coalesce((F.col("p.share") > 0) & (key == F.col("p.cut")), F.lit(False))
    # Rows at a cut are written once, so that each has one number whatever is read again.
    split = materialize(taken.where(at_cut).select(
        F.struct(*(F.col(f"d.`{c}`") for c in docs.columns)).alias("row"), "d.source", key.alias("key"), F.monotonically_increasing_id().alias("id")
    ), "mix-cut")
    split = repeated(times_taken(split, planned), [F.col(f"row.`{c}`") for c in docs.columns], F.col("times"))
    return repeated(taken.where(~at_cut), ["d.*"], times).unionAll(split)
