"""Row order: dense positions, permutations, heads and tails, order statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from perigee import fixed_values as fv
from perigee.session import materialize
from perigee.sources.dims import local_table

# Rows one task may sort to read off a rank; larger brackets are narrowed first.
RANK_LIMIT = 1_000_000
SKETCH_ACCURACY = 10_000
# Up to this many rows are picked by a filter that reaches the scan.
LITERAL_PICKS = 50


def with_dense_index(
    df: DataFrame, order_by: Sequence[str | Column], out: str = "idx", partitions: int | None = None
) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... in the given order, without one global window.

    Rows are range-partitioned and sorted, written once together with their place in
    the partition, and shifted by the sizes of the partitions before.  Only those
    sizes, one row per partition, meet in a single task.  Order columns should be
    unique together; equal rows get places in either order.
    """
    ranged = df.repartitionByRange(partitions, *order_by) if partitions else df.repartitionByRange(*order_by)
    placed = ranged.sortWithinPartitions(*order_by).withColumn("_place", F.monotonically_increasing_id())
    stored = materialize(placed, "ordered").withColumn("_part", F.shiftright("_place", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
        .select(F.col("_part"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.join(offsets, "_part").select(
        *df.columns, (F.col("_offset") + place).alias(out)
    )


def permutation_key(column: str, seed: int = fv.SEED) -> Column:
    """A reproducible pseudo-random sort key of a row id."""
    return F.md5(F.concat_ws(":", F.col(column).cast("string"), F.lit(str(seed))))


def replay_order(
    df: DataFrame, mode: str = "sequential", seq: str | Sequence[str] = "seq", seed: int = fv.SEED
) -> DataFrame:
    """Adds ``position``: the place of each row when played back in ``mode`` order.

    Sequential order may take several columns; shuffled order draws from one unique row id.
    """
    if mode == "sequential":
        return with_dense_index(df, [seq] if isinstance(seq, str) else list(seq), "position")
    if mode != "shuffled":
        raise ValueError(f"unknown order mode {mode!r}")
    keyed = df.withColumn("_key", permutation_key(seq, seed))
    return with_dense_index(keyed, ["_key", seq], "position").drop("_key")


def first_rows(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    return df.orderBy(seq).limit(n)


def last_rows(df: DataFrame, n: int = fv.BUFFER_ROWS, seq: str = "seq") -> DataFrame:
    """The buffer of the latest ``n`` rows; each task keeps at most ``n``."""
    return df.orderBy(F.col(seq).desc()).limit(n)


def newest_first(df: DataFrame, n: int = fv.NEWEST_ROWS, seq: str = "seq") -> DataFrame:
    """The newest ``n`` rows, numbered from the newest."""
    top = last_rows(df, n, seq)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(seq).desc())))


def metric_history(
    df: DataFrame, metrics: Sequence[str], step: str = "seq", points: int = fv.HISTORY_POINTS
) -> DataFrame:
    """One point per step, the last ``points`` steps; absent metrics are left out.

    A step seen twice keeps one point, the least by value, so re-reads change nothing.
    Only rows from the earliest step that counts are grouped.
    """
    kept = [name for name in metrics if name in df.columns]
    steps = df.select(step).where(F.col(step).isNotNull())
    recent = last_rows(steps, points, step).agg(
        F.min(step).alias("first"), F.count(step).alias("rows"), F.count_distinct(step).alias("steps")
    ).first()
    first = recent["first"]
    if recent["rows"] == points and recent["steps"] < points:
        # Repeated steps crowd out earlier ones: take the steps themselves first.
        first = last_rows(steps.groupBy(step).agg(F.lit(1)).select(step), points, step).agg(F.min(step)).first()[0]
    recent_rows = df.where(F.col(step) >= F.lit(first))
    one_per_step = recent_rows.groupBy(step).agg(F.min(F.struct(*kept)).alias("p")).select(step, "p.*")
    return last_rows(one_per_step, points, step)


class _Brackets:
    """Rows of a table between two bounds, for several groups and bounds at once."""

    def __init__(self, df: DataFrame, by: str, value: str) -> None:
        self.rows = df.select(by, value).where(F.col(value).isNotNull() & F.col(by).isNotNull())
        self.by, self.value = by, value
        self.kind = to_arrow_type(self.rows.schema[value].dataType)
        self.group_kind = to_arrow_type(self.rows.schema[by].dataType)

    def table(self, bounds: dict[int, tuple], **extra: pa.DataType) -> DataFrame:
        """``(_t, _by, lo, hi, *extra)`` per entry; NULL bounds are open."""
        columns = {"_t": pa.int32(), "_by": self.group_kind, "lo": self.kind, "hi": self.kind, **extra}
        return local_table(self.rows.sparkSession, columns, [(t, *bound) for t, bound in bounds.items()])

    def inside(self, bounds: dict[int, tuple], **extra: pa.DataType) -> DataFrame:
        """Rows inside each entry's bounds; a row may serve several entries."""
        value = F.col(self.value)
        between = (F.col("lo").isNull() | (value >= F.col("lo"))) & (F.col("hi").isNull() | (value <= F.col("hi")))
        return self.rows.join(self.table(bounds, **extra), (self.rows[self.by] == F.col("_by")) & between)

    def sizes(self, bounds: dict[int, tuple]) -> dict[int, Row]:
        found = self.inside(bounds).groupBy("_t").agg(
            F.count(F.lit(1)).alias("n"), F.min(self.value).alias("lo"), F.max(self.value).alias("hi")
        )
        return {r["_t"]: r for r in found.collect()}

    def sketches(self, bounds: dict[int, tuple], shares: list[float]) -> dict[int, list]:
        found = self.inside(bounds).groupBy("_t").agg(
            F.percentile_approx(self.value, shares, SKETCH_ACCURACY).alias("q")
        )
        return {r["_t"]: r["q"] for r in found.collect()}

    def splits(self, guesses: dict[int, tuple]) -> dict[int, Row]:
        """How the rows of each entry lie about its guess ``(g_lo, g_hi)``."""
        value = F.col(self.value)
        found = self.inside(guesses, g_lo=self.kind, g_hi=self.kind).groupBy("_t").agg(
            F.count_if(value < F.col("g_lo")).alias("under"),
            F.count_if(value <= F.col("g_hi")).alias("upto"),
            F.max(F.when(value < F.col("g_lo"), value)).alias("below"),
            F.min(F.when(value > F.col("g_hi"), value)).alias("above"),
            F.count_if(value == F.col("lo")).alias("at_lo"),
            F.count_if(value < F.col("hi")).alias("under_hi"),
            F.min(F.when(value > F.col("lo"), value)).alias("after_lo"),
            F.max(F.when(value < F.col("hi"), value)).alias("before_hi"),
        )
        return {r["_t"]: r for r in found.collect()}

    def at_ranks(self, targets: dict[int, tuple]) -> dict[int, object]:
        """The value at place ``k`` of each entry; meant for entries of few rows."""
        place = F.row_number().over(Window.partitionBy("_t").orderBy(self.value)) - 1
        found = self.inside(targets, k=pa.int64()).withColumn("_at", place).where("_at = k")
        return {r["_t"]: r[self.value] for r in found.select("_t", self.value).collect()}


def order_statistics(
    df: DataFrame, value: str, ranks: dict[object, Sequence[int]], by: str, rank_limit: int = RANK_LIMIT
) -> dict[tuple[object, int], object]:
    """Exact values at 0-based ``ranks`` of each group: ``{(group, rank): value}``.

    No group is ever sorted in one task unless it is small.  A quantile sketch proposes
    a bracket around each rank, exact counts confirm it (or take the side the rank lies
    on), and the step repeats on the bracket until ``rank_limit`` rows are left.  Every
    pass is an aggregate with map-side parts; the driver keeps two bounds per rank.
    """
    brackets = _Brackets(df, by, value)
    wanted = [(group, rank) for group, group_ranks in ranks.items() for rank in dict.fromkeys(group_ranks)]
    pending = {t: (group, rank, None, None) for t, (group, rank) in enumerate(wanted)}
    small: dict[int, tuple] = {}
    found: dict[tuple[object, int], object] = {}
    margin = 2.0 / SKETCH_ACCURACY

    while pending:
        # Ranks that still share their bounds are measured together.
        shared = {bound: b for b, bound in enumerate(dict.fromkeys((g, lo, hi) for g, _, lo, hi in pending.values()))}
        sizes = brackets.sizes({b: bound for bound, b in shared.items()})
        wide = {}
        for t, (group, k, lo, hi) in pending.items():
            size = sizes.get(shared[(group, lo, hi)])
            if size is None or not 0 <= k < size["n"]:
                raise ValueError(f"group {group!r} has no row at rank {wanted[t][1]}")
            if size["lo"] == size["hi"]:
                found[wanted[t]] = size["lo"]
            elif size["n"] <= rank_limit:
                small[t] = (group, size["lo"], size["hi"], k)
            else:
                wide[t] = (group, k, size)
        if not wide:
            break
        edges = {
            t: [min(1.0, max(0.0, k / size["n"] + side * margin)) for side in (-1, 1)]
            for t, (_, k, size) in wide.items()
        }
        shares = sorted({share for pair in edges.values() for share in pair})
        sketches = brackets.sketches(
            {size["_t"]: (group, size["lo"], size["hi"]) for group, _, size in wide.values()}, shares
        )
        guesses = {
            t: (group, size["lo"], size["hi"], *[sketches[size["_t"]][shares.index(share)] for share in edges[t]])
            for t, (group, _, size) in wide.items()
        }
        split = brackets.splits(guesses)
        pending = {}
        for t, (group, k, size) in wide.items():
            _, lo, hi, low, high = guesses[t]
            seen = split[t]
            if k < seen["under"]:
                pending[t] = (group, k, lo, seen["below"])
            elif k >= seen["upto"]:
                pending[t] = (group, k - seen["upto"], seen["above"], hi)
            elif (low, high) != (lo, hi):
                pending[t] = (group, k - seen["under"], low, high)
            # The guess is the bracket itself: most rows sit on its ends, so take those off.
            elif k < seen["at_lo"]:
                found[wanted[t]] = lo
            elif k >= seen["under_hi"]:
                found[wanted[t]] = hi
            else:
                pending[t] = (group, k - seen["at_lo"], seen["after_lo"], seen["before_hi"])
    if small:
        found.update({wanted[t]: at for t, at in brackets.at_ranks(small).items()})
    return found


def exact_percentiles(
    df: DataFrame, value: str, shares: Sequence[float], by: str, rank_limit: int = RANK_LIMIT
) -> dict[object, list[float]]:
    """Linearly interpolated percentiles of each group; NaN where the group holds a NaN."""
    present = df.select(by, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & F.col(by).isNotNull()
    )
    sizes = present.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max(F.isnan("_v")).alias("broken")).collect()
    result: dict[object, list[float]] = {r[by]: [math.nan] * len(shares) for r in sizes if r["broken"]}
    places = {r[by]: [share * (r["n"] - 1) for share in shares] for r in sizes if not r["broken"]}
    ranks = {
        group: sorted({edge for at in group_places for edge in (math.floor(at), math.ceil(at))})
        for group, group_places in places.items()
    }
    values = order_statistics(present, "_v", ranks, by, rank_limit)
    for group, group_places in places.items():
        result[group] = []
        for at in group_places:
            low, high = values[(group, math.floor(at))], values[(group, math.ceil(at))]
            result[group].append(low + (high - low) * (at - math.floor(at)))
    return result


def representative_rows(
    df: DataFrame, group: str = "Label", seq: str = "seq", rank_limit: int = RANK_LIMIT
) -> DataFrame:
    """The row a third into each group in ``seq`` order; a group without rows gives none.

    Finds the ``seq`` of that row first, so no group is gathered or sorted as a whole.  Among rows of
    one group with that ``seq`` the least by its other columns is taken.
    """
    if not isinstance(df.schema[seq].dataType, T.NumericType):
        raise ValueError(f"{seq!r} must be a number to rank by")
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(seq).alias("n")).collect()
    ranks = {r[group]: [r["n"] // 3] for r in sizes if r["n"] > 0}
    picks = order_statistics(df, seq, ranks, group, rank_limit)
    if len(picks) > LITERAL_PICKS:
        kinds = [to_arrow_type(df.schema[name].dataType) for name in (group, seq)]
        chosen = local_table(
            df.sparkSession, dict(zip(("_group", "_seq"), kinds)), [(value, at) for (value, _), at in picks.items()]
        )
        found = df.join(chosen, (df[group] == chosen["_group"]) & (df[seq] == chosen["_seq"]), "left_semi")
    else:
        condition = F.lit(False)
        for (value, _), at in picks.items():
            condition = condition | ((F.col(group) == F.lit(value)) & (F.col(seq) == F.lit(at)))
        found = df.where(condition)
    one = found.groupBy(group).agg(F.min(F.struct(*df.columns)).alias("_row"))
    return one.select("_row.*")
