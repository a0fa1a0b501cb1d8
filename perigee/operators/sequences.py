"""Sliding windows over globally ordered rows, cut into buckets that run in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from perigee import fixed_values as fv

BUCKET_ROWS = 4096


def require_dense(df: DataFrame, idx: str) -> None:
    """Fails unless ``idx`` runs from 0 to the number of rows less one."""
    seen = df.agg(F.min(idx).alias("first"), F.max(idx).alias("last"), F.count(F.lit(1)).alias("rows")).first()
    if seen["rows"] and (seen["first"], seen["last"]) != (0, seen["rows"] - 1):
        raise ValueError(f"{idx} is not dense from 0; see with_dense_index")


def _bucketed(df: DataFrame, idx: str, length: int, bucket_rows: int) -> DataFrame:
    """Each row in its bucket, and the last ``length`` rows of a bucket in the next one too.

    ``idx`` is dense, so a bucket holds at most ``bucket_rows + length`` rows whatever
    the data: nothing is skewed and no task sees the whole order.
    """
    if bucket_rows < length:
        raise ValueError("a bucket must hold at least one sequence")
    home = F.floor(F.col(idx) / F.lit(bucket_rows)).cast("long")
    in_tail = F.pmod(F.col(idx), F.lit(bucket_rows)) >= bucket_rows - length
    return df.withColumn("_home", home).withColumn(
        "_bucket", F.explode(F.when(in_tail, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home")))
    )


def _frame(idx: str, first: int, last: int) -> WindowSpec:
    return Window.partitionBy("_bucket").orderBy(idx).rowsBetween(first, last)


def _steps(features: Sequence[str]):
    return F.array(*[F.col(name).cast("double") for name in features])


def labelled_sequences(
    df: DataFrame,
    features: Sequence[str],
    idx: str = "seq",
    label: str = "Label",
    length: int = fv.SEQUENCE_LENGTH,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``(idx, label, steps)``: the ``length`` rows before each row, with that row's label.

    ``idx`` must be dense from 0 (see ``with_dense_index``); N rows give N - length.
    """
    frame = _frame(idx, -length, -1)
    rows = _bucketed(df.select(idx, label, _steps(features).alias("_step")), idx, length, bucket_rows)
    return (
        rows.withColumn("steps", F.collect_list("_step").over(frame))
        .where((F.col("_bucket") == F.col("_home")) & (F.size("steps") == length))
        .select(idx, label, "steps")
    )


def sequences(
    df: DataFrame,
    features: Sequence[str],
    idx: str = "seq",
    length: int = fv.SEQUENCE_LENGTH,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``(idx, steps)``: each row with the ``length - 1`` rows before it; N - length + 1 rows."""
    frame = _frame(idx, -(length - 1), 0)
    rows = _bucketed(df.select(idx, _steps(features).alias("_step")), idx, length, bucket_rows)
    return (
        rows.withColumn("steps", F.collect_list("_step").over(frame))
        .where((F.col("_bucket") == F.col("_home")) & (F.size("steps") == length))
        .select(idx, "steps")
    )


def straddling(
    df: DataFrame,
    idx: str = "seq",
    label: str = "Label",
    carry: Sequence[str] = (),
    length: int = fv.SEQUENCE_LENGTH,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``(idx, label, *carry, straddles)``: whether the ``length`` rows before mix labels.

    Least and greatest label of the frame decide; no sequence is built.
    """
    frame = _frame(idx, -length, -1)
    rows = _bucketed(df.select(idx, label, *carry), idx, length, bucket_rows)
    return (
        rows.withColumn("_n", F.count(F.lit(1)).over(frame))
        .withColumn("straddles", F.min(label).over(frame) != F.max(label).over(frame))
        .where((F.col("_bucket") == F.col("_home")) & (F.col("_n") == length))
        .select(idx, label, *carry, "straddles")
    )
