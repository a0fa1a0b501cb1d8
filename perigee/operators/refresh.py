"""Keyed tables that are refreshed rather than rewritten: knowledge base, stored results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee import fixed_values as fv
from perigee.session import materialize, pointers, write_pointer

KEY_BUCKETS = 64


def last_write(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one written last.  Map-side merging copes with a hot key."""
    rest = [name for name in df.columns if name != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("w")).select(key, "w.*")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key.

    With ``order`` the last write of each key counts; without it a key written twice is refused.
    """
    if order is not None:
        new = last_write(new, key, order).drop(order)
    elif not new.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"several rows with one {key!r}: name the column that orders them")
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def _failed(status: str) -> Column:
    return F.col(status).eqNullSafe(fv.STATUS_ERROR)


def to_recompute(
    wanted: DataFrame, done: DataFrame, keys: Sequence[str] = ("class_name",), status: str = "status"
) -> DataFrame:
    """Wanted keys without a good stored result: missing ones and those that ended in ERROR."""
    return wanted.join(done.where(~_failed(status)).select(*keys), list(keys), "left_anti")


def refresh_results(
    wanted: DataFrame,
    done: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    keys: Sequence[str] = ("class_name",),
    status: str = "status",
) -> DataFrame:
    """Stored results with every wanted key that is missing or failed computed again."""
    fresh = compute(to_recompute(wanted, done, keys, status))
    unwanted = done.where(_failed(status)).join(wanted.select(*keys), list(keys), "left_anti")
    return (
        done.where(~_failed(status))
        .unionByName(unwanted)
        .unionByName(fresh, allowMissingColumns=True)
    )


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def save_by_key(fresh: DataFrame, path: str, keys: Sequence[str] = ("class_name",), buckets: int = KEY_BUCKETS) -> None:
    """Replaces the rows of the keys at hand; rows of other keys stay as they are.

    Keys share a fixed number of folders, so many keys are not as many folders.  Only the folders that
    a fresh key falls into are read and written again, each from a copy written beforehand.
    """
    spark = fresh.sparkSession
    fresh = fresh.withColumn("_bucket", _bucket(keys, buckets))
    touched = fresh.select("_bucket").distinct()
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        kept = stored.join(touched, "_bucket", "left_semi").join(fresh.select(*keys), list(keys), "left_anti")
        fresh = fresh.unionByName(kept, allowMissingColumns=True)
    (
        materialize(fresh, "by-key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("_bucket").parquet(path)
    )


def load_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).drop("_bucket")


def save_version(df: DataFrame, root: str, version: int) -> None:
    """A whole new version beside the old ones, then a pointer to it: readers never meet a half-written table."""
    df.write.mode("overwrite").parquet(f"{root}/version={version}")
    write_pointer(df.sparkSession, root, version)


def load_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The given version, or the greatest one that is complete, an empty table included."""
    if version is None:
        version = max(pointers(spark, root), default=None)
        if version is None:
            raise ValueError(f"nothing complete below {root} yet")
    return spark.read.parquet(f"{root}/version={version}")
