"""The latest rows of each key of a stream, in keyed state with a time to live.

Each key (a satellite, an ApId) holds its newest ``size`` rows as a list state.  A batch sends on the whole buffer of the keys
it touched, with a number that grows per key; ``newest`` keeps the last of them.  Work and traffic follow the keys of a batch and never
the number of keys that were ever seen; a key that stays silent for ``ttl`` is forgotten.

The rows that a batch brings for one key meet one state in one task, which takes them part by part and holds ``size`` rows and one Arrow
batch.  A table that is fed in at once can be cut beforehand to the newest ``size`` rows of each key (``cut_batch``), several tasks to
a hot key: what that drops could never stay.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.window import Window

from perigee.session import ship_package

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(value):
    """A value of a pandas cell as the state store takes it."""
    if value is None or value is pd.NaT or value != value:
        return None
    return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value


class LatestRows(StatefulProcessor):
    """Keeps the ``size`` rows with the greatest ``seq`` of each key; rows with the same ``seq`` count once."""

    def __init__(self, key: str, seq: str, columns: Sequence[str], schema: T.StructType, size: int, ttl_ms: int | None):
        self.key, self.seq, self.columns, self.schema, self.size, self.ttl_ms = key, seq, list(columns), schema, size, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.schema, self.ttl_ms)
        self.version = handle.getValueState("version", T.StructType([T.StructField("n", T.LongType())]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        kept = {row[self.columns.index(self.seq)]: row for row in self.rows.get()}
        for part in rows:
            # Part by part, so a task holds ``size`` rows and one Arrow batch.
            cells = part[self.columns].astype(object).itertuples(index=False, name=None)
            kept |= {row[self.columns.index(self.seq)]: row for row in (tuple(map(_plain, cell)) for cell in cells)}
            kept = {seq: kept[seq] for seq in sorted(kept, reverse=True)[: self.size]}
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        self.rows.put([tuple(row) for row in kept.values()])
        out = pd.DataFrame([tuple(row) for row in kept.values()], columns=self.columns)
        out.insert(0, self.key, key[0])
        out.insert(1, "version", version)
        yield out

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _rocksdb(spark: SparkSession):
    """The state store that list states need, for a query that starts inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def latest_by_key(
    stream: DataFrame, key: str, columns: Sequence[str], size: int, seq: str = "seq", ttl_ms: int | None = None
) -> DataFrame:
    """(key, version, *columns): the buffer of each key that a batch touched.  Rows without key or ``seq`` have no place in it."""
    ship_package(stream.sparkSession)
    rows = stream.where(F.col(key).isNotNull() & F.col(seq).isNotNull()).select(key, *columns)
    held = T.StructType([rows.schema[name] for name in columns])
    out = T.StructType([rows.schema[key], T.StructField("version", T.LongType()), *held.fields])
    return rows.groupBy(key).transformWithStateInPandas(
        LatestRows(key, seq, columns, held, size, ttl_ms), outputStructType=out, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None"
    )


def cut_batch(rows: DataFrame, key: str, size: int, seq: str = "seq") -> DataFrame:
    """The newest ``size`` rows of each key of a batch: ranked in each of several slices of a key first, so a hot key is no single task."""
    slices = Window.partitionBy(key, F.pmod(F.xxhash64(seq), F.lit(64))).orderBy(F.desc(seq))
    whole = Window.partitionBy(key).orderBy(F.desc(seq))
    first = rows.withColumn("_place", F.row_number().over(slices)).where(F.col("_place") <= size)
    return first.withColumn("_place", F.row_number().over(whole)).where(F.col("_place") <= size).drop("_place")


def start_latest(
    stream: DataFrame, key: str, columns: Sequence[str], size: int, path: str, checkpoint: str, seq: str = "seq",
    ttl_ms: int | None = None, once: bool = True, interval: str = "10 seconds",
) -> StreamingQuery:
    """Writes the buffers that each batch changed to a folder of its own, which a repeated batch overwrites.

    With a time to live ``once`` works off what is there in a single batch: state that watches the clock always asks for one batch more.
    """
    buffers = latest_by_key(stream, key, columns, size, seq, ttl_ms)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with _rocksdb(stream.sparkSession):
        writer = buffers.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint)
        if once:
            writer = writer.trigger(once=True) if ttl_ms else writer.trigger(availableNow=True)
        else:
            writer = writer.trigger(processingTime=interval)
        return writer.start()


def newest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The buffers as the last batches left them: rows of the greatest version of each key."""
    written = spark.read.parquet(path).drop("batch")
    last = written.groupBy(key).agg(F.max("version").alias("version"))
    return written.join(last, [key, "version"], "left_semi").drop("version")
