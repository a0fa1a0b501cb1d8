"""Streaming plans: source, triage, counters and live views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from perigee import fixed_values as fv
from perigee.operators.gate import Stats, gate
from perigee.operators.order import last_rows, metric_history
from perigee.operators.profile import label_mix
from perigee.session import pointers, remove_folder, write_pointer


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None, files_per_batch: int = 100
) -> DataFrame:
    """Files of a folder as they arrive; the checkpoint of a query records which were read."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def write_stream(
    rows: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = True, interval: str = "10 seconds",
    **options: str,
) -> StreamingQuery:
    """Appends rows to files, each input row once: the file sink commits whole batches.

    ``once`` works off what is there in ordered batches and stops; otherwise the query
    keeps running.
    """
    writer = rows.writeStream.format(fmt).options(**options).option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.outputMode("append").start()


def _each_batch(rows: DataFrame, handle, checkpoint: str, mode: str, once: bool, interval: str) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


class Versions:
    """Tables written as whole versions, with a pointer that names the last complete one.

    A version is the number of a batch.  The pointer is written after all tables of its version, so a reader
    always finds whole tables, also while the next version is written or after a crash.  A batch that is
    run again overwrites its own version.  Only the last ``kept`` versions stay.
    """

    def __init__(self, path: str, kept: int = 2) -> None:
        self.path, self.kept = path, kept

    def folder(self, table: str, version: int) -> str:
        return f"{self.path}/{table}/version={version}"

    def last(self, spark: SparkSession, before: int | None = None) -> int | None:
        """The last complete version, or the last one before the given number."""
        return max((v for v in self._pointers(spark) if before is None or v < before), default=None)

    def _pointers(self, spark: SparkSession) -> list[int]:
        return pointers(spark, self.path)

    def save(self, tables: dict[str, DataFrame], version: int) -> None:
        spark = next(iter(tables.values())).sparkSession
        for name, rows in tables.items():
            rows.coalesce(1).write.mode("overwrite").parquet(self.folder(name, version))
        write_pointer(spark, self.path, version)
        for old in [v for v in self._pointers(spark) if v <= version - self.kept]:
            remove_folder(spark, f"{self.path}/done/{old}")
            for name in tables:
                remove_folder(spark, self.folder(name, old))

    def read(self, spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
        version = self.last(spark) if version is None else version
        if version is None:
            raise ValueError(f"nothing complete below {self.path} yet")
        return spark.read.parquet(self.folder(table, version))


def start_counters(
    stream: DataFrame, stats: Stats, features: Sequence[str], path: str, checkpoint: str,
    z_threshold: float = fv.Z_THRESHOLD, min_features: int = fv.MIN_FEATURES,
    once: bool = True, interval: str = "10 seconds",
) -> StreamingQuery:
    """Running totals of rows seen and escalated, as the one-row table ``counters`` of ``Versions(path)``.

    Each task counts its rows first; the state is a single row however long the stream.
    """
    totals = gate(stream, stats, features, z_threshold, min_features).agg(
        F.count(F.lit(1)).alias("seen"),
        F.coalesce(F.sum(F.col("escalate").cast("long")), F.lit(0)).alias("escalated"),
    )
    versions = Versions(path)

    def save(batch: DataFrame, batch_id: int) -> None:
        versions.save({"counters": batch}, batch_id)

    return _each_batch(totals, save, checkpoint, "complete", once, interval)


class LiveView:
    """Latest rows of a stream, with the label mix and metric history they give.

    Every batch merges the last complete version before it with its own rows and writes a version of its
    own (see ``Versions``), so a batch that is run again after a failure changes nothing.
    """

    def __init__(
        self, path: str, schema: T.StructType, buffer_rows: int = fv.BUFFER_ROWS,
        metrics: Sequence[str] = tuple(fv.CHART_METRICS), history_points: int = fv.HISTORY_POINTS,
        seq: str = "seq", label: str = "Label",
    ) -> None:
        self.versions, self.schema, self.seq, self.label = Versions(path), schema, seq, label
        self.buffer_rows, self.history_points = buffer_rows, history_points
        self.metrics = [name for name in metrics if name in schema.names]

    def update(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # One reading of the source serves the buffer and the history.
        rows = batch.select(*self.schema.names).persist()
        points = rows.select(self.seq, *self.metrics)
        newest = rows
        before = self.versions.last(spark, batch_id)
        if before is not None:
            newest = spark.read.schema(rows.schema).parquet(self.versions.folder("buffer", before)).unionByName(rows)
            points = spark.read.schema(points.schema).parquet(self.versions.folder("history", before)).unionByName(points)
        buffer = last_rows(newest, self.buffer_rows, self.seq).persist()
        history = metric_history(points, self.metrics, self.seq, self.history_points)
        self.versions.save({"buffer": buffer, "history": history, "label_mix": label_mix(buffer, self.label)}, batch_id)
        buffer.unpersist()
        rows.unpersist()

    def start(
        self, stream: DataFrame, checkpoint: str, once: bool = True, interval: str = "10 seconds"
    ) -> StreamingQuery:
        return _each_batch(stream, self.update, checkpoint, "append", once, interval)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """A table as the last complete batch left it."""
        return self.versions.read(spark, table)
