"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
ARROW_ROWS, SPARK_ARROW_ROWS, TEXT_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"
# Scratch folders by application, until they are cleaned up.
_HANDED_OUT: dict[str, list[str]] = {}


def build_session(app_name: str = "perigee", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application.

    Functions of the package are pickled by name, so a worker must be able to import it wherever
    the driver was started from.
    """
    context = spark.sparkContext
    if getattr(context, "_perigee_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="perigee-"), "perigee.zip")
    with zipfile.ZipFile(path, "w") as packed:
        for folder, _, files in os.walk(top):
            for name in sorted(files):
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    packed.write(whole, os.path.relpath(whole, os.path.dirname(top)))
    context.addPyFile(path)
    context._perigee_shipped = True


def prepare(spark: SparkSession) -> None:
    """Ships the package, and bounds the rows of an Arrow batch unless the session has its own bound.

    Spark's default of 10,000 rows is meant for narrow rows; of whole texts that many fill a worker.
    """
    ship_package(spark)
    if spark.conf.get(ARROW_ROWS) == SPARK_ARROW_ROWS:
        spark.conf.set(ARROW_ROWS, TEXT_ARROW_ROWS)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of its own: on a cluster a
    machine-local path would be invisible to the other executors.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="perigee-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; ``cleanup`` removes what was handed out."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _HANDED_OUT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cleanup(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes scratch folders: the given ones, or all that this application was handed.

    Call it when the results built on them have been consumed.
    """
    known = _HANDED_OUT.setdefault(spark.sparkContext.applicationId, [])
    for path in list(known if paths is None else paths):
        remove_folder(spark, path)
        if path in known:
            known.remove(path)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was written to the scratch folder inside."""
    known = _HANDED_OUT.setdefault(spark.sparkContext.applicationId, [])
    before = set(known)
    try:
        yield
    finally:
        cleanup(spark, [path for path in known if path not in before])


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def pointers(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the complete versions below ``root``."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/done")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    return [int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit()]


def write_pointer(spark: SparkSession, root: str, version: int) -> None:
    """Marks a version as complete; the folder of pointers holds empty files named by version."""
    pointer = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/done/{version}")
    pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(pointer, True).close()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a re-read of files, never a re-run of the plan above,
    and values that depend on physical partitioning are frozen by the commit.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fixed_partitions(df: DataFrame, partitions: int, *order: str) -> DataFrame:
    """Rows dealt by the hash of ``order`` into a fixed number of partitions and sorted inside.

    Seeded algorithms that draw per partition then give one result on any cluster.
    """
    return df.repartition(partitions, *order).sortWithinPartitions(*order)


def pieces_of(df: DataFrame, least: int, rows_each: int) -> int:
    """``least`` pieces, and more where a piece would get more than ``rows_each`` rows: counted, so the same rows give the same number."""
    return max(least, -(-df.count() // rows_each))
