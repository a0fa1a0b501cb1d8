"""Telemetry sources: CSV with a declared schema, file roles, ordered ingestion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perigee import fixed_values as fv
from perigee.operators.order import with_dense_index


def telemetry_schema(
    features: Sequence[str] = tuple(fv.FEATURES), extra: Sequence[str] = (), with_seq: bool = False
) -> T.StructType:
    fields = [T.StructField("seq", T.LongType())] if with_seq else []
    fields += [T.StructField(name, T.DoubleType()) for name in [*features, *extra]]
    return T.StructType([*fields, T.StructField("Label", T.IntegerType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header.

    Pass a schema at scale: one pass, pruned columns, and a file whose header differs
    fails instead of shifting columns.  Without one Spark infers it in a second pass.
    A label may be written ``3`` or ``3.0``; text that is no number becomes NULL, which
    ``contract_split`` sets apart.
    """
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    as_read = T.StructType([
        T.StructField(f.name, T.DoubleType()) if f.name == "Label" else f for f in schema.fields
    ])
    rows = reader.schema(as_read).option("enforceSchema", False).csv(path)
    if "Label" in schema.names:
        rows = rows.withColumn("Label", F.col("Label").cast(schema["Label"].dataType))
    return rows


CORRUPT = "_corrupt_record"
REASON = "malformed_reason"


def check_lines(lines: DataFrame, schema: T.StructType, separator: str = ",") -> DataFrame:
    """CSV lines (column ``value``) parsed by a declared schema; one that does not fit keeps its raw text and a reason.

    ``good_rows`` and ``malformed_rows`` split the result; every line but headers and empty ones is in one of them.  A header is a line
    that names the columns of the schema in their order, so any other header comes out as malformed.  Fields do not span lines.
    """
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.fields)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "sep": separator}
    rows = lines.where((F.col("value") != separator.join(schema.names)) & (F.trim("value") != ""))
    parsed = rows.select(F.from_csv("value", ddl, options).alias("row")).select("row.*")
    fields = F.size(F.split(F.col(CORRUPT), f"\\Q{separator}\\E"))
    reason = F.when(fields != len(schema), F.format_string("%d fields instead of %d", fields, F.lit(len(schema)))).otherwise(
        F.lit("a field is not of its type")
    )
    return parsed.withColumn(REASON, F.when(F.col(CORRUPT).isNotNull(), reason))


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",") -> DataFrame:
    """The lines of CSV files under ``check_lines``."""
    return check_lines(spark.read.text(path), schema, separator)


def stream_csv_checked(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",", files_per_batch: int = 100) -> DataFrame:
    """The same for files that arrive in a folder."""
    return check_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path), schema, separator)


def good_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.col(REASON).isNull()).drop(CORRUPT, REASON)


def malformed_rows(checked: DataFrame) -> DataFrame:
    """(raw_line, malformed_reason) of the lines for the quarantine."""
    return checked.where(F.col(REASON).isNotNull()).select(F.col(CORRUPT).alias("raw_line"), REASON)


def file_role(name: Column | str) -> Column:
    """``raw``, ``noised`` or NULL, by the file's name."""
    name = F.lower(F.col(name) if isinstance(name, str) else name)
    return (
        F.when(name.contains("consolidated") | name.contains("raw"), F.lit("raw"))
        .when(name.contains("noised"), F.lit("noised"))
    )


def discover(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """Latest file of each role below ``root``: ``(role, path)``.

    The role is in the name of the file, or in that of its folder, as for data sets written in parts:
    then the path is the folder.  The file index lists the tree; contents are never read.  The last match in
    path order wins, which makes the choice reproducible.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .withColumn("_own", file_role(F.element_at(F.split("path", "/"), -1)))
        .select(
            F.when(F.col("_own").isNotNull(), F.col("path")).otherwise(F.regexp_replace("path", "/[^/]*$", "")).alias("path"),
            F.coalesce("_own", file_role(F.element_at(F.split("path", "/"), -2))).alias("role"),
        )
    )
    return files.where(F.col("role").isNotNull()).groupBy("role").agg(F.max("path").alias("path"))


def read_ordered_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV rows with ``seq``, their position over files in path order; part files in order of their numbers.

    A scan cuts files into byte ranges and numbers rows inside a range, so path, range
    start and that number together give the order of the lines.
    """
    rows = read_csv(spark, path, schema)
    located = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    folder, name = F.regexp_extract("_file", "^(.*/)", 1), F.regexp_extract("_file", "([^/]*)$", 1)
    number = F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("decimal(38,0)"), F.lit(0))
    lettered = located.withColumns({"_folder": folder, "_stem": F.regexp_extract(name, r"^(\D*)", 1), "_number": number})
    placed = with_dense_index(lettered, ["_folder", "_stem", "_number", "_file", "_start", "_at"], "seq")
    return placed.select("seq", *rows.columns)
