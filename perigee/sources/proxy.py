"""Telemetry-shaped views of the given tables.

``telemetry`` maps ``events`` onto a few telemetry features, a label, a prediction
and a confidence; every column comes from the table, row for row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee import fixed_values as fv

FEATURES = ["MsgId", "CmdCode", "TimeRadians", "MsgLength"]
EVENT_LABELS = {"view": 0, "click": 1, "purchase": 2, "signup": 3, "error": 4}
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# As many columns as the telemetry has, made of order lines; SQL that any engine reads.
WIDE = [
    "CAST(l_quantity AS DOUBLE)", "CAST(l_extendedprice AS DOUBLE)", "CAST(l_discount AS DOUBLE)", "CAST(l_tax AS DOUBLE)",
    "CAST(l_linenumber AS DOUBLE)", "CAST(l_orderkey AS DOUBLE)", "CAST(l_partkey AS DOUBLE)", "CAST(l_suppkey AS DOUBLE)",
    "CAST(year(l_shipdate) AS DOUBLE)", "CAST(month(l_shipdate) AS DOUBLE)", "CAST(day(l_shipdate) AS DOUBLE)",
    "l_quantity * l_discount", "l_extendedprice * l_discount", "l_extendedprice * l_tax", "l_quantity * l_tax",
    "l_extendedprice / l_quantity", "CAST(l_orderkey % 97 AS DOUBLE)", "CAST(l_partkey % 89 AS DOUBLE)",
    "CAST(l_suppkey % 83 AS DOUBLE)", "l_extendedprice * (1 - l_discount)", "l_extendedprice * (1 - l_discount) * (1 + l_tax)",
    "l_quantity * l_quantity",
]
WIDE_LABEL = "CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END"


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines under the names of all telemetry features, with a label."""
    named = [f"{sql} AS {name}" for sql, name in zip(WIDE, fv.FEATURES, strict=True)]
    return read(spark, sf_dir, "lineitem").selectExpr(*named, f"{WIDE_LABEL} AS Label")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def as_telemetry(events: DataFrame) -> DataFrame:
    """Works on a batch and on a stream of ``events`` rows alike."""
    # Parsed in a step of its own, so the three columns made of it share one parse.
    events = events.withColumn("_k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("_k")
    label = F.lit(None).cast("int")
    for name, value in EVENT_LABELS.items():
        label = F.when(F.col("event_type") == name, F.lit(value)).otherwise(label)
    # Clock fields of the wall-clock time: the same in every session time zone.
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.date_part(F.lit("SECOND"), "ts")
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("double").alias("MsgId"),
        k.cast("double").alias("CmdCode"),
        (F.lit(2 * math.pi) * seconds.cast("double") / F.lit(86400.0)).alias("TimeRadians"),
        F.col("value").alias("MsgLength"),
        label.alias("Label"),
        (k % 5).alias("pred"),
        (k / F.lit(100.0)).alias("confidence"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_telemetry(read(spark, sf_dir, "events"))


def splits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(raw, noised)``: all rows, and the same rows with a reproducible disturbance.

    Raw carries one column the noised split lacks, as the real files do.
    """
    raw = rows.select("seq", *FEATURES, (F.col("CmdCode") % 7).alias("CommandErrorCounter"), "Label")
    wobble = F.sin(F.col("seq").cast("double"))
    noised = raw.select(
        "seq",
        "MsgId",
        (F.col("CmdCode") + 3.0 * wobble).alias("CmdCode"),
        "TimeRadians",
        (F.col("MsgLength") + 10.0 * wobble).alias("MsgLength"),
        "Label",
    )
    return raw, noised
