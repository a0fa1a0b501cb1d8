"""Dimension tables built from the fixed values.

They are created from Arrow tables, so Spark plans them as local relations whose
exact size it knows: joins to them become broadcast joins by Catalyst's own size
check, and a larger user-supplied table falls back to a shuffled join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from perigee import fixed_values as fv

BAND_COLUMNS = ["class_name", "lo", "hi", "action", "tool_function", "guardrail_note"]


def local_table(spark: SparkSession, columns: dict[str, pa.DataType], rows: list[tuple]) -> DataFrame:
    arrays = [pa.array([row[i] for row in rows], type=kind) for i, kind in enumerate(columns.values())]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))


def classes(spark: SparkSession) -> DataFrame:
    return local_table(
        spark, {"label": pa.int32(), "class_name": pa.string()}, list(enumerate(fv.CLASS_NAMES))
    )


def nominal_baseline(spark: SparkSession) -> DataFrame:
    return local_table(
        spark,
        {"feature": pa.string(), "mean": pa.float64(), "std": pa.float64()},
        [(name, mean, std) for name, (mean, std) in fv.NOMINAL_BASELINE.items()],
    )


def band_rows(policy: list[tuple] | None = None) -> list[tuple]:
    """Half-open bands ``[lo, hi)`` per class.

    Every class also gets one band below its lowest bound (``lo`` NULL), so a row of
    a known class meets exactly one band and a row of an unknown class meets none.
    """
    policy = fv.POLICY if policy is None else policy
    rows = []
    for name in dict.fromkeys(entry[0] for entry in policy):
        bounds = sorted((entry for entry in policy if entry[0] == name), key=lambda entry: entry[1])
        rows.append((name, None, bounds[0][1], None, None, None))
        uppers = [entry[1] for entry in bounds[1:]] + [None]
        rows += [(name, e[1], hi, e[2], e[3], e[4]) for e, hi in zip(bounds, uppers)]
    return rows


def policy_bands(spark: SparkSession) -> DataFrame:
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.string()]
    return local_table(spark, dict(zip(BAND_COLUMNS, kinds)), band_rows())


def bands_from_policy(policy: DataFrame) -> DataFrame:
    """The same bands from a policy table ``(class_name, lo, action, tool_function, guardrail_note)``."""
    order = Window.partitionBy("class_name").orderBy("lo")
    reached = policy.withColumn("hi", F.lead("lo").over(order)).select(*BAND_COLUMNS)
    below = policy.groupBy("class_name").agg(F.min("lo").alias("hi"))
    return reached.unionByName(below, allowMissingColumns=True)


KNOWLEDGE_COLUMNS = {
    "id": pa.string(), "type": pa.string(), "class_id": pa.string(), "class_name": pa.string(),
    "tactic_id": pa.string(), "tactic_name": pa.string(), "technique_id": pa.string(),
    "technique_name": pa.string(), "year": pa.string(), "name": pa.string(), "text": pa.string(),
    "embedding": pa.list_(pa.float64()),
}


def knowledge(spark: SparkSession) -> DataFrame:
    """Class mappings and incidents with a one-line text of our own.

    Longer texts and embeddings (NULL here) are the user's data: upsert them by ``id``.
    """
    rows = [
        (doc_id, "class_mapping", class_id, name, tactic, tactic_name, technique, technique_name, None, None,
         f"{name}: tactic {tactic} ({tactic_name}), technique {technique} ({technique_name}).", None)
        for doc_id, class_id, name, tactic, tactic_name, technique, technique_name in fv.CLASS_MAPPINGS
    ] + [
        (doc_id, "incident", None, None, tactic, None, None, None, year, name, f"{name} ({year}): tactic {tactic}.", None)
        for doc_id, year, name, tactic in fv.INCIDENTS
    ]
    return local_table(spark, KNOWLEDGE_COLUMNS, rows)
