"""Dataset audits: mix, ranges, shape, correlation, diversity."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from perigee import fixed_values as fv
from perigee.functions.numeric import present
from perigee.operators.order import exact_percentiles
from perigee.sources.dims import local_table

PAIRS_PER_PASS = 8
SMALL_SHARE = 1e-6


def label_mix(df: DataFrame, label: str = "Label") -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label)


def range_audit(
    df: DataFrame, column: str = "TimeRadians", expected: tuple[float, float] = fv.TIME_RADIANS_RANGE
) -> DataFrame:
    low, high = expected
    value = present(column)
    return df.agg(
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.count_if((value < low) | (value > high)).alias("out_of_range"),
    )


def dataset_profile(df: DataFrame, label: str = "Label") -> DataFrame:
    """Rows, columns and classes.  Counting per label first keeps the distinct count tiny."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.count(label).alias("classes"),
    )


def _moments(means: list[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: for each pair of columns, sums over the rows where both have a value."""
    centre = np.array(means)[:, None]
    upper = np.triu_indices(len(means), 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.stack([column.to_numpy(zero_copy_only=False) for column in batch.columns]) - centre
            there = ~np.isnan(x)
            x[~there] = 0.0
            mask = there.astype(np.float64)
            with np.errstate(invalid="ignore", over="ignore"):
                part = np.stack([mask @ mask.T, x @ mask.T, (x * x) @ mask.T, x @ x.T])
                total = part if total is None else total + part
        if total is not None:
            n, one, square, product = total
            columns = [n, one, one.T, square, square.T, product]
            yield pa.RecordBatch.from_arrays(
                [pa.array(upper[0]), pa.array(upper[1]), *[pa.array(c[upper]) for c in columns]],
                names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"],
            )

    return sums


def _own_means(df: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple]:
    """(f1, f2, r) with the means of each pair's own rows: slow per pair, exact on any data."""
    found = []
    for chunk in [pairs[i:i + PAIRS_PER_PASS] for i in range(0, len(pairs), PAIRS_PER_PASS)]:
        aggregates = []
        for i, (left, right) in enumerate(chunk):
            x, y = present(F.col(left).cast("double")), present(F.col(right).cast("double"))
            spread = F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x))
            aggregates.append((F.regr_sxy(y, x) / F.nullif(spread, F.lit(0.0))).alias(f"r{i}"))
        row = df.agg(*aggregates).first()
        found += [(*pair, row[f"r{i}"]) for i, pair in enumerate(chunk)]
    return found


def correlation(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation, ``(f1, f2, r)`` for each unordered pair.

    One pass finds the means, a second one the sums of products about them: a matrix
    product per Arrow batch, so tasks send on one row per pair.  Where a pair's own rows
    hardly vary about their own mean, or a value is infinite, those sums say too little
    and the pair is computed apart.  A constant column gives NULL.
    """
    features = list(features)
    facts = df.agg(*[
        F.struct(
            F.min(present(F.col(name).cast("double"))).alias("low"),
            F.max(present(F.col(name).cast("double"))).alias("high"),
            F.avg(present(F.col(name).cast("double"))).alias("mean"),
        ).alias(f"f{i}")
        for i, name in enumerate(features)
    ]).first()
    flat = {i for i in range(len(features)) if facts[f"f{i}"]["low"] == facts[f"f{i}"]["high"]}
    means = [facts[f"f{i}"]["mean"] or 0.0 for i in range(len(features))]
    numbers = df.select(*[F.col(name).cast("double").alias(name) for name in features])
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    parts = numbers.mapInArrow(
        _moments(means), "i long, j long, " + ", ".join(f"{name} double" for name in names)
    )
    sums = {(r["i"], r["j"]): r for r in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]).collect()}
    rows, apart = [], []
    for i, j in combinations(range(len(features)), 2):
        s = sums.get((i, j))
        if i in flat or j in flat or s is None or s["n"] == 0:
            rows.append((features[i], features[j], None))
            continue
        var_x, var_y = s["sxx"] - s["sx"] ** 2 / s["n"], s["syy"] - s["sy"] ** 2 / s["n"]
        if var_x > SMALL_SHARE * s["sxx"] and var_y > SMALL_SHARE * s["syy"] and math.isfinite(s["sxy"]):
            covered = s["sxy"] - s["sx"] * s["sy"] / s["n"]
            rows.append((features[i], features[j], covered / (math.sqrt(var_x) * math.sqrt(var_y))))
        else:
            apart.append((features[i], features[j]))
    rows += _own_means(df, apart)
    return local_table(df.sparkSession, {"f1": pa.string(), "f2": pa.string(), "r": pa.float64()}, rows)


def correlation_matrix(pairs: DataFrame) -> DataFrame:
    """The full matrix in long form: both directions and the diagonal, from one reading of the pairs.

    A feature correlates fully with itself unless it is constant, when all its r are NULL.
    """
    whole = F.when(F.col("r").isNotNull(), F.lit(1.0))
    cells = pairs.select(F.inline(F.array(*[
        F.struct(F.col(x).alias("f1"), F.col(y).alias("f2"), value.alias("r"))
        for x, y, value in [
            ("f1", "f2", F.col("r")), ("f2", "f1", F.col("r")), ("f1", "f1", whole), ("f2", "f2", whole),
        ]
    ])))
    return cells.groupBy("f1", "f2").agg(F.max("r").alias("r"))


def class_diversity(
    df: DataFrame, value: str, code: str, label: str = "Label", shares: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Quantiles of ``value`` and number of different ``code`` values per class; NULL quantiles without values."""
    columns = [f"p{round(100 * share)}" for share in shares]
    quantiles = exact_percentiles(df, value, shares, label)
    table = local_table(
        df.sparkSession,
        {"_label": to_arrow_type(df.schema[label].dataType), **{name: pa.float64() for name in columns}},
        [(group, *values) for group, values in quantiles.items()],
    )
    # Distinct codes first, so a class with most of the rows is merged before it is counted.
    codes = (
        df.where(F.col(label).isNotNull()).select(label, code).distinct()
        .groupBy(label).agg(F.count(code).alias("codes"))
    )
    return codes.join(table, codes[label] == table["_label"], "left").select(label, *columns, "codes")
