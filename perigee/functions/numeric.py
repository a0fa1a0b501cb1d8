"""Numeric column expressions, all evaluated in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def present(value: Column | str) -> Column:
    """The value, with NaN turned into NULL so aggregates skip it as missing."""
    value = as_column(value)
    return F.when(~F.isnan(value), value)


def usable_std(std: float | None) -> bool:
    return std is not None and not math.isnan(std) and std != 0.0


def abs_z(value: Column | str, mean: float | None, std: float | None) -> Column:
    """|value - mean| / std; NULL where the value is missing or the feature carries no deviation."""
    if mean is None or math.isnan(mean) or not usable_std(std):
        return F.lit(None).cast("double")
    return F.abs(present(value) - F.lit(float(mean))) / F.lit(float(std))


def sum_balanced(columns: Sequence[Column]) -> Column:
    """Sum as a balanced tree: hundreds of terms stay a shallow expression."""
    columns = list(columns)
    if not columns:
        return F.lit(0)
    while len(columns) > 1:
        paired = [a + b for a, b in zip(columns[::2], columns[1::2])]
        columns = paired + ([columns[-1]] if len(columns) % 2 else [])
    return columns[0]


def round_exact(value: Column | str, places: int) -> Column:
    """Round to ``places`` as correctly rounded binary arithmetic does, ties to even.

    ``bround`` looks at the shortest decimal text of the double, so 0.84995 (stored a
    little below the tie) would go up.  Here the product by the power of ten is taken
    together with its rounding error (Dekker's split); the error's sign decides ties.
    """
    value = as_column(value).cast("double")
    scale = float(10**places)
    product = value * F.lit(scale)
    spread = value * F.lit(134217729.0)
    high = spread - (spread - value)
    error = (high * F.lit(scale) - product) + (value - high) * F.lit(scale)
    nearest = F.rint(product)
    offset = product - nearest
    rounded = (
        F.when((offset == 0.5) & (error > 0), nearest + 1.0)
        .when((offset == -0.5) & (error < 0), nearest - 1.0)
        .otherwise(nearest)
    )
    return rounded / F.lit(scale)


def argmax(values: Column | str) -> Column:
    """0-based position of the largest element; the first one wins a tie."""
    values = as_column(values)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def mean_squared_error(actual: Column | str, rebuilt: Column | str) -> Column:
    """Mean squared difference of two numeric arrays of equal length."""
    squares = F.zip_with(
        as_column(actual), as_column(rebuilt),
        lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")),
    )
    total = F.aggregate(squares, F.lit(0.0), lambda acc, sq: acc + sq)
    return total / F.size(squares)


def cyclic(radians: Column | str) -> tuple[Column, Column]:
    radians = as_column(radians)
    return F.sin(radians), F.cos(radians)


def percent_text(ratio: Column | str, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", round_exact(as_column(ratio) * 100.0, places))


def thousands_text(value: Column | str) -> Column:
    return F.format_number(as_column(value), 0)
