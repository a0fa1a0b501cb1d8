import math
import random

from pyspark.sql import functions as F

from perigee.functions.numeric import abs_z, argmax, mean_squared_error, percent_text, round_exact, sum_balanced


def test_rounding_agrees_with_correct_binary_rounding(spark, table):
    rng = random.Random(7)
    values = [0.84995, 0.53125, 0.00005, 0.00015, 0.99995, 0.0, 1.0, 0.70005, 0.69995, 1e-12, -0.53125]
    values += [rng.random() for _ in range(4000)]
    values += [(rng.randrange(10000) + 0.5) / 10000 for _ in range(4000)]
    values += [rng.randrange(64) / 64 for _ in range(200)]
    rows = table("x double", [(v,) for v in values]).select("x", round_exact("x", 4).alias("r")).collect()
    assert [(r.x, r.r) for r in rows if r.r != round(r.x, 4)] == []


def test_rounding_keeps_missing_values(table):
    rows = table("x double", [(None,), (math.nan,)]).select(round_exact("x", 4).alias("r")).collect()
    assert rows[0].r is None and math.isnan(rows[1].r)


def test_argmax_takes_the_first_of_equals(table):
    rows = table("x array<double>", [([0.2, 0.4, 0.4],), ([1.0],)]).select(argmax("x").alias("i")).collect()
    assert [r.i for r in rows] == [1, 0]


def test_z_of_missing_values_and_flat_features(table):
    df = table("x double", [(3.0,), (math.nan,), (None,)])
    assert [r.z for r in df.select(abs_z("x", 1.0, 0.5).alias("z")).collect()] == [4.0, None, None]
    for std in (0.0, None, math.nan):
        assert [r.z for r in df.select(abs_z("x", 1.0, std).alias("z")).collect()] == [None] * 3


def test_balanced_sum_of_many_terms(spark):
    row = spark.range(1).select(sum_balanced([F.lit(i) for i in range(501)]).alias("s")).first()
    assert row.s == sum(range(501))


def test_mean_squared_error_and_percent(table):
    row = table("a array<float>, b array<double>", [([1.0, 2.0], [0.0, 4.0])]).select(
        mean_squared_error("a", "b").alias("e"), percent_text(F.lit(0.284)).alias("p")
    ).first()
    assert row.e == 2.5 and row.p == "28.4%"
