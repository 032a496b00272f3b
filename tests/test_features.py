import math

import pytest
from pyspark.sql import functions as F

from foldwise.functions.features import flag_above, interaction, mean_of, rate, ratio
from foldwise.functions.nulls import fill_aggregates, finite_sql, null_fill
from foldwise.functions.scores import linear_margin, sigmoid


def one(spark, values, schema, expression):
    return spark.createDataFrame([values], schema).select(expression.alias("x")).first().x


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [(6.0, 3.0, 2.0), (0.0, 0.0, None), (5.0, 0.0, None), (None, 2.0, None), (2.0, None, None)],
)
def test_ratio_gives_null_for_a_zero_divisor(spark, ansi, a, b, expected):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        assert one(spark, (a, b), "a double, b double", ratio(F.col("a"), F.col("b"))) == expected
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_rate_adds_one_to_the_count(spark):
    value = rate(F.col("a"), F.col("n"))
    assert one(spark, (6.0, 2), "a double, n bigint", value) == 2.0
    assert one(spark, (6.0, 0), "a double, n bigint", value) == 6.0
    assert one(spark, (6.0, -1), "a double, n bigint", value) is None


@pytest.mark.parametrize(("x", "expected"), [(0.8, 0), (0.8000001, 1), (0.1, 0), (None, None)])
def test_flag_is_strict_at_the_threshold(spark, x, expected):
    assert one(spark, (x,), "x double", flag_above(F.col("x"), 0.8)) == expected


def test_interaction_and_mean(spark):
    schema = "a double, b double"
    assert one(spark, (2.0, -3.0), schema, interaction(F.col("a"), F.col("b"))) == -6.0
    assert one(spark, (None, -3.0), schema, interaction(F.col("a"), F.col("b"))) is None
    assert one(spark, (2.0, 3.0), schema, mean_of(F.col("a"), F.col("b"))) == 2.5


def test_linear_score(spark):
    p = sigmoid(linear_margin({"x y": 2.0}, -1.0))
    assert one(spark, (0.5,), "`x y` double", p) == 0.5
    assert one(spark, (1.5,), "`x y` double", p) == pytest.approx(1 / (1 + math.exp(-2.0)))


def test_null_fill_policies(spark):
    values = [1.0, 3.0, None, float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "`LapTime (s)` double")
    assert df.where(F.expr(finite_sql("LapTime (s)")).isNotNull()).count() == 2
    columns = ["LapTime (s)"]

    known = df.agg(*fill_aggregates(columns, for_trees=True)).first()
    trees = null_fill(columns, known, for_trees=True)
    filled = [r[-1] for r in trees.stage().transform(df).collect()]
    assert filled == [1.0, 3.0, 0.0, 0.0, 0.0, 0.0]

    known = df.agg(*fill_aggregates(columns, for_trees=False)).first()
    linear = null_fill(columns, known, for_trees=False)
    rows = [(r[-2], r[-1]) for r in linear.stage().transform(df).collect()]
    assert rows == [(1.0, 0.0), (3.0, 0.0)] + [(2.0, 1.0)] * 4


def test_null_fill_of_an_all_null_column(spark):
    df = spark.createDataFrame([(None,)], "x double")
    known = df.agg(*fill_aggregates(["x"], for_trees=True)).first()
    fill = null_fill(["x"], known, for_trees=True)
    assert fill.stage().transform(df).first()["x__filled"] == -1.0


@pytest.mark.parametrize("least", [0.0, -5.5, 2.0**53, -(2.0**60), 1e300])
def test_trees_see_missing_numbers_below_the_minimum(spark, least):
    fill = null_fill(["x"], [least], for_trees=True)
    assert fill.values["x"] < least


def test_nan_is_not_above_a_threshold(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,), (0.1,)], "x double")
    assert [r[0] for r in df.select(flag_above(F.col("x"), 0.5)).collect()] == [0, None, 1, 0]
