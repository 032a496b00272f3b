import random

import pytest
from pyspark.sql import functions as F

from foldwise.operators import metrics
from foldwise.operators.metrics import fold_summary, roc_auc, score_cuts
from foldwise.plans.cv import leaderboard

SCHEMA = "g string, score double, label int"


def by_pairs(rows):
    """Share of (positive, negative) pairs in the right order, ties one half."""
    positive = [s for _, s, y in rows if y == 1]
    negative = [s for _, s, y in rows if y == 0]
    if not positive or not negative:
        return None
    won = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    return won / (len(positive) * len(negative))


@pytest.mark.parametrize("ranges", [1, 2, 7, 1024])
@pytest.mark.parametrize("levels", [3, 40, 10**9])
def test_equal_to_counting_pairs(spark, ranges, levels):
    draw = random.Random(levels)
    rows = [
        (draw.choice("ab"), draw.randrange(levels) / levels, draw.randrange(2)) for _ in range(300)
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    whole = roc_auc(df, ranges=ranges).collect()
    assert [r.auc for r in whole] == [pytest.approx(by_pairs(rows), abs=1e-12)]
    for row in roc_auc(df, by=["g"], ranges=ranges).collect():
        expected = by_pairs([r for r in rows if r[0] == row.g])
        assert row.auc == pytest.approx(expected, abs=1e-12)


def test_one_score_holds_most_rows(spark):
    rows = [("a", 0.5, i % 2) for i in range(400)] + [("a", i / 97, int(i > 40)) for i in range(97)]
    got = roc_auc(spark.createDataFrame(rows, SCHEMA), ranges=16).first().auc
    assert got == pytest.approx(by_pairs(rows), abs=1e-12)


def test_all_scores_tied(spark):
    df = spark.createDataFrame([("a", 0.3, y) for y in (0, 1, 1, 0)], SCHEMA)
    assert roc_auc(df).first().auc == 0.5


def test_one_class_gives_null_for_that_group_only(spark):
    rows = [("a", 0.1, 1), ("a", 0.2, 1), ("b", 0.1, 0), ("b", 0.2, 1)]
    got = {r.g: r.auc for r in roc_auc(spark.createDataFrame(rows, SCHEMA), by=["g"]).collect()}
    assert got == {"a": None, "b": 1.0}


def test_negative_zero_ties_with_zero_even_at_a_cut(spark):
    rows = [("a", -0.0, 1), ("a", 0.0, 0), ("a", 1.0, 1), ("a", -1.0, 0)]
    got = roc_auc(spark.createDataFrame(rows, SCHEMA), cuts=[0.0]).first().auc
    assert got == pytest.approx(by_pairs(rows))


@pytest.mark.parametrize("score", [None, float("nan")])
def test_a_missing_score_is_an_error(spark, score):
    df = spark.createDataFrame([("a", score, 1), ("a", 0.5, 0)], SCHEMA)
    with pytest.raises(Exception, match="score is NULL or NaN"):
        roc_auc(df).collect()


def test_infinite_scores_rank_at_the_ends(spark):
    rows = [("a", float("inf"), 1), ("a", 0.5, 0), ("a", 0.7, 1), ("a", float("-inf"), 0)]
    assert roc_auc(spark.createDataFrame(rows, SCHEMA), ranges=4).first().auc == 1.0


def test_cuts_hold_about_equally_many_rows(spark):
    df = spark.range(100_000).select((F.col("id") / 1e9).alias("score"))
    cuts = score_cuts(df, "score", 10)
    assert len(cuts) == 9
    assert cuts == pytest.approx([i * 1e-5 for i in range(1, 10)], rel=0.3)


def test_cuts_from_partitions_with_different_scores(spark):
    """Partitions of unequal size, each holding its own stretch of scores."""
    df = spark.range(60_000).select((F.col("id") / 60_000).alias("score"))
    df = df.repartitionByRange(300, "score").union(df.where("score < 0.1").coalesce(1))
    cuts = score_cuts(df, "score", 32)
    rows = sorted(r.score for r in df.collect())
    sizes = [0] * (len(cuts) + 1)
    for score in rows:
        sizes[sum(c <= score for c in cuts)] += 1
    assert max(sizes) < 2 * len(rows) / 32


def test_more_rows_get_more_ranges(spark, monkeypatch):
    df = spark.range(10_000).select((F.col("id") / 10_000).alias("score"))
    assert len(score_cuts(df, "score", 16)) == 15
    monkeypatch.setattr(metrics, "ROWS_PER_RANGE", 100)
    assert 90 <= len(score_cuts(df, "score", 16)) <= 99


# Printed fold scores with their printed mean and standard deviation.
GOLDEN = {
    "six deep": ([0.93617, 0.93467, 0.93619, 0.93584, 0.93640], 0.93586, 0.00062),
    "ratio": ([0.93609, 0.93448, 0.93608, 0.93588, 0.93658], 0.93582, 0.00071),
    "rate": ([0.93617, 0.93467, 0.93619, 0.93584, 0.93640], 0.93586, 0.00062),
    "flag": ([0.93621, 0.93446, 0.93616, 0.93600, 0.93639], 0.93584, 0.00070),
    "interaction": ([0.93577, 0.93428, 0.93577, 0.93572, 0.93633], 0.93557, 0.00069),
    "eight deep": ([0.94590, 0.94504, 0.94682, 0.94592, 0.94616], 0.94597, 0.00057),
    "ten deep": ([0.94772, 0.94660, 0.94823, 0.94757, 0.94776], 0.94758, 0.00053),
    "regularised": ([0.94593, 0.94499, 0.94668, 0.94592, 0.94619], 0.94594, 0.00055),
    "ten deep, more rounds": ([0.94758, 0.94659, 0.94827, 0.94762, 0.94785], 0.94758, 0.00055),
}


@pytest.fixture(scope="module")
def golden_scores(spark):
    rows = [(run, i, auc) for run, (folds, _, _) in GOLDEN.items() for i, auc in enumerate(folds)]
    return spark.createDataFrame(rows, "run string, fold int, auc double")


def test_printed_summaries(spark, golden_scores):
    for row in fold_summary(golden_scores, by=["run"]).collect():
        _, mean, std = GOLDEN[row.run]
        assert row.mean_auc == pytest.approx(mean, abs=1e-5)
        assert row.std_auc == pytest.approx(std, abs=1e-5)
    sample = golden_scores.groupBy("run").agg(F.stddev("auc").alias("std")).collect()
    assert all(abs(r["std"] - GOLDEN[r.run][2]) > 1e-5 for r in sample)


def test_leaderboard_order(spark, golden_scores):
    means = [r.mean_auc for r in leaderboard(golden_scores).collect()]
    assert means == sorted(means, reverse=True)
    runs = [r.run for r in leaderboard(golden_scores).collect()]
    assert runs.index("eight deep") < runs.index("regularised")
    assert set(runs[:2]) == {"ten deep", "ten deep, more rounds"}
