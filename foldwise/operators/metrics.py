"""Exact ROC AUC and fold statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.scores import binary_label

# Ranges that distinct scores are cut into, and when and how far to cut finer.
SCORE_RANGES = 1024
ROWS_PER_RANGE = 5_000_000
MAX_RANGES = 16_384

# Groups in which the sketches of input partitions are merged.
SKETCH_GROUPS = 256


def roc_auc(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    by: Sequence[str] = (),
    ranges: int = SCORE_RANGES,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Exact area under the ROC curve per group in ``by``; ties count one half.

    Equal scores collapse before the shuffle. The distinct scores are then cut into ranges that
    hold about equally many rows, so the running count of negatives never needs a whole group in
    one task: it runs inside each range, and again over the at most ``ranges`` range totals.
    The cuts only decide where work happens and do not enter the result; pass ``score_cuts`` of a
    cheaper source of the same scores to keep them from evaluating ``df`` a second time.

    A group of one class gives NULL. A NULL or NaN score is an error, as is a label other than 0
    and 1.
    """
    by = list(by)
    if cuts is None:
        cuts = score_cuts(df, score, ranges)
    scored = df.select(
        *by,
        known_score(F.col(score)).alias("_s"),
        binary_label(F.col(label)).alias("_y"),
    )
    scored = range_of(scored, cuts)

    positive = F.sum("_y")
    negative = F.sum(F.lit(1) - F.col("_y"))
    tied = scored.groupBy(*by, "_range", "_s").agg(positive.alias("p"), negative.alias("n"))

    in_range = Window.partitionBy(*by, "_range").orderBy("_s")
    totals = (
        tied.withColumn("below", running_before(F.col("n"), in_range))
        .groupBy(*by, "_range")
        .agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(_pairs()).alias("inner"))
    )
    across = Window.partitionBy(*by).orderBy("_range")
    won = F.sum(F.col("inner") + F.col("p") * F.col("below").cast("double"))
    possible = F.sum("p").cast("double") * F.sum("n").cast("double")
    summed = totals.withColumn("below", running_before(F.col("n"), across))
    return summed.groupBy(*by).agg(F.try_divide(won, possible).alias("auc"))


def score_cuts(df: DataFrame, score: str = "score", ranges: int = SCORE_RANGES) -> list[float]:
    """Increasing cuts that split the rows about evenly by score into ``ranges`` ranges.

    Sketched map-side. The sketches of the input partitions are merged in ``SKETCH_GROUPS`` groups
    rather than in one task, and the driver sees ``ranges`` quantiles of each group. If that leaves
    more than ``ROWS_PER_RANGE`` rows to a range, the scores are sketched again, finer. ``df`` is
    evaluated for each sketch and again by the measure itself: pass written scores, not a plan that
    still has to score.
    """
    if ranges < 2:
        return []
    cuts, n_rows = _sketch(df, score, ranges)
    finer = min(MAX_RANGES, n_rows // ROWS_PER_RANGE)
    if finer > ranges:
        cuts, _ = _sketch(df, score, finer)
    return cuts


def _sketch(df: DataFrame, score: str, ranges: int) -> tuple[list[float], int]:
    shares = ", ".join(f"{i / ranges}D" for i in range(1, ranges))
    value = f"CAST(`{score}` AS DOUBLE)"
    group = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g")
    groups = (
        df.select(F.expr(value).alias("v"), group)
        .groupBy("g")
        .agg(
            F.expr(f"percentile_approx(v, array({shares}), {ranges * 4})").alias("quantiles"),
            F.count("v").alias("n"),
        )
        .where("quantiles IS NOT NULL")
        .collect()
    )
    if not groups:
        return [], 0
    quantiles = np.concatenate([np.asarray(g.quantiles) for g in groups])
    weights = np.repeat([g.n / ranges for g in groups], [len(g.quantiles) for g in groups])
    order = np.argsort(quantiles)
    quantiles, reached = quantiles[order], np.cumsum(weights[order])
    wanted = reached[-1] * np.arange(1, ranges) / ranges
    # Adding 0.0 turns -0.0 into 0.0.
    cuts = np.unique(quantiles[np.searchsorted(reached, wanted)] + 0.0)
    return cuts[np.isfinite(cuts)].tolist(), sum(g.n for g in groups)


def fold_summary(scores: DataFrame, by: Sequence[str] = (), auc: str = "auc") -> DataFrame:
    """Mean and population standard deviation of fold scores."""
    return scores.groupBy(*by).agg(
        F.avg(auc).alias("mean_auc"), F.stddev_pop(auc).alias("std_auc")
    )


def _pairs() -> Column:
    """Negatives ranked below each positive of a tied score, ties counting one half."""
    return F.col("p") * (F.col("below") + F.lit(0.5) * F.col("n"))


def running_before(value: Column, window) -> Column:
    """Sum of the rows before, 0 for the first."""
    preceding = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(preceding), F.lit(0))


def known_score(value: Column) -> Column:
    """The score as a double; NULL and NaN stop the job."""
    number = value.cast("double")
    bad = number.isNull() | F.isnan(number)
    # Adding 0.0 turns -0.0 into 0.0, so that the two fall in one range.
    return F.when(bad, F.raise_error(F.lit("score is NULL or NaN"))).otherwise(number + F.lit(0.0))


def range_of(scored: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """``_range``: between which of ``cuts`` the score ``_s`` lies."""
    if not cuts:
        return scored.withColumn("_range", F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    binned = Bucketizer(splits=splits, inputCol="_s", outputCol="_range").transform(scored)
    return binned.withColumn("_range", F.col("_range").cast("int"))
