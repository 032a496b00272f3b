"""Prediction sets: joining them by id, blending, and checking which ids they cover."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.features import mean_of


def join_predictions(
    sets: Mapping[str, DataFrame], id_col: str = "id", score_col: str = "PitNextLap"
) -> DataFrame:
    """Inner join of prediction sets on the id: ``(id, <set name>, <set name>, ...)``.

    Ids are unique within a set, so the join is a stack of all sets and one aggregate by id: one
    exchange for any number of sets, no sort, and copies of an id collapse before the shuffle
    instead of multiplying. An id that occurs twice in a set stops the job with that id.
    """
    names = list(sets)
    key = F.col(f"`{id_col}`")
    stacked = _stack(sets, id_col, score_col).where(key.isNotNull())
    scores = [
        F.max(F.when(F.col("_set") == i, F.col("_score"))).alias(n) for i, n in enumerate(names)
    ]
    counts = [_count_in(i).alias(f"_n{i}") for i in range(len(names))]
    joined = stacked.groupBy(key).agg(*scores, *counts)
    for i in range(len(names)):
        joined = joined.where(F.col(f"_n{i}") > 0)
    most = F.greatest(*[F.col(f"_n{i}") for i in range(len(names))], F.lit(1))
    repeated = F.concat(F.lit("duplicate id in a prediction set: "), key.cast("string"))
    # As a filter, so that no later projection prunes the check away.
    unique = F.coalesce(F.when(most > 1, F.raise_error(repeated).cast("boolean")), F.lit(True))
    return joined.where(unique).select(key, *[F.col(f"`{n}`") for n in names])


def blend_mean(
    sets: Mapping[str, DataFrame], id_col: str = "id", score_col: str = "PitNextLap"
) -> DataFrame:
    """Arithmetic mean of the sets' scores for every id that all of them hold."""
    joined = join_predictions(sets, id_col, score_col)
    return joined.select(
        f"`{id_col}`", mean_of(*[F.col(f"`{n}`") for n in sets]).alias(score_col)
    )


def id_counts(sets: Mapping[str, DataFrame], id_col: str = "id") -> DataFrame:
    """How often each id occurs in each set: ``(id, <set name>, ...)``, one row per id."""
    counts = [_count_in(i).alias(name) for i, name in enumerate(sets)]
    return _stack(sets, id_col, None).groupBy(f"`{id_col}`").agg(*counts)


def missing_ids(expected: DataFrame, actual: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids of ``expected`` without a row in ``actual``."""
    counts = id_counts({"expected": expected, "actual": actual}, id_col)
    return counts.where((F.col("expected") > 0) & (F.col("actual") == 0)).select(f"`{id_col}`")


def duplicate_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids that occur more than once, with their number of rows."""
    counted = df.groupBy(f"`{id_col}`").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > 1)


def _count_in(index: int):
    return F.count(F.when(F.col("_set") == index, F.lit(1)))


def _stack(sets: Mapping[str, DataFrame], id_col: str, score_col: str | None) -> DataFrame:
    score = [F.col(f"`{score_col}`").alias("_score")] if score_col else []
    tagged = [
        df.select(f"`{id_col}`", *score, F.lit(i).alias("_set")) for i, df in enumerate(sets.values())
    ]
    return reduce(DataFrame.unionByName, tagged)
