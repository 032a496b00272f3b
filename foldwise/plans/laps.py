"""The lap experiment: features and learner settings tried on the pit-stop tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.features import flag_above, interaction, rate, ratio
from foldwise.operators.learners import Arm
from foldwise.sources.schema import LAPS

# Learner settings of the recorded runs. MLlib trees have no L2 on leaf values; the
# regularised setting uses a minimum leaf size in its place and is not equivalent to it.
TREE_SETTINGS = {
    "depth 6, 500 rounds": {"maxIter": 500, "stepSize": 0.05, "maxDepth": 6},
    "depth 8, 1000 rounds": {"maxIter": 1000, "stepSize": 0.03, "maxDepth": 8},
    "depth 10, 1500 rounds": {"maxIter": 1500, "stepSize": 0.02, "maxDepth": 10},
    "depth 8, 1000 rounds, regularised": {
        "maxIter": 1000,
        "stepSize": 0.03,
        "maxDepth": 8,
        "minInstancesPerNode": 5,
    },
    "depth 10, 2000 rounds": {"maxIter": 2000, "stepSize": 0.015, "maxDepth": 10},
}
# How trees see the categories, in every fold and fit alike.
NOMINAL = ("Compound",)
TARGET_STAT = ("Driver", "Race")
LEAFWISE_SETTING = {"maxIter": 500, "stepSize": 0.05, "maxDepth": 5}


def lap_features() -> dict:
    """The four derived features, by name."""
    return {
        "DegradationPerTyreLife": ratio(F.col("Cumulative_Degradation"), F.col("TyreLife")),
        "TyreLifeRate": rate(F.col("TyreLife"), F.col("LapNumber")),
        "LateRace": flag_above(F.col("RaceProgress"), 0.8),
        "TyreLife_LapTimeDelta": interaction(F.col("TyreLife"), F.col("LapTime_Delta")),
    }


def constant_feature():
    """A column divided by itself: 1 everywhere, which must change nothing about a model."""
    return ratio(F.col("LapNumber"), F.col("LapNumber"))


def arms(max_bins: int = 32) -> list[Arm]:
    """Every recorded setting, by run name."""
    trees = [tree_arm(setting, max_bins) for setting in TREE_SETTINGS]
    return [logistic_arm(), leafwise_arm(max_bins), *trees]


def tree_arm(setting: str, max_bins: int = 32) -> Arm:
    """Boosted trees on all columns but the id."""
    return Arm(
        run=setting,
        learner="gbt",
        numeric=LAPS.numeric,
        categorical=NOMINAL,
        target_stat=TARGET_STAT,
        params={**TREE_SETTINGS[setting], "maxBins": max_bins},
    )


def leafwise_arm(max_bins: int = 32) -> Arm:
    """Boosted trees of about 31 leaves, with the id among the features."""
    return Arm(
        run="leafwise",
        learner="gbt",
        numeric=(LAPS.id, *LAPS.numeric),
        categorical=NOMINAL,
        target_stat=TARGET_STAT,
        params={**LEAFWISE_SETTING, "maxBins": max_bins},
    )


def logistic_arm() -> Arm:
    """One-hot logistic regression, with the id among the features."""
    return Arm(
        run="logistic",
        learner="logistic",
        numeric=(LAPS.id, *LAPS.numeric),
        categorical=LAPS.categorical,
    )
