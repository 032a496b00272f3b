"""End-to-end jobs: validate, fit, score and write; and blend written prediction files."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.operators.learners import SEED, Arm, FittedArm, fit_arm
from foldwise.operators.predictions import blend_mean
from foldwise.plans.cv import PARALLELISM, fold_scores, folded_table, out_of_fold
from foldwise.sources.schema import TableSpec
from foldwise.sources.sinks import write_predictions
from foldwise.sources.tables import Bundle, read_predictions
from foldwise.workspace import materialize


def predict(fitted: FittedArm, test: DataFrame, spec: TableSpec) -> DataFrame:
    """``(id, probability)`` of the test rows; the id rides on the row it belongs to."""
    return fitted.score(test).select(
        F.col(f"`{spec.id}`").alias(spec.id), F.col("score").alias(spec.label)
    )


@dataclass(frozen=True)
class RunResult:
    fold_scores: DataFrame | None
    fitted: FittedArm
    predictions_path: str


def train_and_submit(
    bundle: Bundle,
    arm: Arm,
    spec: TableSpec,
    path: str,
    k: int = 5,
    seed: int = SEED,
    parallelism: int = PARALLELISM,
    validate: bool = True,
) -> RunResult:
    """Cross-validate an arm, fit it on all training rows, score the test rows, write them.

    The training rows are parsed once: folding, validation and the final fit read written tables.
    """
    scores = None
    if validate:
        train = folded_table(bundle.train, spec.id, spec.label, k, seed)
        scored = out_of_fold(train, [arm], spec.id, spec.label, k, parallelism)
        scores = fold_scores(scored)
    else:
        train = materialize(bundle.train, "train")
    fitted = fit_arm(train, arm, spec.id, spec.label)
    write_predictions(predict(fitted, bundle.test, spec), path, spec.id, spec.label)
    return RunResult(scores, fitted, path)


def blend_files(spark: SparkSession, paths: Mapping[str, str], out: str) -> None:
    """Read prediction files, average them by id, and write the blend once."""
    write_predictions(blend_mean({n: read_predictions(spark, p) for n, p in paths.items()}), out)
