"""Ablations, feature trials and parameter sweeps: lists of arms over the same folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from foldwise.operators.blending import learn_blend
from foldwise.operators.comparison import compare_runs
from foldwise.operators.learners import SEED, Arm
from foldwise.plans.cv import PARALLELISM, fold_scores, folded_table, out_of_fold


def ablation(base: Arm, columns: Sequence[str]) -> list[Arm]:
    """The base arm, and one arm for each column left out."""
    return [base, *(base.without(c) for c in columns)]


def feature_trial(base: Arm, features: Mapping[str, Column]) -> list[Arm]:
    """The base arm, and one arm for each feature added on its own."""
    return [base, *(base.adding(name, expression) for name, expression in features.items())]


def sweep(base: Arm, settings: Mapping[str, Mapping[str, object]]) -> list[Arm]:
    """One arm per named parameter setting."""
    return [base.with_params(run, **params) for run, params in settings.items()]


def staged_sweep(base: Arm, rounds: Sequence[int], settings: Mapping[str, Mapping[str, object]]) -> list[Arm]:
    """Every setting under every number of rounds, with one fit per setting and fold."""
    return [arm.staged(rounds) for arm in sweep(base, settings)]


@dataclass(frozen=True)
class Comparison:
    """What cross-validation says of several arms over the same folds.

    ``scored`` are the out-of-fold scores, ``fold_scores`` the AUCs, ``pairs`` every two runs with
    the error of their difference, and ``weights`` those of the best blend of all runs.
    """

    scored: DataFrame
    fold_scores: DataFrame
    pairs: DataFrame
    weights: dict[str, float]


def compare_arms(
    df: DataFrame,
    arms: Sequence[Arm],
    id_col: str,
    label: str,
    k: int = 5,
    seed: int = SEED,
    parallelism: int = PARALLELISM,
    group: str | None = None,
) -> Comparison:
    """Fit and score all arms fold by fold, and say which differences the held-out rows bear out."""
    folded = folded_table(df, id_col, label, k, seed, group)
    scored = out_of_fold(folded, arms, id_col, label, k, parallelism)
    runs = [run for arm in arms for run in arm.runs]
    sets = {run: scored.where(scored.run == run).select("id", "score") for run in runs}
    labels = scored.where(scored.run == runs[0]).select("id", "label")
    weights = learn_blend(sets, labels, score_col="score")
    return Comparison(scored, fold_scores(scored), compare_runs(scored, runs), weights)
