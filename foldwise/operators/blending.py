"""Blend weights learnt from out-of-fold predictions: least squares on the simplex."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.scores import binary_label
from foldwise.operators.predictions import join_predictions

_LABEL = "_label"


def gram_matrix(joined: DataFrame, names: list[str], label: str) -> tuple[np.ndarray, np.ndarray, int]:
    """``(G, c, n)``: means of products of the sets' scores, and of scores and label; one aggregate."""
    scores = [F.col(f"`{n}`").cast("double") for n in names]
    y = binary_label(F.col(f"`{label}`")).cast("double")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    seen = joined.agg(
        F.count(F.lit(1)),
        *[F.avg(scores[i] * scores[j]) for i, j in pairs],
        *[F.avg(s * y) for s in scores],
    ).first()
    size = len(names)
    gram = np.zeros((size, size))
    if seen[0]:
        for (i, j), value in zip(pairs, seen[1 : 1 + len(pairs)], strict=True):
            gram[i, j] = gram[j, i] = value
    cross = np.array([v or 0.0 for v in seen[1 + len(pairs) :]])
    return gram, cross, seen[0]


def simplex_weights(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """The ``w >= 0`` with sum 1 that minimises ``w'Gw - 2 c'w``, exactly, by active sets.

    Starts from the best single set. Of the sets left out the one with the steepest descent comes
    in; the weights of those in are solved for, and those that would turn negative go out on the way.
    Of sets that score all rows alike, one has the weight.
    """
    size = len(cross)
    best = int(np.argmin(np.diag(gram) - 2 * cross))
    weights, inside = np.eye(size)[best], [best]
    scale = max(float(np.abs(gram).max(initial=0.0)), float(np.abs(cross).max(initial=0.0)), 1e-300)
    for _ in range(50 * size):
        slope = gram @ weights - cross
        level = slope @ weights
        outside = [i for i in range(size) if i not in inside]
        if not outside or min(slope[i] for i in outside) >= level - 1e-13 * scale:
            break
        inside.append(min(outside, key=lambda i: slope[i]))
        while True:
            n = len(inside)
            system = np.ones((n + 1, n + 1))
            system[:n, :n], system[n, n] = gram[np.ix_(inside, inside)], 0.0
            wanted = np.linalg.lstsq(system, np.append(cross[inside], 1.0), rcond=1e-13)[0][:n]
            if (wanted > 0).all():
                weights = np.zeros(size)
                weights[inside] = wanted
                break
            now = weights[inside]
            falling = wanted <= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                steps = np.where(falling, now / (now - wanted), np.inf)
            step = float(np.nan_to_num(steps, nan=0.0, posinf=np.inf).min())
            weights[inside] = now + step * (wanted - now)
            gone = int(np.argmin(np.where(falling, steps, np.inf)))
            weights[inside[gone]] = 0.0
            inside.pop(gone)
            if not inside:
                return np.eye(size)[best]
    weights = np.maximum(weights, 0.0)
    return weights / weights.sum()


def learn_blend(
    sets: Mapping[str, DataFrame],
    labels: DataFrame,
    id_col: str = "id",
    score_col: str = "PitNextLap",
    label: str = "label",
) -> dict[str, float]:
    """Weights of the sets whose blend has the least squared error over the ids that all hold.

    Pass out-of-fold predictions: scores of rows that the models have seen favour the model that
    fitted them closest. Sets and labels meet in one exchange by id; the rest is one aggregate of the
    number of sets squared. No id in common gives equal weights.
    """
    names = list(sets)
    if _LABEL in names:
        raise ValueError(f"a set may not be named {_LABEL!r}")
    marked = labels.select(f"`{id_col}`", F.col(f"`{label}`").cast("double").alias(score_col))
    joined = join_predictions({**sets, _LABEL: marked}, id_col, score_col)
    gram, cross, n = gram_matrix(joined, names, _LABEL)
    weights = simplex_weights(gram, cross) if n else np.full(len(names), 1 / len(names))
    return dict(zip(names, weights.tolist(), strict=True))


def blend_weighted(
    sets: Mapping[str, DataFrame],
    weights: Mapping[str, float],
    id_col: str = "id",
    score_col: str = "PitNextLap",
) -> DataFrame:
    """The weighted sum of the sets' scores for every id that all of them hold."""
    joined = join_predictions(sets, id_col, score_col)
    total = F.lit(0.0)
    for name in sets:
        total = total + F.col(f"`{name}`") * F.lit(float(weights[name]))
    return joined.select(f"`{id_col}`", total.alias(score_col))
