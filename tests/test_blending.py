"""Weights on the simplex against a fine grid, and what they do to blends."""

from itertools import combinations

import numpy as np
import pytest

from foldwise.operators.blending import blend_weighted, learn_blend, simplex_weights


def loss(gram, cross, w):
    return w @ gram @ w - 2 * cross @ w


def best_of_faces(gram, cross):
    """The least loss over all faces of the simplex, each solved as a linear system."""
    size, best = len(cross), np.inf
    for n in range(1, size + 1):
        for face in combinations(range(size), n):
            system = np.ones((n + 1, n + 1))
            system[:n, :n], system[n, n] = gram[np.ix_(face, face)], 0
            w = np.linalg.lstsq(system, np.append(cross[list(face)], 1), rcond=None)[0][:n]
            if (w >= -1e-12).all() and abs(w.sum() - 1) < 1e-9:
                whole = np.zeros(size)
                whole[list(face)] = w
                best = min(best, loss(gram, cross, whole))
    return best


@pytest.mark.parametrize("seed", range(30))
def test_weights_reach_the_least_squared_error(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 7))
    y = (rng.random(80) < 0.4).astype(float)
    scores = y[:, None] * rng.random(size) + rng.normal(size=(80, size)) * rng.random(size)
    if seed % 3 == 0 and size > 1:
        scores[:, -1] = scores[:, 0]  # two sets alike
    gram, cross = scores.T @ scores / 80, scores.T @ y / 80
    w = simplex_weights(gram, cross)
    assert (w >= 0).all() and w.sum() == pytest.approx(1)
    assert loss(gram, cross, w) <= best_of_faces(gram, cross) + 1e-10


def test_five_sets_in_spark(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(300) < 0.5).astype(int)
    columns = {f"m{i}": 0.5 + (y - 0.5) * 0.2 * i + rng.normal(size=300) * 0.2 for i in range(5)}
    sets = {
        n: spark.createDataFrame([(i, float(v)) for i, v in enumerate(c)], "id long, p double")
        for n, c in columns.items()
    }
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "id long, label int")
    weights = learn_blend(sets, labels, score_col="p")
    scores = np.stack(list(columns.values()), axis=1)
    w = np.array([weights[n] for n in columns])
    gram, cross = scores.T @ scores / 300, scores.T @ y / 300
    assert loss(gram, cross, w) <= best_of_faces(gram, cross) + 1e-10
    blended = blend_weighted(sets, weights, score_col="p").collect()
    assert len(blended) == 300
    got = np.array([r.p for r in sorted(blended)])
    assert np.allclose(got, scores @ w)
    alone = min(np.mean((scores[:, i] - y) ** 2) for i in range(5))
    assert np.mean((got - y) ** 2) <= alone


def test_no_common_ids_and_repeated_ids(spark):
    one = spark.createDataFrame([(1, 0.5)], "id long, p double")
    two = spark.createDataFrame([(2, 0.5)], "id long, p double")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "id long, label int")
    assert learn_blend({"a": one, "b": two}, labels, score_col="p") == {"a": 0.5, "b": 0.5}
    with pytest.raises(Exception, match="duplicate id"):
        learn_blend({"a": one.union(one), "b": one}, labels, score_col="p")
    with pytest.raises(ValueError, match="may not be named"):
        learn_blend({"_label": one}, labels, score_col="p")
