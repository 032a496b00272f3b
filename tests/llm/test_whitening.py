"""Whitened embeddings against a dense eigendecomposition, and the updates one by one."""

import math

import numpy as np
import pytest

from foldwise.llm import whitening
from foldwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def expected(vectors, components=16):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], object)
    fit = [list(t) for t in {tuple(v) for v in x}]
    n = len(fit)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    center = np.array([s / n for s in sums])
    y = np.array(fit, float) - center
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1], basis[:, ::-1]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x.tolist()]
    shown = (x.astype(float) - center) @ basis[:, :components] / np.sqrt(values[:components])
    return n, deviation, shown, values[:components] / values.sum()


def test_query_equals_a_dense_decomposition(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, deviation, shown, explained = expected([r.embedding for r in rows])
    at = {r.vec_id: i for i, r in enumerate(rows)}
    got = QUERIES["op12_incremental_whitening"](spark, SF).collect()
    assert len(got) == 16 * len(rows)
    signs = {}
    for r in got:
        want = shown[at[r.vec_id], r.component - 1]
        if r.component not in signs and abs(want) > 0.1:
            signs[r.component] = np.sign(want * r.whitened)
        assert r.n == n and r.deviation == deviation[at[r.vec_id]]
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
    for r in got:
        want = shown[at[r.vec_id], r.component - 1]
        assert r.whitened * signs[r.component] == pytest.approx(want, abs=1e-7)


@pytest.mark.parametrize("rank", [6, 9])
def test_updates_equal_dense_eigenpairs(rank):
    rng = np.random.default_rng(rank)
    roots, basis = np.zeros((3, rank)), np.zeros((3, 6, rank))
    dense = np.zeros((3, 6, 6))
    for step in range(60):
        v = rng.normal(size=(3, 6)) * 10.0 ** rng.integers(-3, 3)
        if step % 5 == 0:
            v = np.repeat(np.eye(6)[[step % 6]], 3, 0)  # equal eigenvalues come about
        if step % 7 == 0:
            v[1] = 0.0
        scale = rng.uniform(0, 2, 3)
        roots, basis = whitening.rank_one_update(roots, basis, v, scale)
        dense += scale[:, None, None] * v[:, :, None] * v[:, None, :]
        made = basis @ (roots[:, :, None] * basis.transpose(0, 2, 1))
        top = np.abs(dense).max()
        assert np.abs(made - dense).max() < 1e-9 * max(top, 1e-300)
    gram = basis.transpose(0, 2, 1) @ basis
    for s in range(3):
        used = np.abs(np.diag(gram[s])) > 0.5
        assert used.sum() == 6 and np.abs(gram[s][np.ix_(used, used)] - np.eye(6)).max() < 1e-11


def test_a_small_rank_keeps_the_largest_directions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 12)) * np.array([50, 30, 20, *[1.0] * 9])
    own = whitening.Spectra(8, 12, 5)
    for at in range(0, len(x), 8):
        own.add(x[at : at + 8])
    one = own.combined()
    assert one.n.tolist() == [4000] and np.allclose(one.mean[0], x.mean(0))
    found = one.basis[0][:, np.argsort(-one.roots[0])[:3]]
    assert np.abs(np.abs(found[:3]).max(0) - 1).max() < 1e-2


def test_unusable_repeated_and_no_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(40)]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (50, None), (51, [1.0, None, 2.0]), (52, [])]
    rows += [(53, [float("nan"), 0.0, 0.0]), (54, [0.0, float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    for name in ("id", "x", "n", "part", "component"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    got = whitening.whitened_embeddings(df, "vec_id", "embedding").collect()
    usable = [v for _, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    assert len(got) == 3 * len(usable) == 3 * 42
    n, deviation, _, explained = expected(np.array(usable, np.float32))
    assert {r.n for r in got} == {n} == {40}
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    assert {round(r.explained, 9) for r in got} == {round(e, 9) for e in explained}
    assert sum(r.id is None for r in got) == 3 and sum(r.id == 3 for r in got) == 6
    assert whitening.whitened_embeddings(df.where("false"), "vec_id", "embedding").collect() == []
    equal = df.where("vec_id = 3")
    assert whitening.whitened_embeddings(equal, "vec_id", "embedding").collect() == []
    with pytest.raises(Exception, match="differ in length"):
        bad = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
        whitening.whitened_embeddings(bad, "vec_id", "embedding").collect()
