"""Paired comparison of AUCs against a plain computation."""

import math
from itertools import product

import numpy as np
import pytest

from foldwise.operators import comparison

SCHEMA = "run string, fold int, id long, label int, score double"


def plain(rows, run_a, run_b):
    """DeLong's variance of the difference, from all pairs of a positive and a negative."""
    folds = sorted({r[1] for r in rows})
    aucs, total = {run_a: [], run_b: []}, 0.0
    for fold in folds:
        placed = {}
        for run in (run_a, run_b):
            pos = {r[2]: r[4] for r in rows if r[:2] == (run, fold) and r[3] == 1}
            neg = {r[2]: r[4] for r in rows if r[:2] == (run, fold) and r[3] == 0}
            win = {
                (i, j): 1.0 if pos[i] > neg[j] else 0.5 if pos[i] == neg[j] else 0.0
                for i, j in product(pos, neg)
            }
            above = {i: np.mean([win[i, j] for j in neg]) for i in pos}
            below = {j: np.mean([win[i, j] for i in pos]) for j in neg}
            placed[run] = above, below
            aucs[run].append(np.mean(list(above.values())))
        for side in (0, 1):
            a, b = placed[run_a][side], placed[run_b][side]
            total += np.var([a[i] - b[i] for i in a], ddof=1) / len(a)
    mean_a, mean_b = np.mean(aucs[run_a]), np.mean(aucs[run_b])
    return mean_a, mean_b, math.sqrt(total) / len(folds)


def random_rows(n=240, folds=3, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.4)
        scores = {"a": rng.normal() + label, "b": round(rng.normal() + label, 1), "c": float(label)}
        rows += [(run, i % folds, i, label, float(s)) for run, s in scores.items()]
    return rows


@pytest.mark.parametrize("rows_per_piece", [1_000_000, 2])
def test_equals_a_plain_computation(spark, rows_per_piece, monkeypatch):
    """Also with every tied score of more than two rows taken for a hot one."""
    whole = comparison.placements
    monkeypatch.setattr(comparison, "placements", lambda df: whole(df, rows_per_piece))
    rows = random_rows()
    got = comparison.compare_runs(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert [(r.run_a, r.run_b) for r in got] == [("a", "b"), ("a", "c"), ("b", "c")]
    for r in got:
        mean_a, mean_b, error = plain(rows, r.run_a, r.run_b)
        assert r.auc_a == pytest.approx(mean_a, rel=1e-12) and r.auc_b == pytest.approx(mean_b, rel=1e-12)
        assert r.std_error == pytest.approx(error, rel=1e-9)
        assert r.z == pytest.approx((mean_a - mean_b) / error, rel=1e-9)
        assert r.p_value == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)))


def test_runs_that_order_all_rows_alike_differ_by_nothing(spark):
    rows = [r for r in random_rows() if r[0] == "a"]
    rows += [("twice", f, i, y, 2 * s + 1) for _, f, i, y, s in rows]
    (r,) = comparison.compare_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (r.difference, r.std_error, r.z, r.p_value) == (0.0, 0.0, None, None)


def test_a_fold_of_one_class_has_no_comparison(spark):
    rows = [(run, i % 2, i, i % 2, float(i)) for run in "ab" for i in range(8)]
    (r,) = comparison.compare_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (r.auc_a, r.std_error, r.z) == (None, None, None)


def test_a_row_that_a_run_has_not_scored_stops_the_job(spark):
    rows = [r for r in random_rows() if not (r[0] == "b" and r[2] == 7)]
    with pytest.raises(Exception, match="not scored once by every run: id 7"):
        comparison.compare_runs(spark.createDataFrame(rows, SCHEMA)).collect()


def test_a_noisy_copy_is_told_apart_only_with_enough_rows(spark):
    """The error of a difference shrinks with the rows, and correlation makes it smaller."""
    few = comparison.compare_runs(spark.createDataFrame(random_rows(120), SCHEMA), ["a", "b"]).first()
    many = comparison.compare_runs(spark.createDataFrame(random_rows(1920), SCHEMA), ["a", "b"]).first()
    assert many.std_error < few.std_error / 2


def test_two_exchanges_of_rows_for_any_number_of_runs(spark):
    """Behind the written tables the plan shuffles by score key and by id; counts do not follow."""
    rows = spark.createDataFrame(random_rows(), SCHEMA)
    placed = comparison.placements(rows)
    for runs in (["a", "b"], ["a", "b", "c"]):
        plan = comparison.auc_moments(placed, runs)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(fold") <= 2 + 1
