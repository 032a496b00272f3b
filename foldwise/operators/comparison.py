"""Is one run better than another? Paired comparison of correlated AUCs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from foldwise.operators.metrics import known_score, range_of, running_before, score_cuts
from foldwise.functions.scores import binary_label
from foldwise.operators.skew import ROWS_PER_PIECE, lookup
from foldwise.workspace import materialize

COMPARISON = (
    "run_a string, run_b string, auc_a double, auc_b double, difference double, "
    "std_error double, z double, p_value double"
)


def placements(scored: DataFrame, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """``(run, fold, id, label, place)``: the share of the other class that a row beats in its run.

    For a positive that is the share of negatives scored below it, for a negative the share of
    positives scored above it, ties counting one half (the mid-ranks of DeLong, DeLong and
    Clarke-Pearson); the mean over a class is the AUC. ``scored`` has the columns of ``out_of_fold``
    and is read twice. A fold of one class gives NULL.

    Equal scores collapse before they are ordered, in ranges (see ``roc_auc``); the rows get their
    place by an equi-join on the score, in which a score of very many rows is spread by id.
    """
    rows = scored.select(
        "run",
        "fold",
        "id",
        binary_label(F.col("label")).alias("label"),
        known_score(F.col("score")).alias("_s"),
    )
    by = ["run", "fold"]
    ranged = range_of(rows, score_cuts(scored))
    tied = ranged.groupBy(*by, "_range", "_s").agg(
        F.sum("label").alias("p"), F.sum(F.lit(1) - F.col("label")).alias("n")
    )
    tied = materialize(tied, "tied-scores")
    sizes = tied.groupBy(*by, "_range").agg(F.sum("p").alias("_rp"), F.sum("n").alias("_rn"))
    across, whole = Window.partitionBy(*by).orderBy("_range"), Window.partitionBy(*by)
    # One row per run, fold and range.
    starts = sizes.select(
        *by,
        "_range",
        running_before(F.col("_rp"), across).alias("_p0"),
        running_before(F.col("_rn"), across).alias("_n0"),
        F.sum("_rp").over(whole).alias("_p"),
        F.sum("_rn").over(whole).alias("_n"),
    )
    inside = Window.partitionBy(*by, "_range").orderBy("_s")
    running = tied.withColumns(
        {"_p1": running_before(F.col("p"), inside), "_n1": running_before(F.col("n"), inside)}
    ).join(starts, [*by, "_range"])
    beaten = F.col("_n0") + F.col("_n1") + F.col("n") / 2
    lost = F.col("_p0") + F.col("_p1") + F.col("p") / 2
    table = running.select(
        _score_key().alias("lookup_key"),
        (F.col("p") + F.col("n")).alias("rows"),
        F.try_divide(beaten, F.col("_n")).alias("above"),
        F.try_divide(F.col("_p") - lost, F.col("_p")).alias("below"),
    )
    table = materialize(table, "placements")
    hot = table.where(F.col("rows") > rows_per_piece).select(
        F.col("lookup_key").alias("hot_key"), F.lit(1).alias("pieces")
    )
    keyed = rows.withColumn("_score_key", _score_key()).drop("_s")
    found = lookup(keyed, table.drop("rows"), "_score_key", "id", hot)
    place = F.when(F.col("label") == 1, F.col("above")).otherwise(F.col("below"))
    return found.select("run", "fold", "id", "label", place.alias("place"))


def _score_key():
    score = F.hex(F.col("_s").cast("string").cast("binary"))
    return F.concat_ws(":", F.col("fold").cast("string"), score, "run")


def auc_moments(placed: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Per fold and class: rows, and sums and products of the runs' places: ``(fold, label, m, s, q)``.

    ``s`` has a sum per run and ``q`` one per pair of runs, in order. The places of a row's runs
    meet by an exchange on the id. Every run must score every row once.
    """
    at = [F.max(F.when(F.col("run") == run, F.col("place"))).alias(f"_v{i}") for i, run in enumerate(runs)]
    wide = placed.where(F.col("run").isin(*runs)).groupBy("fold", "id", "label").agg(
        *at, F.count("*").alias("_rows"), F.count_distinct("run").alias("_runs")
    )
    complete = (F.col("_rows") == len(runs)) & (F.col("_runs") == len(runs))
    shown = F.concat(F.lit("not scored once by every run: id "), F.col("id").cast("string"))
    wide = wide.where(F.when(~complete, F.raise_error(shown).cast("boolean")).otherwise(F.lit(True)))
    pairs = [(i, j) for i in range(len(runs)) for j in range(i, len(runs))]
    return wide.groupBy("fold", "label").agg(
        F.count("*").alias("m"),
        F.array(*[F.sum(f"_v{i}") for i in range(len(runs))]).alias("s"),
        F.array(*[F.sum(F.col(f"_v{i}") * F.col(f"_v{j}")) for i, j in pairs]).alias("q"),
    )


def compare_runs(scored: DataFrame, runs: Sequence[str] | None = None) -> DataFrame:
    """All pairs of runs: their mean AUCs, the difference, its standard error, z and two-sided p.

    ``scored`` has the columns of ``out_of_fold``; rows of one run and fold come from one model. The
    covariance of the AUCs within a fold is DeLong's; folds are independent samples, so the mean
    over k folds has their summed covariance over k squared. The runs' training sets overlap, which
    this does not model: it says whether the held-out rows tell two fitted arms apart.

    Two exchanges of the rows, however many runs: by score, and by id. A fold with fewer than two
    rows of a class makes error, z and p NULL; so does a difference without any variance (z and p).
    """
    if runs is None:
        runs = [r.run for r in scored.select("run").distinct().orderBy("run").collect()]
    moments = auc_moments(placements(scored), runs).collect()  # two rows per fold
    aucs, covariance = combine_folds(moments, len(runs))
    rows = [_compared(runs, aucs, covariance, i, j) for i, j in combinations(range(len(runs)), 2)]
    return scored.sparkSession.createDataFrame(rows, COMPARISON)


def combine_folds(moments: Sequence[Row], n_runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean AUC per run, and the covariance matrix of these means, from ``auc_moments``."""
    folds = sorted({r.fold for r in moments})
    aucs, total = np.zeros((len(folds), n_runs)), np.zeros((n_runs, n_runs))
    upper = np.triu_indices(n_runs)
    for at, fold in enumerate(folds):
        own = {r.label: r for r in moments if r.fold == fold}
        if set(own) != {0, 1}:
            return np.full(n_runs, np.nan), np.full((n_runs, n_runs), np.nan)
        aucs[at] = np.array(own[1].s) / own[1].m
        for row in own.values():
            products = np.zeros((n_runs, n_runs))
            products[upper] = row.q
            products = products + np.triu(products, 1).T
            sums = np.array(row.s)
            if row.m < 2:
                total += np.nan
                continue
            total += (products - np.outer(sums, sums) / row.m) / (row.m - 1) / row.m
    return aucs.mean(0), total / max(len(folds), 1) ** 2


def _compared(runs, aucs, covariance, i: int, j: int) -> tuple:
    difference = aucs[i] - aucs[j]
    variance = covariance[i, i] + covariance[j, j] - 2 * covariance[i, j]
    error = z = p = None
    if np.isfinite(variance):
        # Rounding can leave a little below or above zero for runs that order all rows alike.
        variance = variance if variance > 1e-15 * (covariance[i, i] + covariance[j, j]) else 0.0
        error = math.sqrt(variance)
        if error > 0:
            z = difference / error
            p = math.erfc(abs(z) / math.sqrt(2))
    numbers = (aucs[i], aucs[j], difference, error, z, p)
    numbers = (None if x is None or math.isnan(x) else float(x) for x in numbers)
    return (runs[i], runs[j], *numbers)
