"""Cross-validation of one or many arms over one shared, folded table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.scores import binary_label
from foldwise.operators.folds import (
    group_folds,
    held_out_rows,
    stratified_folds,
    training_rows,
)
from foldwise.operators.learners import (
    LABEL,
    SEED,
    Arm,
    FittedArm,
    TrainingRows,
    fit_prepared,
    prepare_training,
    score_all,
    shared_orders,
    stat_name,
)
from foldwise.operators.metrics import fold_summary, roc_auc
from foldwise.operators.tables import refuse_columns
from foldwise.operators.order_stats import fold_target_stats_over
from foldwise.operators.target_stats import fold_target_stats
from foldwise.workspace import materialize

# Fits that run side by side unless the caller says otherwise. A fit holds its own binned copy of
# its training rows while it runs.
PARALLELISM = 4


def folded_table(
    df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = SEED, group: str | None = None
) -> DataFrame:
    """The table with its folds, written so that every fit of every arm reads it.

    Rows that share a ``group`` stay in one fold; without one, rows are dealt singly.

    Partitioned by fold: training and held-out rows are partition-pruned scans. ``df`` is evaluated
    once: it is written first, and the folds are numbered from what is written.
    """
    source = materialize(df, "source")
    if group is None:
        folded = stratified_folds(source, id_col, label, k, seed)
    else:
        folded = group_folds(source, id_col, group, label, k, seed)
    return materialize(folded, "folded", partition_by=("fold",))


def in_threads(spark, task: Callable, arguments: Sequence, parallelism: int) -> list:
    """``task`` of every argument, some side by side, each with local properties of its own.

    The wrapper copies the properties when it is made, and a thread that runs under it uses that
    very copy. So every task gets its own wrapper: tasks that shared one would see each other's
    job ids and tags.
    """
    wrapped = [inheritable_thread_target(spark)(partial(task, a)) for a in arguments]
    with ThreadPool(max(1, min(parallelism, len(wrapped)))) as pool:
        return pool.map(lambda run: run(), wrapped, chunksize=1)


def out_of_fold(
    folded: DataFrame,
    arms: Sequence[Arm],
    id_col: str,
    label: str,
    k: int = 5,
    parallelism: int = PARALLELISM,
) -> DataFrame:
    """Fit every arm on k - 1 folds and score the remaining one: ``(run, fold, id, label, score)``.

    Each fit is itself a distributed job; ``parallelism`` is how many run side by side. Target
    statistics are encoded for all folds in one pass; dictionaries and fill values are learnt once
    per fold, and all arms of a fold score it in one scan. Every row is scored once per arm, by a
    model and encodings that have not seen it or the labels of its fold. An arm with stages is fitted
    once per fold and gives a run for each of them.
    """
    runs = [run for arm in arms for run in arm.runs]
    if len(set(runs)) < len(runs) or len({arm.run for arm in arms}) < len(arms):
        raise ValueError(f"run names are not unique: {runs}")
    outs = [f"_score_{i}" for i in range(len(runs))]
    refuse_columns(folded, (LABEL, *outs))
    spark = folded.sparkSession
    stats = list(dict.fromkeys(c for arm in arms for c in arm.target_stat))
    orders = shared_orders(arms)
    encoded = _encode_folds(folded, stats, id_col, label, k, orders) if stats else folded

    def rows_for(fold: int, part: DataFrame) -> DataFrame:
        own = {stat_name(c): F.element_at(_stats_name(c), fold + 1) for c in stats}
        return part.withColumns(own).drop(*map(_stats_name, stats)) if stats else part

    def prepare(fold: int) -> TrainingRows:
        train = rows_for(fold, training_rows(encoded, fold))
        return prepare_training(train, arms, id_col, label, encoded=stats)

    def fit(task: tuple[TrainingRows, Arm]) -> FittedArm:
        return fit_prepared(*task)

    prepared = in_threads(spark, prepare, range(k), parallelism)
    fitted = in_threads(
        spark, fit, [(rows, arm) for rows in prepared for arm in arms], parallelism
    )
    parts = []
    for fold in range(k):
        own = fitted[fold * len(arms) : (fold + 1) * len(arms)]
        scored = score_all(own, rows_for(fold, held_out_rows(encoded, fold)), outs)
        named = F.array(
            *[
                F.struct(F.lit(run).alias("run"), F.col(out).alias("score"))
                for run, out in zip(runs, outs, strict=True)
            ]
        )
        parts.append(
            scored.select(
                "fold",
                F.col(f"`{id_col}`").alias("id"),
                F.col(f"`{label}`").cast("int").alias("label"),
                F.explode(named).alias("_run"),
            ).select("_run.run", "fold", "id", "label", "_run.score")
        )
    return materialize(reduce(DataFrame.unionByName, parts), "out-of-fold")


def _encode_folds(
    folded: DataFrame, stats: Sequence[str], id_col: str, label: str, k: int, orders: int
) -> DataFrame:
    base = folded.withColumn(LABEL, binary_label(F.col(f"`{label}`")))
    rows = base
    for category in stats:
        if orders == 1:
            rows = fold_target_stats(
                rows, id_col, category, LABEL, k, _stats_name(category), seed=SEED, base=base
            )
            continue
        # Rows of ordinary and of hot categories are read apart, so the chain is cut between.
        rows = rows if rows is base else materialize(rows, "before-orders")
        rows = fold_target_stats_over(
            rows, id_col, category, LABEL, k, orders, _stats_name(category), seed=SEED, base=base
        )
    return materialize(rows.drop(LABEL), "target-encoded", partition_by=("fold",))


def _stats_name(category: str) -> str:
    return f"{category}__stats"


def fold_scores(scored: DataFrame) -> DataFrame:
    """``(run, fold, auc)``."""
    return roc_auc(scored, by=["run", "fold"])


def leaderboard(scores: DataFrame) -> DataFrame:
    """Mean and population std per run, best mean first."""
    return fold_summary(scores, by=["run"]).orderBy(F.desc("mean_auc"), "run")


def cross_validate(
    df: DataFrame,
    arms: Sequence[Arm],
    id_col: str,
    label: str,
    k: int = 5,
    seed: int = SEED,
    parallelism: int = PARALLELISM,
    group: str | None = None,
) -> DataFrame:
    """Fold, fit, score and measure: ``(run, fold, auc)`` for every arm."""
    folded = folded_table(df, id_col, label, k, seed, group)
    return fold_scores(out_of_fold(folded, arms, id_col, label, k, parallelism))
