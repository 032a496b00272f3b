"""Importance of a column for any fitted arm: the AUC that is lost when its values are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.hashing import order_hash
from foldwise.operators.learners import SEED, FittedArm
from foldwise.operators.metrics import roc_auc, score_cuts
from foldwise.operators.ordering import with_row_number
from foldwise.operators.tables import refuse_columns
from foldwise.workspace import materialize


def with_partner(df: DataFrame, id_col: str, columns: Sequence[str], seed: int = SEED) -> DataFrame:
    """Add ``_partner``, a struct of ``columns`` of another row; every row is the partner of one.

    The rows are numbered in two seeded orders of their ids, and those of one number are put
    together: a seeded permutation that depends on the ids alone, made by two sorts and an
    equi-join. A row can be its own partner. Ids must be unique.
    """
    refuse_columns(df, ("_partner", "_number"))
    key = F.col(f"`{id_col}`")
    partner = F.struct(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    rows = with_row_number(df, [order_hash(key, seed), key], "_number")
    others = df.select(key.alias("_key"), partner.alias("_partner"))
    other = F.col("_key")
    others = with_row_number(others, [order_hash(other, seed + 1), other], "_number").drop("_key")
    return rows.join(others, "_number").drop("_number")


def permutation_importance(
    fitted: FittedArm,
    df: DataFrame,
    id_col: str,
    label: str,
    columns: Sequence[str] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``(run, feature, auc, auc_loss, rank)``: AUC with a column shuffled, and how much less that is.

    For learners of any kind; ``df`` should be rows that the arm was not fitted on, and is scored
    once for each column and once as it is, in one scan. ``columns`` are table columns, all that the
    arm reads unless given. Encodings and derived features are computed from the shuffled column, so
    its loss includes theirs. All columns use the same permutation, one at a time.
    """
    arm = fitted.arm
    if columns is None:
        columns = list(dict.fromkeys((*arm.numeric, *arm.categorical, *arm.target_stat, *arm.grouped)))
    refuse_columns(df, ("_shuffled",))
    paired = materialize(with_partner(df, id_col, columns, seed), "partners")
    variants = F.explode(F.array(*[F.lit(i) for i in range(-1, len(columns))]))
    shuffled = {
        c: F.when(F.col("_shuffled") == i, F.col(f"_partner._c{i}")).otherwise(F.col(f"`{c}`"))
        for i, c in enumerate(columns)
    }
    rows = paired.withColumn("_shuffled", variants)
    rows = rows.select(
        *[shuffled.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns], "_shuffled"
    )
    scored = fitted.score(rows, "_score").select("_shuffled", F.col(f"`{label}`").alias("label"), "_score")
    scored = materialize(scored, "shuffled-scores")
    aucs = roc_auc(scored, "_score", "label", by=["_shuffled"], cuts=score_cuts(scored, "_score"))
    aucs = materialize(aucs, "shuffled-aucs")  # a row per column
    whole = aucs.where("_shuffled < 0").select(F.col("auc").alias("_whole"))
    names = F.array(*[F.lit(c) for c in columns])
    table = aucs.where("_shuffled >= 0").crossJoin(F.broadcast(whole)).select(
        F.lit(arm.run).alias("run"),
        F.element_at(names, F.col("_shuffled") + 1).alias("feature"),
        "auc",
        (F.col("_whole") - F.col("auc")).alias("auc_loss"),
    )
    rank = F.row_number().over(Window.orderBy(F.desc("auc_loss"), "feature"))
    return table.withColumn("rank", rank).orderBy("rank")
