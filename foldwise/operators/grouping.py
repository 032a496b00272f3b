"""More categories than bins: groups of categories in the order of their labels' means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.ordering import with_running_sum
from foldwise.operators.skew import ROWS_PER_PIECE, hot_keys, lookup
from foldwise.operators.target_stats import target_stat_table

# What an unseen category is encoded as: below all groups.
UNSEEN = -1


def target_groups(
    train: DataFrame, category: str, label: str, groups: int, prior: float = 0.5, weight: float = 1.0
) -> DataFrame:
    """``(lookup_key, group)``: at most ``groups`` groups, numbered by rising smoothed label mean.

    Categories in order of their mean (and name) are cut where a ``groups``-th of the rows has gone
    by; a category belongs to the group in which its first row lies. NULL is a category like others.
    For two classes and squared or logistic loss, splits between such groups are those between sets
    of categories that a tree has to try. The categories are ordered by a range-partitioned sort, so
    their number is not bounded by a task.
    """
    if groups < 1:
        raise ValueError("at least one group")
    table = target_stat_table(train, category, label)
    mean = (F.col("s") + F.lit(weight * prior)) / (F.col("n") + F.lit(weight))
    ordered = with_running_sum(table.withColumn("mean", mean), [F.col("mean"), F.col("lookup_key")], F.col("n"))
    rows = table.agg(F.sum("n").alias("_rows"))  # one row
    group = F.floor(F.col("before") * groups / F.col("_rows")).cast("int")
    return ordered.crossJoin(F.broadcast(rows)).select("lookup_key", group.alias("group"))


def apply_groups(
    df: DataFrame,
    table: DataFrame,
    id_col: str,
    category: str,
    out: str = "group",
    rows_per_piece: int = ROWS_PER_PIECE,
    base: DataFrame | None = None,
) -> DataFrame:
    """Add the group of each row's category; ``UNSEEN`` where training had none of it."""
    hot = hot_keys(df if base is None else base, category, rows_per_piece)
    found = lookup(df, table.select("lookup_key", F.col("group").alias(out)), category, id_col, hot)
    return found.withColumn(out, F.coalesce(F.col(f"`{out}`"), F.lit(UNSEEN)))
