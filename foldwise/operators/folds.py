"""Deterministic stratified folds and the row selections built on them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.hashing import hash_position, order_hash
from foldwise.functions.scores import binary_label
from foldwise.operators.metrics import running_before
from foldwise.operators.ordering import with_row_number
from foldwise.operators.skew import ROWS_PER_PIECE as SPLIT_ROWS
from foldwise.operators.skew import hot_keys, lookup
from foldwise.operators.tables import refuse_columns
from foldwise.workspace import materialize

# Rows that are numbered in one piece: pieces grow with the table.
ROWS_PER_PIECE = 250_000


def stratified_folds(
    df: DataFrame,
    id_col: str,
    label: str,
    k: int = 5,
    seed: int = 96,
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """Add ``fold``: rows in order of label, seeded hash of the id, and id are dealt to ``k`` folds.

    Each class is spread over the folds to within one row. Equal to numbering the whole table in
    that order, but each class is cut into pieces of equal hash ranges: count the pieces, add up
    the counts, and number the rows inside a piece. Ids must be unique (see ``duplicate_ids``).

    The folds do not depend on ``rows_per_piece``. ``df`` is read three times (its size, the sizes
    of the pieces, the rows): pass a written table, as ``folded_table`` does.
    """
    refuse_columns(df, ("fold", "_class", "_piece", "_n", "_start", "_rank"))
    pieces = 1 + df.count() // rows_per_piece
    digest = order_hash(F.col(f"`{id_col}`"), seed)
    piece = F.floor(hash_position(digest) * F.lit(pieces)).cast("int")
    cut = df.withColumns({"_class": binary_label(F.col(f"`{label}`")), "_piece": piece})

    starts = _piece_starts(cut.groupBy("_class", "_piece").agg(F.count(F.lit(1)).alias("_n")), pieces)

    # The digest is computed again after the exchange, so the shuffle does not carry it.
    placed = cut.repartition("_class", "_piece")
    in_piece = Window.partitionBy("_class", "_piece").orderBy(digest, F.col(f"`{id_col}`"))
    numbered = placed.withColumn("_rank", F.row_number().over(in_piece) - 1)
    dealt = ((F.col("_start") + F.col("_rank")) % k).cast("int")
    # The rows are dealt by these keys already, so the join moves the starts only.
    return numbered.join(starts.hint("merge"), ["_class", "_piece"]).select(
        *[F.col(f"`{c}`") for c in df.columns], dealt.alias("fold")
    )


def _piece_starts(sizes: DataFrame, pieces: int) -> DataFrame:
    """Rows before each piece, added up in groups of pieces and then over the groups.

    A task sees the square root of the number of pieces: some thousand for 10^12 rows.
    """
    group = F.floor(F.col("_piece") / F.lit(math.isqrt(pieces) + 1)).cast("int")
    placed = sizes.withColumn("_group", group)
    inside = Window.partitionBy("_class", "_group").orderBy("_piece")
    across = Window.orderBy("_class", "_group")
    groups = placed.groupBy("_class", "_group").agg(F.sum("_n").alias("_n"))
    groups = groups.select("_class", "_group", running_before(F.col("_n"), across).alias("_earlier"))
    within = running_before(F.col("_n"), inside)
    joined = placed.withColumn("_within", within).join(groups, ["_class", "_group"])
    return joined.select("_class", "_piece", (F.col("_earlier") + F.col("_within")).alias("_start"))


def group_folds(
    df: DataFrame,
    id_col: str,
    group: str,
    label: str,
    k: int = 5,
    seed: int = 96,
    buckets: int = 8,
    rows_per_piece: int = SPLIT_ROWS,
) -> DataFrame:
    """Add ``fold`` so that no group is in two folds; NULL is a group of its own.

    Groups fall into ``buckets`` by their share of positives; in each, from the largest to the
    smallest, they are dealt to the folds forth and back. So in every bucket the folds' numbers of
    rows differ by less than its largest group holds, and their shares of positives by at most
    ``1 / buckets``. A group too large for a fold makes its fold too large; it is never cut.

    The groups are numbered by a range-partitioned sort, and their folds joined to the rows with hot
    groups spread by id, so neither a bucket nor a group has to fit a task. ``df`` is read three
    times: pass a written table.
    """
    refuse_columns(df, ("fold", "lookup_key", "_class", "_rows", "_positive", "_bucket", "_number"))
    key = F.col(f"`{group}`").cast("string")
    counted = df.groupBy(key.alias("lookup_key")).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(binary_label(F.col(f"`{label}`"))).alias("_positive")
    )
    share = F.floor(F.col("_positive") * buckets / F.col("_rows")).cast("int")
    counted = counted.withColumn("_bucket", F.least(share, F.lit(buckets - 1)))
    named = F.coalesce("lookup_key", F.lit(""))
    order = [F.col("_bucket"), F.desc("_rows"), order_hash(named, seed), F.col("lookup_key")]
    numbered = with_row_number(counted, order, "_number")
    numbered = materialize(numbered, "numbered-groups")
    firsts = numbered.groupBy("_bucket").agg(F.min("_number").alias("_first"))  # a row per bucket
    place = F.col("_number") - F.col("_first")
    turn, step = F.floor(place / k), place % k
    # Every bucket begins with another fold.
    dealt = (F.when(turn % 2 == 0, step).otherwise(k - 1 - step) + F.col("_bucket")) % k
    table = numbered.join(F.broadcast(firsts), "_bucket").select("lookup_key", dealt.cast("int").alias("fold"))
    table = materialize(table, "group-folds")
    return lookup(df, table, group, id_col, hot_keys(df, group, rows_per_piece))


def training_rows(folded: DataFrame, fold: int) -> DataFrame:
    """Rows outside the fold."""
    return folded.where(F.col("fold") != fold)


def held_out_rows(folded: DataFrame, fold: int) -> DataFrame:
    """Rows of the fold."""
    return folded.where(F.col("fold") == fold)


def fold_class_counts(folded: DataFrame, label: str) -> DataFrame:
    """Rows per fold and class."""
    return folded.groupBy("fold", f"`{label}`").agg(F.count(F.lit(1)).alias("n"))


def fold_sizes(folded: DataFrame) -> DataFrame:
    """Training and held-out rows of each fold."""
    sizes = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n_valid"))
    everything = F.sum("n_valid").over(Window.partitionBy())
    return sizes.select("fold", (everything - F.col("n_valid")).alias("n_train"), "n_valid")
