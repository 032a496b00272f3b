"""Keys that hold a large share of all rows, and the work that must be split because of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more rows than one task should take, so a table of N rows has fewer
# than N / ROWS_PER_PIECE hot keys: a millionth of the table, which may be broadcast.
ROWS_PER_PIECE = 1_000_000


def hot_keys(df: DataFrame, key: str, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Hot keys (as strings) and the number of pieces to cut each into: ``(hot_key, pieces)``.

    Keys and pieces grow with the table: fewer than ``n / rows_per_piece`` keys and at most twice
    as many pieces.
    """
    value = F.col(f"`{key}`").cast("string")
    counts = df.groupBy(value.alias("hot_key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > F.lit(rows_per_piece)).select(
        "hot_key", F.ceil(F.col("n") / F.lit(rows_per_piece)).cast("int").alias("pieces")
    )


def with_pieces(
    df: DataFrame, key: str, spread: str, hot: DataFrame, rows_per_piece: int = ROWS_PER_PIECE
) -> DataFrame:
    """Add ``_pieces``: the number of pieces of the row's key; NULL where the key is not hot.

    Hot keys are broadcast if they are few for any table. Smaller pieces make more of them, up to
    one per some rows: then only keys that are large by ``ROWS_PER_PIECE`` are, and the rest are
    joined by the key. Rows of large keys spread by the hash of ``spread`` (the row id).
    """
    named = hot.select(F.col("hot_key").alias("_hot"), F.col("pieces").alias("_pieces"))
    if rows_per_piece >= ROWS_PER_PIECE:
        value = F.col(f"`{key}`").cast("string")
        return df.join(F.broadcast(named), value.eqNullSafe(F.col("_hot")), "left").drop("_hot")
    large = hot.where(F.col("pieces") > F.lit(ROWS_PER_PIECE // rows_per_piece))
    return lookup(df, named.withColumnRenamed("_hot", "lookup_key"), key, spread, large)


def with_piece(
    df: DataFrame,
    key: str,
    spread: str,
    position: Column,
    hot: DataFrame,
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """Add ``_piece``: which piece of its key a row falls in; NULL where the key is not hot.

    ``position`` is a number in [0, 1) per row; pieces are equal intervals of it.
    """
    piece = F.floor(position * F.col("_pieces")).cast("int")
    return with_pieces(df, key, spread, hot, rows_per_piece).withColumn("_piece", piece).drop("_pieces")


def gathered(rows: DataFrame, rows_per_piece: int, *by: Column) -> DataFrame:
    """Rows to be added up by piece, which ``by`` names: small pieces are brought together first.

    Sums before the exchange leave next to nothing of large pieces, but of small ones about as
    many groups as rows, all in the memory of the task that reads them.
    """
    return rows if rows_per_piece >= ROWS_PER_PIECE else rows.repartition(*by)


def lookup(
    rows: DataFrame, table: DataFrame, key: str, spread: str, hot: DataFrame
) -> DataFrame:
    """Left join of ``rows`` to ``table``, which is unique on its string ``lookup_key``.

    Rows of hot keys get their values by broadcast. They still pass through the equi-join, because
    splitting them off would read ``rows`` twice, but under a key of their own that matches nothing
    and spreads by the hash of ``spread`` (the row id). All keys of the join are then small, and
    Spark may broadcast ``table`` instead. NULL keys match NULL.
    """
    values = [c for c in table.columns if c != "lookup_key"]
    same = F.col("hot_key").eqNullSafe(F.col("lookup_key"))
    # One row per hot key, also for those that the table does not have.
    matched = table.join(F.broadcast(hot.select("hot_key")), same, "left_semi")
    absent = [F.lit(None).cast(table.schema[v].dataType).alias(v) for v in values]
    hot_values = (
        hot.select(F.col("hot_key").alias("lookup_key"), *absent)
        .unionByName(matched)
        .groupBy(F.col("lookup_key").alias("_hot"))
        .agg(*[F.max(v).alias(f"_hot_{v}") for v in values], F.lit(True).alias("_is_hot"))
    )
    key_col = F.col(f"`{key}`").cast("string")
    flagged = rows.join(F.broadcast(hot_values), key_col.eqNullSafe(F.col("_hot")), "left")

    # The kind keeps NULL, hot and ordinary keys apart. A hot row's key is a hash of its own; a
    # separate salt column would not do, as equality with a constant drops out of the join keys.
    is_hot = F.col("_is_hot").isNotNull()
    own = F.xxhash64(F.col(f"`{spread}`")).cast("string")
    keyed = flagged.withColumns(
        {
            "_kind": F.when(is_hot, 2).when(key_col.isNull(), 1).otherwise(0),
            "_key": F.when(is_hot, own).otherwise(F.coalesce(key_col, F.lit(""))),
        }
    )
    entries = table.select(
        F.when(F.col("lookup_key").isNull(), 1).otherwise(0).alias("_kind"),
        F.coalesce("lookup_key", F.lit("")).alias("_key"),
        *[F.col(v).alias(f"_cold_{v}") for v in values],
    )
    joined = keyed.join(entries, ["_kind", "_key"], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        *[F.coalesce(f"_hot_{v}", f"_cold_{v}").alias(v) for v in values],
    )
