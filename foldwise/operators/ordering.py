"""Numbers and running sums over a whole table in order, without one task that sees it all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.tables import refuse_columns
from foldwise.workspace import materialize

# monotonically_increasing_id keeps the row's place within its partition in the lower 33 bits.
_PLACE_BITS = 33
_OWN = ("_place", "_part", "_within", "_size", "_start", "_sum", "_before")


def in_order(df: DataFrame, order: Sequence[Column], name: str = "in-order") -> DataFrame:
    """The rows with ``_part`` and ``_within``: a range-partitioned sort, written out.

    It is written because places and sizes must come from the same run of the sort. ``order`` must
    be total for the places to be determined; rows that tie in its first columns are still split
    over tasks by the later ones.
    """
    refuse_columns(df, [c for c in _OWN if c != "_sum"])
    placed = df.sort(*order).withColumn("_place", F.monotonically_increasing_id())
    written = materialize(placed, name)
    return written.withColumns(
        {
            "_part": F.shiftright("_place", _PLACE_BITS),
            "_within": F.col("_place").bitwiseAND(F.lit(2**_PLACE_BITS - 1)),
        }
    ).drop("_place")


def with_row_number(df: DataFrame, order: Sequence[Column], out: str = "number") -> DataFrame:
    """Add the row's number in ``order``, from 0."""
    ordered = in_order(df, order)
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    numbered = ordered.join(F.broadcast(_starts(sizes)), "_part")
    return numbered.withColumn(out, F.col("_start") + F.col("_within")).drop("_part", "_within", "_start")


def with_running_sum(df: DataFrame, order: Sequence[Column], value: Column, out: str = "before") -> DataFrame:
    """Add the sum of ``value`` over the rows before in ``order``, 0 for the first."""
    refuse_columns(df, ["_sum"])
    ordered = in_order(df.withColumn("_sum", value), order)
    sizes = ordered.groupBy("_part").agg(F.sum("_sum").alias("_size"))
    earlier = Window.partitionBy("_part").orderBy("_within").rowsBetween(Window.unboundedPreceding, -1)
    running = ordered.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    summed = running.join(F.broadcast(_starts(sizes)), "_part")
    total = F.col("_start") + F.col("_before")
    return summed.withColumn(out, total).drop("_part", "_within", "_start", "_sum", "_before")


def _starts(sizes: DataFrame) -> DataFrame:
    """What lies before each partition of the sort: one row per partition."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
