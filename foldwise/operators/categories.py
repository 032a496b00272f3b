"""Category dictionaries and one-hot indicators, always learnt from training rows only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.skew import ROWS_PER_PIECE, hot_keys, lookup
from foldwise.workspace import materialize

# monotonically_increasing_id keeps the row's place within its partition in the lower 33 bits.
_PLACE_BITS = 33


def category_dictionary(train: DataFrame, column: str) -> DataFrame:
    """``(category, category_idx)``: dense indices in alphabetical order, for any cardinality.

    The distinct values are range-partitioned and sorted; a value's index is its place in its
    partition plus the sizes of the partitions before. The sorted table is written out first, since
    places and sizes must come from the same run of the sort.
    """
    distinct = train.select(F.col(f"`{column}`").cast("string").alias("category")).distinct()
    ordered = distinct.where(F.col("category").isNotNull()).sort("category")
    place = F.monotonically_increasing_id()
    placed = materialize(ordered.select("category", place.alias("place")), "dictionary")
    placed = placed.select(
        "category",
        F.shiftright("place", _PLACE_BITS).alias("part"),
        F.col("place").bitwiseAND(F.lit(2**_PLACE_BITS - 1)).alias("within"),
    )
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort, so the table's size is bounded by the partition count.
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").select(
        "category", (F.col("start") + F.col("within")).cast("int").alias("category_idx")
    )


def index_categories(
    df: DataFrame,
    id_col: str,
    column: str,
    dictionary: DataFrame,
    rows_per_piece: int = ROWS_PER_PIECE,
    out: str = "category_idx",
    size: int | None = None,
) -> DataFrame:
    """Add the index; unseen and NULL categories share the one after the last.

    ``size`` is the dictionary's size, for callers that have counted it.
    """
    last = F.lit(size)
    if size is None:
        last = dictionary.agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    hot = hot_keys(df, column, rows_per_piece)
    table = dictionary.select(F.col("category").alias("lookup_key"), F.col("category_idx").alias(out))
    found = lookup(df, table, column, id_col, hot)
    return found.withColumn(out, F.coalesce(F.col(f"`{out}`"), last))


def vocabulary(
    train: DataFrame, columns: Sequence[str], limits: Sequence[int]
) -> dict[str, list[str]]:
    """Sorted categories of each column; an error names columns with more than their limit.

    For categories declared to be few: at most one more than the limit reaches the driver.
    """
    values: dict[str, list[str]] = {c: [] for c in columns}
    if not values:
        return values
    found = [
        train.select(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("category"))
        .where(F.col("category").isNotNull())
        .distinct()
        .limit(limit + 1)
        for i, (c, limit) in enumerate(zip(columns, limits, strict=True))
    ]
    for row in reduce(DataFrame.unionByName, found).collect():
        values[columns[row.i]].append(row.category)
    over = [c for c, limit in zip(columns, limits, strict=True) if len(values[c]) > limit]
    if over:
        raise ValueError(f"more categories than declared possible in {over}")
    return {c: sorted(v) for c, v in values.items()}


def index_stages(categories: dict[str, list[str]]) -> list[StringIndexerModel]:
    """Nominal indices ``<column>__idx`` over known categories.

    Unseen and NULL values go to one index after the last. A model per column, because a
    many-column model made from label lists pads the shorter lists with NULL labels.
    """
    return [
        StringIndexerModel.from_labels(
            values, inputCol=column, outputCol=f"{column}__idx", handleInvalid="keep"
        )
        for column, values in categories.items()
    ]


def one_hot_encoder(sizes: dict[str, int]) -> OneHotEncoder:
    """Sparse indicators ``<column>__hot`` of the indices ``<column>__code``.

    A slot per training category, none for the rest: unseen and NULL values have the index after
    the last, and the encoder drops that one. See ``with_sizes`` for what tells it the sizes.
    """
    return OneHotEncoder(
        inputCols=[f"{c}__code" for c in sizes],
        outputCols=[f"{c}__hot" for c in sizes],
        handleInvalid="error",
        dropLast=True,
    )


def with_sizes(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The indices with their number of categories attached, so that no pass has to find it."""
    for column, size in sizes.items():
        name = f"{column}__code"
        attribute = {"type": "nominal", "name": name, "num_vals": size + 1}
        df = df.withColumn(name, F.col(f"`{name}`").cast("double"))
        df = df.withMetadata(name, {"ml_attr": attribute})
    return df


def one_hot_columns(
    df: DataFrame, categories: dict[str, list[str]], names: dict[str, list[str]] | None = None
) -> DataFrame:
    """Indicators as 0/1 columns, ``<column>_<category>`` unless ``names`` says otherwise.

    Unseen and NULL categories are 0 in all of them.
    """
    out = [F.col(f"`{c}`") for c in df.columns if c not in categories]
    for column, values in categories.items():
        labels = names[column] if names else [f"{column}_{v}" for v in values]
        own = F.col(f"`{column}`").cast("string")
        out += [
            own.eqNullSafe(F.lit(value)).cast("int").alias(label)
            for value, label in zip(values, labels, strict=True)
        ]
    return df.select(*out)


def align_categories(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """What one-hot alignment does with each category: keep, fill with zeros, or drop.

    A full outer join of two distinct sets, done as one aggregate over both.
    """
    def tagged(df: DataFrame, in_train: bool) -> DataFrame:
        value = F.col(f"`{column}`").cast("string").alias("category")
        return df.select(value, F.lit(in_train).alias("t"), F.lit(not in_train).alias("s"))

    both = tagged(train, True).unionByName(tagged(test, False)).where("category IS NOT NULL")
    seen = both.groupBy("category").agg(F.max("t").alias("t"), F.max("s").alias("s"))
    action = F.when(~F.col("s"), "zero_fill").when(~F.col("t"), "drop").otherwise("keep")
    return seen.select("category", action.alias("action"))
