"""Target statistics: a category replaced by a smoothed mean of its labels, without leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.hashing import hash_position, order_hash
from foldwise.operators.skew import ROWS_PER_PIECE, gathered, hot_keys, lookup, with_piece


def ordered_target_stat(
    train: DataFrame,
    id_col: str,
    category: str,
    label: str,
    out: str = "stat",
    prior: float = 0.5,
    weight: float = 1.0,
    seed: int = 96,
    rows_per_piece: int = ROWS_PER_PIECE,
    base: DataFrame | None = None,
) -> DataFrame:
    """Statistic of each training row from the rows of its category that come before it.

    Order is a seeded hash of the id, so a row never sees its own label. ``(sum + weight * prior)
    / (count + weight)``. A hot category is cut into pieces by hash; the sums of the pieces before
    are added to the running sum inside a piece. NULL is a category of its own.

    ``base`` holds the same rows at less cost, if ``train`` is itself the result of a chain of
    these: sizes and sums are taken from it.
    """
    base = train if base is None else base
    hot = hot_keys(base, category, rows_per_piece)
    digest = order_hash(F.col(f"`{id_col}`"), seed)
    key = F.col(f"`{category}`")

    narrow = base.select(f"`{id_col}`", key, f"`{label}`")
    pieces = with_piece(narrow, category, id_col, hash_position(digest), hot, rows_per_piece)
    pieces = gathered(pieces.where("_piece IS NOT NULL"), rows_per_piece, key, F.col("_piece"))
    totals = pieces.groupBy(key.alias("_key"), "_piece").agg(
        F.sum(f"`{label}`").alias("_s"), F.count(f"`{label}`").alias("_n")
    )
    before = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each piece of the hot categories, which goes to the piece and stands first there.
    carried = totals.select(
        F.col("_key").alias(category),
        "_piece",
        F.lit(True).alias("_carried"),
        F.sum("_s").over(before).alias("_s0"),
        F.sum("_n").over(before).alias("_n0"),
    )

    placed = with_piece(train, category, id_col, hash_position(digest), hot, rows_per_piece)
    placed = placed.unionByName(carried, allowMissingColumns=True).repartition(key, "_piece")
    earlier = (
        Window.partitionBy(key, "_piece")
        .orderBy(F.desc("_carried"), digest, F.col(f"`{id_col}`"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    running = placed.withColumns(
        {
            "_s0": F.first("_s0").over(earlier),
            "_n0": F.first("_n0").over(earlier),
            "_s1": F.sum(f"`{label}`").over(earlier),
            "_n1": F.count(f"`{label}`").over(earlier),
        }
    ).where("_carried IS NULL")
    zero = F.lit(0)
    total = F.coalesce("_s0", zero) + F.coalesce("_s1", zero)
    count = F.coalesce("_n0", zero) + F.col("_n1")
    return running.select(*_quoted(train), _smoothed(total, count, prior, weight).alias(out))


def fold_target_stats(
    folded: DataFrame,
    id_col: str,
    category: str,
    label: str,
    k: int,
    out: str = "stats",
    prior: float = 0.5,
    weight: float = 1.0,
    seed: int = 96,
    rows_per_piece: int = ROWS_PER_PIECE,
    base: DataFrame | None = None,
) -> DataFrame:
    """The category's statistic for every held-out fold at once: ``out`` is an array of ``k``.

    Element ``f`` is what the row is encoded with when fold ``f`` is held out. For a training row
    that is ``ordered_target_stat`` over the other folds, for a row of fold ``f`` it is
    ``apply_target_stat`` from them. Leaving a fold out is a subtraction from sums kept per fold,
    so ``k`` encodings cost one exchange instead of ``k`` and the held-out rows need no join.
    """
    base = folded if base is None else base
    hot = hot_keys(base, category, rows_per_piece)
    digest = order_hash(F.col(f"`{id_col}`"), seed)
    key = F.col(f"`{category}`")
    # Label sum and row count: of all rows, and of each fold.
    sums = {"s": F.sum(f"`{label}`"), "n": F.count(f"`{label}`")}
    for f in range(k):
        own = F.when(F.col("fold") == f, F.col(f"`{label}`"))
        sums |= {f"s{f}": F.sum(own), f"n{f}": F.count(own)}

    narrow = base.select(f"`{id_col}`", key, f"`{label}`", "fold")
    pieces = with_piece(narrow, category, id_col, hash_position(digest), hot, rows_per_piece)
    pieces = gathered(pieces.where("_piece IS NOT NULL"), rows_per_piece, key, F.col("_piece"))
    totals = pieces.groupBy(key.alias("_key"), "_piece").agg(
        *[value.alias(name) for name, value in sums.items()]
    )
    whole_key = Window.partitionBy("_key")
    before = whole_key.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each piece of the hot categories, which goes to the piece and stands first there.
    carried = totals.select(
        F.col("_key").alias(category),
        "_piece",
        F.lit(True).alias("_carried"),
        *[F.sum(name).over(before).alias(f"_before_{name}") for name in sums],
        *[F.sum(name).over(whole_key).alias(f"_total_{name}") for name in sums],
    )

    placed = with_piece(folded, category, id_col, hash_position(digest), hot, rows_per_piece)
    placed = placed.unionByName(carried, allowMissingColumns=True).repartition(key, "_piece")
    whole = Window.partitionBy(key, "_piece")
    earlier = whole.orderBy(F.desc("_carried"), digest, F.col(f"`{id_col}`"))
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumns(
        {f"_run_{name}": value.over(earlier) for name, value in sums.items()}
        | {f"_all_{name}": value.over(whole) for name, value in sums.items()}
        | {f"_before_{name}": F.first(f"_before_{name}").over(earlier) for name in sums}
        | {f"_total_{name}": F.first(f"_total_{name}").over(earlier) for name in sums}
    ).where("_carried IS NULL")

    def ordered(name: str) -> str:
        return f"(coalesce(_before_{name}, 0) + coalesce(_run_{name}, 0))"

    def held_out(name: str) -> str:
        return f"coalesce(_total_{name}, _all_{name}, 0)"

    def stat(of, f: int) -> str:
        total = f"({of('s')} - {of(f's{f}')} + {weight * prior!r}D)"
        return f"{total} / ({of('n')} - {of(f'n{f}')} + {float(weight)!r}D)"

    stats = [
        F.expr(f"CASE WHEN fold = {f} THEN {stat(held_out, f)} ELSE {stat(ordered, f)} END")
        for f in range(k)
    ]
    return running.select(*_quoted(folded), F.array(*stats).alias(out))


def target_stat_table(train: DataFrame, category: str, label: str) -> DataFrame:
    """Label sum and count per category over all training rows: ``(lookup_key, s, n)``."""
    value = F.col(f"`{category}`").cast("string")
    return train.groupBy(value.alias("lookup_key")).agg(
        F.sum(f"`{label}`").alias("s"), F.count(f"`{label}`").alias("n")
    )


def apply_target_stat(
    df: DataFrame,
    table: DataFrame,
    id_col: str,
    category: str,
    out: str = "stat",
    prior: float = 0.5,
    weight: float = 1.0,
    rows_per_piece: int = ROWS_PER_PIECE,
    base: DataFrame | None = None,
) -> DataFrame:
    """Statistic of rows outside the training set; an unseen category gets the prior.

    ``base`` holds the same rows at less cost, as in ``ordered_target_stat``.
    """
    hot = hot_keys(df if base is None else base, category, rows_per_piece)
    found = lookup(df, table, category, id_col, hot)
    zero = F.lit(0)
    stat = _smoothed(F.coalesce("s", zero), F.coalesce("n", zero), prior, weight)
    return found.select(*_quoted(df), stat.alias(out))


def _smoothed(total, count, prior: float, weight: float):
    return (total + F.lit(weight * prior)) / (count + F.lit(weight))


def _quoted(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]
