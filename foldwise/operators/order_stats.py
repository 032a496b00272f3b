"""Target statistics averaged over several seeded orders, and keys made of several categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.hashing import hash_position, order_hash
from foldwise.operators.skew import ROWS_PER_PIECE, gathered, hot_keys, with_pieces
from foldwise.operators.tables import refuse_columns

_OWN = ("_hot", "_is_hot", "_kind", "_pieces", "_order", "_piece", "_carried", "_row", "_key", "_part")


def pair_key(*columns: str) -> Column:
    """One key for the values of several categories; NULL is a value like others.

    Lengths stand before the values, so different values never give the same key.
    """
    values = [F.col(f"`{c}`").cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.concat(*parts)


def with_pairs(df: DataFrame, pairs: Sequence[Sequence[str]]) -> DataFrame:
    """Add a key column for each pair (or more) of categories, named like ``Driver & Race``."""
    return df.withColumns({pair_name(pair): pair_key(*pair) for pair in pairs})


def pair_name(pair: Sequence[str]) -> str:
    return " & ".join(pair)


def ordered_target_stats(
    train: DataFrame,
    id_col: str,
    category: str,
    label: str,
    orders: int,
    out: str = "stat",
    prior: float = 0.5,
    weight: float = 1.0,
    seed: int = 96,
    rows_per_piece: int = ROWS_PER_PIECE,
    base: DataFrame | None = None,
) -> DataFrame:
    """The mean over ``orders`` seeds, from ``seed`` on, of ``ordered_target_stat``.

    A row early in one order stands later in another, so its statistic varies less. Rows of all
    orders share one exchange by the category. A hot category is cut into pieces, which differ from
    order to order: its rows are copied once per order, and the copies meet again by id. Ids must
    be unique; ``train`` and ``base`` are read for either kind of row.
    """
    found = _averaged(train, id_col, category, label, 0, orders, prior, weight, seed, rows_per_piece, base)
    return found.select(*_quoted(train), F.col("_stats")[0].alias(out))


def fold_target_stats_over(
    folded: DataFrame,
    id_col: str,
    category: str,
    label: str,
    k: int,
    orders: int,
    out: str = "stats",
    prior: float = 0.5,
    weight: float = 1.0,
    seed: int = 96,
    rows_per_piece: int = ROWS_PER_PIECE,
    base: DataFrame | None = None,
) -> DataFrame:
    """The mean over ``orders`` seeds of ``fold_target_stats``, in the same exchange for all."""
    found = _averaged(folded, id_col, category, label, k, orders, prior, weight, seed, rows_per_piece, base)
    return found.select(*_quoted(folded), F.col("_stats").alias(out))


def _averaged(df, id_col, category, label, k, orders, prior, weight, seed, rows_per_piece, base) -> DataFrame:
    """``df`` with ``_stats``: one statistic if ``k`` is 0, else one per held-out fold."""
    if orders < 1:
        raise ValueError("at least one order")
    refuse_columns(df, (*_OWN, "_stats"))
    base = df if base is None else base
    key, row_id = F.col(f"`{category}`"), F.col(f"`{id_col}`")
    digests = [order_hash(row_id, seed + j) for j in range(orders)]
    hot = hot_keys(base, category, rows_per_piece)

    def flagged(rows: DataFrame) -> DataFrame:
        return with_pieces(rows, category, id_col, hot, rows_per_piece)

    sums = {"s": F.sum(f"`{label}`"), "n": F.count(f"`{label}`")}
    for f in range(k):
        own = F.when(F.col("fold") == f, F.col(f"`{label}`"))
        sums |= {f"s{f}": F.sum(own), f"n{f}": F.count(own)}

    def stat(running, whole, f: int | None) -> Column:
        """The statistic with fold ``f`` left out; held-out rows take it from all other rows."""
        def smoothed(of) -> Column:
            total, count = of("s"), of("n")
            if f is not None:
                total, count = total - of(f"s{f}"), count - of(f"n{f}")
            return (total + F.lit(weight * prior)) / (count + F.lit(weight))

        return smoothed(running) if f is None else F.when(F.col("fold") == f, smoothed(whole)).otherwise(smoothed(running))

    wanted = list(range(k)) or [None]
    zero = F.lit(0)

    # Categories of ordinary size: a task has all their rows and puts them in every order.
    rows = flagged(df).where("_pieces IS NULL").repartition(key)
    everything = Window.partitionBy(key)
    names: dict[str, Column] = {f"_all_{n}": F.coalesce(v.over(everything), zero) for n, v in sums.items()}
    for j, digest in enumerate(digests):
        earlier = everything.orderBy(digest, row_id).rowsBetween(Window.unboundedPreceding, -1)
        names |= {f"_run{j}_{n}": F.coalesce(v.over(earlier), zero) for n, v in sums.items()}
    rows = rows.withColumns(names)
    means = []
    for f in wanted:
        each = [stat(lambda n, j=j: F.col(f"_run{j}_{n}"), lambda n: F.col(f"_all_{n}"), f) for j in range(orders)]
        means.append(sum(each[1:], each[0]) / orders)
    ordinary = rows.select(*_quoted(df), F.array(*means).alias("_stats"))

    # Hot categories: a copy per order, in the piece where the row lies in that order.
    def copied(own: DataFrame) -> DataFrame:
        own = flagged(own).where("_pieces IS NOT NULL")
        own = own.withColumn("_order", F.explode(F.array(*[F.lit(j) for j in range(orders)])))
        piece = F.floor(hash_position(_chosen(digests)) * F.col("_pieces")).cast("int")
        return own.withColumn("_piece", piece).drop("_pieces")

    narrow = base.select(row_id, key, f"`{label}`", *["fold"] * (k > 0))
    place = (key, F.col("_order"), F.col("_piece"))
    totals = gathered(copied(narrow), rows_per_piece, *place).groupBy(key.alias("_key"), "_order", "_piece")
    totals = totals.agg(*[v.alias(n) for n, v in sums.items()])
    one_order = Window.partitionBy("_key", "_order")
    before = one_order.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each piece, which goes to the piece and stands first there.
    carried = totals.select(
        F.col("_key").alias(category),
        "_order",
        "_piece",
        F.lit(True).alias("_carried"),
        *[F.coalesce(F.sum(n).over(before), zero).alias(f"_before_{n}") for n in sums],
        *[F.sum(n).over(one_order).alias(f"_total_{n}") for n in sums],
    )
    rows = copied(df).unionByName(carried, allowMissingColumns=True).where("_piece IS NOT NULL").repartition(*place)
    in_piece = Window.partitionBy(*place).orderBy(F.desc("_carried"), _chosen(digests), row_id)
    earlier = in_piece.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {f"_run_{n}": F.coalesce(v.over(earlier), zero) for n, v in sums.items()}
        | {f"_{kind}_{n}": F.first(f"_{kind}_{n}").over(earlier) for kind in ("before", "total") for n in sums}
    ).where("_carried IS NULL")
    each = [
        stat(lambda n: F.col(f"_before_{n}") + F.col(f"_run_{n}"), lambda n: F.col(f"_total_{n}"), f)
        for f in wanted
    ]
    copies = rows.select(
        F.struct(*_quoted(df)).alias("_row"), row_id.alias("_id"), "_order", F.array(*each).alias("_each")
    )
    met = copies.groupBy("_id").agg(
        F.min_by("_row", "_order").alias("_row"),
        F.array(*[F.avg(F.col("_each")[i]) for i in range(len(wanted))]).alias("_stats"),
    )
    return ordinary.unionByName(met.select("_row.*", "_stats"))


def _chosen(digests: Sequence[Column]) -> Column:
    """The digest of the copy's own order."""
    cases = F.when(F.col("_order") == 0, digests[0])
    for j, digest in enumerate(digests[1:], 1):
        cases = cases.when(F.col("_order") == j, digest)
    return cases


def _quoted(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]
