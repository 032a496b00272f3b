"""A profile of every column of a table in one scan, from sketches that merge."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Binary logarithm of the registers of a distinct-count sketch, items of a quantile sketch, and
#: values tracked by a frequency sketch.
DISTINCT_BITS, QUANTILE_ITEMS, TRACKED_VALUES = 12, 400, 1000
#: Longer texts are told apart by a hash behind their beginning.
SHOWN_CHARS = 48

# The error bounds that the sketches' papers and library state.
#: Relative standard error of a distinct count.
DISTINCT_ERROR = 1.04 / math.sqrt(2**DISTINCT_BITS)
#: Error of a quantile's rank as a share of the rows, not exceeded with 99 % confidence.
RANK_ERROR = 2.296 / QUANTILE_ITEMS**0.9021
#: Error of a frequency as a share of the rows; none while no more values occur than are tracked.
FREQUENCY_ERROR = 3.5 / 2 ** math.ceil(math.log2(TRACKED_VALUES / 0.75))


def sketch_columns(df: DataFrame) -> DataFrame:
    """One row of counts and sketches per column of ``df``, made by one aggregate over one scan.

    Sketches of parts of a table (days, folds, files) merge by ``merge_sketches`` without reading
    the parts again. Numbers, times and booleans have quantiles; NaN counts as NULL there. Values of
    any type are counted by a 64-bit hash; maps by their JSON text.
    """
    parts = [_sketch(i, field) for i, field in enumerate(df.schema.fields)]
    if not parts:
        raise ValueError("the table has no columns")
    row = df.agg(*[part.alias(f"c{i}") for i, part in enumerate(parts)])
    return row.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(parts))])).alias("c")).select("c.*")


def _sketch(position: int, field: T.StructField) -> Column:
    raw = F.col(_quoted(field.name))
    number, text = _number(field), _text(field)
    nested = isinstance(field.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))
    hashed = F.xxhash64(text if nested else raw)
    known = raw.isNotNull()
    top = f"approx_top_k_accumulate(value, {TRACKED_VALUES})"
    frequent = F.expr(top.replace("value", _text_sql(field))).alias("frequent")
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(field.name).alias("column"),
        F.lit(field.dataType.simpleString()).alias("dtype"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count(raw).alias("n_known"),
        F.min(text).alias("least_text"),
        F.max(text).alias("greatest_text"),
        F.count(number).alias("n_numbers"),
        F.min(number).alias("least"),
        F.max(number).alias("greatest"),
        F.avg(number).alias("mean"),
        F.var_pop(number).alias("variance"),
        F.hll_sketch_agg(F.when(known, hashed), DISTINCT_BITS).alias("distinct"),
        F.kll_sketch_agg_double(number, QUANTILE_ITEMS).alias("quantiles"),
        frequent,
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _number(field: T.StructField) -> Column:
    """The column as a double; NULL of that type where it is none."""
    raw, kind = F.col(_quoted(field.name)), field.dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(raw), raw.cast("double"))
    if isinstance(kind, T.NumericType):
        return raw.cast("double")
    if isinstance(kind, T.BooleanType):
        return raw.cast("int").cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(raw).cast("double")
    if isinstance(kind, T.TimestampType):
        return raw.cast("double")
    if isinstance(kind, T.TimestampNTZType):
        since = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), raw)
        return since.cast("double") / 1e6
    return F.lit(None).cast("double")


def _text_sql(field: T.StructField) -> str:
    name = _quoted(field.name)
    nested = isinstance(field.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))
    value = f"to_json(struct({name}))" if nested else f"CAST({name} AS STRING)"
    long = f"concat(left({value}, {SHOWN_CHARS}), '~', hex(xxhash64({value})))"
    return f"(CASE WHEN {name} IS NULL THEN NULL WHEN length({value}) > 64 THEN {long} ELSE {value} END)"


def _text(field: T.StructField) -> Column:
    return F.expr(_text_sql(field))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """Rows of ``sketch_columns`` of several parts of a table, put together per column."""
    n = F.sum("n_numbers")
    mean = F.try_divide(F.sum(F.col("mean") * F.col("n_numbers")), n)
    squares = F.sum((F.col("variance") + F.col("mean") * F.col("mean")) * F.col("n_numbers"))
    return sketches.groupBy("position", "column", "dtype").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_known").alias("n_known"),
        F.min("least_text").alias("least_text"),
        F.max("greatest_text").alias("greatest_text"),
        n.alias("n_numbers"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        mean.alias("mean"),
        F.when(n > 0, F.greatest(squares / n - mean * mean, F.lit(0.0))).alias("variance"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.expr(f"approx_top_k_combine(frequent, {TRACKED_VALUES})").alias("frequent"),
    )


def read_profile(sketches: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75), top: int = 5) -> DataFrame:
    """One row per column: counts, range, moments, and what its sketches estimate.

    ``n_distinct`` is off by ``DISTINCT_ERROR`` (a standard deviation); ``quantiles`` at ``shares``
    by ``RANK_ERROR`` of the rows; ``frequent`` counts by ``FREQUENCY_ERROR`` of the rows. Everything
    else is exact. A column that is no number has no quantiles; texts show their range instead.
    """
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    quantiles = F.kll_sketch_get_quantile_double("quantiles", wanted)
    # The sketch counts NULL among the values; one more is asked for, and it is left out.
    frequent = F.expr(f"approx_top_k_estimate(frequent, {top + 1})")
    values = F.slice(F.filter(frequent, lambda x: x["item"].isNotNull()), 1, top)
    is_number = F.col("n_numbers") > 0
    return sketches.select(
        "position",
        "column",
        "dtype",
        "n_rows",
        (F.col("n_rows") - F.col("n_known")).alias("n_null"),
        F.hll_sketch_estimate("distinct").alias("n_distinct"),
        "least_text",
        "greatest_text",
        "least",
        "greatest",
        "mean",
        F.sqrt("variance").alias("std"),
        F.when(is_number, quantiles).alias("quantiles"),
        F.when(F.col("n_known") > 0, values).alias("frequent"),
    )


def profile(df: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75), top: int = 5) -> DataFrame:
    """``read_profile`` of a table: one scan, whatever its columns."""
    return read_profile(sketch_columns(df), shares, top)


def drift(before: DataFrame, after: DataFrame, bins: int = 10, values: int = 20) -> DataFrame:
    """``(column, kind, psi, null_change)`` of two tables' sketches, by columns that both have.

    ``psi`` is the population stability index, ``sum((q - p) ln(q / p))``. Where a column has more
    distinct values than ``values`` and they are numbers, the bins are those of the ``before``
    quantiles; else they are its most frequent values and a bin for all others. Shares are held
    above a millionth. Columns without values on either side have none.
    """
    a, b = before.alias("a"), after.alias("b")
    joined = a.join(b, F.col("a.column") == F.col("b.column"))
    numeric = (F.col("a.n_numbers") > 0) & (F.col("b.n_numbers") > 0)
    numeric = numeric & (F.hll_sketch_estimate(F.col("a.distinct")) > values)
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    # Ranks are read off a grid as fine as the sketch.
    grid = [F.lit((i + 0.5) / QUANTILE_ITEMS) for i in range(QUANTILE_ITEMS)]
    edges = F.array_distinct(F.kll_sketch_get_quantile_double(F.col("a.quantiles"), cuts))
    ranked = joined.withColumn("_edges", F.when(numeric, edges))

    def shares_of_bins(side: str) -> Column:
        quantiles = F.kll_sketch_get_quantile_double(F.col(f"{side}.quantiles"), F.array(*grid))
        ranks = F.transform(
            "_edges", lambda edge: F.size(F.filter(quantiles, lambda x: x <= edge)) / len(grid)
        )
        return _steps(F.concat(ranks, F.array(F.lit(1.0))))

    def counts_of(side: str) -> Column:
        known = F.expr(f"approx_top_k_estimate({side}.frequent, {TRACKED_VALUES})")
        return F.filter(known, lambda x: x["item"].isNotNull())

    listed = ranked.withColumns(
        {"_top": F.slice(counts_of("a"), 1, values), "_after": F.map_from_entries(counts_of("b"))}
    )
    p = F.transform("_top", lambda x: x["count"] / F.col("a.n_known"))
    q = F.transform("_top", lambda x: F.coalesce(F.col("_after")[x["item"]], F.lit(0)) / F.col("b.n_known"))
    both = (F.col("a.n_known") > 0) & (F.col("b.n_known") > 0)
    shares = F.when(numeric, F.struct(shares_of_bins("a").alias("p"), shares_of_bins("b").alias("q")))
    shares = shares.when(both, F.struct(_with_rest(p).alias("p"), _with_rest(q).alias("q")))
    null_share = [1 - F.try_divide(F.col(f"{s}.n_known"), F.col(f"{s}.n_rows")) for s in "ab"]
    return listed.withColumn("_shares", shares).select(
        F.col("a.position").alias("position"),
        F.col("a.column").alias("column"),
        F.when(numeric, "quantiles").otherwise("values").alias("kind"),
        F.aggregate(
            F.zip_with("_shares.p", "_shares.q", _index_term), F.lit(0.0), lambda total, x: total + x
        ).alias("psi"),
        (null_share[1] - null_share[0]).alias("null_change"),
    )


def _index_term(p: Column, q: Column) -> Column:
    least = F.lit(1e-6)
    p, q = F.greatest(p, least), F.greatest(q, least)
    return (q - p) * F.log(q / p)


def _steps(ranks: Column) -> Column:
    """Shares between increasing ranks, from 0."""
    return F.transform(
        ranks, lambda rank, i: rank - F.when(i > 0, F.get(ranks, i - 1)).otherwise(F.lit(0.0))
    )


def _with_rest(shares: Column) -> Column:
    rest = 1.0 - F.aggregate(shares, F.lit(0.0), lambda total, x: total + x)
    return F.concat(shares, F.array(rest))
