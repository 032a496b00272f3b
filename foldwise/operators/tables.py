"""Column and row selections of a classification table, and checks on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.sources.schema import TableSpec
from foldwise.sources.tables import Bundle


def split_label(
    df: DataFrame, id_col: str, label: str, label_is_last: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Features (the label dropped by name) and ``(id, label)``; both keep the id.

    With ``label_is_last`` a table whose label is elsewhere is refused, because taking the last
    column and dropping by name would then disagree.
    """
    if label_is_last and df.columns[-1] != label:
        raise ValueError(f"label {label!r} is not the last column of {df.columns}")
    return df.drop(label), df.select(f"`{id_col}`", F.col(f"`{label}`").cast("int").alias("label"))


def refuse_columns(df: DataFrame, names: Sequence[str]) -> None:
    """An error for columns whose names an operator needs for its own."""
    taken = sorted(set(names) & set(df.columns))
    if taken:
        raise ValueError(f"these column names are reserved, rename them: {taken}")


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns by name; a name the table does not have is an error."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return df.drop(*names)


def scan_profile(
    df: DataFrame, ranged: Mapping[str, str], distinct: Mapping[str, str]
) -> DataFrame:
    """Row count, exact distinct counts and value ranges in one pass.

    ``distinct`` maps an output name to a column, ``ranged`` maps a suffix to a column and gives
    ``min_<suffix>`` and ``max_<suffix>``.
    """
    counted = [F.countDistinct(f"`{c}`").alias(n) for n, c in distinct.items()]
    ranges = [
        f(f"`{c}`").alias(f"{name}_{n}")
        for n, c in ranged.items()
        for name, f in (("min", F.min), ("max", F.max))
    ]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *counted, *ranges)


def bundle_check(bundle: Bundle, spec: TableSpec) -> DataFrame:
    """One row per table: its size, id defects, label defects and column differences."""
    needed = {
        "train": [spec.id, spec.label, *spec.features],
        "test": [spec.id, *spec.features],
        "sample": [spec.id, spec.label],
    }
    tables = {"train": bundle.train, "test": bundle.test, "sample": bundle.sample}
    checks = [
        _check_table(role, table, needed[role], spec)
        for role, table in tables.items()
        if table is not None
    ]
    return reduce(DataFrame.unionByName, checks)


def _check_table(role: str, table: DataFrame, needed: list[str], spec: TableSpec) -> DataFrame:
    missing = ",".join(c for c in needed if c not in table.columns)
    extra = ",".join(c for c in table.columns if c not in needed)
    wrong_label = F.lit(None)
    if spec.label in table.columns:
        value = F.col(f"`{spec.label}`")
        allowed = value.isin(0, 1) if role == "train" else value.between(0, 1)
        wrong_label = F.when(F.coalesce(allowed, F.lit(False)), None).otherwise(1)
    return table.agg(
        F.lit(role).alias("role"),
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(f"`{spec.id}`").alias("n_ids"),
        F.count(F.when(F.col(f"`{spec.id}`").isNull(), 1)).alias("n_null_ids"),
        F.count(wrong_label).alias("n_wrong_labels"),
        F.lit(missing).alias("missing_columns"),
        F.lit(extra).alias("extra_columns"),
    )
