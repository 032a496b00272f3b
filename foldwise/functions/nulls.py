"""How missing and non-finite numbers reach a learner.

MLlib's learners reject NULL, NaN and infinities. Trees get a value below the training minimum,
so that missing rows stay together on one side of a split; linear models get the training mean
plus an indicator column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite_sql(column: str) -> str:
    """The column as a double, with NaN and infinities turned to NULL, as SQL text."""
    number = f"CAST(`{column}` AS DOUBLE)"
    infinite = f"abs({number}) = DOUBLE('Infinity')"
    return f"CASE WHEN NOT (isnan({number}) OR {infinite}) THEN {number} END"


@dataclass(frozen=True)
class NullFill:
    """Fill values learnt from training rows, one per numeric column."""

    values: dict[str, float]
    flag_missing: bool

    @property
    def outputs(self) -> list[str]:
        names = [filled_name(c) for c in self.values]
        if self.flag_missing:
            names += [missing_name(c) for c in self.values]
        return names

    def stage(self) -> SQLTransformer:
        """The fill as a pipeline stage, so that it is saved along with the model."""
        parts = []
        for column, value in self.values.items():
            finite = finite_sql(column)
            parts.append(f"coalesce({finite}, {value!r}D) AS `{filled_name(column)}`")
            if self.flag_missing:
                parts.append(f"CAST({finite} IS NULL AS DOUBLE) AS `{missing_name(column)}`")
        return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def filled_name(column: str) -> str:
    return f"{column}__filled"


def missing_name(column: str) -> str:
    return f"{column}__missing"


def fill_aggregates(columns: Sequence[str], for_trees: bool) -> list[Column]:
    """The aggregates over training rows that fill values come from, in column order."""
    aggregate = F.min if for_trees else F.avg
    return [aggregate(F.expr(finite_sql(c))) for c in columns]


def null_fill(columns: Sequence[str], known: Sequence[float | None], for_trees: bool) -> NullFill:
    """Fill values from the results of ``fill_aggregates``."""
    values = {c: 0.0 if v is None else v for c, v in zip(columns, known, strict=True)}
    if for_trees:
        values = {c: _below(v) for c, v in values.items()}
    return NullFill(values, flag_missing=not for_trees)


def _below(value: float) -> float:
    """One less, or the next double below where that is the same number."""
    less = value - 1.0
    return less if less < value else math.nextafter(value, -math.inf)
