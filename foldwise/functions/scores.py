"""From margins and probability vectors to one score per row."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def positive_class(probability: Column) -> Column:
    """Probability of class 1 from a learner's probability vector."""
    return vector_to_array(probability)[1]


def linear_margin(weights: Mapping[str, float], intercept: float) -> Column:
    """Intercept plus weighted sum of the named columns."""
    terms = [F.lit(weight) * F.col(f"`{name}`") for name, weight in weights.items()]
    return reduce(add, terms, F.lit(intercept))


def sigmoid(margin: Column) -> Column:
    """Logistic function."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def binary_label(label: Column) -> Column:
    """The label as 0 or 1; anything else, NULL included, stops the job."""
    shown = F.coalesce(label.cast("string"), F.lit("NULL"))
    wrong = F.raise_error(F.concat(F.lit("label is not 0 or 1: "), shown))
    return F.when(label.isin(0, 1), label.cast("int")).otherwise(wrong)
