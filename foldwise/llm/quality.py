"""Quality scores from the sizes that zstandard dictionaries of good and bad text compress to."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of what a fit reads: rows per class for the dictionaries, rows per class for the
#: calibration, and the longest text (in characters) that is taken for either.
DICTIONARY_ROWS = 1000
CALIBRATION_ROWS = 4000
MAX_CHARS = 20_000
DICTIONARY_BYTES = 110_000
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries, and intercept and slope of their size difference; a few hundred kB."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    empty_score: float


class _Sizes:
    """Compressors are made once per Python worker and model."""

    def __init__(self, model: QualityModel) -> None:
        def compressor(content: bytes | None) -> zstandard.ZstdCompressor:
            if not content:
                return zstandard.ZstdCompressor(level=LEVEL)
            given = zstandard.ZstdCompressionDict(content)
            given.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=given)

        self.good, self.bad, self.none = map(compressor, (model.good, model.bad, None))

    def difference(self, text: str) -> float:
        """How many more bytes the bad dictionary needs, over the size without a dictionary."""
        raw = text.encode("utf-8", "surrogatepass")
        good, bad, none = (len(c.compress(raw)) for c in (self.good, self.bad, self.none))
        return (bad - good) / none


def size_differences(model: QualityModel, texts: Iterable[str | None]) -> np.ndarray:
    """The normalised compressed-size differences of texts; 0 for NULL and empty ones."""
    sizes = _Sizes(model)
    return np.array([sizes.difference(t) if t else 0.0 for t in texts], float)


def _dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary, or the joined texts themselves where they are too few to train on."""
    samples = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[:size]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps on the bounded calibration sample.

    The first column of ``x`` is the intercept; the others are scaled for the fit.
    """
    middle, spread = x.mean(axis=0), x.std(axis=0)
    middle[0], spread[0] = 0, 1
    spread[spread == 0] = 1
    z = (x - middle) / spread
    beta, held = np.zeros(z.shape[1]), ridge * np.r_[0, np.ones(z.shape[1] - 1)]

    def loss(b: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ b)) + held @ b**2 / 2)

    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (weight * (y - p)) - held * beta
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(held + 1e-9)
        step, now = np.linalg.solve(curve, slope), loss(beta)
        while loss(beta + step) > now and np.abs(step).max() > 1e-8:
            step /= 2
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    scaled = beta / spread
    scaled[0] = beta[0] - (scaled[1:] * middle[1:]).sum()
    return scaled


def held_out(id_column: F.Column) -> F.Column:
    """Rows never learned from: ``crc32`` of the id's text divides by 5. A NULL id is held out."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 0, F.lit(True))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    dictionary_rows: int = DICTIONARY_ROWS,
    calibration_rows: int = CALIBRATION_ROWS,
    max_chars: int = MAX_CHARS,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> QualityModel:
    """Learn from a bounded sample of labelled rows; what the sample is does not depend on row order.

    Per class, ``dictionary_rows`` labelled rows (at most half) make a dictionary and further
    ``calibration_rows`` rows, weighted up to the class's share of all labels, calibrate. Rows are
    taken in the order of a hash of the id. Texts longer than ``max_chars`` are not learned from.
    NULL, empty and unlabelled rows are not learned from; held-out ids neither. Without both
    classes the score is the share of good labels (0.5 without any).
    """
    known = labels.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")
    ).where((~held_out(F.col("id"))) & F.col("y").isin(0, 1))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    counted = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counted.values())
    prior = counted.get(1, 0) / total if total else 0.5
    order = F.xxhash64(F.lit(7), "id")
    rows = dictionary_rows + calibration_rows
    parts = [known.where(F.col("y") == y).orderBy(order, "id").limit(rows) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    text = F.col(f"`{text_col}`")
    sampled = (
        docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
        .where(F.col("text").isNotNull() & (F.length("text").between(1, max_chars)))
        .join(F.broadcast(chosen), "id")  # at most two classes of ``rows`` ids
    )
    half = {y: min(dictionary_rows, (counted.get(y, 0) + 1) // 2) for y in (0, 1)}
    first = (
        chosen.withColumn("place", F.row_number().over(Window.partitionBy("y").orderBy(order, "id")))
        .where(F.col("place") <= F.when(F.col("y") == 1, half[1]).otherwise(half[0]))
        .select("id")
    )
    learn = sampled.join(F.broadcast(first), "id", "left_semi").collect()
    learn.sort(key=lambda r: (r.id, r.text))
    texts = {y: [r.text for r in learn if r.y == y] for y in (0, 1)}
    if not texts[0] or not texts[1]:
        return QualityModel(b"", b"", (), prior)
    blank = QualityModel(
        _dictionary(texts[1], dictionary_bytes), _dictionary(texts[0], dictionary_bytes), (), prior
    )

    @F.pandas_udf("double")
    def sizes(given: pd.Series) -> pd.Series:
        return pd.Series(size_differences(blank, given))

    rest = sampled.join(F.broadcast(first), "id", "left_anti")
    measured = rest.select("id", "y", sizes("text").alias("x")).collect()
    if len({r.y for r in measured}) < 2:  # too few labels to keep some apart
        measured = sampled.select("id", "y", sizes("text").alias("x")).collect()
    measured.sort(key=lambda r: (r.id, r.x))
    x = np.array([[1.0, r.x] for r in measured])
    y = np.array([r.y for r in measured], float)
    share = {c: counted[c] / max(1, (y == c).sum()) for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    beta = _logistic(x, y, weight * len(y) / weight.sum())
    return QualityModel(blank.good, blank.bad, tuple(float(b) for b in beta), prior)


def quality_score(model: QualityModel, text: F.Column) -> F.Column:
    """Score from 0 to 1 of a text column, a logistic function of its size difference alone.

    NULL and empty texts score the share of good labels."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not model.weights:
            return pd.Series(np.full(len(texts), model.empty_score))
        margin = model.weights[0] + model.weights[1] * size_differences(model, texts)
        scores = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return pd.Series(np.where([bool(t) for t in texts], scores, model.empty_score))

    return score(text)
