"""Held-out accuracy of the compression classifier, and rows it must not fail on."""

import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from foldwise.llm import quality
from foldwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_scores_rank_held_out_labels(spark):
    scored = QUERIES["op1_compression_quality"](spark, SF).collect()
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in scored)
    pairs = [(r.score, known[r.doc_id]) for r in scored if r.held_out and r.doc_id in known]
    good = np.array([s for s, y in pairs if y == 1])
    bad = np.array([s for s, y in pairs if y == 0])
    assert (good[:, None] > bad[None]).mean() > 0.9
    assert (good >= 0.3).mean() > 0.97


def test_scores_are_the_calibrated_size_difference(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(docs, labels, "doc_id", "text", "quality")
    rows = docs.select("text", quality.quality_score(model, F.col("text")).alias("s")).collect()

    def size(text, dictionary):
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=given).compress(text.encode()))

    low, slope = model.weights
    assert slope > 0
    pairs = []
    for r in rows[::5]:
        if r.text:
            d = (size(r.text, model.bad) - size(r.text, model.good)) / size(r.text, b"")
            assert abs(r.s - 1 / (1 + np.exp(-np.clip(low + slope * d, -30, 30)))) < 1e-9
            pairs.append((d, r.s))
    pairs.sort()
    assert len(pairs) > 150 and all(a[1] <= b[1] for a, b in zip(pairs, pairs[1:]))


def test_hard_rows_and_labels_without_both_classes(spark, hard, empty):
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 0)], "doc_id long, quality int")
    model = quality.fit_quality(hard, labels, "doc_id", "text", "quality")
    score = quality.quality_score(model, F.col("text"))
    assert {r.s for r in hard.select(score.alias("s")).collect()} == {model.empty_score}
    assert empty.select(score.alias("s")).collect() == []
    both = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    model = quality.fit_quality(hard, both, "doc_id", "text", "quality")
    rows = hard.select("text", quality.quality_score(model, F.col("text")).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in rows)
    assert len({r.s for r in rows if not r.text}) == 1
