"""The stages of the corpus pipeline against brute force on what each is given."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foldwise.llm import decontamination, quality, simhash

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "best-fit packing",
    ]


def test_filters_keep_columns_and_take_effect(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(docs, labels, "doc_id", "text", "quality")
    scored = docs.select("doc_id", quality.quality_score(model, F.col("text")).alias("s")).collect()
    kept = STAGE["quality classifier"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored if r.s >= 0.3}

    groups = simhash.near_groups(docs, "doc_id", "text").collect()
    one = STAGE["SimHash near-dedup"](spark, docs, SF)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted({r.component_id for r in groups})

    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    holds = decontamination.find_passages(docs, items, "doc_id", "text", "item_id", "text")
    bad = {r.id for r in holds.collect()}
    clean = STAGE["benchmark decontamination"](spark, docs, SF)
    assert bad and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad


def test_personal_data_is_replaced(spark, docs):
    clean = STAGE["PII"](spark, docs, SF)
    assert clean.dtypes == docs.dtypes and clean.count() == docs.count()
    rows = clean.collect()
    assert not any("@mail" in r.text for r in rows) and any("<email>" in r.text for r in rows)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_hard_rows_pass_all_stages(spark, hard):
    columns = hard.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"),
                          F.length("text").cast("long").alias("n_chars"), "kept" if "kept" in hard.columns else F.lit(1).alias("kept"))
    for frame in (columns, columns.where("false")):
        left = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, SF)
            assert left.columns == frame.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, left, SF)
        assert packed.count() >= left.count()


def test_run_applies_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset", "ids_crc32"} <= set(rows.columns)
    assert rows.count() > 0


def test_an_id_on_two_texts_loses_only_its_duplicate(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in ("apple", "brick", "cloud"))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (5, c)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = STAGE["SimHash near-dedup"](spark, frame, SF).collect()
    assert sorted(map(tuple, kept)) == [(1, a), (2, b), (4, c)]
