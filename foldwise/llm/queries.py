"""The dealt operators bound to the test tables, with the settings of production."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import (
    alignment,
    decontamination,
    languages,
    licenses,
    packing,
    pii,
    quality,
    repeats,
    simhash,
    sketches,
    token_files,
    tokens,
    urls,
    whitening,
)
from foldwise.llm.batches import bound_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(build: Query) -> Query:
    @wraps(build)
    def bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return build(spark, sf_dir)

    QUERIES[build.__name__] = bounded
    return bounded


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned from the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    scored = docs.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        quality.quality_score(model, F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    docs = _table(spark, sf_dir, "documents")
    grouped = simhash.near_groups(docs, "doc_id", "text", n_words=4, max_bits=4)
    return grouped.select(
        F.col("id").alias("doc_id"),
        simhash.fingerprint_hex(F.col("fingerprint")).alias("fingerprint"),
        "component_id",
    )


@query
def op6_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, and where."""
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontamination.find_passages(docs, items, "doc_id", "text", "item_id", "text")
    return found.withColumnRenamed("id", "doc_id")


@query
def op7_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts and a digest of the base spans, and all spans."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, pii.fit_pii(docs, "text"), "text")
    return found.select(
        "row.doc_id",
        *[pii.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.joined_spans(F.col("base")), 256).alias("base_sha256"),
        pii.joined_spans(F.col("spans")).alias("spans"),
    )


def _tokenizer(name: str) -> str:
    """A public tokenizer's definition; the file is read where the query is built."""
    import public_tokenizers

    return tokens.read_definition(public_tokenizers.path(name))


@query
def op4_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 1024 ids, and their places in packed sequences."""
    docs = _table(spark, sf_dir, "documents")
    packed = packing.pack_documents(
        docs, "doc_id", "text", _tokenizer("byte_bpe_50k.json"), "spaces", end_id=2, capacity=1024
    )
    return packed.withColumnRenamed("id", "doc_id")


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to shards, found again by the index and read back."""
    docs = _table(spark, sf_dir, "documents")
    root = token_files.write_token_files(
        docs, "doc_id", "text", _tokenizer("word_bpe_49k.json"), "words", end_id=2
    )
    keys = token_files.read_documents(spark, root).select("id", "copy")
    read = token_files.read_ids(root, token_files.look_up(spark, root, keys))
    return read.select(
        F.col("id").alias("doc_id"), "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32"
    )


#: ``(verdict, host, path)``.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@query
def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict and its host's reputation; a page's known outcome is the label of its number.

    In the given tables a label says nothing about the page of its number, so hosts hardly differ."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    outcomes = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.coalesce(bad, F.lit(0)).alias("bad")
    )
    judged = urls.judge_urls(_table(spark, sf_dir, "pages"), outcomes, "page_id", "url", URL_RULES)
    judged = judged.withColumns({c: F.round(c, 6) for c in ("rate", "lower")})
    return judged.withColumnRenamed("id", "page_id")


ORACLE_SQL["op2_host_reputation"] = urls.judge_urls_sql(URL_RULES)


@query
def op8_bottom_k_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch, its edited text's, and how near it is to that and to the next."""
    docs = _table(spark, sf_dir, "documents")
    compared = sketches.compare_with_edits(docs, "doc_id", "text")
    return compared.select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        sketches.sketch_text(F.col("sketch")).alias("fingerprint"),
        sketches.sketch_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query
def op3_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph that is a licence notice, its family and whether a template confirms it."""
    docs = _table(spark, sf_dir, "documents")
    found = licenses.scan_licenses(docs, licenses.fit_licenses(docs, "text"), "doc_id", "text")
    return found.withColumnRenamed("id", "doc_id")


@query
def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that documents share, its class, and which one stays."""
    docs = _table(spark, sf_dir, "documents")
    return repeats.repeated_passages(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")


@query
def op11_fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two tokenizers, aligned by the bytes they cover."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    docs = _table(spark, sf_dir, "documents")
    aligned = alignment.align_documents(docs, "doc_id", "text", _tokenizer("byte_bpe_50k.json"), model)
    return aligned.withColumnRenamed("id", "doc_id")


@query
def op12_incremental_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding's whitened components."""
    vectors = _table(spark, sf_dir, "embeddings")
    return whitening.whitened_embeddings(vectors, "vec_id", "embedding").withColumnRenamed("id", "vec_id")


@query
def op13_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from the documents that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    trees = languages.fit_languages(docs, "doc_id", "text", "lang")
    found = languages.predict_languages(trees, docs, "doc_id", "text")
    return found.select(
        F.col("id").alias("doc_id"), languages.held_out(F.col("id")).alias("held_out"), "lang_pred", "score"
    )
