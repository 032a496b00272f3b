"""The corpus pipeline: filter, deduplicate, decontaminate, clean and pack ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import decontamination, packing, pii, quality, simhash, tokens
from foldwise.llm.batches import bound_batches
from foldwise.workspace import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(build: Stage) -> Stage:
    @wraps(build)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return build(spark, docs, sf_dir)

    return bounded


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, labels, "doc_id", "text", "quality")
    return docs.where(quality.quality_score(model, F.col("text")) >= 0.3)


@stage
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one whose id names the group.

    An id may stand on several texts: each is judged in its own group, and if the naming id has more
    than one text there, the least stays. Rows of one id and text are one document. Rows with a NULL
    id can't be named and stay.
    """
    grouped = simhash.near_groups(docs, "doc_id", "text", n_words=4, max_bits=4)
    grouped = materialize(grouped, "near-groups")
    other = grouped.where("id <> component_id").select(F.col("id").alias("other")).distinct()
    twice = grouped.groupBy("id").count().where("count > 1").select(F.col("id").alias("twice"))
    twice = materialize(twice, "repeated-ids")
    named = twice.isEmpty()  # ids name rows, as they should
    same = docs.doc_id.eqNullSafe(twice.twice)
    single = docs if named else docs.join(twice, same, "left_anti")
    # By sorting at every size: the others grow with the documents and are never broadcast.
    kept = single.join(other.hint("merge"), single.doc_id == other.other, "left_anti")
    if named:
        return kept
    repeated = docs.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    repeated = materialize(repeated, "repeated-rows")
    unnamed = repeated.where("doc_id is null")
    rows = repeated.where("doc_id is not null").select(F.struct("*").alias("row"))
    rows = rows.select("row", "row.text")
    prints = simhash.fingerprints(
        rows, "row", "text", n_words=4
    ).select(F.col("id").alias("row"), "fingerprint")
    groups = grouped.where("id = component_id").select("id", "fingerprint", "component").distinct()
    found = prints.join(groups.hint("merge"), "fingerprint").where("row.doc_id = id")
    found = found.groupBy("component").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row"))
    return kept.unionByName(found.select("row.*")).unionByName(unnamed)


@stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    holds = decontamination.is_contaminated(items, "item_id", "text", F.col("text"))
    return docs.where(~holds)


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their personal data replaced by its kind; ``n_chars`` follows."""
    found = pii.find_pii(docs, pii.fit_pii(docs, "text"), "text")
    clean = pii.redact(F.col("text"), F.col("spans"))
    length = F.when(F.size("spans") > 0, F.length("clean").cast("long"))
    changed = {"text": F.col("clean"), "n_chars": F.coalesce(length, F.col("row.n_chars"))}
    return found.withColumn("clean", clean).select(
        *[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 1024 ids."""
    import public_tokenizers

    definition = tokens.read_definition(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack_documents(docs, "doc_id", "text", definition, "spaces", end_id=2)
    return packed.withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = materialize(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
