"""What the plans do when one key holds a third of all rows, and what they leave unread."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from foldwise import queries
from foldwise.operators import skew
from foldwise.plans import cv
from foldwise.operators.categories import category_dictionary, index_categories
from foldwise.operators.folds import stratified_folds
from foldwise.operators.metrics import roc_auc, score_cuts
from foldwise.operators.predictions import join_predictions
from foldwise.operators.order_stats import fold_target_stats_over, ordered_target_stats
from foldwise.operators.target_stats import (
    apply_target_stat,
    fold_target_stats,
    ordered_target_stat,
    target_stat_table,
)
from foldwise.plans.cv import folded_table
from foldwise.workspace import materialize

N = 24_000
PARTITIONS = 16
SF_DIR = "/root/testdata/sf0.001"


@contextmanager
def shuffling(spark):
    """No broadcast by size and no runtime coalescing: the plan as large tables would get it."""
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": str(PARTITIONS),
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def broadcast_rows(spark, df):
    """Rows of each broadcast of a plan that has run, by the plan's own metrics."""
    with shuffling(spark):
        execution = df._jdf.queryExecution()
        execution.toRdd().count()
        nodes, rows = [execution.executedPlan()], []
        for node in nodes:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "BroadcastExchange":
                rows.append(node.metrics().apply("numOutputRows").value())
    return rows


def largest_share(df):
    """Rows of the fullest partition, relative to an even spread."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) * PARTITIONS / sum(sizes)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one category, another third NULL."""
    hot = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None)
    return materialize(
        spark.range(N).select(
            "id",
            hot.otherwise(F.concat(F.lit("t"), F.col("id") % 500)).alias("c"),
            (F.xxhash64("id") % 10 == 0).cast("int").alias("y"),
        ),
        "skewed",
    )


def test_lookup_spreads_hot_rows(spark, skewed):
    table = materialize(target_stat_table(skewed, "c", "y"), "table")
    with shuffling(spark):
        split = apply_target_stat(skewed, table, "id", "c", rows_per_piece=375)
        assert "SortMergeJoin" in plan(split)
        assert largest_share(split) < 2
        whole = apply_target_stat(skewed, table, "id", "c")
        assert largest_share(whole) > 5
        assert sorted(split.collect()) == sorted(whole.collect())


def test_index_lookup_spreads_hot_rows(spark, skewed):
    dictionary = category_dictionary(skewed, "c")
    with shuffling(spark):
        found = index_categories(skewed, "id", "c", dictionary, rows_per_piece=375)
        assert largest_share(found) < 2


def test_ordered_statistic_spreads_hot_rows(spark, skewed):
    with shuffling(spark):
        split = ordered_target_stat(skewed, "id", "c", "y", rows_per_piece=94)
        assert largest_share(split) < 2
        assert largest_share(ordered_target_stat(skewed, "id", "c", "y")) > 4


def test_folds_spread_a_large_class(spark, skewed):
    with shuffling(spark):
        assert largest_share(stratified_folds(skewed, "id", "y", rows_per_piece=50)) < 2


def test_copies_collapse_before_the_shuffle(spark):
    scored = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / N).alias("score"),
        (F.col("id") % 2).cast("int").alias("label"),
    )
    with shuffling(spark):
        auc = plan(roc_auc(scored))
        one = scored.withColumnRenamed("label", "id")
        blend = plan(join_predictions({"a": one, "b": one}, score_col="score"))
    for text in (auc, blend):
        assert re.search(r"Exchange hashpartitioning.*\n.*HashAggregate.*partial_", text)
        assert "Join" not in text
    assert blend.count("Exchange") == 1


def test_score_ranges_stay_even_when_scores_crowd(spark):
    crowded = spark.range(N).select((F.pow(F.col("id") / N, 12)).alias("score"))
    cuts = score_cuts(crowded, "score", 64)
    rows = crowded.collect()
    sizes = [0] * (len(cuts) + 1)
    for row in rows:
        sizes[sum(c <= row.score for c in cuts)] += 1
    assert max(sizes) < 3 * N / 64


@pytest.mark.parametrize(
    ("name", "read"),
    [
        ("feature_ratio", "l_orderkey:bigint,l_linenumber:int,l_extendedprice:double,l_tax:double"),
        ("drop_columns", "event_id:bigint,user_id:bigint,event_type:string,value:double"),
        ("id_coverage", "o_orderkey:bigint"),
        ("linear_score", "doc_id:bigint,n_chars:bigint"),
    ],
)
def test_scans_read_only_what_is_used(spark, name, read):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan(queries.QUERIES[name](spark, SF_DIR)))
    assert schemas
    assert set(schemas) == {read}


@pytest.mark.parametrize("name", ["feature_ratio", "feature_rate", "feature_flag", "linear_score"])
def test_features_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(queries.QUERIES[name](spark, SF_DIR))


@pytest.mark.parametrize(
    "name",
    [
        "roc_auc_by_fold",
        "category_index",
        "ordered_target_stat",
        "target_stat_apply",
        "fold_target_stats",
        "one_hot_align",
    ],
)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(queries.QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text


def test_texts_are_not_shuffled(spark):
    with shuffling(spark):
        execution = queries._learner_table(spark, SF_DIR)._jdf.queryExecution()
        formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        text = execution.explainString(formatted)
    exchanged = re.findall(r"Exchange\s*\n\s*Input \[\d+\]: \[(.*?)\]", text)
    assert len(exchanged) == 2
    assert not any(re.search(r"\btext#", columns) for columns in exchanged)


def test_the_source_of_folds_is_evaluated_once(spark, monkeypatch):
    source = spark.read.parquet(f"{SF_DIR}/orders.parquet").selectExpr(
        "o_orderkey AS id", "CAST(o_orderstatus = 'F' AS INT) AS y"
    )
    plans = []
    monkeypatch.setattr(cv, "materialize", lambda df, *a, **b: plans.append(plan(df)) or materialize(df, *a, **b))
    folded_table(source, "id", "y")
    assert [text.count("orders.parquet") for text in plans] == [1, 0]


@pytest.mark.parametrize("rows_per_piece", [10, 1000])
def test_folds_do_not_depend_on_the_pieces(spark, skewed, rows_per_piece):
    def folds(**how):
        return sorted(tuple(r) for r in stratified_folds(skewed, "id", "y", **how).select("id", "fold").collect())

    assert folds(rows_per_piece=rows_per_piece) == folds()


def test_held_out_rows_are_a_pruned_partition(spark, skewed):
    folded = folded_table(skewed, "id", "y")
    assert re.search(r"PartitionFilters: \[.*fold.* = 2", plan(folded.where("fold = 2")))


@pytest.mark.parametrize("at_most", [1000, 10])
def test_small_pieces_over_orders_are_not_broadcast(spark, monkeypatch, at_most):
    """Keys beyond the usual size are, but not as many keys and sums as there are rows."""
    monkeypatch.setattr(skew, "ROWS_PER_PIECE", at_most)
    rows = spark.range(900).selectExpr("id", "if(id < 400, -1, id DIV 5) AS c", "CAST(id % 3 = 0 AS INT) AS y")
    folded = rows.withColumn("fold", F.col("id") % 2)
    for df in (
        ordered_target_stats(rows, "id", "c", "y", 2, rows_per_piece=3),
        fold_target_stats_over(folded, "id", "c", "y", 2, 2, rows_per_piece=3),
    ):
        assert sum(broadcast_rows(spark, df)) <= 20
        assert df.count() == 900


@pytest.mark.parametrize("at_most", [1000, 10])
def test_small_pieces_are_not_broadcast(spark, monkeypatch, at_most):
    monkeypatch.setattr(skew, "ROWS_PER_PIECE", at_most)
    rows = spark.range(900).selectExpr("id", "if(id < 400, -1, id DIV 5) AS c", "CAST(id % 3 = 0 AS INT) AS y")
    folded = rows.withColumn("fold", F.col("id") % 2)
    for df in (
        ordered_target_stat(rows, "id", "c", "y", rows_per_piece=3),
        fold_target_stats(folded, "id", "c", "y", 2, rows_per_piece=3),
    ):
        assert sum(broadcast_rows(spark, df)) <= 20
        assert df.count() == 900
