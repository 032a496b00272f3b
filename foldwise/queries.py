"""The operators bound to the test tables: one query per entry of ``QUERIES``.

``orders`` plays the labelled table (unique id, two-class label, a small and a large category),
``lineitem`` supplies feature inputs, and ``labels`` with ``documents`` is what learners fit on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.features import flag_above, interaction, rate, ratio
from foldwise.functions.scores import linear_margin, positive_class, sigmoid
from foldwise.operators import (
    blending,
    categories,
    comparison,
    folds,
    grouping,
    metrics,
    order_stats,
    permutation,
    predictions,
    profile,
    tables,
    target_stats,
)
from foldwise.operators.learners import SEED, Arm, fit_arm
from foldwise.plans import cv, experiments
from foldwise.plans.laps import leafwise_arm
from foldwise.plans.pipelines import blend_files, predict
from foldwise.sources.schema import TableSpec
from foldwise.sources.sinks import write_predictions
from foldwise.sources.tables import Bundle, read_predictions, read_table, shape
from foldwise.workspace import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- orders in its roles -------------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").cast("string").alias("customer"),
        F.col("o_orderpriority").alias("priority"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )


def _train(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("id") % 5 != 0)


def _test(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("id") % 5 == 0)


def _score_a() -> F.Column:
    return F.col("id") * 37 % 101 / F.lit(101.0)


def _score_b() -> F.Column:
    return F.col("id") * 53 % 97 / F.lit(97.0)


def _folded(labelled: DataFrame) -> DataFrame:
    return folds.stratified_folds(labelled, "id", "label", k=5, seed=SEED)


# --- sources and sinks ---------------------------------------------------------------------------


@query
def scan_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return tables.scan_profile(
        orders,
        ranged={"id": "o_orderkey"},
        distinct={"n_ids": "o_orderkey", "n_categories": "o_orderpriority"},
    )


@query
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of a table: counts, range and moments, and the value of most rows of few values."""
    table = profile.profile(_table(spark, sf_dir, "orders"))
    few = F.col("n_distinct") <= 100
    first = F.array_sort("frequent", _more_frequent)[0]
    return table.select(
        "position",
        "column",
        "n_rows",
        "n_null",
        "least",
        "greatest",
        F.round("mean", 3).alias("mean"),
        F.round("std", 3).alias("std"),
        F.when(few, first["item"]).alias("top_value"),
        F.when(few, first["count"]).alias("top_count"),
    ).where("dtype <> 'timestamp_ntz'")


def _more_frequent(a: F.Column, b: F.Column) -> F.Column:
    """Order of values: by falling count, then by value."""
    by_value = F.when(a["item"] < b["item"], -1).when(a["item"] > b["item"], 1).otherwise(0)
    return F.when(a["count"] > b["count"], -1).when(a["count"] < b["count"], 1).otherwise(by_value)


@query
def column_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the categories of late orders are spread compared with those of early ones."""
    orders = _table(spark, sf_dir, "orders").select("o_orderdate", "o_orderstatus", "o_orderpriority")
    late = F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")
    kept = orders.withColumn("o_orderpriority", F.when(F.col("o_orderpriority") < "5", F.col("o_orderpriority")))
    sketches = [profile.sketch_columns(kept.where(side).drop("o_orderdate")) for side in (~late, late)]
    return _rounded(profile.drift(*sketches).drop("position"), "psi", "null_change")


@query
def table_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(_table(spark, sf_dir, "orders"))


@query
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV and scanned again with declared types; the time shown as text."""
    path = scratch_path(spark, "orders-csv")
    orders = _table(spark, sf_dir, "orders")
    orders.write.option("header", True).csv(path)
    scanned = read_table(spark, path, orders.schema)
    return scanned.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query
def bundle_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three written tables in a folder, told apart by their sorted names, and checked."""
    labelled = _labelled(spark, sf_dir).drop("customer")
    folder = scratch_path(spark, "bundle")
    test = _test(labelled)
    parts = {
        "train.csv": _train(labelled),
        "test.csv": test.drop("label"),
        "sample.csv": test.select("id", F.lit(0.5).alias("label")),
    }
    for name, rows in parts.items():
        rows.write.option("header", True).csv(f"{folder}/{name}")
    spec = TableSpec(id="id", label="label", categorical=("priority",))
    return tables.bundle_check(Bundle.from_folder(spark, folder), spec)


@query
def bundle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir)
    test = _test(labelled)
    bundle = Bundle(
        train=_train(labelled),
        test=test.drop("label"),
        sample=test.select("id", F.lit(0.0).alias("label")),
    )
    spec = TableSpec(id="id", label="label", categorical=("customer", "priority"))
    return tables.bundle_check(bundle, spec)


@query
def submission_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed-form score written as a prediction file and read back."""
    scored = _linear_score(spark, sf_dir)
    path = scratch_path(spark, "submission")
    write_predictions(scored, path, "id", "p")
    return read_predictions(spark, path, scored.select("id", "p").schema)


# --- row and column selection --------------------------------------------------------------------


@query
def label_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _train(_labelled(spark, sf_dir))
    _, label = tables.split_label(train, "id", "label", label_is_last=True)
    return label


@query
def label_split_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, _ = tables.split_label(_train(_labelled(spark, sf_dir)), "id", "label")
    return features


@query
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.drop_columns(_table(spark, sf_dir, "events"), ["ts", "props"])


# --- features ------------------------------------------------------------------------------------


def _lineitem_feature(spark: SparkSession, sf_dir: str, name: str, value) -> DataFrame:
    lineitem = _table(spark, sf_dir, "lineitem")
    return lineitem.select("l_orderkey", "l_linenumber", value.alias(name))


@query
def feature_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = ratio(F.col("l_extendedprice"), F.col("l_tax"))
    return _lineitem_feature(spark, sf_dir, "ratio", value)


@query
def feature_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = rate(F.col("l_quantity"), F.col("l_linenumber"))
    return _lineitem_feature(spark, sf_dir, "rate", value)


@query
def feature_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem_feature(spark, sf_dir, "late_flag", flag_above(F.col("l_discount"), 0.08))


@query
def feature_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = interaction(F.col("l_quantity"), F.col("l_discount"))
    return _lineitem_feature(spark, sf_dir, "interaction", value)


# --- categories ----------------------------------------------------------------------------------


@query
def category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir)
    dictionary = categories.category_dictionary(_train(labelled), "customer")
    indexed = categories.index_categories(
        labelled.select("id", "customer"), "id", "customer", dictionary
    )
    return indexed.select("id", "category_idx")


@query
def category_index_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every customer of more than 3 orders taken for a hot one."""
    labelled = _labelled(spark, sf_dir)
    dictionary = categories.category_dictionary(_train(labelled), "customer")
    rows = labelled.select("id", "customer")
    indexed = categories.index_categories(rows, "id", "customer", dictionary, rows_per_piece=3)
    return indexed.select("id", "category_idx")


@query
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators learnt from training rows, on test rows with unseen and NULL categories."""
    labelled = _labelled(spark, sf_dir).select("id", "priority")
    known = categories.vocabulary(_train(labelled), ["priority"], [100])
    other = F.when(F.col("id") % 7 == 0, "6-NEVER SEEN").when(F.col("id") % 11 == 0, None)
    test = _test(labelled).withColumn("priority", other.otherwise(F.col("priority")))
    return categories.one_hot_columns(test, known)


@query
def one_hot_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir)
    return categories.align_categories(_train(labelled), _test(labelled), "customer")


@query
def ordered_target_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _train(_labelled(spark, sf_dir)).select("id", "customer", "label")
    encoded = target_stats.ordered_target_stat(train, "id", "customer", "label", seed=SEED)
    return encoded.select("id", "stat")


@query
def ordered_target_stat_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every customer of more than 3 orders cut into pieces."""
    train = _train(_labelled(spark, sf_dir)).select("id", "customer", "label")
    encoded = target_stats.ordered_target_stat(
        train, "id", "customer", "label", seed=SEED, rows_per_piece=3
    )
    return encoded.select("id", "stat")


def _target_stat_apply(spark: SparkSession, sf_dir: str, **split: int) -> DataFrame:
    labelled = _labelled(spark, sf_dir)
    table = target_stats.target_stat_table(_train(labelled), "customer", "label")
    table = materialize(table, "target-stats")
    test = _test(labelled).select("id", "customer")
    found = target_stats.apply_target_stat(test, table, "id", "customer", **split)
    return found.select("id", "stat")


@query
def target_stat_apply_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _target_stat_apply(spark, sf_dir, rows_per_piece=3)


@query
def target_stat_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _target_stat_apply(spark, sf_dir)


def _fold_target_stats(spark: SparkSession, sf_dir: str, **split: int) -> DataFrame:
    folded = materialize(_folded(_labelled(spark, sf_dir).drop("priority")), "folded")
    encoded = target_stats.fold_target_stats(
        folded, "id", "customer", "label", k=5, seed=SEED, **split
    )
    return encoded.select("id", F.posexplode("stats").alias("held_out", "stat"))


@query
def fold_target_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's statistic under every held-out fold, one row for each."""
    return _fold_target_stats(spark, sf_dir)


@query
def fold_target_stats_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold_target_stats(spark, sf_dir, rows_per_piece=3)


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the month they were made in and the pair of priority and month as keys."""
    orders = _table(spark, sf_dir, "orders")
    rows = orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("priority"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )
    return materialize(order_stats.with_pairs(rows, [("priority", "month")]), "paired")


def _stats_over_orders(spark: SparkSession, sf_dir: str, **split: int) -> DataFrame:
    train = _train(_paired(spark, sf_dir))
    pair = order_stats.pair_name(("priority", "month"))
    encoded = order_stats.ordered_target_stats(train, "id", pair, "label", orders=4, seed=SEED, **split)
    return encoded.select("id", F.round("stat", 9).alias("stat"))


@query
def target_stats_over_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistic of a pair of categories, averaged over four orders."""
    return _stats_over_orders(spark, sf_dir)


@query
def target_stats_over_orders_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every pair of more than 5 orders cut into pieces in each order."""
    return _stats_over_orders(spark, sf_dir, rows_per_piece=5)


@query
def fold_stats_over_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's averaged statistic under every held-out fold, some customers cut into pieces."""
    folded = materialize(_folded(_labelled(spark, sf_dir).drop("priority")), "folded")
    encoded = order_stats.fold_target_stats_over(
        folded, "id", "customer", "label", k=5, orders=2, seed=SEED, rows_per_piece=20
    )
    stats = encoded.select("id", F.posexplode("stats").alias("held_out", "stat"))
    return _rounded(stats, "stat")


@query
def category_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in at most 31 groups by the mean of their labels."""
    train = _train(_labelled(spark, sf_dir))
    return grouping.target_groups(train, "customer", "label", 31)


@query
def category_groups_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of test rows, unseen customers below all."""
    labelled = _labelled(spark, sf_dir)
    table = materialize(grouping.target_groups(_train(labelled), "customer", "label", 31), "groups")
    test = _test(labelled).select("id", "customer")
    return grouping.apply_groups(test, table, "id", "customer", rows_per_piece=3).select("id", "group")


# --- folds ---------------------------------------------------------------------------------------


@query
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir).select("id", "label")
    return _folded(labelled).select("id", "fold")


@query
def fold_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_class_counts(_folded(_labelled(spark, sf_dir).select("id", "label")), "label")


@query
def fold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_sizes(_folded(_labelled(spark, sf_dir).select("id", "label")))


@query
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders stay together."""
    labelled = materialize(_labelled(spark, sf_dir).select("id", "customer", "label"), "grouped")
    return folds.group_folds(labelled, "id", "customer", "label", k=5, seed=SEED).select("id", "fold")


@query
def group_folds_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every customer of more than 3 orders taken for a hot one."""
    labelled = materialize(_labelled(spark, sf_dir).select("id", "customer", "label"), "grouped")
    folded = folds.group_folds(labelled, "id", "customer", "label", k=5, seed=SEED, rows_per_piece=3)
    return folded.select("id", "fold")


# --- metrics -------------------------------------------------------------------------------------


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def _fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir).select("id", "label", _score_a().alias("score"))
    return metrics.roc_auc(_folded(labelled), by=["fold"], cuts=metrics.score_cuts(labelled))


@query
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _labelled(spark, sf_dir).select("label", _score_a().alias("score"))
    return _rounded(metrics.roc_auc(scored), "auc")


@query
def roc_auc_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_fold_scores(spark, sf_dir), "auc")


@query
def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.fold_summary(_fold_scores(spark, sf_dir)), "mean_auc", "std_auc")


# --- prediction sets -----------------------------------------------------------------------------


def _set_a(labelled: DataFrame) -> DataFrame:
    return labelled.select("id", _score_a().alias("p"))


def _set_b(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("id") % 10 != 3).select("id", _score_b().alias("p"))


@query
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir)
    sets = {"a": _set_a(labelled), "b": _set_b(labelled)}
    return predictions.blend_mean(sets, score_col="p")


@query
def blend_two_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two written prediction files, blended into a third, which is read back."""
    labelled = _labelled(spark, sf_dir)
    paths = {name: scratch_path(spark, f"set-{name}") for name in "ab"}
    for name, rows in (("a", _set_a(labelled)), ("b", _set_b(labelled))):
        write_predictions(rows.withColumnRenamed("p", "PitNextLap"), paths[name])
    out = scratch_path(spark, "blend")
    blend_files(spark, paths, out)
    return read_predictions(spark, out).select("id", F.round("PitNextLap", 9).alias("p"))


def _blend_sets(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """One set that leans to the label and one that does not, and the labels."""
    labelled = _labelled(spark, sf_dir)
    leaning = labelled.select("id", (_score_a() + F.col("label") * 0.3).alias("p"))
    return {"a": leaning, "b": _set_b(labelled)}, labelled.select("id", "label")


@query
def blend_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares weights of two sets on the simplex."""
    sets, labels = _blend_sets(spark, sf_dir)
    weights = blending.learn_blend(sets, labels, score_col="p")
    rows = [(name, round(weight, 6)) for name, weight in weights.items()]
    return spark.createDataFrame(rows, "name string, weight double")


@query
def blend_learnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets blended by weights that are learnt from half of the ids."""
    sets, labels = _blend_sets(spark, sf_dir)
    half = labels.where(F.pmod(F.col("id"), F.lit(2)) == 0)
    weights = blending.learn_blend(sets, half, score_col="p")
    return _rounded(blending.blend_weighted(sets, weights, score_col="p"), "p")


@query
def prediction_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir)
    sets = {"p": _set_a(labelled), "p_lgb": _set_b(labelled)}
    return predictions.join_predictions(sets, score_col="p")


@query
def id_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir)
    return predictions.missing_ids(labelled.select("id"), _set_b(labelled))


@query
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    return predictions.duplicate_ids(lineitem)


@query
def run_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of two models and of their blend, best first."""
    scored = _labelled(spark, sf_dir).select(
        "label", _score_a().alias("a"), _score_b().alias("b")
    )
    scored = scored.withColumn("blend", F.round((F.col("a") + F.col("b")) / 2, 9))
    runs = scored.unpivot(["label"], ["a", "b", "blend"], "run", "score")
    return _rounded(metrics.roc_auc(runs, by=["run"]), "auc").orderBy(F.desc("auc"), "run")


@query
def arm_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are two models and their blend told apart by the rows of five folds?"""
    folded = _folded(_labelled(spark, sf_dir).select("id", "label"))
    scored = folded.withColumns({"a": _score_a(), "b": _score_b()})
    scored = scored.withColumn("blend", F.round((F.col("a") + F.col("b")) / 2, 9))
    runs = scored.unpivot(["id", "label", "fold"], ["a", "b", "blend"], "run", "score")
    compared = comparison.compare_runs(materialize(runs, "runs"))
    shown = _rounded(compared, "auc_a", "auc_b", "difference", "std_error", "z")
    return shown.drop("p_value")


# --- learners ------------------------------------------------------------------------------------


def _learner_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with counts over their whole texts.

    The counts are taken below the join, so the texts themselves are never shuffled.
    """
    text = F.col("text")
    documents = _table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).alias("n_lines"),
        F.regexp_count(text, F.lit(r"\S+")).alias("n_words"),
    )
    return _table(spark, sf_dir, "labels").select("doc_id", "quality").join(documents, "doc_id")


LEARNER_SPEC = TableSpec(
    id="doc_id",
    label="quality",
    categorical=("lang",),
    numeric=("n_chars", "n_lines", "n_words"),
)


def _arm(run: str, learner: str, **params) -> Arm:
    return Arm(
        run=run,
        learner=learner,
        numeric=LEARNER_SPEC.numeric,
        categorical=LEARNER_SPEC.categorical,
        params=params,
    )


def _small_trees() -> Arm:
    return _arm("trees", "gbt", maxIter=5, stepSize=0.05, maxDepth=4)


def _linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    p = sigmoid(linear_margin({"n_chars": -0.001}, 0.5))
    scored = documents.select(
        F.col("doc_id").alias("id"),
        array_to_vector(F.array(F.lit(1.0) - p, p)).alias("probability"),
    )
    return scored.select("id", F.round(positive_class(F.col("probability")), 9).alias("p"))


@query
def linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linear_score(spark, sf_dir)


@query
def logistic_base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an unpenalised intercept the mean prediction equals the base rate."""
    data = materialize(_learner_table(spark, sf_dir), "learner-input")
    fitted = fit_arm(data, _arm("logistic", "logistic"), "doc_id", "quality")
    return fitted.score(data).agg(F.round(F.avg("score"), 3).alias("mean_p"))


@query
def importance_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature divided by itself is constant and gets no importance."""
    data = materialize(_learner_table(spark, sf_dir), "learner-input")
    arm = _small_trees().adding("constant_one", ratio(F.col("n_lines"), F.col("n_lines")))
    table = fit_arm(data, arm, "doc_id", "quality").importance()
    return table.where(F.col("feature") == "constant_one").select("feature", "importance")


@query
def one_hot_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpenalised logistic regression on one-hot indicators alone gives category base rates."""
    data = materialize(_learner_table(spark, sf_dir), "learner-input")
    exact = {"regParam": 0.0, "maxIter": 500, "tol": 1e-12}
    arm = Arm("rates", "logistic", numeric=(), categorical=("lang",), params=exact)
    scored = fit_arm(data, arm, "doc_id", "quality").score(data)
    return scored.groupBy("lang").agg(F.round(F.avg("score"), 5).alias("mean_p"))


# One boosting round of depth 1: a learner whose fitted scores have a closed form.
STUMP = {"maxIter": 1, "maxDepth": 1}


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {
        "long": flag_above(F.col("n_chars"), 1000.0),
        "english": (F.col("lang") == "en").cast("int"),
    }
    data = _learner_table(spark, sf_dir).withColumns(flags)
    return data.select("doc_id", "quality", "lang", "source", "n_chars", *flags)


def _stump(run: str, *flags: str) -> Arm:
    return Arm(run, "gbt", numeric=flags, params=STUMP)


@query
def stump_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = materialize(_flagged(spark, sf_dir), "learner-input")
    scored = fit_arm(data, _stump("stump", "long"), "doc_id", "quality").score(data)
    return scored.select(F.col("doc_id").alias("id"), F.round("score", 9).alias("p"))


@query
def importance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One split over two flags: the better one has all the importance."""
    data = materialize(_flagged(spark, sf_dir), "learner-input")
    return fit_arm(data, _stump("both", "long", "english"), "doc_id", "quality").importance()


@query
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The AUC lost by shuffling a flag, and exactly none by shuffling a constant."""
    data = _flagged(spark, sf_dir).withColumn("constant", F.lit(1))
    data = materialize(data.withColumnRenamed("long", "is_long"), "learner-input")
    arm = Arm("stump", "gbt", numeric=("is_long", "constant"), params=STUMP)
    fitted = fit_arm(data, arm, "doc_id", "quality")
    table = permutation.permutation_importance(fitted, data, "doc_id", "quality")
    return _rounded(table, "auc", "auc_loss")


@query
def leafwise_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded leaf-wise setting, two rounds of it, on a flag: deeper trees add nothing."""
    data = materialize(_flagged(spark, sf_dir), "learner-input")
    params = {**leafwise_arm(64).params, "maxIter": 2}
    arm = Arm("leafwise", "gbt", numeric=("long",), params=params)
    scored = fit_arm(data, arm, "doc_id", "quality").score(data)
    return scored.select(F.col("doc_id").alias("id"), F.round("score", 9).alias("p"))


def _crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three flags that cut the rows into up to eight cells."""
    english = (F.col("lang") == "en").cast("int")
    learner = _learner_table(spark, sf_dir).withColumns(
        {"long": flag_above(F.col("n_chars"), 1000.0), "english": english, "lines": flag_above(F.col("n_lines"), 8.0)}
    )
    return learner.select("doc_id", "quality", "long", "english", "lines")


@query
def crossed_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of trees of depth 2 over two flags: each of the four cells is a leaf."""
    data = materialize(_crossed(spark, sf_dir), "learner-input")
    params = {"maxIter": 2, "maxDepth": 2, "stepSize": 0.3}
    arm = Arm("crossed", "gbt", numeric=("long", "english"), params=params)
    scored = fit_arm(data, arm, "doc_id", "quality").score(data)
    return scored.select(F.col("doc_id").alias("id"), F.round("score", 9).alias("p"))


@query
def leafwise_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded leaf-wise setting, two rounds of it, over three flags: every cell is a leaf."""
    data = materialize(_crossed(spark, sf_dir), "learner-input")
    params = {**leafwise_arm(64).params, "maxIter": 2}
    arm = Arm("leafwise", "gbt", numeric=("long", "english", "lines"), params=params)
    scored = fit_arm(data, arm, "doc_id", "quality").score(data)
    return scored.select(F.col("doc_id").alias("id"), F.round("score", 9).alias("p"))


@query
def boosted_stump_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second round: fitted to what the first left over, and weighted by the step size."""
    data = materialize(_flagged(spark, sf_dir), "learner-input")
    arm = _stump("boosted", "long").with_params("boosted", maxIter=2, stepSize=0.3)
    scored = fit_arm(data, arm, "doc_id", "quality").score(data)
    return scored.select(F.col("doc_id").alias("id"), F.round("score", 9).alias("p"))


@query
def nominal_stump_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best two-way grouping of a nominal category."""
    data = materialize(_flagged(spark, sf_dir), "learner-input")
    arm = Arm("nominal", "gbt", numeric=(), categorical=("lang",), params=STUMP)
    scored = fit_arm(data, arm, "doc_id", "quality").score(data)
    return scored.select(F.col("doc_id").alias("id"), F.round("score", 9).alias("p"))


@query
def out_of_fold_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out score of every row, each from the model that was fitted without its fold."""
    folded = cv.folded_table(_flagged(spark, sf_dir), "doc_id", "quality")
    arms = [_stump("stump", "long")]
    scored = cv.out_of_fold(folded, arms, "doc_id", "quality")
    return scored.select("id", "fold", "label", F.round("score", 9).alias("p"))


@query
def cv_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = [_stump("stump", "long")]
    scores = cv.cross_validate(_flagged(spark, sf_dir), arms, "doc_id", "quality")
    return _rounded(scores.select("fold", "auc"), "auc")


@query
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaving out either of two flags; with both, the round splits on the better one."""
    arms = experiments.ablation(_stump("both", "long", "english"), ["long", "english"])
    scores = cv.cross_validate(_flagged(spark, sf_dir), arms, "doc_id", "quality")
    return _rounded(cv.leaderboard(scores), "mean_auc", "std_auc")


@query
def feature_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived flag added to a given one."""
    added = {"is_long": flag_above(F.col("n_chars"), 1000.0)}
    arms = experiments.feature_trial(_stump("english", "english"), added)
    scores = cv.cross_validate(_flagged(spark, sf_dir), arms, "doc_id", "quality")
    return _rounded(cv.leaderboard(scores), "mean_auc", "std_auc")


@query
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds and step size of the same stump."""
    settings = {
        "1 round": {"maxIter": 1},
        "2 rounds, step 0.3": {"maxIter": 2, "stepSize": 0.3},
        "2 rounds, step 0.9": {"maxIter": 2, "stepSize": 0.9},
    }
    arms = experiments.sweep(_stump("stump", "long"), settings)
    scores = cv.cross_validate(_flagged(spark, sf_dir), arms, "doc_id", "quality")
    return _rounded(cv.leaderboard(scores), "mean_auc", "std_auc")


@query
def staged_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to four rounds of the stump under two step sizes, from one fit per step size and fold."""
    settings = {"step 0.3": {"stepSize": 0.3}, "step 0.9": {"stepSize": 0.9}}
    arms = experiments.staged_sweep(_stump("stump", "long"), [1, 2, 3, 4], settings)
    folded = cv.folded_table(_flagged(spark, sf_dir), "doc_id", "quality")
    scored = cv.out_of_fold(folded, arms, "doc_id", "quality")
    return scored.select("run", "id", "fold", F.round("score", 9).alias("p"))


@query
def staged_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounds of one fit per fold ranked."""
    arms = [_stump("stump", "long").with_params("stump", stepSize=0.3).staged([1, 2, 3])]
    scores = cv.cross_validate(_flagged(spark, sf_dir), arms, "doc_id", "quality")
    return _rounded(cv.leaderboard(scores), "mean_auc", "std_auc")


def _submit(spark: SparkSession, data: DataFrame, arm: Arm) -> DataFrame:
    """Fit on all training rows, score the test rows, write the file, and read it back."""
    train = data.where(F.col("doc_id") % 5 != 0)
    test = data.where(F.col("doc_id") % 5 == 0).drop("quality")
    out = predict(fit_arm(train, arm, "doc_id", "quality"), test, LEARNER_SPEC)
    path = scratch_path(spark, "submission")
    write_predictions(out, path, "doc_id", "quality")
    return read_predictions(spark, path, out.schema)


@query
def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = materialize(_flagged(spark, sf_dir), "learner-input")
    written = _submit(spark, data, _stump("stump", "long"))
    return written.select(F.col("doc_id").alias("id"), F.round("quality", 9).alias("p"))


@query
def cv_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a penalty, one-hot indicators alone give the training folds' category rates."""
    exact = {"regParam": 0.0, "maxIter": 500, "tol": 1e-12}
    arm = Arm("rates", "logistic", numeric=(), categorical=("lang",), params=exact)
    folded = cv.folded_table(_flagged(spark, sf_dir), "doc_id", "quality")
    scored = cv.out_of_fold(folded, [arm], "doc_id", "quality")
    scores = cv.fold_scores(_rounded(scored, "score"))
    return _rounded(scores.select("fold", "auc"), "auc")


@query
def cv_grouped_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in at most four groups, learnt per fold, and a stump that splits them best."""
    arm = Arm("grouped", "gbt", numeric=(), grouped=("source",), params={**STUMP, "maxBins": 5})
    folded = cv.folded_table(_flagged(spark, sf_dir), "doc_id", "quality")
    scored = cv.out_of_fold(folded, [arm], "doc_id", "quality")
    return scored.select("id", "fold", "label", F.round("score", 9).alias("p"))


@query
def cv_target_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category's statistic through cross-validation: a stump on whether it is high."""
    arms = [
        Arm("statistic", "gbt", numeric=(), target_stat=("source",), params=STUMP),
        Arm("flag", "gbt", numeric=(), params=STUMP).adding(
            "high", flag_above(F.col("source__stat"), 0.85), run="flag"
        ),
    ]
    folded = cv.folded_table(_flagged(spark, sf_dir), "doc_id", "quality")
    scored = cv.out_of_fold(folded, arms, "doc_id", "quality").where("run = 'flag'")
    return scored.select("id", "fold", "label", F.round("score", 9).alias("p"))
