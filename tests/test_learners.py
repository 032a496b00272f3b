import threading

import pytest
from pyspark.sql import functions as F

from foldwise.functions.features import ratio
from foldwise.operators.folds import held_out_rows, training_rows
from foldwise.operators.learners import Arm, fit_arm, fit_prepared, prepare_training
from foldwise.plans import cv, experiments
from foldwise.plans.cv import cross_validate, fold_scores, folded_table, leaderboard, out_of_fold
from foldwise.sources.schema import LAPS
from foldwise.workspace import materialize
from lap_data import laps

TREES = {"maxIter": 3, "stepSize": 0.3, "maxDepth": 3}


@pytest.fixture(scope="module")
def train(spark):
    return materialize(laps(spark, 0, 600), "laps-train")


@pytest.fixture(scope="module")
def trees():
    return Arm(
        "trees",
        "gbt",
        numeric=LAPS.numeric,
        categorical=("Compound", "Race"),
        target_stat=("Driver",),
        params=TREES,
    )


@pytest.fixture(scope="module")
def logistic():
    return Arm(
        "logistic",
        "logistic",
        numeric=(LAPS.id, *LAPS.numeric),
        categorical=LAPS.categorical,
        params={"maxIter": 30},
    )


@pytest.fixture(scope="module")
def fitted_trees(train, trees):
    return fit_arm(train, trees, LAPS.id, LAPS.label)


def test_categories_are_encoded_as_declared(fitted_trees):
    assert list(fitted_trees.stats) == ["Driver"]
    features = [r.feature for r in fitted_trees.importance().collect()]
    assert set(features) == set(LAPS.features)


def test_importance_sums_to_100_and_falls(fitted_trees):
    values = [r.importance for r in fitted_trees.importance().collect()]
    assert sum(values) == pytest.approx(100.0)
    assert values == sorted(values, reverse=True)
    assert fitted_trees.importance().first().feature == "TyreLife"


def test_probabilities_and_columns(spark, fitted_trees):
    driver = F.when(F.col("id") % 2 == 0, "nobody").when(F.col("id") % 3 == 0, None)
    compound = F.when(F.col("id") % 5 == 0, "WET")
    test = laps(spark, 5000, 100).drop(LAPS.label)
    test = test.withColumn("Driver", driver.otherwise(F.col("Driver")))
    test = test.withColumn("Compound", compound.otherwise(F.col("Compound")))
    scored = fitted_trees.score(test)
    assert scored.columns == [*test.columns, "score"]
    rows = scored.collect()
    assert sorted(r.id for r in rows) == list(range(5000, 5100))
    assert all(0.0 <= r.score <= 1.0 for r in rows)


def test_constant_feature_changes_nothing(train, trees, fitted_trees):
    constant = trees.adding("ones", ratio(F.col("LapNumber"), F.col("LapNumber")))
    other = fit_arm(train, constant, LAPS.id, LAPS.label)
    importance = {r.feature: r.importance for r in other.importance().collect()}
    assert importance.pop("ones") == 0.0
    before = {r.feature: r.importance for r in fitted_trees.importance().collect()}
    assert importance == pytest.approx(before)
    assert _scores(other, train) == pytest.approx(_scores(fitted_trees, train))


def test_same_seed_same_scores(train, trees, fitted_trees):
    again = fit_arm(train, trees, LAPS.id, LAPS.label)
    assert _scores(again, train) == pytest.approx(_scores(fitted_trees, train))


def _scores(fitted, df):
    return {r.id: r.score for r in fitted.score(df).select("id", "score").collect()}


def test_mean_probability_is_the_base_rate(train, logistic):
    arm = logistic.with_params("long", maxIter=200).without("id")
    got = fit_arm(train, arm, LAPS.id, LAPS.label).score(train)
    row = got.agg(F.avg("score").alias("p"), F.avg(LAPS.label).alias("y")).first()
    assert row.p == pytest.approx(row.y, abs=1e-3)


def test_one_hot_logistic_fits_category_rates(train):
    """Without a penalty, one-hot indicators alone reproduce each category's base rate."""
    arm = Arm("rates", "logistic", numeric=(), categorical=("Compound",), params={"regParam": 0.0})
    scored = fit_arm(train, arm, LAPS.id, LAPS.label).score(train)
    rates = scored.groupBy("Compound").agg(F.avg("score").alias("p"), F.avg(LAPS.label).alias("y"))
    for row in rates.collect():
        assert row.p == pytest.approx(row.y, abs=1e-3)


def test_missing_and_infinite_numbers_reach_both_learners(train, trees, logistic):
    dirty = train.withColumn(
        "TyreLife",
        F.when(F.col("id") % 7 == 0, float("nan"))
        .when(F.col("id") % 7 == 1, float("inf"))
        .when(F.col("id") % 7 == 2, None)
        .otherwise(F.col("TyreLife")),
    )
    for arm in (trees, logistic):
        scored = fit_arm(dirty, arm, LAPS.id, LAPS.label).score(dirty)
        assert scored.where("score BETWEEN 0 AND 1").count() == 600


def test_unknown_learner(train):
    with pytest.raises(ValueError, match="unknown learner"):
        fit_arm(train, Arm("x", "forest", numeric=("Year",)), LAPS.id, LAPS.label)


def test_arms_of_an_experiment(trees):
    arms = experiments.ablation(trees, ["Year", "Driver"])
    assert [a.run for a in arms] == ["trees", "trees - Year", "trees - Driver"]
    assert "Year" not in arms[1].numeric
    assert "Driver" not in arms[2].target_stat
    added = experiments.feature_trial(trees, {"f": F.lit(1)})
    assert list(added[1].derived) == ["f"]
    assert not added[1].without("f").derived
    swept = experiments.sweep(trees, {"deep": {"maxDepth": 5}})
    assert swept[0].params == {**TREES, "maxDepth": 5}
    assert trees.params == TREES


def test_cross_validation_scores_every_row_once_per_arm(train, trees, logistic):
    folded = folded_table(train, LAPS.id, LAPS.label, k=3)
    scored = out_of_fold(folded, [trees, logistic], LAPS.id, LAPS.label, k=3, parallelism=4)
    counts = scored.groupBy("run", "id").count()
    assert counts.count() == 1200
    assert counts.where("count <> 1").count() == 0
    scores = fold_scores(scored)
    assert scores.count() == 6
    board = leaderboard(scores).collect()
    assert {r.run for r in board} == {"trees", "logistic"}
    # The label is a noisy threshold on one column, which either learner finds.
    assert all(r.mean_auc > 0.8 for r in board)


def test_one_preparation_serves_arms_with_different_encodings(train, trees, logistic):
    nominal = Arm("nominal", "gbt", ("Year",), ("Driver",), params={**TREES, "maxBins": 70})
    shared = prepare_training(train, [trees, nominal, logistic], LAPS.id, LAPS.label)
    assert list(shared.encodings.stats) == ["Driver"]
    assert len(shared.nominal["Driver"]) == 60
    for arm, stats in ((trees, ["Driver"]), (nominal, []), (logistic, [])):
        together = fit_prepared(shared, arm)
        assert list(together.stats) == stats
        alone = fit_arm(train, arm, LAPS.id, LAPS.label)
        assert _scores(together, train) == pytest.approx(_scores(alone, train), abs=1e-6)


def test_a_nominal_category_that_does_not_fit_is_an_error_naming_it(train):
    arm = Arm("nominal", "gbt", numeric=(), categorical=("Driver",), params=TREES)
    with pytest.raises(ValueError, match="Driver"):
        fit_arm(train, arm, LAPS.id, LAPS.label)


def test_encoding_is_the_same_in_every_fold(spark, monkeypatch):
    """32 categories, one of them a single row: some fold trains on 31, others on 32."""
    rows = [(i, f"c{i % 31}", i % 3 % 2) for i in range(310)] + [(999, "only here", 1)]
    df = spark.createDataFrame(rows, "id long, c string, y int")
    seen = []
    monkeypatch.setattr(
        cv, "fit_prepared", lambda train, arm: seen.append(fit_prepared(train, arm)) or seen[-1]
    )
    folded = folded_table(df, "id", "y", k=3)
    out_of_fold(folded, [Arm("s", "gbt", (), target_stat=("c",), params=TREES)], "id", "y", k=3)
    assert [one.inputs for one in seen] == [("c",)] * 3
    assert all(not one.stats for one in seen)  # encoded for all folds beforehand
    nominal = Arm("n", "gbt", (), categorical=("c",), params={**TREES, "maxBins": 33})
    seen.clear()
    out_of_fold(folded, [nominal], "id", "y", k=3)
    assert [one.inputs for one in seen] == [("c",)] * 3


def test_tasks_do_not_see_each_others_properties(spark):
    """Job ids and tags are such properties; shared ones broke concurrent fits."""
    turn = threading.Barrier(2)
    context = spark.sparkContext

    def run(number):
        context.setLocalProperty("foldwise.test", str(number))
        turn.wait(20)
        own = context.getLocalProperty("foldwise.test")
        turn.wait(20)
        return own

    assert cv.in_threads(spark, run, [1, 2], 2) == ["1", "2"]


def test_reserved_names_are_refused_and_common_ones_ride_along(train, trees):
    for name in ("_label", "features", "probability"):
        with pytest.raises(ValueError, match=name):
            fit_arm(train.withColumn(name, F.lit(1)), trees, LAPS.id, LAPS.label)
    named = train.withColumn("label", F.lit("kept"))
    scored = fit_arm(named, trees, LAPS.id, LAPS.label).score(named)
    assert scored.select("label").distinct().collect()[0][0] == "kept"
    with pytest.raises(ValueError, match="score"):
        fit_arm(train, trees, LAPS.id, LAPS.label).score(train.withColumn("score", F.lit(1)))


def test_a_logistic_arm_has_no_importances(train, logistic):
    with pytest.raises(ValueError, match="no feature importances"):
        fit_arm(train, logistic, LAPS.id, LAPS.label).importance()


def test_one_hot_has_no_largest_number_of_categories(spark):
    df = spark.range(4000).selectExpr("id", "concat('c', id % 1500) AS c", "CAST(id % 2 AS INT) AS y")
    arm = Arm("wide", "logistic", numeric=(), categorical=("c",), params={"maxIter": 5})
    fitted = fit_arm(df, arm, "id", "y")
    assert fitted.pipeline.stages[-1].coefficients.size == 1500
    new = spark.createDataFrame([(1, "c1"), (2, "unseen"), (3, None)], "id long, c string")
    scores = {r.id: r.score for r in fitted.score(new).collect()}
    assert scores[2] == scores[3]


def test_encoding_all_folds_at_once_gives_the_same_scores(train, trees):
    folded = folded_table(train, LAPS.id, LAPS.label, k=2)
    scored = out_of_fold(folded, [trees], LAPS.id, LAPS.label, k=2, parallelism=2)
    got = {r.id: r.score for r in scored.collect()}
    for fold in range(2):
        fitted = fit_arm(training_rows(folded, fold), trees, LAPS.id, LAPS.label)
        assert list(fitted.stats) == ["Driver"]
        alone = _scores(fitted, held_out_rows(folded, fold))
        assert {i: got[i] for i in alone} == pytest.approx(alone)


def test_run_names_must_differ(train, trees):
    with pytest.raises(ValueError, match="not unique"):
        out_of_fold(train, [trees, trees], LAPS.id, LAPS.label)


def test_both_ablation_arms_use_the_same_folds(train, trees):
    small = trees.with_params("small", maxIter=1)
    arms = experiments.ablation(small, ["TyreLife"])
    scores = cross_validate(train, arms, LAPS.id, LAPS.label, k=2, parallelism=4)
    board = {r.run: r.mean_auc for r in leaderboard(scores).collect()}
    assert board["small"] > board["small - TyreLife"] + 0.2


def test_stages_of_one_fit_equal_fits_of_fewer_rounds(spark, train, trees):
    staged = fit_arm(train, trees.with_params("trees", maxDepth=4).staged([5, 1, 3]), LAPS.id, LAPS.label)
    assert staged.arm.runs == ("trees, 1 rounds", "trees, 3 rounds", "trees, 5 rounds")
    unseen = laps(spark, 600, 200)
    got = staged.score_stages(unseen, ["s1", "s3", "s5"])
    assert got.columns == [*unseen.columns, "s1", "s3", "s5"]
    found = {r[LAPS.id]: (r.s1, r.s3, r.s5) for r in got.collect()}
    whole = {r[LAPS.id]: r.score for r in staged.score(unseen).collect()}
    for at, rounds in enumerate((1, 3, 5)):
        alone = fit_arm(train, trees.with_params("alone", maxDepth=4, maxIter=rounds), LAPS.id, LAPS.label)
        for r in alone.score(unseen).collect():
            assert found[r[LAPS.id]][at] == pytest.approx(r.score, rel=1e-9)
    assert all(whole[i] == pytest.approx(s[2], rel=1e-9) for i, s in found.items())


def test_staged_arms_are_fitted_once_per_fold(spark, train, trees, logistic, monkeypatch):
    fits = []
    monkeypatch.setattr(cv, "fit_prepared", lambda *task: fits.append(task[1].run) or fit_prepared(*task))
    folded = folded_table(train, LAPS.id, LAPS.label, k=2)
    scored = out_of_fold(folded, [trees.staged([1, 2, 3]), logistic], LAPS.id, LAPS.label, k=2)
    assert sorted(fits) == ["logistic"] * 2 + ["trees"] * 2
    counts = {r.run: r["count"] for r in scored.groupBy("run").count().collect()}
    assert counts == {**{f"trees, {n} rounds": 600 for n in (1, 2, 3)}, "logistic": 600}


def test_stages_are_rounds_of_trees(trees, logistic):
    for arm, rounds in ((logistic, [1]), (trees, []), (trees, [0, 2])):
        with pytest.raises(ValueError, match="boosting rounds"):
            arm.staged(rounds)
