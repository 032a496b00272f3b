from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foldwise import __main__ as cli
from foldwise.operators.learners import fit_arm
from foldwise.plans import experiments
from foldwise.plans import laps as lap_plans
from foldwise.plans.cv import leaderboard
from foldwise.plans.pipelines import blend_files, train_and_submit
from foldwise.sources import LAPS, Bundle, read_predictions
from foldwise.workspace import materialize, scratch_path
from lap_data import laps


@pytest.fixture(scope="module")
def bundle(spark):
    return Bundle(train=laps(spark, 0, 400), test=laps(spark, 400, 90).drop(LAPS.label))


@pytest.fixture(scope="module")
def out(tmp_path_factory):
    return tmp_path_factory.mktemp("output")


@pytest.fixture(scope="module")
def tree_run(bundle, out):
    arm = lap_plans.tree_arm("depth 6, 500 rounds").with_params("trees", maxIter=2, maxDepth=3)
    return train_and_submit(bundle, arm, LAPS, str(out / "trees"), k=3, parallelism=3)


@pytest.fixture(scope="module")
def logistic_run(bundle, out):
    arm = lap_plans.logistic_arm().with_params("logistic", maxIter=10)
    return train_and_submit(bundle, arm, LAPS, str(out / "logistic"), validate=False)


def test_run_validates_and_writes_one_row_per_test_id(spark, tree_run, logistic_run):
    assert tree_run.fold_scores.count() == 3
    assert logistic_run.fold_scores is None
    for run in (tree_run, logistic_run):
        rows = read_predictions(spark, run.predictions_path).collect()
        assert sorted(r.id for r in rows) == list(range(400, 490))
        assert all(0.0 <= r.PitNextLap <= 1.0 for r in rows)


def test_blend_of_written_files(spark, tree_run, logistic_run, out):
    paths = {"trees": tree_run.predictions_path, "logistic": logistic_run.predictions_path}
    blend_files(spark, paths, str(out / "blend"))
    blend_files(spark, paths, str(out / "blend"))
    a, b, blend = (
        {r.id: r.PitNextLap for r in read_predictions(spark, p).collect()}
        for p in (*paths.values(), str(out / "blend"))
    )
    assert blend == {i: pytest.approx((a[i] + b[i]) / 2) for i in a}


def test_recorded_arms(spark):
    arms = {arm.run: arm for arm in lap_plans.arms()}
    assert len(arms) == 7
    assert "id" in arms["logistic"].numeric
    assert "id" in arms["leafwise"].numeric
    assert "id" not in arms["depth 10, 2000 rounds"].numeric
    assert arms["depth 8, 1000 rounds"].params["stepSize"] == 0.03
    bins = [a.params["maxBins"] for a in lap_plans.arms(100) if a.learner == "gbt"]
    assert bins == [100] * 6


def test_every_lap_feature_can_be_fitted(spark, bundle):
    base = lap_plans.tree_arm("depth 6, 500 rounds").with_params("trees", maxIter=1, maxDepth=2)
    for name, expression in lap_plans.lap_features().items():
        base = base.adding(name, expression)
    base = base.adding("TyreLifeRate constant", lap_plans.constant_feature())
    fitted = fit_arm(bundle.train, base, LAPS.id, LAPS.label)
    importance = {r.feature: r.importance for r in fitted.importance().collect()}
    assert importance["TyreLifeRate constant"] == 0.0
    assert set(lap_plans.lap_features()) < set(importance)


def test_lap_features_on_edge_rows(spark, bundle):
    row = bundle.train.limit(1).withColumns(
        {
            "TyreLife": F.lit(0.0),
            "LapNumber": F.lit(4),
            "RaceProgress": F.lit(0.8),
            "LapTime_Delta": F.lit(-1.5),
        }
    )
    got = row.withColumns(lap_plans.lap_features()).first()
    assert got.DegradationPerTyreLife is None
    assert got.TyreLifeRate == 0.0
    assert got.LateRace == 0
    assert got.TyreLife_LapTimeDelta == 0.0


def test_scratch_tables_can_be_cleared(spark):
    written = materialize(spark.range(3), "some")
    assert written.count() == 3
    folder = Path(scratch_path(spark, "x").removeprefix("file:")).parent
    assert any(folder.iterdir())


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    cleared = []
    monkeypatch.setattr(cli, "clear_scratch", cleared.append)  # other tests read scratch tables
    folder = tmp_path / "input"
    folder.mkdir()
    train, test = laps(spark, 0, 60), laps(spark, 60, 20).drop(LAPS.label)
    train.toPandas().to_csv(folder / "train.csv", index=False)
    test.toPandas().to_csv(folder / "test.csv", index=False)
    sample = test.select("id", F.lit(0.0).alias(LAPS.label))
    sample.toPandas().to_csv(folder / "sample.csv", index=False)
    cli.main(["preview", "--folder", str(folder), "--rows", "2"])
    cli.main(["check", "--folder", str(folder)])
    shown = capsys.readouterr().out
    assert "LapTime (s)" in shown
    assert "n_wrong_labels" in shown
    job = ["run", "--folder", str(folder), "--arm", "logistic"]
    cli.main([*job, "--out", str(tmp_path / "a")])
    assert "mean_auc" in capsys.readouterr().out
    assert len(cleared) == 1
    pairs = [f"{name}={tmp_path / 'a'}" for name in ("one", "two")]
    cli.main(["blend", "--out", str(tmp_path / "b"), *pairs])
    a, b = (read_predictions(spark, str(tmp_path / p)).orderBy("id").collect() for p in "ab")
    assert a == b
    assert len(a) == 20


def test_command_line_profiles_and_compares(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "clear_scratch", lambda _: None)
    folder = tmp_path / "input"
    folder.mkdir()
    train, test = laps(spark, 0, 300), laps(spark, 300, 60).drop(LAPS.label)
    train.toPandas().to_csv(folder / "train.csv", index=False)
    test.toPandas().to_csv(folder / "test.csv", index=False)
    sample = test.select("id", F.lit(0.0).alias(LAPS.label))
    sample.toPandas().to_csv(folder / "sample.csv", index=False)
    cli.main(["profile", "--folder", str(folder)])
    shown = capsys.readouterr().out
    assert "n_distinct" in shown and "psi" in shown and "Compound" in shown
    small = lap_plans.tree_arm("depth 6, 500 rounds").with_params("small", maxDepth=2)
    monkeypatch.setattr(lap_plans, "arms", lambda max_bins=32: [lap_plans.logistic_arm(), small])
    args = ["compare", "--folder", str(folder), "--arm", "small", "--rounds", "1", "3", "--group", "Driver"]
    cli.main(args)
    shown = capsys.readouterr().out
    assert "small, 1 rounds" in shown and "small, 3 rounds" in shown and "std_error" in shown


def test_compared_arms_and_their_blend(spark):
    train = laps(spark, 0, 300)
    trees = lap_plans.tree_arm("depth 6, 500 rounds").with_params("trees", maxDepth=2, maxIter=2)
    result = experiments.compare_arms(train, [trees, lap_plans.logistic_arm()], LAPS.id, LAPS.label, k=2)
    assert sum(result.weights.values()) == pytest.approx(1) and set(result.weights) == {"trees", "logistic"}
    (pair,) = result.pairs.collect()
    means = {r.run: r.mean_auc for r in leaderboard(result.fold_scores).collect()}
    assert (pair.auc_a, pair.auc_b) == (pytest.approx(means["trees"]), pytest.approx(means["logistic"]))
    assert 0 < pair.std_error < 0.2 and 0 <= pair.p_value <= 1
