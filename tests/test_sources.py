import pytest
from pyspark.sql import functions as F

from foldwise.operators.tables import bundle_check, drop_columns, scan_profile, split_label
from foldwise.sources import (
    LAPS,
    LAPS_TEST,
    Bundle,
    read_predictions,
    read_table,
    write_predictions,
)
from foldwise.sources.tables import preview, shape
from lap_data import laps


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three plain CSV files, as a competition ships them."""
    root = tmp_path_factory.mktemp("input")
    train, test = laps(spark, 0, 300), laps(spark, 300, 100).drop(LAPS.label)
    sample = test.select("id", F.lit(0.0).alias(LAPS.label))
    for name, df in (("sample_submission", sample), ("test", test), ("train", train)):
        df.toPandas().to_csv(root / f"{name}.csv", index=False)
    return root


def test_bundle_from_a_folder(spark, folder):
    bundle = Bundle.from_folder(spark, str(folder), LAPS)
    assert bundle.train.schema == LAPS.schema
    assert bundle.test.schema == LAPS_TEST
    assert (bundle.train.count(), bundle.test.count(), bundle.sample.count()) == (300, 100, 100)
    assert sorted(bundle.train.collect()) == sorted(laps(spark, 0, 300).collect())


def test_bundle_of_an_unknown_layout_is_inferred(spark, folder):
    bundle = Bundle.from_folder(spark, str(folder))
    types = dict(bundle.train.dtypes)
    assert types["Driver"] == "string"
    assert types["LapTime (s)"] == "double"
    assert types["id"] in ("int", "bigint")
    assert preview(bundle.train, 7).count() == 7
    columns = shape(bundle.test).orderBy("position").collect()
    assert [r.column for r in columns] == bundle.test.columns
    assert {r.n_rows for r in columns} == {100}


def test_any_other_number_of_files_is_refused(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("id\n1\n")
    with pytest.raises(ValueError, match="exactly 3 files"):
        Bundle.from_folder(spark, str(tmp_path))
    for name in ("c", "d"):
        (tmp_path / f"{name}.csv").write_text("id\n1\n")
    with pytest.raises(ValueError, match="exactly 3 files"):
        Bundle.from_folder(spark, str(tmp_path))


def test_a_reordered_file_is_refused(spark, tmp_path):
    (tmp_path / "p.csv").write_text("PitNextLap,id\n0.5,1\n")
    with pytest.raises(Exception, match="header"):
        read_predictions(spark, str(tmp_path / "p.csv")).collect()


def test_predictions_round_trip_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "deep" / "er" / "submission")
    rows = [(1, 0.25), (2, None), (3, 1e-17)]
    first = spark.createDataFrame(rows, "id bigint, PitNextLap double")
    write_predictions(first, path)
    assert sorted(map(tuple, read_predictions(spark, path).collect())) == rows
    write_predictions(first.where("id = 1"), path, single_file=True)
    got = read_predictions(spark, path)
    assert dict(got.dtypes) == {"id": "bigint", "PitNextLap": "double"}
    assert [tuple(r) for r in got.collect()] == [(1, 0.25)]


def test_bundle_check_reports_every_defect(spark, folder):
    clean = Bundle.from_folder(spark, str(folder), LAPS)
    for row in bundle_check(clean, LAPS).collect():
        assert row.n_rows == row.n_ids
        assert (row.n_null_ids, row.n_wrong_labels) == (0, 0)
        assert (row.missing_columns, row.extra_columns) == ("", "")
    labels = F.when(F.col("id") > 2, 1).when(F.col("id") == 1, 7)
    broken = Bundle(
        train=clean.train.withColumn("PitNextLap", labels),
        test=clean.test.drop("Year").withColumn("new", F.lit(1)).unionByName(
            clean.test.drop("Year").withColumn("new", F.lit(1)).limit(1)
        ),
        sample=clean.sample.withColumn("id", F.when(F.col("id") > 301, F.col("id"))),
    )
    rows = {r.role: r for r in bundle_check(broken, LAPS).collect()}
    assert rows["train"].n_wrong_labels == 3
    assert (rows["test"].n_rows, rows["test"].n_ids) == (101, 100)
    assert (rows["test"].missing_columns, rows["test"].extra_columns) == ("Year", "new")
    assert rows["sample"].n_null_ids == 2


def test_split_label(spark):
    df = laps(spark, 0, 10)
    features, label = split_label(df, "id", LAPS.label, label_is_last=True)
    assert features.columns == [c for c in df.columns if c != LAPS.label]
    assert label.columns == ["id", "label"]
    moved = df.select(LAPS.label, *features.columns)
    with pytest.raises(ValueError, match="not the last column"):
        split_label(moved, "id", LAPS.label, label_is_last=True)
    again, _ = split_label(moved, "id", LAPS.label)
    assert again.columns == features.columns


def test_drop_columns_wants_known_names(spark):
    df = laps(spark, 0, 3)
    assert "Year" not in drop_columns(df, ["id", "Year"]).columns
    with pytest.raises(ValueError, match="no such columns"):
        drop_columns(df, ["Yaer"])


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "id bigint, `c d` string")
    row = scan_profile(df, {"id": "id"}, {"n_ids": "id", "n_c": "c d"}).first()
    assert row.asDict() == {"n_rows": 3, "n_ids": 2, "n_c": 2, "min_id": 1, "max_id": 2}


def test_csv_scan_prunes_columns(spark, folder):
    df = read_table(spark, str(folder / "train.csv"), LAPS.schema).select("id", "Year")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,Year:bigint>" in plan
