"""Profiles of whole tables against exact aggregates, merged sketches, and drift."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foldwise.operators import profile
from lap_data import laps

SF = "/root/testdata/sf0.01"


def close(got, want):
    return got == want if isinstance(want, str) or want is None else got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("table", ["orders", "lineitem", "events", "documents"])
def test_estimates_keep_their_stated_errors(spark, table):
    df = spark.read.parquet(f"{SF}/{table}.parquet")
    rows = profile.profile(df, (0.1, 0.5, 0.9)).collect()
    n = df.count()
    assert [r.column for r in sorted(rows)] == df.columns
    for r in rows:
        column = F.col(f"`{r.column}`")
        exact = df.agg(F.count_distinct(column), F.count(column)).first()
        assert (r.n_rows, r.n_null) == (n, n - exact[1])
        # Four standard deviations, and exact for few values.
        assert abs(r.n_distinct - exact[0]) <= max(4 * profile.DISTINCT_ERROR * exact[0], 0.5)
        if r.quantiles is not None and r.dtype in ("bigint", "int", "double"):
            for share, value in zip((0.1, 0.5, 0.9), r.quantiles, strict=True):
                below, upto = df.agg(
                    F.avg((column < value).cast("int")), F.avg((column <= value).cast("int"))
                ).first()
                assert below - profile.RANK_ERROR <= share <= upto + profile.RANK_ERROR
            want = df.agg(F.min(column), F.max(column), F.avg(column), F.stddev_pop(column)).first()
            found = (r.least, r.greatest, r.mean, r["std"])
            assert all(close(a, b) for a, b in zip(found, want, strict=True))
        if exact[0] <= profile.TRACKED_VALUES and r.dtype != "timestamp_ntz":
            counts = df.where(column.isNotNull()).groupBy(column.cast("string")).count().collect()
            most = sorted((x["count"] for x in counts), reverse=True)[:5]
            assert [x["count"] for x in r.frequent] == most
            known = {x[0]: x["count"] for x in counts}
            assert all(len(x["item"]) > 48 or known[x["item"]] == x["count"] for x in r.frequent)


def test_one_scan_for_all_columns(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    plan = profile.profile(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_sketches_of_parts_merge_to_those_of_the_whole(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    parts = [profile.sketch_columns(df.where(F.col("o_orderkey") % 3 == i)) for i in range(3)]
    merged = profile.read_profile(profile.merge_sketches(parts[0].union(parts[1]).union(parts[2])))
    whole = {r.column: r for r in profile.profile(df).collect()}
    for r in merged.collect():
        w = whole[r.column]
        for name in ("n_rows", "n_null", "least", "greatest", "least_text", "greatest_text"):
            assert r[name] == w[name]
        assert close(r.mean, w.mean)
        assert r["std"] == (None if w["std"] is None else pytest.approx(w["std"], rel=1e-6))
        assert abs(r.n_distinct - w.n_distinct) <= 8 * profile.DISTINCT_ERROR * w.n_distinct


def test_every_type_nulls_and_no_rows(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, 2.5D, 'x', true, DATE'2024-01-02', TIMESTAMP'2024-01-02 03:04:05', "
        "array(1, 2), named_struct('a', 1), map('k', 1), X'00ff', CAST(1.5 AS DECIMAL(5,2)), NULL), "
        "(NULL, double('NaN'), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL) "
        "AS t(i, d, s, b, day, at, list, st, m, raw, dec, void)"
    ).withColumn("void", F.lit(None).cast("string")).withColumn("a b`c", F.lit("z" * 500))
    got = {r.column: r for r in profile.profile(df).collect()}
    assert list(got) == df.columns and {r.n_rows for r in got.values()} == {2}
    assert (got["d"].n_null, got["d"].least, got["d"].n_distinct) == (0, 2.5, 2)
    assert got["day"].least == 19724.0 and got["b"].mean == 1.0 and got["dec"].mean == 1.5
    assert (got["m"].n_distinct, got["list"].n_distinct, got["raw"].n_null) == (1, 1, 1)
    assert (got["void"].n_null, got["void"].n_distinct, got["void"].frequent) == (2, 0, None)
    assert len(got["a b`c"].frequent[0]["item"]) < 70 and got["a b`c"].n_distinct == 1
    none = profile.profile(df.where("false")).collect()
    assert {(r.n_rows, r.n_distinct, r.mean) for r in none} == {(0, 0, None)}
    merged = profile.merge_sketches(profile.sketch_columns(df).union(profile.sketch_columns(df.where("false"))))
    assert {r.n_rows for r in profile.read_profile(merged).collect()} == {2}


def test_drift_finds_the_column_that_moved(spark):
    before, after = laps(spark, 0, 3000), laps(spark, 3000, 3000)
    moved = after.withColumn("TyreLife", F.col("TyreLife") * 1.5).withColumn("Compound", F.lit("SOFT"))
    moved = moved.withColumn("Race", F.when(F.col("id") % 2 == 0, F.col("Race")))
    sketches = [profile.sketch_columns(df.drop("id")) for df in (before, after, moved)]
    still = {r.column: r for r in profile.drift(sketches[0], sketches[1]).collect()}
    assert set(still) == set(before.drop("id").columns)
    assert all(r.psi < 0.05 for r in still.values())
    found = {r.column: r for r in profile.drift(sketches[0], sketches[2]).collect()}
    high = {c for c, r in found.items() if r.psi > 0.1}
    assert high == {"TyreLife", "Compound"}
    assert found["Race"].null_change == pytest.approx(0.5) and found["Year"].null_change == 0


def test_drift_of_numbers_is_the_index_of_their_bins(spark):
    before = spark.range(20_000).selectExpr("double(id) AS x")
    after = spark.range(20_000).selectExpr("double(id * id / 20000) AS x")
    got = profile.drift(profile.sketch_columns(before), profile.sketch_columns(after)).first()
    want = 0.0
    for i in range(10):
        q = math.sqrt((i + 1) / 10) - math.sqrt(i / 10)
        want += (q - 0.1) * math.log(q / 0.1)
    assert got.kind == "quantiles" and got.psi == pytest.approx(want, abs=0.03)
    assert Counter(r.kind for r in [got]) == {"quantiles": 1}
