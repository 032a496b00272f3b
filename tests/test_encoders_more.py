"""Statistics over several orders, keys of several categories, and groups of many categories."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foldwise.operators import skew
from foldwise.operators.grouping import UNSEEN, apply_groups, target_groups
from foldwise.operators.learners import Arm, fit_arm, prepare_training, shared_orders
from foldwise.operators.order_stats import ordered_target_stats, pair_key, pair_name, with_pairs
from foldwise.plans.cv import folded_table, out_of_fold
from foldwise.sources.schema import LAPS
from lap_data import laps


def plain(rows, orders, seed=96):
    """Mean over orders of the smoothed mean of the labels before a row in its category."""
    out = defaultdict(float)
    for j in range(orders):
        seen = defaultdict(lambda: [0, 0])
        digest = lambda i, j=j: hashlib.md5(f"{seed + j}:{i}".encode()).hexdigest()
        for i, c, y in sorted(rows, key=lambda r: (digest(r[0]), r[0])):
            s, n = seen[c]
            out[i] += (s + 0.5) / (n + 1) / orders
            seen[c] = [s + y, n + 1]
    return out


@pytest.mark.parametrize("orders", [1, 3])
@pytest.mark.parametrize("rows_per_piece", [1_000_000, 30, 1])
def test_mean_over_orders(spark, orders, rows_per_piece):
    """Hot categories, NULL among them, are cut into pieces and give the same."""
    rows = [(i, None if i % 5 == 0 else f"c{i % 3}" if i % 2 else f"d{i % 40}", int(i % 7 < 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, c string, y int").repartition(6)
    got = ordered_target_stats(df, "id", "c", "y", orders, rows_per_piece=rows_per_piece)
    assert got.columns == ["id", "c", "y", "stat"]
    want = plain(rows, orders)
    found = {r.id: r.stat for r in got.collect()}
    assert found == {i: pytest.approx(s, rel=1e-12) for i, s in want.items()}


@pytest.mark.parametrize("at_most, rows_per_piece", [(20, 20), (20, 6), (10**6, 6)])
def test_either_way_to_find_pieces_gives_the_same_over_orders(spark, monkeypatch, at_most, rows_per_piece):
    """Hot categories are broadcast, joined by key, or both; categories and labels may be NULL."""
    monkeypatch.setattr(skew, "ROWS_PER_PIECE", at_most)
    rows = [(i, None if i % 5 == 0 else f"c{i % 3}" if i % 2 else f"d{i % 40}", int(i % 7 < 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, c string, y int").repartition(6)
    got = ordered_target_stats(df, "id", "c", "y", 2, rows_per_piece=rows_per_piece)
    want = plain(rows, 2)
    assert {r.id: r.stat for r in got.collect()} == {i: pytest.approx(s, rel=1e-12) for i, s in want.items()}


def test_orders_share_one_exchange_of_ordinary_rows(spark):
    """Rows of ordinary categories move once however many orders there are."""
    df = spark.range(50).selectExpr("id", "id % 4 AS c", "id % 2 AS y")
    for orders in (2, 5):
        plan = ordered_target_stats(df, "id", "c", "y", orders)._jdf.queryExecution().executedPlan().toString()
        moved = [x for x in plan.splitlines() if "Exchange" in x and "REPARTITION_BY_COL" in x]
        assert len(moved) == 2  # one for each kind of row


def test_more_orders_vary_less(spark):
    df = spark.range(4000).selectExpr("id", "'c' AS c", "CAST(xxhash64(id) % 2 = 0 AS int) AS y")
    spread = [
        ordered_target_stats(df, "id", "c", "y", n).agg(F.stddev_pop("stat")).first()[0] for n in (1, 8)
    ]
    assert spread[1] < spread[0] / 2


def test_keys_of_several_categories_do_not_collide(spark):
    rows = [("a", "bc"), ("ab", "c"), (None, "abc"), ("abc", None), ("", "abc"), ("1:a", "b"), (None, None), ("-", "-")]
    df = spark.createDataFrame(rows, "x string, y string")
    keys = [r[0] for r in df.select(pair_key("x", "y")).collect()]
    assert len(set(keys)) == len(rows) and None not in keys
    assert with_pairs(df, [("x", "y")]).columns == ["x", "y", "x & y"] == ["x", "y", pair_name(("x", "y"))]


def test_orders_and_pairs_through_cross_validation(spark):
    train = with_pairs(laps(spark, 0, 400), [("Driver", "Race")])
    params = {"maxIter": 2, "maxDepth": 2}
    arm = Arm("pairs", "gbt", numeric=("TyreLife",), target_stat=("Driver & Race", "Driver"), params=params, orders=3)
    folded = folded_table(train, LAPS.id, LAPS.label, k=2)
    scored = out_of_fold(folded, [arm], LAPS.id, LAPS.label, k=2).collect()
    assert len(scored) == 400 and all(0 < r.score < 1 for r in scored)
    fitted = fit_arm(train, arm, LAPS.id, LAPS.label)
    assert fitted.score(with_pairs(laps(spark, 400, 50), [("Driver", "Race")])).count() == 50
    with pytest.raises(ValueError, match="as many orders"):
        shared_orders([arm, Arm("one", "gbt", numeric=(), target_stat=("Driver",))])


@pytest.mark.parametrize("partitions", [1, 20])
def test_groups_follow_the_label_means(spark, partitions):
    rows = [(i, None if i % 50 == 7 else f"c{i % 45:02d}", int(i % 45 * 3 > i % 100)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, c string, y int").repartition(partitions)
    table = {r.lookup_key: r.group for r in target_groups(df, "c", "y", 7).collect()}
    count, positive = defaultdict(int), defaultdict(int)
    for _, c, y in rows:
        count[c] += 1
        positive[c] += y
    ordered = sorted(count, key=lambda c: ((positive[c] + 0.5) / (count[c] + 1), c is not None, c or ""))
    before = 0
    for c in ordered:
        assert table[c] == before * 7 // 900
        before += count[c]
    assert set(table) == set(count)
    unseen = spark.createDataFrame([(1, "new"), (2, "c01"), (3, None)], "id long, c string")
    got = {r.id: r.group for r in apply_groups(unseen, spark.createDataFrame(list(table.items()), "lookup_key string, group int"), "id", "c").collect()}
    assert got == {1: UNSEEN, 2: table["c01"], 3: table[None]}


def test_more_categories_than_bins_are_grouped_for_trees(spark):
    """As nominal they are an error; grouped, trees split them as well as one bin each would."""
    df = spark.range(3000).selectExpr(
        "id", "concat('c', id % 200) AS c", "CAST((id % 200) % 3 = 0 AND id % 7 > 0 AS int) AS y"
    )
    params = {"maxIter": 1, "maxDepth": 1, "maxBins": 16}
    with pytest.raises(ValueError, match="more categories"):
        prepare_training(df, [Arm("n", "gbt", numeric=(), categorical=("c",), params=params)], "id", "y")
    arm = Arm("g", "gbt", numeric=(), grouped=("c",), params=params)
    fitted = fit_arm(df, arm, "id", "y")
    assert fitted.inputs == ("c",) and fitted.importance().first().importance == 100.0
    scored = fitted.score(df).groupBy((F.substring("c", 2, 9).cast("int") % 3 == 0).alias("third"))
    means = {r.third: r.m for r in scored.agg(F.avg("score").alias("m")).collect()}
    assert means[True] > 0.7 and means[False] < 0.3
    assert fitted.score(df.withColumn("c", F.lit("never seen"))).count() == 3000
    with pytest.raises(ValueError, match="for trees"):
        prepare_training(df, [Arm("l", "logistic", numeric=(), grouped=("c",))], "id", "y")
