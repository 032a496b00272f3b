"""Numbers, running sums, grouped folds and permutations, made without one task that sees all."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foldwise.operators.folds import group_folds, stratified_folds
from foldwise.operators.learners import Arm, fit_arm
from foldwise.operators.ordering import with_row_number, with_running_sum
from foldwise.operators.permutation import permutation_importance, with_partner
from foldwise.plans.cv import folded_table


@pytest.mark.parametrize("partitions", [1, 40])
def test_numbers_and_running_sums(spark, partitions):
    rows = [(i, (i * 37) % 11, (i * 7) % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a long, v long").repartition(partitions)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = with_row_number(df, [F.desc("a"), F.col("id")], "n")
    assert got.columns == ["id", "a", "v", "n"]
    assert sorted((r.n, r.id) for r in got.collect()) == [(n, r[0]) for n, r in enumerate(want)]
    summed = with_running_sum(df, [F.desc("a"), F.col("id")], F.col("v"), "s")
    found = {r.id: r.s for r in summed.collect()}
    total = 0
    for key, _, v in want:
        assert found[key] == total
        total += v


def test_no_rows_have_no_numbers(spark):
    df = spark.createDataFrame([], "id long")
    assert with_row_number(df, [F.col("id")]).collect() == []
    assert with_running_sum(df, [F.col("id")], F.lit(1)).collect() == []


def grouped(spark, partitions=4):
    rows = []
    for g in range(60):
        n = 1 + (g * g) % 23
        rows += [(g * 100 + i, f"g{g}", int((i * 7 + g) % 10 < g % 4 * 3)) for i in range(n)]
    rows += [(9000 + i, None, i % 2) for i in range(5)]
    return rows, spark.createDataFrame(rows, "id long, g string, y int").repartition(partitions)


@pytest.mark.parametrize("rows_per_piece", [1_000_000, 4])
def test_groups_stay_whole_and_folds_balanced(spark, rows_per_piece):
    rows, df = grouped(spark)
    got = group_folds(df, "id", "g", "y", 4, rows_per_piece=rows_per_piece).collect()
    assert sorted((r.id, r.g, r.y) for r in got) == sorted(rows, key=lambda r: r[0])
    fold_of = defaultdict(set)
    for r in got:
        fold_of[r.g].add(r.fold)
    assert all(len(f) == 1 for f in fold_of.values()) and len(fold_of) == 61
    size, positive = Counter(r[1] for r in rows), Counter(r[1] for r in rows if r[2])
    buckets = defaultdict(list)
    for g in size:
        buckets[min(7, positive[g] * 8 // size[g])].append(g)
    for own in buckets.values():
        held = Counter({f: 0 for f in range(4)})
        for g in own:
            (f,) = fold_of[g]
            held[f] += size[g]
        assert max(held.values()) - min(held.values()) <= max(size[g] for g in own)


def test_grouped_folds_depend_on_the_rows_alone(spark):
    one = {r.id: r.fold for r in group_folds(grouped(spark, 1)[1], "id", "g", "y").collect()}
    many = {r.id: r.fold for r in group_folds(grouped(spark, 30)[1], "id", "g", "y").collect()}
    assert one == many


def test_a_folded_table_by_group(spark):
    folded = folded_table(grouped(spark)[1], "id", "y", k=3, group="g")
    assert folded.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert folded.count() == len(grouped(spark)[0])


def test_numbering_rows_for_folds_moves_them_once_and_joins_in_place(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    plan = stratified_folds(df, "id", "y", rows_per_piece=10)._jdf.queryExecution().executedPlan().toString()
    (join,) = [line for line in plan.splitlines() if "Join" in line and "_piece" in line]
    assert "SortMergeJoin" in join and plan.count("REPARTITION_BY_COL") == 1
    rows = [line for line in plan.splitlines() if "Exchange" in line and "REPARTITION" not in line]
    assert not any("id#" in line for line in rows)


def test_partners_are_a_seeded_permutation(spark):
    df = spark.range(200).select("id", (F.col("id") * 3).alias("x")).repartition(7)
    got = {r.id: r._partner._c0 for r in with_partner(df, "id", ["x"], 96).collect()}
    digest = lambda seed, i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest()
    first = sorted(range(200), key=lambda i: (digest(96, i), i))
    second = sorted(range(200), key=lambda i: (digest(97, i), i))
    assert got == {a: 3 * b for a, b in zip(first, second, strict=True)}


def test_importance_of_a_linear_arm(spark):
    """Shuffling the category that decides costs most, the constant nothing, and derived ones follow."""
    df = spark.range(900).select(
        "id",
        F.element_at(F.array(*map(F.lit, "pqr")), (F.col("id") % 3 + 1).cast("int")).alias("c"),
        F.lit(1.0).alias("one"),
        (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("noise"),
        ((F.col("id") % 3 == 0) & (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)) > 1)).cast("int").alias("y"),
    )
    arm = Arm("linear", "logistic", numeric=("one", "noise"), categorical=("c",))
    arm = arm.adding("twice", F.col("noise") * 2, run="linear")
    table = permutation_importance(fit_arm(df, arm, "id", "y"), df, "id", "y").collect()
    loss = {r.feature: r.auc_loss for r in table}
    assert [r.rank for r in table] == [1, 2, 3] and table[0].feature == "c"
    assert loss["one"] == 0.0 and loss["c"] > 0.3 and abs(loss["noise"]) < 0.1
