import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foldwise.operators import skew
from foldwise.operators.folds import stratified_folds
from foldwise.operators.target_stats import (
    apply_target_stat,
    fold_target_stats,
    ordered_target_stat,
    target_stat_table,
)
from foldwise.workspace import materialize

SCHEMA = "id bigint, c string, y int"


def skewed_rows(n=600):
    """A third of the rows in one category, a sixth NULL, the rest in a long tail."""
    draw = random.Random(5)

    def category(i):
        if i % 3 == 0:
            return "hot"
        return None if i % 6 == 1 else f"t{draw.randrange(80)}"

    return [(i, category(i), draw.randrange(2)) for i in range(n)]


def by_hand(rows, prior=0.5, weight=1.0, seed=96):
    groups = defaultdict(list)
    for i, c, y in rows:
        groups[c].append((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i, y))
    out = {}
    for members in groups.values():
        total = count = 0
        for _, i, y in sorted(members):
            out[i] = (total + weight * prior) / (count + weight)
            total, count = total + y, count + 1
    return out


@pytest.mark.parametrize("rows_per_piece", [10**6, 1, 60, 200])
@pytest.mark.parametrize("partitions", [1, 8])
def test_equal_to_a_running_mean_by_hand(spark, rows_per_piece, partitions):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = ordered_target_stat(df, "id", "c", "y", rows_per_piece=rows_per_piece).collect()
    assert {r.id: r.stat for r in got} == pytest.approx(by_hand(rows))
    assert len(got) == len(rows)


def test_first_row_of_a_category_gets_the_prior(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA)
    got = ordered_target_stat(df, "id", "c", "y", prior=0.2, weight=3.0).collect()
    assert [r.stat for r in got] == pytest.approx([0.2, 0.2])


def test_own_label_is_never_seen(spark):
    rows = skewed_rows(120)
    base = {r.id: r.stat for r in _stats(spark, rows)}
    flipped = [(i, c, 1 - y if i == 30 else y) for i, c, y in rows]
    assert {r.id: r.stat for r in _stats(spark, flipped)}[30] == base[30]


def _stats(spark, rows):
    return ordered_target_stat(spark.createDataFrame(rows, SCHEMA), "id", "c", "y").collect()


@pytest.mark.parametrize("rows_per_piece", [5, 10**6])
def test_other_rows_get_the_whole_training_mean(spark, rows_per_piece):
    rows = skewed_rows()
    train = spark.createDataFrame(rows, SCHEMA)
    table = target_stat_table(train, "c", "y")
    new = [(1000 + i, c) for i, c in enumerate(["hot"] * 30 + [None] * 5 + ["t1", "unseen"])]
    df = spark.createDataFrame(new, "id bigint, c string")
    got = apply_target_stat(df, table, "id", "c", rows_per_piece=rows_per_piece).collect()
    assert len(got) == len(new)
    for row in got:
        labels = [y for _, c, y in rows if c == row.c]
        assert row.stat == pytest.approx((sum(labels) + 0.5) / (len(labels) + 1))


def test_chained_statistics_read_the_source_once_each(spark):
    rows = skewed_rows(200)
    base = spark.createDataFrame(rows, SCHEMA).withColumn("d", F.concat("c", F.col("id") % 2))
    once = ordered_target_stat(base, "id", "c", "y", "c_stat", rows_per_piece=40)
    both = ordered_target_stat(once, "id", "d", "y", "d_stat", rows_per_piece=40, base=base)
    got = both.collect()
    assert {r.id: r.c_stat for r in got} == pytest.approx(by_hand(rows))
    split = [(i, None if c is None else f"{c}{i % 2}", y) for i, c, y in rows]
    assert {r.id: r.d_stat for r in got} == pytest.approx(by_hand(split))


@pytest.mark.parametrize("rows_per_piece", [10**6, 40])
def test_all_folds_at_once_equal_one_fold_at_a_time(spark, rows_per_piece):
    df = spark.createDataFrame(skewed_rows(300), SCHEMA)
    folded = stratified_folds(df, "id", "y", k=3)
    at_once = fold_target_stats(folded, "id", "c", "y", 3, rows_per_piece=rows_per_piece)
    got = {r.id: r.stats for r in at_once.collect()}
    assert len(got) == 300
    for fold in range(3):
        train = folded.where(F.col("fold") != fold)
        held_out = folded.where(F.col("fold") == fold)
        table = target_stat_table(train, "c", "y")
        one = ordered_target_stat(train, "id", "c", "y").unionByName(
            apply_target_stat(held_out, table, "id", "c")
        )
        assert {i: stats[fold] for i, stats in got.items()} == pytest.approx(
            {r.id: r.stat for r in one.collect()}
        )


def test_held_out_labels_do_not_reach_their_own_fold(spark):
    rows = skewed_rows(150)
    folded = materialize(stratified_folds(spark.createDataFrame(rows, SCHEMA), "id", "y", k=3), "f")
    other = F.when(F.col("fold") == 1, 1 - F.col("y")).otherwise(F.col("y"))
    flipped = folded.withColumn("y", other)
    a, b = (
        {r.id: r.stats for r in fold_target_stats(df, "id", "c", "y", 3).collect()}
        for df in (folded, flipped)
    )
    assert all(a[i][1] == b[i][1] for i in a)
    assert any(a[i][0] != b[i][0] for i in a)


def test_an_id_with_a_dot(spark):
    rows = skewed_rows(60)
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("id", "row.id")
    got = ordered_target_stat(df, "row.id", "c", "y", rows_per_piece=5).collect()
    assert {r["row.id"]: r.stat for r in got} == pytest.approx(by_hand(rows))
    folded = df.withColumn("fold", F.col("`row.id`") % 2)
    assert fold_target_stats(folded, "row.id", "c", "y", 2, rows_per_piece=5).count() == 60
    table = target_stat_table(df, "c", "y")
    assert apply_target_stat(df, table, "row.id", "c", rows_per_piece=5).count() == 60


@pytest.mark.parametrize("at_most, rows_per_piece", [(20, 20), (20, 6), (10**6, 6)])
def test_either_way_to_find_pieces_gives_the_same(spark, monkeypatch, at_most, rows_per_piece):
    """Hot categories are broadcast, joined by key, or both; categories and labels may be NULL."""
    monkeypatch.setattr(skew, "ROWS_PER_PIECE", at_most)
    df = spark.createDataFrame(skewed_rows(), SCHEMA).withColumn("y", F.expr("if(id % 11 = 0, NULL, y)"))
    folded = df.withColumn("fold", F.col("id") % 3)
    for encode in (
        lambda n: ordered_target_stat(df, "id", "c", "y", out="s", rows_per_piece=n),
        lambda n: fold_target_stats(folded, "id", "c", "y", 3, out="s", rows_per_piece=n),
    ):
        cut, whole = ({r.id: r for r in encode(n).collect()} for n in (rows_per_piece, 10**6))
        assert cut == whole
        assert len(cut) == 600
