import hashlib

import pytest
from pyspark.sql import functions as F

from foldwise.operators.folds import (
    fold_class_counts,
    fold_sizes,
    held_out_rows,
    stratified_folds,
    training_rows,
)


def labelled(spark, n, positives):
    return spark.range(n).select("id", (F.col("id") < positives).cast("int").alias("y"))


def expected_folds(rows, k, seed):
    key = {i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest() for i, _ in rows}
    order = sorted(rows, key=lambda r: (r[1], key[r[0]], r[0]))
    return {i: place % k for place, (i, _) in enumerate(order)}


@pytest.mark.parametrize("rows_per_piece", [1, 150, 250_000])
@pytest.mark.parametrize("partitions", [1, 50])
def test_equal_to_numbering_the_whole_table(spark, rows_per_piece, partitions):
    df = labelled(spark, 500, 77).repartition(partitions)
    got = {r.id: r.fold for r in stratified_folds(df, "id", "y", 5, 96, rows_per_piece).collect()}
    assert got == expected_folds([(i, int(i < 77)) for i in range(500)], 5, 96)


def test_classes_are_spread_to_within_one_row(spark):
    folded = stratified_folds(labelled(spark, 1003, 98), "id", "y", 5)
    for label in (0, 1):
        counts = [r.n for r in fold_class_counts(folded, "y").where(F.col("y") == label).collect()]
        assert len(counts) == 5
        assert max(counts) - min(counts) <= 1


def test_class_smaller_than_k(spark):
    folded = stratified_folds(labelled(spark, 50, 3), "id", "y", 5)
    counts = fold_class_counts(folded, "y").where("y = 1").collect()
    assert sorted(r.n for r in counts) == [1, 1, 1]


def test_split_is_a_partition_of_the_rows(spark):
    folded = stratified_folds(labelled(spark, 203, 50), "id", "y", 5)
    for row in fold_sizes(folded).collect():
        train = {r.id for r in training_rows(folded, row.fold).collect()}
        valid = {r.id for r in held_out_rows(folded, row.fold).collect()}
        assert (len(train), len(valid)) == (row.n_train, row.n_valid)
        assert not train & valid
        assert train | valid == set(range(203))


def test_seed_changes_the_folds_and_columns_ride_along(spark):
    df = labelled(spark, 100, 30).withColumn("LapTime (s)", F.col("id") * 0.5)
    first = stratified_folds(df, "id", "y", 5, seed=96)
    other = stratified_folds(df, "id", "y", 5, seed=97)
    assert first.columns == ["id", "y", "LapTime (s)", "fold"]
    assert {(r.id, r.fold) for r in first.collect()} != {(r.id, r.fold) for r in other.collect()}


@pytest.mark.parametrize("label", [None, 2])
def test_a_label_other_than_0_and_1_is_an_error(spark, label):
    df = spark.createDataFrame([(1, 0), (2, label)], "id bigint, y int")
    with pytest.raises(Exception, match="label is not 0 or 1"):
        stratified_folds(df, "id", "y").collect()


def test_reserved_names_are_refused(spark):
    for name in ("fold", "_class", "_rank"):
        taken = labelled(spark, 10, 3).withColumn(name, F.lit(1))
        with pytest.raises(ValueError, match=name):
            stratified_folds(taken, "id", "y")
