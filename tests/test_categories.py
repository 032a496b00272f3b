import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from foldwise.operators.categories import (
    align_categories,
    category_dictionary,
    index_categories,
    one_hot_columns,
    one_hot_encoder,
    vocabulary,
    with_sizes,
)
from foldwise.operators.skew import hot_keys


@pytest.fixture(scope="module")
def train(spark):
    rows = [(1, "SOFT"), (2, "HARD"), (3, "MEDIUM"), (4, "SOFT"), (5, None)]
    return spark.createDataFrame(rows, "id bigint, Compound string")


@pytest.fixture(scope="module")
def test(spark):
    rows = [(10, "SOFT"), (11, "WET"), (12, None), (13, "HARD")]
    return spark.createDataFrame(rows, "id bigint, Compound string")


@pytest.mark.parametrize("partitions", [1, 7])
def test_dictionary_is_dense_and_alphabetical(spark, partitions):
    df = spark.range(5000).select(F.concat(F.lit("driver"), F.col("id") % 1234).alias("c"))
    got = category_dictionary(df.repartition(partitions), "c").collect()
    expected = sorted({f"driver{i % 1234}" for i in range(5000)})
    assert {r.category: r.category_idx for r in got} == {c: i for i, c in enumerate(expected)}


@pytest.mark.parametrize("rows_per_piece", [1, 10**6])
def test_unseen_and_null_share_the_last_index(train, test, rows_per_piece):
    dictionary = category_dictionary(train, "Compound")
    for df in (train, test):
        got = index_categories(df, "id", "Compound", dictionary, rows_per_piece=rows_per_piece)
        assert got.columns == ["id", "Compound", "category_idx"]
        known = {"HARD": 0, "MEDIUM": 1, "SOFT": 2}
        for row in got.collect():
            assert row.category_idx == known.get(row.Compound, 3)
        assert got.count() == df.count()


def test_vocabulary_is_sorted_and_limited(spark, train):
    assert vocabulary(train, ["Compound"], [3]) == {"Compound": ["HARD", "MEDIUM", "SOFT"]}
    with pytest.raises(ValueError, match="Compound"):
        vocabulary(train, ["Compound"], [2])
    many = spark.range(500).select(
        F.col("id").cast("string").alias("a"),
        F.lit("x").alias("b"),
        F.lit(None).cast("string").alias("c"),
    )
    assert vocabulary(many, ["b", "c"], [20, 20]) == {"b": ["x"], "c": []}
    with pytest.raises(ValueError, match=r"\['a'\]"):
        vocabulary(many, ["a", "b"], [499, 1])
    assert vocabulary(many, [], []) == {}


def test_one_hot_keeps_every_training_category_and_no_other(train, test):
    dictionary = category_dictionary(train, "Compound")
    for df, expected in (
        (train, {1: "SOFT", 2: "HARD", 3: "MEDIUM", 4: "SOFT", 5: None}),
        (test, {10: "SOFT", 11: None, 12: None, 13: "HARD"}),
    ):
        coded = index_categories(df, "id", "Compound", dictionary, out="Compound__code", size=3)
        sized = with_sizes(coded, {"Compound": 3})
        hot = one_hot_encoder({"Compound": 3}).fit(sized).transform(sized)
        for row in hot.select("id", vector_to_array("Compound__hot").alias("v")).collect():
            order = ["HARD", "MEDIUM", "SOFT"]
            assert list(row.v) == [float(expected[row.id] == c) for c in order]


def test_indicator_columns_are_named_after_their_category(train):
    known = vocabulary(train, ["Compound"], [100])
    got = one_hot_columns(train, known)
    assert got.columns == ["id", "Compound_HARD", "Compound_MEDIUM", "Compound_SOFT"]
    assert got.where("id = 5").first()[1:] == (0, 0, 0)


def test_alignment(train, test):
    got = {r.category: r.action for r in align_categories(train, test, "Compound").collect()}
    assert got == {"SOFT": "keep", "HARD": "keep", "MEDIUM": "zero_fill", "WET": "drop"}


def test_hot_keys_are_those_with_more_rows_than_a_piece(spark):
    key = F.when(F.col("id") < 400, "a").when(F.col("id") < 700, None)
    df = spark.range(1000).select(key.otherwise(F.col("id").cast("string")).alias("k"))
    got = {r.hot_key: r.pieces for r in hot_keys(df, "k", 100).collect()}
    assert got == {"a": 4, None: 3}
    assert hot_keys(df, "k", 350).count() == 1


def test_columns_of_different_sizes_are_encoded_together(spark):
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "c", "y")]
    df = spark.createDataFrame(rows, "id int, p string, q string")
    known = vocabulary(df, ["p", "q"], [10, 10])
    rows = one_hot_columns(df, known).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 0, 0, 1, 0), (2, 0, 1, 0, 1, 0), (3, 0, 0, 1, 0, 1)]
