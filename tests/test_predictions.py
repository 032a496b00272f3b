import pytest

from foldwise.operators.predictions import (
    blend_mean,
    duplicate_ids,
    id_counts,
    join_predictions,
    missing_ids,
)

SCHEMA = "id bigint, PitNextLap double"


def prediction_set(spark, **scores):
    return spark.createDataFrame([(int(k[1:]), v) for k, v in scores.items()], SCHEMA)


def test_join_is_inner_with_one_column_per_set(spark):
    a = prediction_set(spark, i1=0.2, i2=0.4, i3=None)
    b = prediction_set(spark, i2=0.8, i3=0.5, i4=0.1)
    got = join_predictions({"PitNextLap": a, "PitNextLap_lgb": b})
    assert got.columns == ["id", "PitNextLap", "PitNextLap_lgb"]
    assert sorted(map(tuple, got.collect())) == [(2, 0.4, 0.8), (3, None, 0.5)]


def test_blend_of_two_and_of_three(spark):
    a = prediction_set(spark, i1=0.2, i2=0.4)
    b = prediction_set(spark, i1=0.4, i2=0.8)
    c = prediction_set(spark, i2=0.9, i1=0.6)
    assert sorted(map(tuple, blend_mean({"a": a, "b": b}).collect())) == [
        (1, pytest.approx(0.3)),
        (2, pytest.approx(0.6)),
    ]
    got = {r.id: r.PitNextLap for r in blend_mean({"a": a, "b": b, "c": c}).collect()}
    assert got == {1: pytest.approx(0.4), 2: pytest.approx(0.7)}


def test_a_repeated_id_is_an_error_and_is_reported(spark):
    a = prediction_set(spark, i1=0.2, i2=0.4)
    b = prediction_set(spark, i1=0.4).unionByName(prediction_set(spark, i1=0.5, i2=0.1))
    with pytest.raises(Exception, match="duplicate id in a prediction set: 1"):
        blend_mean({"a": a, "b": b}).collect()
    assert [tuple(r) for r in duplicate_ids(b).collect()] == [(1, 2)]


def test_null_ids_do_not_meet(spark):
    a = spark.createDataFrame([(None, 0.1), (1, 0.2)], SCHEMA)
    assert [tuple(r) for r in blend_mean({"a": a, "b": a}).collect()] == [(1, 0.2)]


def test_coverage(spark):
    expected = prediction_set(spark, i1=0.0, i2=0.0, i3=0.0)
    actual = prediction_set(spark, i2=0.5, i9=0.5)
    assert sorted(r.id for r in missing_ids(expected, actual).collect()) == [1, 3]
    counts = {r.id: (r.e, r.a) for r in id_counts({"e": expected, "a": actual}).collect()}
    assert counts == {1: (1, 0), 2: (1, 1), 3: (1, 0), 9: (0, 1)}


@pytest.mark.parametrize("look", [lambda df: df.count(), lambda df: df.select("id", "b").collect()])
def test_no_projection_hides_a_repeated_id(spark, look):
    a = prediction_set(spark, i1=0.2).unionByName(prediction_set(spark, i1=0.3, i2=0.4))
    b = prediction_set(spark, i1=0.5, i2=0.6)
    for sets in ({"a": a, "b": b}, {"b": b, "a": a}):
        with pytest.raises(Exception, match="duplicate id in a prediction set: 1"):
            look(join_predictions(sets))


def test_an_id_with_a_dot(spark):
    a = prediction_set(spark, i1=0.2, i2=0.4).withColumnRenamed("id", "row.id")
    got = blend_mean({"a": a, "b": a}, id_col="row.id")
    assert sorted(map(tuple, got.collect())) == [(1, 0.2), (2, 0.4)]
    assert missing_ids(a, a, "row.id").count() == duplicate_ids(a, "row.id").count() == 0
