"""A table of hard rows that every operator must take."""

import pytest

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} tail{i}" for i in range(15_000))
ROWS = [
    (0, "A plain text of some ten words or a few more."),
    (1, "A plain text of some ten words or a few more."),
    (2, ""),
    (3, None),
    (4, " \n\t "),
    (5, LONG),
    (6, "Ünïcode 😀 wörds\u00a0and\u2028marks \ud7ff end."),
    (6, "Ünïcode 😀 wörds\u00a0and\u2028marks \ud7ff end."),
    (None, "no id at all, but mail me@example.org and +49 (30) 1234567"),
    (None, None),
    (7, "x"),
]
#: Names that operators use for columns of their own.
CLASHES = (
    "id host path rule label fold score key band fingerprint least content words start n length "
    "piece run rank found base spans row text2 features probability weight paragraph family"
).split()


@pytest.fixture(scope="session")
def hard(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string")
    return rows.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(hard):
    return hard.where("false")
