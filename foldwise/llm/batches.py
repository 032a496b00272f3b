"""Bounded batches between Spark and its Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of one Arrow batch at most: batches of very long texts hold fewer rows, so that a worker's
#: memory does not follow the length of its texts.
BATCH_BYTES = 16 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Set the bound in the session, unless it has a smaller one."""
    if _bytes(spark.conf.get(_SETTING)) > BATCH_BYTES:
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def _bytes(value: str) -> int:
    """A size as settings write it: digits, and perhaps a unit."""
    digits = value.rstrip("bBkKmMgG")
    unit = value[len(digits) :].lower().rstrip("b")
    return int(digits) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]
