"""Scans: train/test/sample bundles, CSV tables and prediction files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.sources.schema import PREDICTIONS, TableSpec


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV scan with a header. Without a schema the types are inferred, at the cost of a pass.

    A declared schema is matched against the header, so a reordered file fails instead of being
    read into the wrong columns.
    """
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).option("enforceSchema", False).csv(path)


def read_predictions(
    spark: SparkSession, path: str, schema: T.StructType = PREDICTIONS
) -> DataFrame:
    """Scan of an ``(id, probability)`` file."""
    return read_table(spark, path, schema)


@dataclass(frozen=True)
class Bundle:
    """The three tables of an experiment, by role rather than by position in a folder."""

    train: DataFrame
    test: DataFrame
    sample: DataFrame | None = None

    @classmethod
    def read(
        cls,
        spark: SparkSession,
        train: str,
        test: str,
        sample: str | None = None,
        spec: TableSpec | None = None,
    ) -> Bundle:
        """Read by explicit path. Tables of an unknown layout (no ``spec``) are inferred."""
        train_schema = spec.schema if spec else None
        test_schema = spec.test_schema() if spec else None
        sample_schema = None
        if spec and spec.schema is not None:
            sample_schema = T.StructType(
                [spec.schema[spec.id], T.StructField(spec.label, T.DoubleType())]
            )
        return cls(
            train=read_table(spark, train, train_schema),
            test=read_table(spark, test, test_schema),
            sample=read_table(spark, sample, sample_schema) if sample else None,
        )

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, spec: TableSpec | None = None) -> Bundle:
        """A folder of exactly three tables which, sorted by name, are sample, test and train.

        A table is a file or a folder of part files; names that start with a dot or an underscore
        are not counted. The column check in ``bundle_check`` is what confirms roles.
        """
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        entries = [entry.getPath() for entry in store.listStatus(place)]
        paths = sorted(e.toString() for e in entries if e.getName()[0] not in "._")
        if len(paths) != 3:
            raise ValueError(f"expected exactly 3 files in {folder}, found {len(paths)}")
        sample, test, train = paths
        return cls.read(spark, train=train, test=test, sample=sample, spec=spec)


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    """First ``rows`` rows; together with ``shape`` this is what printing a table shows."""
    return df.limit(rows)


def shape(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, and the table's row count."""
    spark = df.sparkSession
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    columns = spark.createDataFrame(
        [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)],
        "position int, column string, dtype string",
    )
    return columns.withColumn("n_rows", counted.scalar())
