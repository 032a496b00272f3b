"""Declared schemas, so that no scan has to infer types with a second pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """Column roles of a classification table."""

    id: str
    label: str
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    schema: T.StructType | None = field(default=None, compare=False)

    @property
    def features(self) -> tuple[str, ...]:
        return self.categorical + self.numeric

    def test_schema(self) -> T.StructType | None:
        """The schema without the label, which test tables do not carry."""
        if self.schema is None:
            return None
        return T.StructType([f for f in self.schema.fields if f.name != self.label])


# The lap table's columns, in file order.
_LAP_FIELDS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("Driver", T.StringType()),
        T.StructField("Compound", T.StringType()),
        T.StructField("Race", T.StringType()),
        T.StructField("Year", T.LongType()),
        T.StructField("PitStop", T.LongType()),
        T.StructField("LapNumber", T.LongType()),
        T.StructField("Stint", T.LongType()),
        T.StructField("TyreLife", T.DoubleType()),
        T.StructField("Position", T.LongType()),
        T.StructField("LapTime (s)", T.DoubleType()),
        T.StructField("LapTime_Delta", T.DoubleType()),
        T.StructField("Cumulative_Degradation", T.DoubleType()),
        T.StructField("RaceProgress", T.DoubleType()),
        T.StructField("Position_Change", T.DoubleType()),
        T.StructField("PitNextLap", T.LongType()),
    ]
)

LAPS = TableSpec(
    id="id",
    label="PitNextLap",
    categorical=("Driver", "Compound", "Race"),
    numeric=tuple(
        f.name
        for f in _LAP_FIELDS.fields
        if f.name not in ("id", "PitNextLap") and not isinstance(f.dataType, T.StringType)
    ),
    schema=_LAP_FIELDS,
)

LAPS_TEST = LAPS.test_schema()

# A prediction file re-read with inference would turn small ids into INT, hence the fixed types.
PREDICTIONS = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("PitNextLap", T.DoubleType())]
)
