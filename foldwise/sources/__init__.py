from foldwise.sources.schema import LAPS, LAPS_TEST, PREDICTIONS, TableSpec
from foldwise.sources.sinks import write_predictions
from foldwise.sources.tables import Bundle, read_predictions, read_table

__all__ = [
    "LAPS",
    "LAPS_TEST",
    "PREDICTIONS",
    "Bundle",
    "TableSpec",
    "read_predictions",
    "read_table",
    "write_predictions",
]
