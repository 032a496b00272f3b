"""Writers for prediction sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_predictions(
    predictions: DataFrame,
    path: str,
    id_col: str = "id",
    score_col: str = "PitNextLap",
    single_file: bool = False,
) -> None:
    """Write ``(id, score)`` as CSV with a header, replacing what is at ``path``.

    One part file per task by default. ``single_file`` funnels every row through one task and is
    only for handing a small result to an outside consumer.
    """
    out = predictions.select(F.col(f"`{id_col}`"), F.col(f"`{score_col}`"))
    if single_file:
        out = out.repartition(1)
    out.write.mode("overwrite").option("header", True).csv(path)
