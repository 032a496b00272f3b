"""Small lap tables in the real layout, made by Spark from hashes of the id."""

from pyspark.sql import functions as F

from foldwise.sources.schema import LAPS


def laps(spark, first, n):
    def u(name):
        return F.pmod(F.xxhash64(F.col("id"), F.lit(name)), F.lit(10_000)) / F.lit(10_000.0)

    def pick(name, values):
        options = F.array(*[F.lit(v) for v in values])
        return F.element_at(options, F.floor(u(name) * len(values)).cast("int") + 1)

    df = spark.range(first, first + n).select(
        "id",
        F.concat(F.lit("D"), F.floor(u("driver") * 60)).alias("Driver"),
        pick("compound", ["HARD", "MEDIUM", "SOFT"]).alias("Compound"),
        pick("race", ["North", "South"]).alias("Race"),
        (F.floor(u("year") * 3) + 2023).alias("Year"),
        F.floor(u("pit") * 3).alias("PitStop"),
        (F.floor(u("lap") * 60) + 1).alias("LapNumber"),
        (F.floor(u("stint") * 4) + 1).alias("Stint"),
        F.floor(u("tyre") * 40).cast("double").alias("TyreLife"),
        (F.floor(u("position") * 20) + 1).alias("Position"),
        F.when(u("gap") > 0.05, 80 + 20 * u("time")).alias("LapTime (s)"),
        (4 * u("delta") - 2).alias("LapTime_Delta"),
        (10 * u("wear")).alias("Cumulative_Degradation"),
        u("progress").alias("RaceProgress"),
        (F.floor(6 * u("change")) - 3).cast("double").alias("Position_Change"),
        (u("tyre") + 0.3 * u("noise") > 0.75).cast("bigint").alias("PitNextLap"),
    )
    return spark.createDataFrame(df.collect(), LAPS.schema)
