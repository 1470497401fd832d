"""The table of matches: what is known of each video."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.schema import MATCHES


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with match_id, fps, width, height and n_frames; unknown ones are NULL."""
    return spark.read.schema(MATCHES).json(path)


def timed(rows: DataFrame, matches: DataFrame, fps: float = 24.0) -> DataFrame:
    """``rows`` with ``time`` in seconds by their match's frame rate, or ``fps`` where that is not known."""
    rates = matches.groupBy("match_id").agg(F.max("fps").alias("_fps"))
    joined = rows.drop("time").join(rates, "match_id", "left")
    rate = F.when(F.col("_fps") > 0, F.col("_fps")).otherwise(F.lit(float(fps)))
    return joined.withColumn("time", F.col("frame") / rate).drop("_fps")
