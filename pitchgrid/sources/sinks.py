"""Writers: lines of the long and wide formats in their total order, and the champion's record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header lines of the tracking formats, with the names that they repeat.
RAW_HEADER = "Frame,Object,Object ID,Team,X1,Y1,X2,X2,X_Pitch,Y_Pitch"
TRACKER_HEADER = "Frame,Object,Object ID,Team,X1,Y1,X1,X2,X_Pitch,Y_Pitch"


def _text(c: str, missing: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(missing))


def raw_lines(tracks: DataFrame, objects: DataFrame, missing: str = "") -> DataFrame:
    """(match_id, frame, ord, line): by frame, players in order, then the ball. The first row per object and frame
    counts; teams are the objects'. A missing point is written as ``missing``, so that reading it gives NULL again."""
    from pitchgrid.sources.raw import keep_first

    first = keep_first(tracks.select("match_id", "object_id", "frame", "object_type", "x1", "y1", "x2", "y2", "x", "y", "src_row"), ["match_id", "object_id", "frame"], ["src_row"])
    named = first.join(objects.select("match_id", "object_id", "team_label", "ord"), ["match_id", "object_id"], "left")
    ball = F.col("object_type") == "ball"
    parts = [
        F.col("frame").cast("string"),
        F.col("object_type"),
        F.when(ball, "0").otherwise(F.col("object_id")),
        F.when(ball, "0").otherwise(F.coalesce("team_label", F.lit(""))),
        *(_text(c, missing) for c in ("x1", "y1", "x2", "y2", "x", "y")),
    ]
    return named.select("match_id", "frame", F.when(ball, F.lit(2_147_483_647)).otherwise(F.coalesce("ord", F.lit(2_147_483_646))).alias("ord"), F.concat_ws(",", *parts).alias("line"))


def write_lines(lines: DataFrame, path: str, header: str | None = RAW_HEADER, single: bool = False) -> None:
    """Text files in total order, one folder per match; ``single``: one file a match, each in one task, that begins with
    ``header`` (None: the lines hold their own)."""
    if single:
        # a match is one task's, so the header can go before its first line
        ordered = lines.select("match_id", "frame", "ord", "line")
        if header is not None:
            ordered = ordered.unionByName(lines.select("match_id").distinct().select("match_id", F.lit(-1).alias("frame"), F.lit(-1).alias("ord"), F.lit(header).alias("line")))
        ordered = ordered.repartition("match_id").sortWithinPartitions("match_id", "frame", "ord")
        ordered.select("match_id", "line").write.partitionBy("match_id").text(path)
    else:
        lines.repartitionByRange("match_id", "frame", "ord").sortWithinPartitions("match_id", "frame", "ord").select("match_id", "line").write.partitionBy("match_id").text(path)


def champion_record(champions: DataFrame, path: str) -> None:
    champions.write.mode("overwrite").json(path)
