"""Long tracking files: one line per object and frame, positional columns, unreliable header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_COLUMNS = ("frame", "object", "object_id", "team", "x1", "y1", "x2", "y2", "xp", "yp")


def is_missing(xp: Column, yp: Column) -> Column:
    """Text ``0`` or a blank in either pitch coordinate; ``0.0`` is a value."""
    blank = lambda c: c.isNull() | (F.trim(c) == "") | (c == "0")
    return blank(xp) | blank(yp)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(match_id, src_row, parts) of each line but the first of each file.

    Spark's text scans have no row numbers, and order decides first-seen teams. Files are read whole, a file per
    task, as they are small next to the number of matches."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("match_id"), "value")
    rows = files.select("match_id", F.posexplode(F.split("value", r"\r?\n")).alias("src_row", "line"))
    return rows.filter((F.col("src_row") > 0) & (F.trim("line") != "")).select("match_id", F.col("src_row").cast("long"), F.split("line", ",").alias("parts"))


def parse(rows: DataFrame, fps: float = 24.0) -> DataFrame:
    """Canonical tracks from (match_id, src_row, parts): an object that isn't ``ball`` is a player."""
    text = {name: F.get(F.col("parts"), F.lit(k)) for k, name in enumerate(_COLUMNS)}
    gone = is_missing(text["xp"], text["yp"])
    number = lambda name: F.when(~gone, text[name].try_cast("double"))
    ball = text["object"] == "ball"
    frame = text["frame"].try_cast("int")
    return rows.select(
        "match_id",
        frame.alias("frame"),
        (frame / fps).alias("time"),
        F.when(ball, "ball").otherwise("player").alias("object_type"),
        F.when(ball, F.lit("ball")).otherwise(text["object_id"]).alias("object_id"),
        F.when(~ball, text["team"]).alias("team_label"),
        *(number(c).alias(c) for c in ("x1", "y1", "x2", "y2")),
        number("xp").alias("x"),
        number("yp").alias("y"),
        "src_row",
    ).filter(F.col("frame").isNotNull())


def read_raw(spark: SparkSession, path: str, fps: float = 24.0) -> DataFrame:
    return parse(lines(spark, path), fps)


def objects_of(tracks: DataFrame, match: str = "match_id") -> DataFrame:
    """Players with the team of the row seen first and their order of appearance; later team changes are lost."""
    seen = tracks.filter("object_type <> 'ball'").groupBy(match, "object_id")
    seen = seen.agg(F.min_by("team_label", "src_row").alias("team_label"), F.min("src_row").alias("_first"))
    order = Window.partitionBy(match).orderBy("_first", "object_id")
    return seen.select(
        match, "object_id", F.lit("player").alias("object_type"), "team_label", F.concat(F.lit("Player "), "object_id").alias("name"), F.row_number().over(order).alias("ord")
    )


def match_length(tracks: DataFrame, match: str = "match_id") -> DataFrame:
    """Frames of a match: the number of its ball rows."""
    return tracks.groupBy(match).agg(F.count_if(F.col("object_type") == "ball").alias("n_frames"))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. A minimum of structs aggregates before the shuffle, which ranking doesn't."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in [*order, *rest])).select(rows.columns)
