"""Wide tracking files: three header rows (team, player id, name), then period, frame, time and coordinate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.sources.raw import is_missing


def parse_wide(files: DataFrame) -> DataFrame:
    """Tracks from (match_id, value), ``value`` a whole file. The last column named Ball is the ball."""
    rows = files.select("match_id", F.split("value", r"\r?\n").alias("_lines"))
    cells = lambda k: F.split(F.get("_lines", F.lit(k)), ",")
    rows = rows.select("match_id", cells(0).alias("teams"), cells(1).alias("ids"), cells(2).alias("names"), F.posexplode("_lines").alias("_no", "_line"))
    rows = rows.filter((F.col("_no") > 2) & (F.trim("_line") != "")).withColumn("c", F.split("_line", ","))
    # columns 3, 5, ...: one object each
    at = F.sequence(F.lit(3), F.greatest(F.lit(3), F.size("names") - 1), F.lit(2))
    balls = F.array_max(F.transform(F.sequence(F.lit(0), F.size("names") - 1), lambda i: F.when(F.trim(F.get("names", i)) == "Ball", i).otherwise(-1)))
    rows = rows.withColumn("_ball", balls).select("*", F.explode(at).alias("i"))
    rows = rows.filter((F.trim(F.get("names", F.col("i"))) != "Ball") | (F.col("i") == F.col("_ball")))
    xp, yp = F.get("c", F.col("i")), F.get("c", F.col("i") + 1)
    ball, gone = F.col("i") == F.col("_ball"), is_missing(xp, yp)
    ident = F.when(ball, "ball").otherwise(F.get("ids", F.col("i")))
    blank = F.lit(None).cast("double")
    return rows.select(
        "match_id",
        F.get("c", F.lit(1)).try_cast("int").alias("frame"),
        F.get("c", F.lit(2)).try_cast("double").alias("time"),
        F.when(ball, "ball").otherwise("player").alias("object_type"),
        ident.alias("object_id"),
        F.when(~ball, F.get("teams", F.col("i"))).alias("team_label"),
        *(blank.alias(k) for k in ("x1", "y1", "x2", "y2")),
        F.when(~gone, xp.try_cast("double")).alias("x"),
        F.when(~gone, yp.try_cast("double")).alias("y"),
        (F.col("_no").cast("long") * 1_000_000 + F.col("i")).alias("src_row"),
        F.when(~ball, F.get("names", F.col("i"))).alias("name"),
    )


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    return parse_wide(spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("match_id"), "value"))


def objects_of(tracks: DataFrame) -> DataFrame:
    """Players with team, name and place among the columns, from parsed rows."""
    from pitchgrid.sources.raw import objects_of as by_first_row

    names = tracks.filter("object_type <> 'ball'").groupBy("match_id", "object_id").agg(F.min_by("name", "src_row").alias("name"))
    return by_first_row(tracks).drop("name").join(names, ["match_id", "object_id"], "left").select("match_id", "object_id", "object_type", "team_label", "name", "ord")


def wide_rows(tracks: DataFrame, objects: DataFrame, keys: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """A row per match and frame from 1 to the last that any of its rows has: ``cells``, a struct (x, y) for each of the
    match's objects in order, then the ball; NULL where missing. The first row of an object and frame counts.

    A match's objects are data, not columns, so matches with any objects go through one plan."""
    ball = F.col("object_type") == "ball"
    ident = F.when(~ball, F.col("object_id").cast("string"))
    first = tracks.groupBy(*keys, "frame", ident.alias("_id")).agg(F.min_by(F.struct("x", "y"), "src_row").alias("_at"))
    entry = F.struct(F.coalesce("_id", F.lit("ball:")).alias("key"), "_at")
    by_frame = first.groupBy(*keys, "frame").agg(F.map_from_entries(F.collect_list(entry)).alias("_seen"))
    frames = by_frame.groupBy(*keys).agg(F.max("frame").alias("_n"))
    spine = frames.select(*keys, F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_n").cast("int")))).alias("frame"))
    order = objects.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("object_id").cast("string").alias("id")))), lambda o: o["id"]).alias("_order"))
    rows = spine.join(by_frame, [*keys, "frame"], "left").join(order, list(keys), "left")
    ids = F.concat(F.coalesce("_order", F.array().cast("array<string>")), F.array(F.lit("ball:")))
    return rows.select(*keys, "frame", F.transform(ids, lambda i: F.col("_seen")[i]).alias("cells"))


def wide_lines(tracks: DataFrame, objects: DataFrame, seconds_per_frame: float = 0.04, keys: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """(keys, frame, ord, line) of the wide format: three header lines (frame 0: teams, ids, names with the ball last),
    then period 1, the frame, its time and a pair per object, 0 and 0 where missing."""
    cell = lambda c: F.when(c["x"].isNotNull() & c["y"].isNotNull(), F.concat_ws(",", c["x"].cast("string"), c["y"].cast("string"))).otherwise(F.lit("0,0"))
    rows = wide_rows(tracks, objects, keys)
    start = F.concat_ws(",", F.lit("1"), F.col("frame").cast("string"), (F.col("frame") * seconds_per_frame).cast("string"))
    rows = rows.select(*keys, "frame", F.lit(0).alias("ord"), F.concat(start, F.lit(","), F.array_join(F.transform("cells", cell), ",")).alias("line"))
    matches = tracks.select(*keys).distinct()
    listed = F.array_sort(F.collect_list(F.struct("ord", F.coalesce(F.col("team_label").cast("string"), F.lit("")).alias("t"), F.col("object_id").cast("string").alias("i"), F.coalesce("name", F.lit("")).alias("n"))))
    heads = matches.join(objects.groupBy(*keys).agg(listed.alias("o")), list(keys), "left").withColumn("o", F.coalesce("o", F.slice(F.array(F.struct(F.lit(0).alias("ord"), *(F.lit("").alias(k) for k in "tin"))), 1, 0)))
    text = lambda first, field, last: F.concat(F.lit(first), F.array_join(F.concat(F.transform("o", lambda x: x[field]), F.array(F.lit(last))), ",,"), F.lit(","))
    lines = F.array(text(",,,", "t", ""), text(",,,", "i", ""), text("Period,Frame,Time [s],", "n", "Ball"))
    heads = heads.select(*keys, F.lit(0).alias("frame"), F.posexplode(lines).alias("ord", "line"))
    return heads.unionByName(rows)
