"""Aggregations over objects, frames and training runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.functions.geometry import label_place, label_text
from pitchgrid.operators import folds


def zscore(rows: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Columns less their mean by their population deviation, which counts as 1 where it is 0."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({c: (F.col(c) - F.avg(c).over(w)) / F.coalesce(F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)), F.lit(1.0)) for c in columns})


def median_residual(rows: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Exact median of the distance to the mean."""
    means = rows.groupBy(*keys).agg(F.avg(column).alias("_m"))
    return rows.join(means, list(keys)).groupBy(*keys).agg(F.median(F.abs(F.col(column) - F.col("_m"))).alias("median_residual"))


def neighbour_distance(rows: DataFrame, columns: Sequence[str], k: int, keys: Sequence[str]) -> DataFrame:
    """The exact median, over an object's points, of the distance to the ``k``-th nearest of them, the point itself counted;
    NULL for objects of fewer than ``k`` points. An object's points are compared in blocks inside a task."""
    schema = T.StructType([*(rows.schema[c] for c in keys), T.StructField("median_distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in folds.objects(batches, len(keys)):
            z = np.column_stack([table[c].to_numpy() for c in columns]).astype(float)
            far = []
            for a in range(0, len(z) if len(z) >= k else 0, 512):
                d = np.sqrt(((z[a : a + 512, None, :] - z[None, :, :]) ** 2).sum(2))
                far.append(np.partition(d, k - 1, axis=1)[:, k - 1])
            median = float(np.median(np.concatenate(far))) if far else None
            yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks().slice(0, 1) for c in keys), pa.array([median], pa.float64())], [*keys, "median_distance"])

    whole = rows.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns)).dropna(subset=list(columns))
    return whole.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def last_seen(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last position from 1 with a point, 0 if none."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("frame"))
    placed = rows.withColumn("_n", n)
    return placed.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("x").isNotNull(), F.col("_n"))), F.lit(0)).alias("last_frame"))


def still_exists(rows: DataFrame, after: int, keys: Sequence[str]) -> DataFrame:
    """Whether there is a point at a position, from 0, beyond ``after``."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("frame")) - 1
    placed = rows.withColumn("_n", n)
    return placed.groupBy(*keys).agg(F.bool_or((F.col("_n") > after) & F.col("x").isNotNull()).alias("still_exists"))


def moments(rows: DataFrame, keys: Sequence[str] = ("match_id", "frame"), fields: Sequence[str] = ("object_id", "x", "y"), team: str = "team_id", balls: DataFrame | None = None) -> DataFrame:
    """A row per frame: ``home`` and ``away``, arrays of the frame's objects by id.

    With ``balls`` (keys, time and the fields but the id), a row per frame of the ball, with ``time`` and ``ball``: a
    frame without players has empty arrays, and players of a frame without the ball are left out."""
    item = F.struct(*fields)
    side = lambda home: F.array_sort(F.collect_list(F.when((F.col(team) < 1) if home else ~F.coalesce(F.col(team) < 1, F.lit(False)), item)))
    players = rows.groupBy(*keys).agg(side(True).alias("home"), side(False).alias("away"))
    if balls is None:
        return players
    one = balls.groupBy(*keys).agg(F.min("time").alias("time"), F.min(F.struct(*fields[1:])).alias("ball"))
    none = F.array().cast(players.schema["home"].dataType)
    joined = one.join(players, list(keys), "left")
    return joined.select(*keys, "time", "ball", *(F.coalesce(F.col(c), none).alias(c) for c in ("home", "away")))


def player_loc(object_id) -> Column:
    """Of a moment: where the player with this id is, a struct (x, y); NULL if not there or without a point."""
    found = F.get(F.filter(F.concat("home", "away"), lambda o: o["object_id"].cast("string") == F.lit(str(object_id))), F.lit(0))
    return F.when(found["x"].isNotNull() & found["y"].isNotNull(), F.struct(found["x"].alias("x"), found["y"].alias("y")))


def ball_loc() -> Column:
    """Of a moment: where the ball is, a struct (x, y); NULL without a point."""
    ball = F.col("ball")
    return F.when(ball["x"].isNotNull() & ball["y"].isNotNull(), F.struct(ball["x"].alias("x"), ball["y"].alias("y")))


def render_records(tracks: DataFrame, last: DataFrame, keys: Sequence[str] = ("match_id",), team: str = "team_label") -> DataFrame:
    """What a renderer draws of each frame from 1 to a match's last (``last``: keys, n_frames): ``players`` in the order of
    their ids (box, label and where it stands, team), the pitch points of either side, the ball's box and pitch point.
    A frame without players or ball has empty arrays and NULLs."""
    number = F.col(team).try_cast("double")
    label_x, label_y = label_place()
    ball_x, ball_y = label_place(dx=17, dy=10)
    there = tracks.withColumn("_team", number)
    ball = F.col("object_type") == "ball"
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    player = F.struct("object_id", *box, label_text("object_id", "Player #").alias("label"), label_x.alias("label_x"), label_y.alias("label_y"), number.cast("int").alias("team"))
    point = F.struct("object_id", "x", "y")
    home = F.coalesce(F.col("_team") < 1, F.lit(False))
    seen = there.groupBy(*keys, "frame").agg(
        F.array_sort(F.collect_list(F.when(~ball, player))).alias("players"),
        F.array_sort(F.collect_list(F.when(~ball & home, point))).alias("home_points"),
        F.array_sort(F.collect_list(F.when(~ball & ~home, point))).alias("away_points"),
        F.min(F.when(ball, F.struct(ball_x.alias("x1"), ball_y.alias("y1"), "x2", "y2"))).alias("ball"),
        F.min(F.when(ball, F.struct("x", "y"))).alias("ball_point"),
    )
    spine = last.select(*keys, F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n_frames").cast("int")))).alias("frame"))
    joined = spine.join(seen, [*keys, "frame"], "left")
    lists = ("players", "home_points", "away_points")
    return joined.select(*keys, "frame", *(F.coalesce(F.col(c), F.array().cast(seen.schema[c].dataType)).alias(c) for c in lists), "ball", "ball_point")


def has_next(frames: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each distinct frame with whether another follows."""
    distinct = frames.select(*keys, "frame").distinct()
    last = distinct.groupBy(*keys).agg(F.max("frame").alias("_last"))
    joined = distinct.join(last, list(keys)) if keys else distinct.crossJoin(F.broadcast(last))
    return joined.select(*keys, "frame", (F.col("frame") < F.col("_last")).alias("has_next"))


def champion(metrics: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The best value of each key, and whether it is strictly above the previous best; without one, anything is."""
    best = metrics.groupBy(*keys).agg(F.max("value").alias("best"))
    joined = best.join(previous.withColumnRenamed("best", "_p"), list(keys), "left")
    wins = F.col("best") > F.coalesce(F.col("_p"), F.lit(float("-inf")))
    return joined.select(*keys, F.when(wins, F.col("best")).otherwise(F.col("_p")).alias("best_score"), wins.alias("promoted"))
