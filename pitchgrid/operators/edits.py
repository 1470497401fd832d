"""Edits of a match: each returns a new plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remove(rows: DataFrame, object_id, key: str = "object_id") -> DataFrame:
    return rows.filter(~F.col(key).eqNullSafe(F.lit(object_id)))


def change(objects: DataFrame, object_id, column: str, value, key: str = "object_id") -> DataFrame:
    """A new team (0 home, 1 away) or name for one object."""
    return objects.withColumn(column, F.when(F.col(key) == object_id, F.lit(value)).otherwise(F.col(column)))


def team(objects: DataFrame, value, column: str = "team_label") -> DataFrame:
    return objects.filter(F.col(column) == value)


def merge(tracks: DataFrame, first, second, last: int | DataFrame | None = None, prefer: str = "row", key: str = "object_id", keys: Sequence[str] = ()) -> DataFrame:
    """Rows of ``first`` and, where it has none, of ``second``, under the id of ``first``, for frames 1 to
    ``last``: a number, or a table of ``keys`` and n_frames; without it, all.

    ``prefer``: 'row' takes a row of ``first`` even if its point is missing; 'value' skips missing ones."""
    rows = tracks.filter(F.col(key).isin(first, second) & (F.col("frame") >= 1))
    if isinstance(last, DataFrame):
        rows = rows.join(last.select(*keys, F.col("n_frames").alias("_n")), list(keys)).filter("frame <= _n")
    elif last is not None:
        rows = rows.filter(F.col("frame") <= last)
    second_choice = (F.col(key) != first).cast("int")
    if prefer == "value":
        second_choice = second_choice + 2 * F.col("x").isNull().cast("int")
    rest = [c for c in tracks.columns if c not in (*keys, "frame", key)]
    best = rows.groupBy(*keys, "frame").agg(F.min_by(F.struct(*rest), second_choice).alias("_r"))
    return best.select(*keys, "frame", F.lit(first).alias(key), *(F.col(f"_r.{c}").alias(c) for c in rest)).select(tracks.columns)


def replace_frames(tracks: DataFrame, new: DataFrame, keys: Sequence[str] = ("match_id", "object_id")) -> DataFrame:
    """New x and y for the frames that ``new`` names; time and boxes stay."""
    renamed = new.select(*keys, "frame", F.col("x").alias("_x"), F.col("y").alias("_y"), F.lit(True).alias("_hit"))
    joined = tracks.join(renamed, [*keys, "frame"], "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("x", "y")}).select(tracks.columns)
