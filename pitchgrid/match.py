"""A match as an immutable pair of plans, tracks and objects; every edit returns a new one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pitchgrid.operators import aggregates, edits, tracks as ops
from pitchgrid.operators.kernel import KernelConfig, straighten
from pitchgrid.sources import raw, sinks, wide


@dataclass(frozen=True)
class Match:
    tracks: DataFrame
    objects: DataFrame
    source: str
    #: match_id and n_frames, a row per match
    lengths: DataFrame

    @classmethod
    def read_raw(cls, spark: SparkSession, path: str) -> Match:
        rows = raw.read_raw(spark, path)
        return cls(rows, raw.objects_of(rows), "raw", raw.match_length(rows))

    @classmethod
    def read_wide(cls, spark: SparkSession, path: str) -> Match:
        rows = wide.read_wide(spark, path)
        return cls(rows.drop("name"), wide.objects_of(rows), "wide", rows.groupBy("match_id").agg(F.max("frame").cast("long").alias("n_frames")))

    def player(self, object_id: str) -> DataFrame:
        return self.tracks.filter((F.col("object_id") == object_id) & (F.col("object_type") != "ball"))

    @property
    def ball(self) -> DataFrame:
        return self.tracks.filter("object_type = 'ball'")

    def team(self, label: str) -> DataFrame:
        return edits.team(self.objects, label)

    def remove_player(self, object_id: str) -> Match:
        return replace(self, tracks=edits.remove(self.tracks, object_id), objects=edits.remove(self.objects, object_id))

    def add_player(self, rows: DataFrame, team_label: str, name: str | None = None) -> Match:
        both = self.tracks.unionByName(rows)
        new = rows.select("match_id", "object_id").distinct().select("match_id", "object_id", F.lit("player").alias("object_type"), F.lit(team_label).alias("team_label"), F.coalesce(F.lit(name), F.concat(F.lit("Player "), "object_id")).alias("name"))
        last = self.objects.groupBy("match_id").agg(F.max("ord").alias("_o"))
        new = new.join(last, "match_id", "left").withColumn("ord", F.coalesce("_o", F.lit(0)) + 1).drop("_o")
        return replace(self, tracks=both, objects=self.objects.unionByName(new))

    def merge_players(self, first: str, second: str, prefer: str = "row") -> Match:
        """Both go and their union, under the first one's id, team and name, comes last."""
        merged = edits.merge(self.tracks, first, second, self.lengths, prefer, keys=("match_id",))
        rest = self.tracks.filter(~F.col("object_id").isin(first, second))
        last = self.objects.agg(F.max("ord")).first()[0] or 0
        objects = edits.remove(self.objects, second).withColumn("ord", F.when(F.col("object_id") == first, last + 1).otherwise(F.col("ord")))
        return replace(self, tracks=rest.unionByName(merged), objects=objects)

    def change_team(self, object_id: str, label: str) -> Match:
        return replace(self, objects=edits.change(self.objects, object_id, "team_label", label))

    def change_name(self, object_id: str, name: str) -> Match:
        return replace(self, objects=edits.change(self.objects, object_id, "name", name))

    def add_frames(self, rows: DataFrame) -> Match:
        """More rows of objects that are there, or of the ball."""
        return replace(self, tracks=self.tracks.unionByName(rows))

    def replace_frames(self, new: DataFrame) -> Match:
        return replace(self, tracks=edits.replace_frames(self.tracks, new))

    def clean_ball(self, arcs: bool = True, config: KernelConfig | None = None) -> Match:
        """Filters, pads, fills and, if asked for, straightens the ball's path."""
        lone, chain = (200.0, 2000.0) if self.source == "raw" else (0.02, 0.2)
        config = config or KernelConfig(unit_scale=1.0 if self.source == "raw" else 10_000.0)
        columns = ("x", "y", "x1", "y1", "x2", "y2") if self.source == "raw" else ("x", "y")
        ball = ops.clean_path_filters(self.ball, lone, chain, columns=columns)
        ball = straighten(ball, config) if arcs else ball
        return replace(self, tracks=self.tracks.filter("object_type <> 'ball'").unionByName(ball))

    def frame(self, n: int) -> DataFrame:
        return self.tracks.filter(F.col("frame") == n)

    def moments(self) -> DataFrame:
        """A row per frame of the ball: time, ball, home and away; see aggregates.player_loc and ball_loc."""
        teams = self.objects.select("match_id", "object_id", F.col("team_label").try_cast("double").alias("team_id"))
        players = self.tracks.filter("object_type <> 'ball'").join(teams, ["match_id", "object_id"])
        return aggregates.moments(players, balls=self.ball)

    def each_moment(self) -> Iterator[Row]:
        """Moments in frame order, a partition at a time."""
        return self.moments().orderBy("match_id", "frame").toLocalIterator()

    def render_records(self) -> DataFrame:
        """What a renderer draws of each frame, by the teams of the objects."""
        teams = self.objects.select("match_id", "object_id", "team_label")
        rows = self.tracks.drop("team_label").join(teams, ["match_id", "object_id"], "left")
        return aggregates.render_records(rows, self.lengths)

    def export_lines(self) -> DataFrame:
        """Lines of the format that the match came in, with match_id, frame and ord for their order."""
        return wide.wide_lines(self.tracks, self.objects) if self.source == "wide" else sinks.raw_lines(self.tracks, self.objects)

    def export(self, path: str, single: bool = True) -> None:
        """Writes the match in the format that it came in; the wide format's headers are among its lines."""
        sinks.write_lines(self.export_lines(), path, None if self.source == "wide" else sinks.RAW_HEADER, single)
