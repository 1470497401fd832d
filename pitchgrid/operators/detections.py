"""Operators on detections: classes, boxes, suppression, teams, pitch template and homographies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.functions.geometry import distance, iou, padded

BALL, KEEPER, PLAYER, REFEREE = 0, 1, 2, 3


@dataclass(frozen=True)
class TrackConfig:
    """Where the tracking variants differ; the defaults are the main one's."""

    confidence: float = 0.3
    iou: float = 0.5
    activation: float = 0.25
    lost_buffer: int = 30
    match: float = 0.8
    min_consecutive: int = 1
    keep_referees: bool = False
    object_class_name: str | None = None
    team_classes: tuple[int, ...] | None = None
    empty_team_is_home: bool = False
    keypoint_confidence: float = 0.5
    stride: int = 30
    ball_padding: float = 10.0


#: The other variant's settings.
REMOTE = TrackConfig(0.35, 0.4, 0.35, 60, 0.85, 2, True, "player", (PLAYER,), True)


def confident(detections: DataFrame, config: TrackConfig = TrackConfig()) -> DataFrame:
    return detections.filter(F.col("confidence") >= config.confidence)


def of_classes(detections: DataFrame, *classes: int, exclude: bool = False) -> DataFrame:
    hit = F.col("class_id").isin(*classes)
    return detections.filter(~hit if exclude else hit)


def pad_boxes(detections: DataFrame, px: float = 10.0) -> DataFrame:
    return detections.withColumns(padded(px))


def nms(detections: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ("match_id", "frame"), order: Sequence[str] = ("det_id",)) -> DataFrame:
    """Greedy non-maximum suppression whatever the class: by falling confidence (ties by ``order``), a box stays if no
    box that stayed overlaps it by more than ``threshold``. A frame's boxes are few, so a fold in one row will do."""
    # the whole row travels with its box, so nothing is joined back
    rest = [c for c in detections.columns if c not in keys and c not in order]
    box = F.struct((-F.col("confidence")).alias("_c"), *order, *rest)
    frames = detections.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("b"))
    kind = "array<" + frames.schema["b"].dataType.elementType.simpleString() + ">"

    def step(kept: Column, b: Column) -> Column:
        return F.when(F.exists(kept, lambda k: iou(k, b) > threshold), kept).otherwise(F.concat(kept, F.array(b)))

    kept = frames.select(*keys, F.explode(F.aggregate("b", F.array().cast(kind), step)).alias("k"))
    return kept.select(*(F.col(c) if c in keys else F.col("k")[c].alias(c) for c in detections.columns))


def first_ball(detections: DataFrame, keys: Sequence[str] = ("match_id", "frame"), order: Sequence[str] = ("det_id",)) -> DataFrame:
    """The first ball of a frame in the detector's order."""
    from pitchgrid.sources.raw import keep_first

    return keep_first(of_classes(detections, BALL), list(keys), list(order))


def ball_spine(frames: DataFrame, balls: DataFrame, keys: Sequence[str] = ("match_id", "frame"), columns: Sequence[str] = ("x1", "y1", "x2", "y2", "x", "y")) -> DataFrame:
    """A ball row for every frame; zeros where there is none."""
    have = [c for c in columns if c in balls.columns]
    joined = frames.select(*keys).join(balls.select(*keys, *have), list(keys), "left")
    return joined.select(*keys, *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in have))


def merge_detections(*parts: DataFrame) -> DataFrame:
    """All rows of the parts in their order, with ``part`` from 0."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out


def team_centroids(players: DataFrame, keys: Sequence[str] = ("match_id", "frame"), team: str = "team_id") -> DataFrame:
    """Mean anchor of each team and frame."""
    return players.groupBy(*keys, team).agg(F.avg("ax").alias("cx"), F.avg("ay").alias("cy"), F.count(F.lit(1)).alias("n"))


def keeper_team(keepers: DataFrame, players: DataFrame, keys: Sequence[str] = ("match_id", "frame"), team: str = "team_id", empty_team_is_home: bool = False) -> DataFrame:
    """Team of the nearer centroid, 0 if strictly nearer and else 1; a frame with a team missing gives 1 (or 0)."""
    mean = lambda t, c: F.avg(F.when(F.col(team) == t, F.col(c)))
    centres = players.groupBy(*keys).agg(*(mean(t, c).alias(f"c{t}_{c}") for t in (0, 1) for c in ("ax", "ay")))
    joined = keepers.join(centres, list(keys), "left")
    d0, d1 = distance("ax", "ay", "c0_ax", "c0_ay"), distance("ax", "ay", "c1_ax", "c1_ay")
    if empty_team_is_home:
        choice = F.when(d0.isNull() | d1.isNull(), 0).when(d0 < d1, 0).otherwise(1)
    else:
        choice = F.when(d0 < d1, 0).otherwise(1)
    return joined.withColumn(team, choice).drop("c0_ax", "c0_ay", "c1_ax", "c1_ay")


def with_template(keypoints: DataFrame, pitch: DataFrame, confidence: float = 0.5) -> DataFrame:
    """Key points above the confidence with their place on the pitch; the template has a few dozen rows."""
    if pitch.limit(10_001).count() > 10_000:
        raise ValueError("a template of more than 10,000 points")
    return keypoints.filter(F.col("confidence") > confidence).join(F.broadcast(pitch), "vertex_idx")


def normalised(rows: DataFrame, length: float, width: float) -> DataFrame:
    return rows.withColumns({"x": F.col("x") / length, "y": F.col("y") / width})


def nearest_team(crops: DataFrame, centres: list[list[float]], column: str = "embedding") -> DataFrame:
    """Team of the nearest of a few given centres by squared distance, the first on a tie."""
    far = [F.aggregate(F.zip_with(column, F.lit(c).cast("array<double>"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in centres]
    best = F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(k).alias("k")) for k, d in enumerate(far))))
    return crops.withColumn("team_id", best["k"])


def fit_teams(crops: DataFrame, column: str = "embedding", k: int = 2, seed: int = 1) -> list[list[float]]:
    """Centres of ``k`` clusters of crop embeddings, ordered, so that reruns name teams alike."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = crops.select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    return sorted([float(x) for x in c] for c in KMeans(k=k, seed=seed).fit(data).clusterCenters())
