"""The tracking step: detections and key points of a match to rows of its tracking file, in batch and on a stream.

Boxes below the confidence go; balls are padded and the first of a frame is kept; the other boxes are suppressed where
they overlap and tracked; keepers take the team of the nearer centroid; anchors go through the frame's homography.
In batch, all but the tracker works frame by frame in DataFrame operators. On a stream, a row per frame carries its
boxes and key points, and the state is the tracker's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from pitchgrid.functions.geometry import anchor
from pitchgrid.operators import detections as det, homography
from pitchgrid.operators.detections import BALL, KEEPER, PLAYER, REFEREE, TrackConfig
from pitchgrid.operators.tracker import Tracker, track
from pitchgrid.schema import CLASSES

KEYS = ("match_id", "frame")
#: Rows of a tracking file: ball rows have no id and no team; ``part`` and ``det_id`` order a frame's objects.
ROWS = "match_id string, frame int, object_type string, object_id string, team_id int, x1 double, y1 double, x2 double, y2 double, x double, y double, part int, det_id int"


def _types(config: TrackConfig, column: str = "class_id") -> Column:
    """The object type of a class, or the one name that the configuration gives all."""
    if config.object_class_name is not None:
        return F.lit(config.object_class_name)
    return F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))[F.col(column)]


def crops_to_learn_teams(detections: DataFrame, config: TrackConfig = TrackConfig(), keys: Sequence[str] = KEYS) -> DataFrame:
    """Boxes from which a team model learns: of every ``stride``-th frame, of ``team_classes`` if these are given, which
    are then suppressed as well."""
    from pitchgrid.operators.tracks import stride

    some = stride(det.confident(detections, config), config.stride)
    return some if config.team_classes is None else det.nms(det.of_classes(some, *config.team_classes), config.iou, keys)


def track_match(
    detections: DataFrame, keypoints: DataFrame, pitch: DataFrame, config: TrackConfig = TrackConfig(), teams: DataFrame | None = None, fps: float | None = None
) -> DataFrame:
    """ROWS of every frame that has a box or a key point, in any order.

    ``teams`` (match_id, frame, det_id, team_id) is what a team model says of players; without one, players carry their
    class and, where the configuration leaves empty teams away, keepers 1 and else theirs. Tracked boxes only; a frame
    whose key points give no homography has NULL points. A frame without a ball has a ball row of zeros."""
    frames = detections.select(*KEYS).unionByName(keypoints.select(*KEYS)).distinct()
    boxes = det.confident(detections, config)
    ax, ay = anchor()
    h = homography.fit(det.with_template(keypoints, pitch, config.keypoint_confidence), KEYS)

    balls = det.first_ball(boxes, KEYS)
    balls = homography.apply(det.pad_boxes(balls, config.ball_padding).withColumns({"ax": ax, "ay": ay}), h, KEYS)
    balls = det.ball_spine(frames, balls.withColumns({"x": F.col("px"), "y": F.col("py"), "_seen": F.lit(1.0)}), KEYS, ("x1", "y1", "x2", "y2", "_seen", "px", "py"))
    unseen = F.col("_seen") == 0
    # a ball that was seen in a frame without homography has no point; one that wasn't has zeros
    known = frames.join(h.filter("h is not null").select(*KEYS, F.lit(True).alias("_h")), list(KEYS), "left")
    balls = balls.join(known, list(KEYS)).withColumns({c: F.when(unseen | F.col("_h"), F.col(p)) for c, p in (("x", "px"), ("y", "py"))})
    balls = balls.select(*KEYS, F.lit("ball").alias("object_type"), F.lit(None).cast("string").alias("object_id"), F.lit(None).cast("int").alias("team_id"), "x1", "y1", "x2", "y2", "x", "y", F.lit(3).alias("part"), F.lit(None).cast("int").alias("det_id"))

    rest = det.nms(det.of_classes(boxes, BALL, exclude=True), config.iou, KEYS)
    rest = track(rest, config, ("match_id",), fps).filter("tracker_id > 0").withColumns({"ax": ax, "ay": ay})
    players, keepers = det.of_classes(rest, PLAYER), det.of_classes(rest, KEEPER)
    if teams is not None:
        players = players.join(teams.select(*KEYS, "det_id", "team_id"), [*KEYS, "det_id"], "left")
    else:
        players = players.withColumn("team_id", F.lit(PLAYER))
    if teams is not None or not config.empty_team_is_home:
        keepers = det.keeper_team(keepers, players, KEYS, empty_team_is_home=config.empty_team_is_home)
    else:
        keepers = keepers.withColumn("team_id", F.lit(KEEPER))
    parts = [players, keepers.select(players.columns)]
    if config.keep_referees:
        parts.append(det.of_classes(rest, REFEREE).withColumn("team_id", F.lit(REFEREE - 1)).select(players.columns))
    found = homography.apply(det.merge_detections(*parts), h, KEYS).withColumns({"x": F.col("px"), "y": F.col("py")})
    found = found.select(*KEYS, _types(config).alias("object_type"), F.col("tracker_id").cast("string").alias("object_id"), "team_id", "x1", "y1", "x2", "y2", "x", "y", "part", F.col("det_id").cast("int").alias("det_id"))
    return found.unionByName(balls)


def objects_of(rows: DataFrame) -> DataFrame:
    """Tracked objects in the order in which they are first seen: frame, part, box."""
    first = rows.filter("object_id is not null").groupBy("match_id", "object_id").agg(F.min(F.struct("frame", "part", "det_id")).alias("_f"))
    from pyspark.sql import Window

    order = Window.partitionBy("match_id").orderBy("_f", "object_id")
    return first.select("match_id", "object_id", F.row_number().over(order).alias("ord"))


def tracker_lines(rows: DataFrame, missing: str = "0") -> DataFrame:
    """(match_id, frame, ord, line) of the tracker's own file: a frame's objects in first-seen order, then the ball, whose
    id and team are blank. A missing point is written as ``missing``, so that reading it gives NULL again."""
    named = rows.join(objects_of(rows), ["match_id", "object_id"], "left")
    ball = F.col("object_type") == "ball"
    text = [F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in ("x1", "y1", "x2", "y2", "x", "y")]
    ident = [F.when(ball, "").otherwise(F.col(c).cast("string")) for c in ("object_id", "team_id")]
    line = F.concat_ws(",", F.col("frame").cast("string"), F.when(ball, "ball").otherwise("player"), *ident, *text)
    return named.select("match_id", "frame", F.coalesce("ord", F.lit(2_147_483_647)).alias("ord"), line.alias("line"))


#: Stream rows: a frame with its boxes and key points.
FRAMES = (
    "match_id string, frame int, boxes array<struct<det_id: int, class_id: int, confidence: double, x1: double, y1: double, x2: double, y2: double, team_id: int>>, "
    "points array<struct<vertex_idx: int, x: double, y: double, confidence: double>>"
)


def frames_of(detections: DataFrame, keypoints: DataFrame, teams: DataFrame | None = None) -> DataFrame:
    """FRAMES of batch tables, for a stream or a test of one."""
    if teams is not None:
        detections = detections.drop("team_id").join(teams, [*KEYS, "det_id"], "left")
    elif "team_id" not in detections.columns:
        detections = detections.withColumn("team_id", F.lit(None).cast("int"))
    box = F.struct(*(F.col(c).cast(t).alias(c) for c, t in (("det_id", "int"), ("class_id", "int"), *((c, "double") for c in ("confidence", "x1", "y1", "x2", "y2")), ("team_id", "int"))))
    point = F.struct(F.col("vertex_idx").cast("int").alias("vertex_idx"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "confidence")))
    a = detections.groupBy(*KEYS).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    b = keypoints.groupBy(*KEYS).agg(F.array_sort(F.collect_list(point)).alias("points"))
    return a.join(b, list(KEYS), "full").select(F.col("match_id").cast("string").alias("match_id"), F.col("frame").cast("int").alias("frame"), "boxes", "points")


def suppressed(boxes: np.ndarray, confidence: np.ndarray, threshold: float) -> np.ndarray:
    """The boxes that stay, by falling confidence; see detections.nms."""
    kept: list[int] = []
    for i in np.argsort(-confidence, kind="stable").tolist():
        b = boxes[i]
        for k in kept:
            o = boxes[k]
            inter = max(0.0, min(b[2], o[2]) - max(b[0], o[0])) * max(0.0, min(b[3], o[3]) - max(b[1], o[1]))
            union = (o[2] - o[0]) * (o[3] - o[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
            if union > 0 and inter / union > threshold:
                break
        else:
            kept.append(i)
    return np.array(kept, np.int64)


def frame_rows(tracker: Tracker, match_id: str, frame: int, boxes: list, points: list, pitch: dict[int, tuple[float, float]], config: TrackConfig, has_teams: bool) -> list[tuple]:
    """ROWS of one frame, as ``track_match`` has them; the tracker moves on by it."""
    get = lambda items, c: np.array([p[c] for p in items], float)
    used = [p for p in points if p["confidence"] > config.keypoint_confidence and p["vertex_idx"] in pitch]
    h = None
    if len(used) >= 4:
        both = np.column_stack([get(used, "x"), get(used, "y"), np.array([pitch[p["vertex_idx"]] for p in used], float)])
        solved, good = homography.solve(both[np.lexsort(both.T[::-1])][None])
        h = solved[0] if good[0] else None

    def place(x: float, y: float) -> tuple[float | None, float | None]:
        if h is None or (w := h[6] * x + h[7] * y + h[8]) == 0:
            return None, None
        return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w

    sure = sorted((b for b in boxes if b["confidence"] >= config.confidence), key=lambda b: b["det_id"])
    out = []
    rest = [b for b in sure if b["class_id"] != BALL]
    xyxy = np.array([[b["x1"], b["y1"], b["x2"], b["y2"]] for b in rest], float).reshape(-1, 4)
    rest = [rest[i] for i in np.sort(suppressed(xyxy, get(rest, "confidence"), config.iou))]
    ids = tracker.update(frame, np.array([[b["x1"], b["y1"], b["x2"], b["y2"]] for b in rest], float).reshape(-1, 4), get(rest, "confidence"))
    rest = [(b, int(i)) for b, i in zip(rest, ids, strict=True) if i > 0]
    foot = lambda b: np.array([(b["x1"] + b["x2"]) / 2, b["y2"]])
    team = lambda b: b["team_id"] if has_teams else PLAYER
    centre = [[foot(b) for b, _ in rest if b["class_id"] == PLAYER and team(b) == t] for t in (0, 1)]
    for part, cls in enumerate((PLAYER, KEEPER, REFEREE) if config.keep_referees else (PLAYER, KEEPER)):
        for b, i in rest:
            if b["class_id"] != cls:
                continue
            if cls == PLAYER:
                t = team(b)
            elif cls == REFEREE:
                t = REFEREE - 1
            elif not has_teams and config.empty_team_is_home:
                t = KEEPER
            elif not centre[0] or not centre[1]:
                t = 0 if config.empty_team_is_home else 1
            else:
                d = [np.linalg.norm(foot(b) - np.mean(c, axis=0)) for c in centre]
                t = 0 if d[0] < d[1] else 1
            out.append((match_id, frame, config.object_class_name or CLASSES[cls], str(i), t, b["x1"], b["y1"], b["x2"], b["y2"], *place(*foot(b)), part, b["det_id"]))
    ball = next((b for b in sure if b["class_id"] == BALL), None)
    if ball:
        px = config.ball_padding
        box = ball["x1"] - px, ball["y1"] - px, ball["x2"] + px, ball["y2"] + px
        out.append((match_id, frame, "ball", None, None, *box, *place((box[0] + box[2]) / 2, box[3]), 3, None))
    else:
        out.append((match_id, frame, "ball", None, None, *[0.0] * 6, 3, None))
    return out


def track_stream(frames: DataFrame, pitch: list[tuple[int, float, float]], config: TrackConfig = TrackConfig(), has_teams: bool = False, fps: float | None = None, timeout_ms: int | None = None) -> DataFrame:
    """ROWS of a stream of FRAMES, as ``track_match`` has them of a table. Frames of a match must arrive in order from
    batch to batch; within one they are sorted. State is the live tracks."""
    from pitchgrid.streaming.stateful import _timeout

    places = {int(k): (float(x), float(y)) for k, x, y in pitch}
    names = [c.split()[0] for c in ROWS.split(", ")]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracker = Tracker.load(config, json.loads(state.get[0]), fps) if state.exists else Tracker(config, fps=fps)
        listed = lambda v: [] if v is None or v is pd.NA or isinstance(v, float) else list(v)
        out: list[tuple] = []
        for row in pd.concat(list(parts)).sort_values("frame", kind="stable").itertuples():
            out += frame_rows(tracker, key[0], int(row.frame), listed(row.boxes), listed(row.points), places, config, has_teams)
        state.update((json.dumps(tracker.dump()),))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        found = pd.DataFrame(out, columns=names)
        yield found.astype({"team_id": "Int32", "det_id": "Int32", "part": "int32", "frame": "int32"})

    return frames.groupBy("match_id").applyInPandasWithState(step, ROWS, "tracker string", "append", _timeout(timeout_ms))
