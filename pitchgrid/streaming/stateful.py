"""Online chain filter and tracker, keyed by object or match, and windowed counts of late data.

Rows of a key must arrive in frame order from batch to batch; within a batch they are sorted. State is one point, or
the live tracks, so it doesn't grow with the stream; with ``timeout_ms``, a key that is
silent for so long loses its state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pitchgrid.operators.detections import TrackConfig
from pitchgrid.operators.tracker import Tracker, run_frames


def _timeout(ms: int | None) -> str:
    """Processing-time timeouts keep batches coming even without data, so they are only on when asked for."""
    return GroupStateTimeout.NoTimeout if ms is None else GroupStateTimeout.ProcessingTimeTimeout


def chain_step(last: tuple[float, float] | None, x: float | None, y: float | None, radius: float) -> bool:
    """Whether a point is kept after the last one kept."""
    if x is None or y is None or x != x or y != y or (x == 0 and y == 0):
        return False
    return last is None or (x - last[0]) ** 2 + (y - last[1]) ** 2 <= radius * radius


def chain_filter(stream: DataFrame, radius: float, key: str = "object_id", timeout_ms: int | None = None) -> DataFrame:
    """Kept rows of ``stream`` (key, frame, x, y)."""
    kind = {f.name: f.dataType for f in stream.schema.fields}
    schema = T.StructType([T.StructField(c, kind[c]) for c in (key, "frame", "x", "y")])

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = tuple(state.get) if state.exists else None
        pdf = pd.concat(list(parts)).sort_values("frame", kind="stable")
        keep = []
        for x, y in zip(pdf["x"], pdf["y"], strict=True):
            ok = chain_step(last, x, y, radius)
            last = (float(x), float(y)) if ok else last
            keep.append(ok)
        if last is not None:
            state.update(last)
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pdf[keep][[key, "frame", "x", "y"]]

    return stream.groupBy(key).applyInPandasWithState(step, schema, "x double, y double", "append", _timeout(timeout_ms))


def track(stream: DataFrame, config: TrackConfig = TrackConfig(), key: str = "match_id", timeout_ms: int | None = None) -> DataFrame:
    """Detections of a stream with ``tracker_id``; see operators.tracker."""
    names = stream.columns
    schema = T.StructType([*stream.schema.fields, T.StructField("tracker_id", T.LongType())])

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracker = Tracker.load(config, json.loads(state.get[0])) if state.exists else Tracker(config)
        out = run_frames(tracker, pd.concat(list(parts)))
        state.update((json.dumps(tracker.dump()),))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield out[[*names, "tracker_id"]]

    return stream.groupBy(key).applyInPandasWithState(step, schema, "tracker string", "append", _timeout(timeout_ms))


def windowed_counts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Rows and their mean value per tumbling window and key; later rows than ``late`` are left out."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


def sessions(stream: DataFrame, time: str = "ts", late: str = "10 minutes", gap: str = "30 minutes", key: str = "user_id") -> DataFrame:
    """Session windows of each key, closed by ``gap`` without a row."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
