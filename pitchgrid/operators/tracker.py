"""Multi-object tracking: two-stage greedy matching by IoU, as in the ByteTrack paper (arXiv 2110.06864).

A frame's confident boxes are matched with the live tracks first, then the unsure boxes with what is left. A track's
box moves by its last velocity. One state serves the batch operator and the stream.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pitchgrid.operators.detections import TrackConfig


@dataclass
class Tracker:
    config: TrackConfig = TrackConfig()
    next_id: int = 1
    #: id, box, velocity, last frame, hits
    tracks: list[list] = field(default_factory=list)
    #: frames a second; the buffer of lost tracks counts thirtieths
    fps: float | None = None

    @property
    def most_lost(self) -> int:
        return self.config.lost_buffer if self.fps is None else int(self.fps / 30.0 * self.config.lost_buffer)

    def update(self, frame: int, boxes: np.ndarray, confidence: np.ndarray) -> np.ndarray:
        """Track id of each box, 0 for none (too unsure, or not seen often enough yet)."""
        ids = np.zeros(len(boxes), np.int64)
        self.tracks = [t for t in self.tracks if frame - t[3] <= self.most_lost]
        free = list(range(len(self.tracks)))
        sure = confidence >= self.config.activation
        for stage in (np.flatnonzero(sure), np.flatnonzero(~sure)):
            for k, b in self._matches(frame, free, stage, boxes):
                t = self.tracks[k]
                t[2] = (boxes[b] - t[1]) / max(1, frame - t[3])
                t[1], t[3], t[4] = boxes[b].copy(), frame, t[4] + 1
                free.remove(k)
                ids[b] = t[0] if t[4] >= self.config.min_consecutive else 0
                sure[b] = False
        for b in np.flatnonzero(sure):
            self.tracks.append([self.next_id, boxes[b].copy(), np.zeros(4), frame, 1])
            ids[b] = self.next_id if self.config.min_consecutive <= 1 else 0
            self.next_id += 1
        return ids

    def _matches(self, frame: int, free: list[int], stage: np.ndarray, boxes: np.ndarray) -> list[tuple[int, int]]:
        if not free or not len(stage):
            return []
        at = np.array([self.tracks[k][1] + self.tracks[k][2] * (frame - self.tracks[k][3]) for k in free])
        b = boxes[stage]
        low, high = np.maximum(at[:, None, :2], b[None, :, :2]), np.minimum(at[:, None, 2:], b[None, :, 2:])
        inter = np.prod(np.clip(high - low, 0, None), axis=2)
        area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
        iou = inter / np.maximum(area(at)[:, None] + area(b)[None, :] - inter, 1e-9)
        out, used_t, used_b = [], set(), set()
        for flat in np.argsort(-iou, axis=None, kind="stable"):
            i, j = divmod(int(flat), len(stage))
            if iou[i, j] < 1 - self.config.match:
                break
            if i not in used_t and j not in used_b:
                used_t.add(i)
                used_b.add(j)
                out.append((free[i], int(stage[j])))
        return out

    def dump(self) -> list:
        return [self.next_id, [[t[0], t[1].tolist(), t[2].tolist(), t[3], t[4]] for t in self.tracks]]

    @classmethod
    def load(cls, config: TrackConfig, state: list, fps: float | None = None) -> Tracker:
        return cls(config, state[0], [[t[0], np.array(t[1], float), np.array(t[2], float), t[3], t[4]] for t in state[1]], fps)


def run_frames(tracker: Tracker, pdf: pd.DataFrame, frame: str = "frame", order: str = "det_id") -> pd.DataFrame:
    """``pdf`` with ``tracker_id``, frame by frame."""
    pdf = pdf.sort_values([frame, order], kind="stable")
    boxes, confidence, frames = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), pdf["confidence"].to_numpy(float), pdf[frame].to_numpy()
    ids = np.zeros(len(pdf), np.int64)
    for a, b in zip(*(lambda c: (c[:-1], c[1:]))([0, *(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(frames)]), strict=True):
        if b > a:
            ids[a:b] = tracker.update(int(frames[a]), boxes[a:b], confidence[a:b])
    return pdf.assign(tracker_id=ids)


def track(detections: DataFrame, config: TrackConfig = TrackConfig(), keys: Sequence[str] = ("match_id",), fps: float | None = None) -> DataFrame:
    """Detections with ``tracker_id``, 0 where none. A match is one task's, as each frame needs the one before."""
    names = detections.columns
    schema = T.StructType([*detections.schema.fields, T.StructField("tracker_id", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return run_frames(Tracker(config, fps=fps), pdf)[[*names, "tracker_id"]]

    return detections.groupBy(*keys).applyInPandas(run, schema)
