"""Homographies of frames from key points, by the normalised direct linear transform."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.functions.geometry import project


def solve(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Homographies of many frames with equally many points: ``points`` (frames, points, 4) holds x, y, px, py. Nine
    numbers each, the last 1, and whether the points determine them."""
    m, n = points.shape[:2]
    if n < 4 or not m:
        return np.zeros((m, 9)), np.zeros(m, bool)

    def centred(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = p.mean(1, keepdims=True)
        s = np.sqrt(2) / np.maximum(np.sqrt(((p - mean) ** 2).sum(2)).mean(1), 1e-12)
        t = np.zeros((m, 3, 3))
        t[:, 0, 0] = t[:, 1, 1] = s
        t[:, 0, 2], t[:, 1, 2], t[:, 2, 2] = -s * mean[:, 0, 0], -s * mean[:, 0, 1], 1
        return (p - mean) * s[:, None, None], t

    a, ta = centred(points[:, :, :2].astype(float))
    b, tb = centred(points[:, :, 2:].astype(float))
    one, zero = np.ones((m, n)), np.zeros((m, n))
    (u, v), (p, q) = (a[:, :, 0], a[:, :, 1]), (b[:, :, 0], b[:, :, 1])
    rows = np.concatenate([np.stack([-u, -v, -one, zero, zero, zero, p * u, p * v, p], 2), np.stack([zero, zero, zero, -u, -v, -one, q * u, q * v, q], 2)], 1)
    _, s, vt = np.linalg.svd(rows)
    # of nine singular values the last is that of the solution; four points give eight
    good = s[:, 7] >= 1e-9
    h = np.linalg.inv(tb) @ vt[:, -1].reshape(m, 3, 3) @ ta
    last = h[:, 2, 2]
    good &= np.abs(last) > 1e-12
    return (h / np.where(good, last, 1)[:, None, None]).reshape(m, 9), good


def fit(matched: DataFrame, keys: Sequence[str] = ("match_id", "frame")) -> DataFrame:
    """``h`` array<double> of each frame from matched key points (x, y, px, py); NULL where it can't be solved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.stack([f.to_numpy(zero_copy_only=False) for f in lists.flatten().flatten()], 1) if n.sum() else np.zeros((0, 4))
            begin = np.cumsum(n) - n
            out: list = [None] * len(n)
            # frames with equally many points are solved together
            for size in np.unique(n[n >= 4]).tolist():
                at = np.flatnonzero(n == size)
                for k in range(0, len(at), 2_048):
                    part = at[k : k + 2_048]
                    h, good = solve(flat[begin[part][:, None] + np.arange(size)])
                    for i, row, ok in zip(part.tolist(), h.tolist(), good.tolist(), strict=True):
                        out[i] = row if ok else None
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(out, pa.list_(pa.float64()))], [*keys, "h"])

    whole = [F.col(c).isNotNull() for c in ("x", "y", "px", "py")]
    point = F.when(whole[0] & whole[1] & whole[2] & whole[3], F.struct(*(F.col(c).cast("double").alias(c) for c in ("x", "y", "px", "py"))))
    gathered = matched.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("_p"))
    schema = T.StructType([*(matched.schema[k] for k in keys), T.StructField("h", T.ArrayType(T.DoubleType()))])
    return gathered.mapInArrow(run, schema)


def apply(points: DataFrame, homographies: DataFrame, keys: Sequence[str] = ("match_id", "frame"), x: str = "ax", y: str = "ay") -> DataFrame:
    """Points with pitch coordinates ``px`` and ``py``; NULL for frames without a homography."""
    joined = points.join(homographies, list(keys), "left")
    px, py = project(x, y, [F.col("h")[k] for k in range(9)])
    return joined.withColumns({"px": F.when(F.col("h").isNotNull(), px), "py": F.when(F.col("h").isNotNull(), py)}).drop("h")
