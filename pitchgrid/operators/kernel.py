"""Arc removal from a ball path: outlier clusters, Kalman smoothing, straight segments and their knots.

The kernel runs in numpy, one object at a time (applyInPandas): its stages are sequential and look at the whole path.
Its constants assume centimetres; ``unit_scale`` multiplies other units up first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class KernelConfig:
    unit_scale: float = 1.0
    neighbours: int = 10
    time_weight: float = 2.0
    time_neighbours: int = 5
    least_cluster: int = 3
    start_variance: float = 10.0
    measurement_deviation: float = 100.0
    process_variance: float = 100.0
    passes: int = 5
    outlier_factor: float = 5.0
    residual: float = 50.0
    trials: int = 100
    island_gap: int = 15
    least_island: int = 25
    peak_distance: int = 20
    peak_prominence: float = 20.0
    gap_margin: int = 8
    warm_up: bool = True
    #: shorter paths are left as they are
    least_frames: int = 3


def cluster_filter(path: np.ndarray, c: KernelConfig) -> np.ndarray:
    """Which rows of (frame, x, y) stay: components of links between neighbours in time that are near in all three."""
    n = len(path)
    if n <= c.neighbours:
        return np.ones(n, bool)
    sd = path.std(0)
    z = (path - path.mean(0)) / np.where(sd == 0, 1, sd)
    z[:, 0] *= c.time_weight
    kth = np.empty(n)
    for a in range(0, n, 512):  # blocks of distances; the path's own point counts as a neighbour
        d = np.sqrt(((z[a : a + 512, None, :] - z[None, :, :]) ** 2).sum(2))
        kth[a : a + 512] = np.partition(d, c.neighbours - 1, axis=1)[:, c.neighbours - 1]
    near = 2 * np.median(kth)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # the points nearest in time, those before and after alike; a link of either point counts
    order = np.argsort(path[:, 0], kind="stable")
    time = path[order, 0]
    for a in range(n):
        low, high = max(0, a - c.time_neighbours), min(n, a + c.time_neighbours + 1)
        others = [b for b in range(low, high) if b != a]
        others.sort(key=lambda b: (abs(time[b] - time[a]), b))
        for b in others[: c.time_neighbours]:
            i, j = order[a], order[b]
            if np.sqrt(((z[i] - z[j]) ** 2).sum()) < near:
                parent[root(i)] = root(j)
    labels = np.array([root(i) for i in range(n)])
    _, inverse, size = np.unique(labels, return_inverse=True, return_counts=True)
    return size[inverse] >= c.least_cluster


def on_grid(frames: np.ndarray, values: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Piecewise linear, and on beyond both ends with the outer pair's slope."""
    if len(frames) == 1:
        return np.full(len(grid), values[0], float)
    k = np.clip(np.searchsorted(frames, grid, side="right") - 1, 0, len(frames) - 2)
    slope = (values[k + 1] - values[k]) / (frames[k + 1] - frames[k])
    return values[k] + slope * (grid - frames[k])


_A = np.diag([1.0, 1.0, 1.0], 1)
_F = np.eye(4) + _A + _A @ _A / 2 + _A @ _A @ _A / 6
_G = np.array([1 / 6, 1 / 2, 1.0, 1.0])


def kalman_smooth(z: np.ndarray, c: KernelConfig, p0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States (position, velocity, acceleration, jerk) after a forward filter and a backward (RTS) pass; the filter's
    last covariance."""
    n = len(z)
    q = np.outer(_G, _G) * c.process_variance
    x, p = np.array([z[0], 0, 0, 0], float), p0
    xs, ps = np.empty((n, 4)), np.empty((n, 4, 4))
    for k in range(n):
        x, p = _F @ x, _F @ p @ _F.T + q
        gain = p[:, 0] / (p[0, 0] + c.measurement_deviation**2)
        x = x + gain * (z[k] - x[0])
        p = p - np.outer(gain, p[0])
        xs[k], ps[k] = x, p
    last = p
    for k in range(n - 2, -1, -1):
        ahead = _F @ ps[k] @ _F.T + q
        g = np.linalg.solve(ahead, _F @ ps[k]).T
        xs[k] = xs[k] + g @ (xs[k + 1] - _F @ xs[k])
        ps[k] = ps[k] + g @ (ps[k + 1] - ahead) @ g.T
    return xs, last


def smoothed(xy: np.ndarray, c: KernelConfig) -> np.ndarray:
    """States of x and y, (n, 2, 4), after passes that replace outlying measurements by the smooth value."""
    z, p = xy.astype(float).copy(), np.eye(4) * c.start_variance
    if c.warm_up:
        _, p = kalman_smooth(z[:, 1], c, p)
    out = np.zeros((len(z), 2, 4))
    for _ in range(c.passes):
        for a in (0, 1):
            out[:, a], p = kalman_smooth(z[:, a], c, p)
            off = np.abs(z[:, a] - out[:, a, 0])
            far = off >= c.outlier_factor * np.median(off)
            z[far, a] = out[far, a, 0]
    return out


def _inliers(u: np.ndarray, v: np.ndarray, c: KernelConfig, seed: int) -> np.ndarray:
    """The points within the residual of a line v(u) through two of them: of ``trials`` lines, the one with most."""
    rng = np.random.default_rng(seed)
    best = np.zeros(len(u), bool)
    for _ in range(c.trials):
        i, j = rng.choice(len(u), 2, replace=False)
        if u[i] == u[j]:
            continue
        slope = (v[j] - v[i]) / (u[j] - u[i])
        hit = np.abs(v - (v[i] + slope * (u - u[i]))) <= c.residual
        if hit.sum() > best.sum():
            best = hit
    return best


def _longest(frames: np.ndarray, gap: int) -> np.ndarray:
    parts = np.split(frames, np.flatnonzero(np.diff(frames) >= gap) + 1)
    return max(parts, key=len)


def segments(xy: np.ndarray, c: KernelConfig) -> list[tuple[int, int]]:
    """First and last frame of the straight stretches, peeled off one by one, the longest first."""
    rest, out, seed = np.arange(len(xy)), [], 0
    while len(rest) > 2:
        x, y = xy[rest, 0], xy[rest, 1]
        runs = [_longest(rest[hit], c.island_gap) for hit in (_inliers(x, y, c, seed), _inliers(y, x, c, seed)) if hit.any()]
        if not runs:
            break
        island = runs[-1] if len(runs[-1]) >= len(runs[0]) else runs[0]
        if len(island) <= c.least_island:
            break
        out.append((int(island[0]), int(island[-1])))
        rest = np.setdiff1d(rest, island)
        seed += 1
    return out


def peaks(v: np.ndarray, distance: int, prominence: float) -> list[int]:
    """Local maxima, the higher first where they are nearer than ``distance``, that rise by ``prominence``."""
    at = [k for k in range(1, len(v) - 1) if v[k - 1] < v[k] > v[k + 1]]
    kept: list[int] = []
    for k in sorted(at, key=lambda k: -v[k]):
        if all(abs(k - j) >= distance for j in kept):
            kept.append(k)
    out = []
    for k in sorted(kept):
        higher_l, higher_r = np.flatnonzero(v[:k] > v[k]), np.flatnonzero(v[k + 1 :] > v[k])
        left = v[(higher_l[-1] if len(higher_l) else 0) : k + 1].min()
        right = v[k : k + 2 + (higher_r[0] if len(higher_r) else len(v))].min()
        if v[k] - max(left, right) >= prominence:
            out.append(k)
    return out


def knots(states: np.ndarray, c: KernelConfig) -> np.ndarray | None:
    """Frames where straight pieces meet; None with fewer than two segments."""
    found = segments(states[:, :, 0], c)
    if len(found) < 2:
        return None
    starts, ends = sorted(s for s, _ in found), sorted(e for _, e in found)
    acceleration = np.sqrt((states[:, :, 2] ** 2).sum(1))
    tops = peaks(acceleration, c.peak_distance, c.peak_prominence)
    between = [p for e, s in zip(ends[:-1], starts[1:], strict=True) for p in tops if e + c.gap_margin <= p <= s - c.gap_margin]
    return np.unique([0, len(states) - 1, *starts, *ends, *between])


def remove_arcs(frames: np.ndarray, xy: np.ndarray, c: KernelConfig = KernelConfig()) -> np.ndarray:
    """The path on frames 0 to the last: piecewise straight, or only smoothed where there aren't two straight parts."""
    last = int(frames.max())
    grid = np.arange(last + 1)
    points = np.column_stack([frames, xy * c.unit_scale]).astype(float)
    keep = cluster_filter(points, c)
    points = points[keep] if keep.sum() >= 2 else points
    raw = np.column_stack([on_grid(points[:, 0], points[:, k], grid) for k in (1, 2)])
    states = smoothed(raw, c)
    at = knots(states, c)
    line = states[:, :, 0] if at is None else np.column_stack([on_grid(at, states[at, k, 0], grid) for k in (0, 1)])
    return line / c.unit_scale


def straighten(tracks: DataFrame, config: KernelConfig = KernelConfig(), keys: Sequence[str] = ("match_id", "object_id")) -> DataFrame:
    """Tracks with x and y replaced by the straightened path, one frame late as the format has it: frame f takes the
    path at f - 1, and the last frame keeps its point. Tracks with fewer than ``least_frames`` points, or three, stay as
    they are."""
    types = {f.name: f.dataType for f in tracks.schema.fields}
    schema = T.StructType([*(T.StructField(k, types[k]) for k in keys), T.StructField("frame", T.IntegerType()), T.StructField("sx", T.DoubleType()), T.StructField("sy", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame").drop_duplicates("frame")
        if len(pdf) < max(3, config.least_frames):
            return pdf.iloc[:0][[*keys, "frame"]].assign(sx=0.0, sy=0.0)
        frames = pdf["frame"].to_numpy()
        line = remove_arcs(frames, pdf[["x", "y"]].to_numpy(float), config)
        at = frames[(frames < frames.max()) & (frames >= 1)]
        out = pd.DataFrame({"frame": at.astype(np.int32), "sx": line[at - 1, 0], "sy": line[at - 1, 1]})
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "frame", "sx", "sy"]]

    live = tracks.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*keys, F.col("frame").cast("int").alias("frame"), "x", "y")
    moved = live.groupBy(*keys).applyInPandas(run, schema)
    joined = tracks.join(moved, [*keys, "frame"], "left")
    return joined.withColumns({"x": F.coalesce("sx", "x"), "y": F.coalesce("sy", "y")}).select(tracks.columns)
