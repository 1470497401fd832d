"""Trajectory operators: filters, padding, gap filling, interpolation, islands and peaks.

All take a DataFrame with the key columns (an object of a match), ``frame`` and the coordinates, and keep one shuffle
by the keys where they can: windows and folds over one object share its exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.functions.geometry import distance
from pitchgrid.operators import folds

KEYS = ("match_id", "object_id")


def _by(keys: Sequence[str], order: str = "frame"):
    return Window.partitionBy(*keys).orderBy(order)


def stride(rows: DataFrame, step: int = 30) -> DataFrame:
    """Frames 1, 1 + step, ...: a filter, which reaches the scan."""
    return rows.filter(F.pmod(F.col("frame") - 1, F.lit(step)) == 0)


def path(tracks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Coordinates numbered by position from 1; a missing point is (0, 0)."""
    gone = F.col("x").isNull() | F.col("y").isNull()
    zero = lambda c: F.when(gone, F.lit(0.0)).otherwise(F.col(c))
    return tracks.select(*keys, F.row_number().over(_by(keys)).alias("n"), zero("x").alias("x"), zero("y").alias("y"))


def lone_points(tracks: DataFrame, radius: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Present points with another point of the object, at any time, within ``radius``. Missing points stand at (0, 0).

    Two points in one grid cell of side radius / sqrt 2 are near each other, so only points alone in their cell look
    into the 24 cells around it: an equi-join on the cell instead of all pairs of an object."""
    gone = F.col("x").isNull() | F.col("y").isNull()
    side = radius / 2**0.5
    points = tracks.withColumns({"_x": F.when(gone, 0.0).otherwise(F.col("x")), "_y": F.when(gone, 0.0).otherwise(F.col("y")), "_gone": gone})
    points = points.withColumns({"_cx": F.floor(F.col("_x") / side), "_cy": F.floor(F.col("_y") / side)})
    counts = points.groupBy(*keys, "_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"))
    points = points.join(counts, [*keys, "_cx", "_cy"])
    together = points.filter("_n > 1 and not _gone")
    around = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if (a, b) != (0, 0)]
    alone = points.filter("_n = 1 and not _gone").withColumn("_d", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in around))))
    alone = alone.withColumns({"_nx": F.col("_cx") + F.col("_d.a"), "_ny": F.col("_cy") + F.col("_d.b")})
    others = points.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_cx").alias("_ox"), F.col("_cy").alias("_oy"), F.col("_x").alias("_px"), F.col("_y").alias("_py"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on = [*same, F.col("_nx") == F.col("_ox"), F.col("_ny") == F.col("_oy"), distance("_x", "_y", "_px", "_py") <= radius]
    near = alone.join(others, on, "left_semi").select(tracks.columns).dropDuplicates([*keys, "frame"])
    return together.select(tracks.columns).unionByName(near)


def chain_filter(tracks: DataFrame, radius: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Points within ``radius`` of the last point kept; the first is kept, missing ones and exact (0, 0) are skipped.

    A fold over the object's ordered points: each depends on the one kept before it. It streams in Arrow."""
    return folds.per_object(tracks, keys, lambda v, n: folds.chain(v["x"], v["y"], radius), ("x", "y"))


def survivor_spine(tracks: DataFrame, survivors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All rows of ``tracks``; those that didn't survive lose their coordinates and keep the rest."""
    alive = survivors.select(*keys, "frame").distinct().withColumn("_alive", F.lit(True))
    joined = tracks.join(alive, [*keys, "frame"], "left")
    lost = [c for c in ("x", "y", "x1", "y1", "x2", "y2") if c in tracks.columns]
    return joined.withColumns({c: F.when(F.col("_alive"), F.col(c)) for c in lost}).select(tracks.columns)


def pad_start(tracks: DataFrame, columns: Sequence[str] = ("x", "y"), keys: Sequence[str] = KEYS) -> DataFrame:
    """Leading missing points take the first real one; without any, all stay missing."""
    before = _by(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = _by(keys).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    real = F.when(F.col(columns[0]).isNotNull(), F.struct(*columns))
    return (
        tracks.withColumns({"_b": F.last(real, True).over(before), "_a": F.first(real, True).over(after)})
        .withColumns({c: F.when(F.col("_b").isNull(), F.col(f"_a.{c}")).otherwise(F.col(c)) for c in columns})
        .drop("_a", "_b")
    )


def pad_end(tracks: DataFrame, columns: Sequence[str] = ("x", "y"), keys: Sequence[str] = KEYS) -> DataFrame:
    """Trailing missing points take the last real one, as it is before gaps are filled."""
    before = _by(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = _by(keys).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    real = F.when(F.col(columns[0]).isNotNull(), F.struct(*columns))
    return (
        tracks.withColumns({"_b": F.last(real, True).over(before), "_a": F.first(real, True).over(after)})
        .withColumns({c: F.when(F.col("_a").isNull(), F.col(f"_b.{c}")).otherwise(F.col(c)) for c in columns})
        .drop("_a", "_b")
    )


def _gaps(tracks: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds the position in the object, and position and values of the real points around each row."""
    before = _by(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = _by(keys).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = tracks.withColumn("_n", F.row_number().over(_by(keys)))
    real = F.when(F.col(columns[0]).isNotNull(), F.struct("_n", *columns))
    return rows.withColumns({"_b": F.last(real, True).over(before), "_a": F.first(real, True).over(after)})


def fill_gaps(tracks: DataFrame, columns: Sequence[str] = ("x", "y"), keys: Sequence[str] = KEYS, compat: bool = True) -> DataFrame:
    """Fills the missing points between real ones.

    ``compat``: m missing points after value v and before value e become v + i / (m + 2) (e - v), and the real point
    after them is overwritten by i = m + 1; the next gap starts from there. Otherwise: linear, real points stay.
    Points without a real one on both sides stay missing."""
    if compat:
        return folds.per_object(tracks, keys, lambda v, n: folds.fill_between({c: v[c] for c in columns}, columns[0]), columns)
    rows = _gaps(tracks, keys, columns)
    share = (F.col("_n") - F.col("_b._n")) / F.greatest(F.lit(1), F.col("_a._n") - F.col("_b._n"))
    linear = {c: F.coalesce(F.col(c), F.col(f"_b.{c}") + share * (F.col(f"_a.{c}") - F.col(f"_b.{c}"))) for c in columns}
    return rows.withColumns(linear).drop("_n", "_a", "_b")


def clean_path_filters(tracks: DataFrame, lone: float, chain: float, keys: Sequence[str] = KEYS, columns: Sequence[str] = ("x", "y")) -> DataFrame:
    """Lone points, chain filter, spine, both pads and the gap filling, in one pass over each object: a clean path but
    for its arcs. The operators of these steps give the same one after the other."""
    columns = [*columns, *(c for c in ("x", "y", "x1", "y1", "x2", "y2") if c in tracks.columns and c not in columns)]
    return folds.per_object(tracks, keys, lambda v, n: folds.clean({c: v[c] for c in columns}, lone, chain), columns)


def interpolate_grid(knots: DataFrame, last: int | None = None, first: int = 0, keys: Sequence[str] = KEYS, column: str = "x") -> DataFrame:
    """Piecewise linear values on the frames ``first`` to ``last``; beyond the knots, the outer two's line goes on.

    Without ``last``, an object's grid ends at its own last frame, with or without a value. An object with one knot has
    its value everywhere. The grid is joined by segment, not frame by frame."""
    w = _by(keys)
    end = F.lit(last) if last is not None else F.max("frame").over(Window.partitionBy(*keys))
    knots = knots.withColumn("_end", end)
    seg = knots.filter(F.col(column).isNotNull()).select(
        *keys, F.col("frame").alias("f0"), F.col(column).alias("v0"), F.lead("frame").over(w).alias("f1"), F.lead(column).over(w).alias("v1"),
        F.lag("frame").over(w).alias("fp"), F.lag(column).over(w).alias("vp"), "_end",
    )
    is_first, is_last = F.col("fp").isNull(), F.col("f1").isNull()
    # the last knot draws its line from the one before it
    seg = seg.withColumn("slope", F.when(~is_last, (F.col("v1") - F.col("v0")) / (F.col("f1") - F.col("f0"))).when(~is_first, (F.col("v0") - F.col("vp")) / (F.col("f0") - F.col("fp"))).otherwise(F.lit(0.0)))
    low = F.when(is_first, F.lit(first)).otherwise(F.greatest(F.col("f0"), F.lit(first)))
    high = F.when(is_last, F.col("_end")).otherwise(F.least(F.col("f1") - 1, F.col("_end")))
    frames = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = seg.select(*keys, "f0", "v0", "slope", F.explode(frames).alias("frame"))
    return rows.select(*keys, "frame", (F.col("v0") + F.col("slope") * (F.col("frame") - F.col("f0"))).alias(column))


def islands(rows: DataFrame, gap: int = 15, keys: Sequence[str] = KEYS) -> DataFrame:
    """Numbers the runs of frames that are less than ``gap`` apart, from 1."""
    w = _by(keys)
    new = F.when(F.col("frame") - F.lag("frame").over(w) >= gap, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("island", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("int")).drop("_new")


def longest_island(rows: DataFrame, gap: int = 15, keys: Sequence[str] = KEYS) -> DataFrame:
    """The island with the most frames of each object, the first on a tie: island, n, first and last frame."""
    sizes = islands(rows, gap, keys).groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    best = sizes.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("island")).alias("o"), "first_frame", "last_frame")).alias("b"))
    return best.select(*keys, (-F.col("b.o")).alias("island"), F.col("b.n").alias("n"), F.col("b.first_frame").alias("first_frame"), F.col("b.last_frame").alias("last_frame"))


def local_peaks(rows: DataFrame, column: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows whose value is larger than both neighbours'; ends have none."""
    w = _by(keys)
    return rows.withColumns({"_p": F.lag(column).over(w), "_q": F.lead(column).over(w)}).filter((F.col(column) > F.col("_p")) & (F.col(column) > F.col("_q"))).drop("_p", "_q")


def peaks(rows: DataFrame, column: str, distance: int = 20, prominence: float = 20.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of local maxima that rise by ``prominence`` above what parts them from higher values; of two that are nearer
    than ``distance`` rows, the higher one (then the earlier). Missing values count as the lowest."""
    from pitchgrid.operators.kernel import peaks as at

    def step(v: dict, n: int) -> np.ndarray:
        keep = np.zeros(n, bool)
        keep[at(np.where(np.isnan(v[column]), -np.inf, v[column]), distance, prominence)] = True
        return keep

    return folds.per_object(rows, keys, step, (column,))


def peaks_in_gaps(segments: DataFrame, peaks: DataFrame, margin: int = 8, keys: Sequence[str] = KEYS) -> DataFrame:
    """Peaks between the end of a segment and the start of the next, ``margin`` frames inside at least.

    Starts and ends are sorted independently: the k-th end is paired with the k+1-th start."""
    w_end, w_start = Window.partitionBy(*keys).orderBy("last_frame"), Window.partitionBy(*keys).orderBy("first_frame")
    ends = segments.select(*keys, F.row_number().over(w_end).alias("k"), (F.col("last_frame") + margin).alias("low"))
    starts = segments.select(*keys, (F.row_number().over(w_start) - 1).alias("k"), (F.col("first_frame") - margin).alias("high"))
    gaps = ends.join(starts, [*keys, "k"]).filter("low <= high").select(*keys, "k", "low", "high")
    return peaks.join(gaps, list(keys)).filter(F.col("frame").between(F.col("low"), F.col("high"))).drop("k", "low", "high").distinct()


def shifted(smooth: DataFrame, original: DataFrame, last: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Frame f takes the smooth value of f - 1; the last frame, by default an object's own, keeps its value."""
    original_columns = original.columns
    original = original.withColumn("_last", F.lit(last) if last is not None else F.max("frame").over(Window.partitionBy(*keys)))
    moved = smooth.select(*keys, (F.col("frame") + 1).alias("frame"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    joined = original.join(moved, [*keys, "frame"], "left")
    keep = (F.col("frame") >= F.col("_last")) | F.col("_x").isNull()
    return joined.withColumns({"x": F.when(keep, F.col("x")).otherwise(F.col("_x")), "y": F.when(keep, F.col("y")).otherwise(F.col("_y"))}).select(original_columns)
