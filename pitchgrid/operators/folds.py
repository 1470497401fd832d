"""Passes over whole objects in Arrow: rows sorted by object and frame stream by, an object at a time in numpy.

An object is a track of one match, so a task holds a match's frames of one object at most. One shuffle by the object
serves all steps of a pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def objects(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The rows of each object, from rows sorted by the first ``n_keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = np.zeros(batch.num_rows - 1, bool)
        for k in range(n_keys):
            a, b = batch.column(k).slice(1), batch.column(k).slice(0, batch.num_rows - 1)
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            edge |= ~same.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(edge) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(k)[-1].as_py() != part.column(k)[0].as_py() for k in range(n_keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def per_object(rows: DataFrame, keys: Sequence[str], step: Callable[[dict[str, np.ndarray], int], dict[str, np.ndarray] | np.ndarray], columns: Sequence[str]) -> DataFrame:
    """``rows`` through ``step``, object by object in the order of frames. It gets ``frame`` and ``columns`` as float arrays
    (NaN where null), and returns the rows to keep as a mask, or new values of some columns (NaN becomes null)."""
    rest = [c for c in rows.columns if c not in keys]
    ordered = rows.select(*keys, *rest)
    names, schema = ordered.columns, ordered.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in objects(batches, len(keys)):
            arrays = {c: pc.cast(table[c], pa.float64()).to_numpy() for c in ("frame", *columns)}
            got = step(arrays, len(table))
            if isinstance(got, dict):
                for c, v in got.items():
                    kind = table.schema.field(c).type
                    table = table.set_column(names.index(c), table.schema.field(c), pc.cast(pa.array(v, from_pandas=True), kind))
            else:
                table = table.filter(pa.array(got))
            yield from table.combine_chunks().to_batches()

    done = ordered.repartition(*keys).sortWithinPartitions(*keys, "frame").mapInArrow(run, schema)
    return done.select(rows.columns)


def near_another(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """Whether each point has another within ``radius``. Two points in one cell of side radius / sqrt 2 have; only
    points alone in theirs look into the cells around it."""
    n = len(x)
    if not n or radius <= 0:
        return np.zeros(n, bool)
    side = radius / 2**0.5
    cells = np.stack([np.floor(x / side), np.floor(y / side)], 1).astype(np.int64)
    kinds, of, size = np.unique(cells, axis=0, return_inverse=True, return_counts=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    begin = np.cumsum(size) - size
    place = {(int(a), int(b)): k for k, (a, b) in enumerate(kinds.tolist())}
    near = size[of] > 1
    around = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if a or b]
    for i in np.flatnonzero(~near).tolist():
        a, b = cells[i].tolist()
        for da, db in around:
            k = place.get((a + da, b + db))
            if k is not None:
                other = order[begin[k] : begin[k] + size[k]]
                if (np.sqrt((x[i] - x[other]) ** 2 + (y[i] - y[other]) ** 2) <= radius).any():
                    near[i] = True
                    break
    return near


def chain(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """Points within ``radius`` of the last point kept; missing points and exact (0, 0) are skipped, the first is kept."""
    keep = np.zeros(len(x), bool)
    live = np.flatnonzero(~(np.isnan(x) | np.isnan(y)) & ~((x == 0) & (y == 0)))
    last = None
    for i, a, b in zip(live.tolist(), x[live].tolist(), y[live].tolist(), strict=True):
        if last is None or ((a - last[0]) * (a - last[0]) + (b - last[1]) * (b - last[1])) ** 0.5 <= radius:
            keep[i], last = True, (a, b)
    return keep


def pad_ends(values: dict[str, np.ndarray], by: str, start: bool = True, end: bool = True) -> dict[str, np.ndarray]:
    """Missing points before the first real one take it, and those after the last; ``by`` tells which are real."""
    real = np.flatnonzero(~np.isnan(values[by]))
    if not len(real):
        return values
    out = {c: v.copy() for c, v in values.items()}
    for c, v in out.items():
        if start:
            v[: real[0]] = v[real[0]]
        if end:
            v[real[-1] + 1 :] = v[real[-1]]
    return out


def fill_between(values: dict[str, np.ndarray], by: str) -> dict[str, np.ndarray]:
    """m missing points after value v and before value e become v + i / (m + 2) (e - v), and e itself is overwritten by
    i = m + 1; the next gap starts from there. Points without a real one on both sides stay missing."""
    real = np.flatnonzero(~np.isnan(values[by]))
    if len(real) < 2:
        return values
    m = np.diff(real) - 1
    out = {}
    for c, v in values.items():
        new = v.copy()
        fitted = v[real].tolist()
        for k in np.flatnonzero(m > 0).tolist():
            fitted[k + 1] = fitted[k] + (m[k] + 1) / (m[k] + 2) * (fitted[k + 1] - fitted[k])
        new[real] = fitted
        for k in np.flatnonzero(m > 0).tolist():
            a, n = int(real[k]), int(m[k])
            i = np.arange(1, n + 1)
            new[a + 1 : a + n + 1] = fitted[k] + i / (n + 2) * (v[real[k + 1]] - fitted[k])
        out[c] = new
    return out


def clean(values: dict[str, np.ndarray], lone: float, radius: float) -> dict[str, np.ndarray]:
    """Lone points, the chain filter, both pads and the filling of gaps: points that go lose all their columns."""
    x, y = values["x"], values["y"]
    gone = np.isnan(x) | np.isnan(y)
    # missing points stand at (0, 0) where company is looked for
    company = near_another(np.where(gone, 0.0, x), np.where(gone, 0.0, y), lone)
    alive = chain(np.where(company & ~gone, x, np.nan), y, radius)
    kept = {c: np.where(alive, v, np.nan) for c, v in values.items()}
    return fill_between(pad_ends(kept, "x"), "x")
