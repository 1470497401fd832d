"""Vectors as the near-duplicate and search operators take them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(col: str) -> Column:
    """Not null, not empty, without null or non-finite components and not all zero."""
    inf = float("inf")
    good = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.col(col).isNotNull() & (F.size(col) > 0) & F.coalesce(good, F.lit(False)) & F.exists(col, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as float64 rows."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def sample(vectors: DataFrame, col: str, n: int) -> np.ndarray:
    """At most ``n`` vectors, those with the least hashes; for fitting projections and rotations on the driver."""
    got = vectors.select(col, F.xxhash64(col).alias("h")).orderBy("h", col).limit(n).select(col).toArrow()
    column = got[col].combine_chunks()
    return matrix(column if isinstance(column, pa.ListArray) else pa.concat_arrays(column.chunks)) if len(got) else np.zeros((0, 0))


def one_length(vectors: DataFrame, col: str) -> int:
    """The vectors' common length, 0 if there are none; raises where lengths differ."""
    r = vectors.agg(F.min(F.size(col)).alias("a"), F.max(F.size(col)).alias("b")).first()
    if r["a"] != r["b"]:
        raise ValueError(f"vectors of lengths {r['a']} to {r['b']}")
    return r["a"] or 0


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows with equal values in the first ``n_keys`` columns, from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(n_keys)])
        cuts = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[:, a])
            if held and key != last:
                yield pa.concat_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)
