"""Connected components of a graph of links, by forests that are merged until each node has one parent.

Edges point from the larger id to the smaller. They are dealt out by the larger one; each task replaces its edges by a
spanning forest of stars towards the least id it sees. Nodes with several parents so pass their parents on to each
other, until every node has one smaller parent at most: then each tree is a component, and pointer jumping flattens it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pitchgrid.llm.common import Scratch, lean, partitions


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its tree) for all nodes of these edges but the least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        # the least label on either side goes to both ends and to the roots they had
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for end in (u, v):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds the batches of a task into one forest: no more edges than nodes are held."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > max(1 << 18, 2 * len(a)):
            a, b = _forest(np.concatenate([a, *(h[0] for h in held)]), np.concatenate([b, *(h[1] for h in held)]))
            held, size = [], 0
    a, b = _forest(np.concatenate([a, *(h[0] for h in held)]), np.concatenate([b, *(h[1] for h in held)]))
    for k in range(0, len(a), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(a[k : k + (1 << 16)]), pa.array(b[k : k + (1 << 16)])], ["a", "b"])


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 200) -> DataFrame:
    """``edges`` (a, b): longs. One row per linked node: ``id`` and ``component``, the least id reachable from it.

    Nulls and loops link nothing; repeated edges count once; without edges the result is empty. A round moves each
    edge once; each is written, so a lost executor costs a reread. A node's edges are one task's, and a task holds a
    forest of its nodes only, whatever their degree.
    """
    n = partitions(scratch.spark)
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    state = None
    for _ in range(most_rounds):
        before, seen = edges, Observation()
        merged = before.repartition(n, "a").mapInArrow(lean(_merge), "a long, b long")
        # what a round has made is told by the job that writes it
        merged = merged.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a") % 1_000_003).alias("s"))
        edges = scratch.write(merged)
        scratch.release(before)
        now = tuple(seen.get[k] for k in "nxs")
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError("the components haven't settled")
    for _ in range(most_rounds):
        if not now[0]:
            break
        up, seen = edges.select(F.col("a").alias("b"), F.col("b").alias("c")), Observation()
        jumped = edges.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved"))
        jumped = scratch.write(jumped.observe(seen, F.count_if("moved").alias("moved")))
        scratch.release(edges)
        edges = jumped.select("a", "b")
        edges._scratch = jumped._scratch
        if not seen.get["moved"]:
            break
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
