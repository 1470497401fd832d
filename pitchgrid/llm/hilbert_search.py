"""Approximate nearest neighbours by shifted space-filling curves.

Largest inner product becomes nearest neighbour by one more coordinate that gives every candidate the largest norm.
Each curve projects the vectors with a rotation of its own, shifts the grid and orders them by Hilbert key, which is
range-partitioned in Spark. A query meets the candidates in a window of keys around its own; the windows of all
curves are merged and reranked by the exact inner product. The window is as wide as a measurement asks for: the true
neighbours of some queries are looked for on the curves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.llm import vectors
from pitchgrid.llm.common import Scratch, lean, partitions


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of points with ``bits`` bits a coordinate (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(hit, q - 1, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
    x ^= flip
    keys = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            keys = (keys << 1) | ((x[i] >> b) & 1)
    return keys


class _Curves:
    """Projections and shifted quantile grids of all curves, fitted on a sample."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int, largest: float, seed: int):
        rng = np.random.default_rng(seed)
        self.bits, self.largest = bits, largest
        lifted = self.lift(sample)
        d = lifted.shape[1]
        self.axes, self.grids = [], []
        for _ in range(curves):
            axes = np.linalg.qr(rng.normal(size=(d, d)))[0][:, : min(dims, d)]
            # a grid of quantiles, shifted by a part of a cell, so that no two curves part neighbours alike
            steps = (np.arange(1, 1 << bits) + rng.uniform(-0.5, 0.5)) / (1 << bits)
            self.axes.append(axes)
            self.grids.append(np.quantile(lifted @ axes, steps.clip(0, 1), axis=0))

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest**2 - (x * x).sum(1), 0))
        return np.column_stack([x, rest])

    def lift_queries(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x * (self.largest / np.linalg.norm(x, axis=1))[:, None], np.zeros(len(x))])

    def keys(self, lifted: np.ndarray, curve: int) -> np.ndarray:
        p = lifted @ self.axes[curve]
        cells = np.column_stack([np.searchsorted(self.grids[curve][:, j], p[:, j]) for j in range(p.shape[1])])
        return hilbert_keys(cells, self.bits)


def search(
    embeddings: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    curves: int = 8,
    recall: float = 0.94,
    probes: int = 128,
    dims: int = 4,
    bits: int = 12,
    sample_rows: int = 10_000,
    query_slice: int = 4_096,
    seed: int = 7,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` (inner product in double precision) of each query's
    ``k`` best found; ties go to the smaller id. Queries are the rows where ``is_query`` holds; candidates are all
    rows but the query's own id.

    Every usable row is in the index; rows with a null id or an unusable vector (null, zero, or with null or
    non-finite components) take no part. Fewer candidates than ``k``: all found. Repeated rows of an id count once, by
    the least of their vectors. Scores are sums along the components of one pair, the same wherever the pair is met,
    so equal vectors tie and their ids decide. An empty table, or no query, gives an empty result; other columns are
    left out. Vectors must have one length. Only the projections are fitted on a sample, of ``sample_rows`` vectors at
    most.
    The window is the least that holds the share ``recall`` of the true neighbours of ``probes`` queries on the curve
    where they are nearest; one pass over all rows finds these neighbours. Vectors without structure, as in the test
    tables, take a window that grows with the table; where neighbours are near, it doesn't. A task holds
    ``query_slice`` queries and a slice of candidates.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vec_col).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
    ).filter(vectors.usable("v") & F.col("id").isNotNull())
    rows = scratch.write(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("query").alias("query")))
    found = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("query").alias("q"),
        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m"),
        F.min(F.size("v")).alias("a"),
        F.max(F.size("v")).alias("b"),
    ).first()
    schema = "query_id long, vec_id long, score double"
    if not found["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if found["a"] != found["b"]:
        raise ValueError(f"vectors of lengths {found['a']} to {found['b']}")
    n, largest = found["n"], float(np.sqrt(found["m"]))
    model = _Curves(vectors.sample(rows, "v", sample_rows), curves, dims, bits, largest, seed)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, at = vectors.matrix(batch.column(1)), np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
            lifted, asked = model.lift(x), model.lift_queries(x[at])
            for c in range(curves):
                for kind, part, points in ((1, np.arange(len(x)), lifted), (0, at, asked)):
                    if len(part):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(part), c, np.int32)), pa.array(model.keys(points, c)), pa.array(np.full(len(part), kind, np.int32)), batch.column(0).take(pa.array(part)), batch.column(1).take(pa.array(part))],
                            ["curve", "key", "kind", "id", "v"],
                        )

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts the candidates before each row within its partition and curve."""
        part, so_far = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve, kind = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            before = np.zeros(batch.num_rows, np.int64)
            for c in np.unique(curve).tolist():
                at = curve == c
                run = np.cumsum(kind[at])
                before[at] = so_far.get(c, 0) + run - kind[at]
                so_far[c] = so_far.get(c, 0) + int(run[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(before)], [*batch.schema.names, "part", "before"])

    columns = "curve int, key long, kind int, id long, v array<double>"
    points = rows.mapInArrow(lean(keyed), columns)
    placed = points.repartitionByRange(partitions(spark), "curve", "key", "kind", "id").sortWithinPartitions("curve", "key", "kind", "id")
    placed = scratch.write(placed.mapInArrow(lean(ranked), f"{columns}, part int, before long"))
    # as many rows as partitions and curves
    counts = placed.groupBy("curve", "part").agg(F.sum("kind").alias("n"))
    earlier = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("curve", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    placed = placed.join(F.broadcast(counts), ["curve", "part"]).withColumn("place", F.col("first") + F.col("before"))
    window = _window(rows, placed, k, n, recall, probes)
    block = max(1, -(-window // 4))
    blocks = -(-n // block)
    slices = max(1, -(-int(found["q"] * 1.25 * window / n) // query_slice))
    candidates = placed.filter("kind = 1").select(
        "curve", F.floor(F.col("place") / block).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "kind", "place", "id", "v"
    )
    # the window keeps its width at both ends of the curve; blocks that it only touches are looked through whole
    low = F.greatest(F.lit(0), F.least(F.col("place") - window // 2, F.lit(n - window)))
    asked = placed.filter("kind = 0").select(
        "curve",
        F.explode(F.sequence(F.floor(low / block).cast("int"), F.least(F.floor((low + window - 1) / block), F.lit(blocks - 1)).cast("int"))).alias("block"),
        F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"),
        "kind",
        "place",
        "id",
        "v",
    )
    met = candidates.unionByName(asked).repartition(partitions(spark), "curve", "block", "slice").sortWithinPartitions("curve", "block", "slice", "kind", "id")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, asked, best, best_id = None, [], [], None, None

        def result() -> Iterator[pa.RecordBatch]:
            if best is not None:
                own = np.repeat(np.concatenate(ids), best.shape[1])
                good = np.isfinite(best.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(own[good]), pa.array(best_id.ravel()[good]), pa.array(best.ravel()[good])], ["query_id", "vec_id", "score"])

        for part in _slices(batches):
            key = tuple(part.column(j)[0].as_py() for j in range(3))
            if key != at:
                yield from result()
                at, ids, asked, best, best_id = key, [], [], None, None
            if part.column(3)[0].as_py() == 0:
                ids.append(part.column(5).to_numpy())
                asked.append(vectors.matrix(part.column(6)))
                continue
            if not ids:
                continue
            own, q = np.concatenate(ids), np.concatenate(asked)
            x, x_id = vectors.matrix(part.column(6)), part.column(5).to_numpy()
            score = exact_best(q, x, own, x_id, k, largest)
            all_id = np.broadcast_to(x_id, score.shape)
            if best is not None:
                score, all_id = np.hstack([best, score]), np.hstack([best_id, all_id])
            if score.shape[1] > k:
                order = np.lexsort((all_id, -score), axis=1)[:, :k]
                score, all_id = np.take_along_axis(score, order, 1), np.take_along_axis(all_id, order, 1)
            best, best_id = score, all_id
        yield from result()

    found = met.mapInArrow(lean(rerank), schema).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # a query has at most k rows of each block of its windows
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_best(q: np.ndarray, x: np.ndarray, q_id: np.ndarray, x_id: np.ndarray, k: int, largest: float) -> np.ndarray:
    """Inner products of each query with the candidates that can be among its ``k`` best, by one formula for each pair;
    -inf for all others and the query's own id. A matrix product, which rounds by its shape, only tells which can."""
    rough = q @ x.T
    rough[q_id[:, None] == x_id[None, :]] = -np.inf
    cut = np.full((len(q), 1), -np.inf)
    if rough.shape[1] > k:
        margin = 1e-12 * largest * np.sqrt((q * q).sum(1))
        cut = (-np.partition(-rough, k - 1, axis=1)[:, k - 1] - margin)[:, None]
    i, j = np.nonzero((rough >= cut) & (rough > -np.inf))
    score = np.full(rough.shape, -np.inf)
    for a in range(0, len(i), 1 << 16):
        part = slice(a, a + (1 << 16))
        score[i[part], j[part]] = (q[i[part]] * x[j[part]]).sum(1)
    return score


def _window(rows: DataFrame, placed: DataFrame, k: int, n: int, recall: float, probes: int) -> int:
    """The least window that reaches ``recall`` for the true neighbours of some queries (those of least hashes)."""
    asked = rows.filter("query").select("id", "v").orderBy(F.xxhash64("id"), "id").limit(probes).toArrow()
    ids = asked["id"].to_numpy()
    q = np.array(asked["v"].to_pylist(), np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, best_id = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 4_096):
                part = batch.slice(a, 4_096)
                x_id = part.column(0).to_numpy()
                score = q @ vectors.matrix(part.column(1)).T
                score[ids[:, None] == x_id[None, :]] = -np.inf
                best, best_id = np.hstack([best, score]), np.hstack([best_id, np.broadcast_to(x_id, score.shape)])
                order = np.argsort(-best, axis=1, kind="stable")[:, :k]
                best, best_id = np.take_along_axis(best, order, 1), np.take_along_axis(best_id, order, 1)
        good = np.isfinite(best.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])[good]), pa.array(best_id.ravel()[good]), pa.array(best.ravel()[good])], ["q", "id", "score"])

    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    true = rows.select("id", "v").mapInArrow(lean(nearest), "q long, id long, score double").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    true = true.select("q", "id").toArrow()
    a, b = true["q"].to_numpy(), true["id"].to_numpy()
    if not len(a):
        return min(n, 4 * k)
    spark = rows.sparkSession
    # as many rows as probes and their neighbours
    wanted = spark.createDataFrame([(int(x), 0) for x in np.unique(a)] + [(int(x), 1) for x in np.unique(b)], "id long, kind int")
    at = placed.join(F.broadcast(wanted), ["id", "kind"]).select("curve", "kind", "id", "place").toArrow()
    curve, kind, who, place = (at[c].to_numpy() for c in ("curve", "kind", "id", "place"))
    nearest_by = np.full(len(a), n, np.int64)
    for c in np.unique(curve):
        of_query = dict(zip(who[(curve == c) & (kind == 0)].tolist(), place[(curve == c) & (kind == 0)].tolist(), strict=True))
        of_other = dict(zip(who[(curve == c) & (kind == 1)].tolist(), place[(curve == c) & (kind == 1)].tolist(), strict=True))
        gap = np.array([abs(of_query[x] - of_other[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        nearest_by = np.minimum(nearest_by, gap)
    need = int(np.quantile(nearest_by, recall, method="higher"))
    return min(n, max(4 * k, 2 * need + 1))


def _slices(batches: Iterator[pa.RecordBatch], most: int = 2_048) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal first four columns, cut to ``most`` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(4)])
        cuts = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for c in range(a, b, most):
                yield batch.slice(c, min(most, b - c))
