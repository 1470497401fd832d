"""Near-duplicate vectors by iterative quantisation (ITQ) and multi-index Hamming tables.

1. Unit vectors are centred on their mean and projected on their principal directions; rotations learned on a sample
   bring them close to the corners of a cube, and each direction is cut at its median: balanced binary codes.
2. Table t holds the t-th substring of every code. Vectors whose substrings differ in one bit at most meet: a vector
   stands in the bucket of its own substring and looks into those with one more bit set.
3. Codes are compared by Hamming distance before vectors are fetched. Buckets of few vectors give pairs, which are
   verified with the original vectors; buckets of many are split into blocks that verify theirs inside tasks and give
   sums and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm import vectors
from pitchgrid.llm.common import Scratch, lean, log2_ceil, partitions
from pitchgrid.llm.components import components

#: Cosines by a matrix product may be off by this; within it of the threshold, the one formula of ``cosines`` decides.
_MARGIN = 1e-9


def learn_rotation(sample: np.ndarray, seed: int, rounds: int = 40) -> np.ndarray:
    """The rotation whose signs are closest to the rotated sample (Gong and Lazebnik): alternate codes and Procrustes."""
    d = sample.shape[1]
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(sample.T @ np.where(sample @ r >= 0, 1.0, -1.0))
        r = u @ vt
    return r


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each pair of rows: sums along rows don't depend on what other rows there are, nor on the sides."""
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


class Codes:
    """Balanced codes of ``tables`` substrings of ``bits`` bits, fitted on a sample."""

    def __init__(self, sample: np.ndarray, bits: int, tables: int, seed: int):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = unit.mean(0)
        centred = unit - self.mean
        spread, axes = np.linalg.eigh(centred.T @ centred)
        # principal directions up to 99% of the variance
        n = max(1, int(np.searchsorted(np.cumsum(spread[::-1]), 0.99 * max(spread.sum(), 1e-300)) + 1))
        axes = axes[:, ::-1][:, : min(len(spread), max(n, min(8, len(spread))))]
        reduced = centred @ axes
        self.bits, self.tables = bits, tables
        columns = []
        rng = np.random.default_rng(seed)
        for k in range(-(-bits * tables // axes.shape[1])):
            columns.append(axes @ learn_rotation(reduced, seed + k)[:, rng.permutation(axes.shape[1])])
        self.axes = np.hstack(columns)[:, : bits * tables]
        self.cuts = np.median(centred @ self.axes, axis=0)

    def bits_of(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return (unit - self.mean) @ self.axes >= self.cuts

    def substrings(self, x: np.ndarray) -> np.ndarray:
        weights = 1 << np.arange(self.bits, dtype=np.int64)
        return self.bits_of(x).reshape(len(x), self.tables, self.bits) @ weights


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of bits in which numbers differ."""
    return np.bitwise_count(a ^ b).astype(np.int64)


def threshold_pairs(sample: np.ndarray, threshold: float, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the sample, each with a made partner right at the threshold: half of the partners lie in a random
    direction, half in the direction of another vector of the sample."""
    rng = np.random.default_rng(seed)
    u = sample[rng.integers(0, len(sample), n)]
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    other = sample[rng.integers(0, len(sample), n)] - sample[rng.integers(0, len(sample), n)]
    shaped = (np.arange(n) % 2 == 0) & (np.abs(other).sum(1) > 0)
    w[shaped] = other[shaped]
    w -= (w * u).sum(1, keepdims=True) * u
    norm = np.linalg.norm(w, axis=1, keepdims=True)
    w = np.divide(w, norm, out=np.zeros_like(w), where=norm > 1e-12)
    return u, threshold * u + np.sqrt(1 - threshold**2) * w


def nearest_pairs(sample: np.ndarray, threshold: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the sample at the threshold or above, the ``n`` nearest to it: what it has of them."""
    u = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    found = []
    for k in range(0, len(u), 500):
        cos = u[k : k + 500] @ u.T
        i, j = np.nonzero((cos >= threshold) & (np.arange(len(u))[None, :] > np.arange(k, k + len(cos))[:, None]))
        keep = np.argsort(cos[i, j], kind="stable")[:n]
        found.append((cos[i, j][keep], i[keep] + k, j[keep]))
    cos, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = np.argsort(cos, kind="stable")[:n]
    return u[i[keep]], u[j[keep]]


def fit(sample: np.ndarray, n: int, threshold: float, recall: float, max_tables: int, seed: int) -> tuple[Codes, int, float]:
    """Codes, the Hamming radius of whole codes, and the recall measured on other pairs than those fitted on.

    Pairs are ``threshold_pairs`` and, where the sample has 200 or more, its own at the threshold; the worse of the two
    counts. Substrings begin with buckets of about 16 of ``n`` vectors; they get shorter, and buckets larger, until
    ``max_tables`` tables reach ``recall``. A substring of no more than one bit is always within the distance of one."""
    made = [threshold_pairs(sample, threshold, 4_000, seed + k) for k in (0, 1)]
    a, b = nearest_pairs(sample[:3_000], threshold, 8_000)
    kinds = [made, [(a[0::2], b[0::2]), (a[1::2], b[1::2])]] if len(a) >= 200 else [made]

    def apart(codes: Codes, half: int) -> list[np.ndarray]:
        return [differing(codes.substrings(k[half][0]), codes.substrings(k[half][1])) for k in kinds]

    bits = min(30, max(6, log2_ceil(max(1, n // 16))))
    while True:
        codes = Codes(sample, bits, max_tables, seed)
        missed = np.max([np.cumprod(d > 1, axis=1).mean(0) for d in apart(codes, 0)], axis=0)
        enough = np.flatnonzero(missed <= 1 - recall)
        if len(enough) or bits == 1:
            break
        bits = max(1, bits - 2)
    codes = Codes(sample, bits, int(enough[0]) + 1 if len(enough) else max_tables, seed)
    # the radius goes beyond the largest distance that was seen
    whole = [d.sum(1) for d in apart(codes, 0)]
    radius = min(codes.bits * codes.tables, max(int(np.ceil(max(w.max(), w.mean() + 5 * w.std()))) + 1 for w in whole))
    found = min(float(((d <= 1).any(1) & (d.sum(1) <= radius)).mean()) for d in apart(codes, 1))
    return codes, radius, found


def near_duplicates(
    embeddings: DataFrame,
    threshold: float = 0.95,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    recall: float = 0.999,
    max_tables: int = 24,
    sample_rows: int = 5_000,
    direct_rows: int = 32,
    block_rows: int = 1_024,
    seed: int = 11,
) -> DataFrame:
    """One row per input row: the id, ``n_links`` (other vectors linked to it directly), ``component_id`` (least id
    reachable by links, itself included) and ``kept`` (whether that is its own id).

    Vectors link where their cosine in double precision is ``threshold`` or more. Every row is in the tables; only
    the codes are learned on a sample of ``sample_rows`` vectors at most. ``recall`` is that of pairs right at the
    threshold, measured on pairs of the sample and pairs made from it; it sets the number and width of the tables, and closer pairs
    are found more surely. Where vectors crowd so that ``max_tables`` tables of narrow buckets can't reach it, buckets
    get larger, down to one bit, which compares all. Vectors that are null, zero or hold null or non-finite components
    have no link; a null id is its own row without link and with a null component. Equal vectors are linked as one
    class, so a group of copies costs its size. Rows with one id are one node for components and links. An empty table
    gives an empty result; other columns are left out. Vectors must have one length.

    A pair is verified once, in the first table where it meets. Vectors travel to pairs of small buckets and to blocks
    of buckets of more than ``direct_rows``, not to tables: these hold ids and codes.
    """
    spark = embeddings.sparkSession
    scratch, n_tasks = Scratch(spark), partitions(spark)
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    good = rows.filter(vectors.usable("v") & F.col("id").isNotNull())
    key = [F.xxhash64("v").alias("h1"), F.xxhash64(F.reverse("v")).alias("h2")]
    # the class of equal vectors: its least id stands for it
    classes = scratch.write(good.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).select("*", *key))
    vectors.one_length(classes, "v")
    n = classes.count()
    everyone = rows.select("id")
    if n == 0:
        return _result(everyone, id_col)
    codes, radius, _ = fit(vectors.sample(classes, "v", sample_rows), n, threshold, recall, max_tables, seed)
    tables, bits = codes.tables, codes.bits
    packed = -(-bits // 8)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1_000):
                part = batch.slice(k, 1_000)
                if part.num_rows:
                    x = codes.substrings(vectors.matrix(part.column(0)))
                    yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([_pack(r, packed) for r in x], pa.binary())], ["rep", "copies", "code"])

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per table for the own substring (kind 1), and one for each bit that isn't set (kind 0)."""
        for batch in batches:
            for k in range(0, batch.num_rows, 1_000):
                part = batch.slice(k, 1_000)
                x = _unpack(part.column(2), tables, packed)
                for t in range(tables):
                    own = x[:, t]
                    bit, at = np.nonzero((own[None, :] >> np.arange(bits)[:, None]) & 1 == 0)
                    take = np.concatenate([np.arange(len(own)), at])
                    value = np.concatenate([own, own[at] | (np.int64(1) << bit)])
                    kind = np.concatenate([np.ones(len(own), np.int32), np.zeros(len(at), np.int32)])
                    moved = part.take(pa.array(take))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), t, np.int32)), pa.array(value.astype(np.int32)), pa.array(kind), *moved.columns], ["t", "bucket", "kind", "rep", "copies", "code"])

    code_table = scratch.write(classes.select("v", "rep", "copies").mapInArrow(lean(coded), "rep long, copies long, code binary"))
    entries = code_table.mapInArrow(lean(entered), "t int, bucket int, kind int, rep long, copies long, code binary")
    sizes = code_table.mapInArrow(lean(entered), "t int, bucket int, kind int, rep long, copies long, code binary").groupBy("t", "bucket").agg(F.sum("kind").alias("own"), F.sum(1 - F.col("kind")).alias("asks"))
    # buckets in which something meets; written, so that their size decides how they are joined
    sizes = scratch.write(sizes.filter((F.col("own") > 1) | (F.col("own") > 0) & (F.col("asks") > 0)))
    blocks = lambda c: F.ceil(F.col(c) / block_rows).cast("int")
    large = scratch.write(sizes.filter(F.col("own") + F.col("asks") > direct_rows).select("t", "bucket", blocks("own").alias("own_blocks"), blocks("asks").alias("ask_blocks")))

    # few: codes meet, pairs within the radius are verified
    few = entries.join(large, ["t", "bucket"], "left_anti").repartition(n_tasks, "t", "bucket").sortWithinPartitions("t", "bucket", "kind", "rep")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in vectors.groups(batches, 2):
            kind = group.column(2).to_numpy()
            own, asks = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
            if not len(own) or len(kind) < 2:
                continue
            x, rep = _unpack(group.column(5), tables, packed), group.column(3).to_numpy()
            t = group.column(0)[0].as_py()
            i, j = np.triu_indices(len(own), 1)
            a = np.concatenate([own[i], np.repeat(asks, len(own))])
            b = np.concatenate([own[j], np.tile(own, len(asks))])
            apart = differing(x[a], x[b])
            near = (apart.sum(1) <= radius) & (apart[:, :t] > 1).all(1)
            if near.any():
                a, b = rep[a[near]], rep[b[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    pairs = scratch.write(few.mapInArrow(lean(meet), "a long, b long"))
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("copies").alias(f"c{s}"), F.col("v").alias(f"v{s}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = cosines(vectors.matrix(batch.column(4)), vectors.matrix(batch.column(5))) >= threshold
                a, b, ca, cb = (batch.column(k).to_numpy()[near] for k in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((a, b), (b, a), (cb, ca))], ["rep", "root", "links"])

    found = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ca", "cb", "va", "vb").mapInArrow(lean(check), "rep long, root long, links long")

    # many: blocks of those in the bucket among each other, and of those that look into it with them
    placed = entries.join(large, ["t", "bucket"])
    count = lambda c: F.greatest(F.col(c), F.lit(1))
    block = F.pmod(F.xxhash64("rep", "t", "kind"), F.when(F.col("kind") == 1, count("own_blocks")).otherwise(count("ask_blocks"))).cast("int")
    placed = placed.withColumn("block", block)
    among = placed.filter("kind = 1").select("*", F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1)).alias("o"))
    among = among.select("t", "bucket", F.lit(1).alias("kind"), F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), (F.col("block") <= F.col("o")).cast("int").alias("first"), "rep", "copies", "code")
    looks = placed.filter("own_blocks > 0 and ask_blocks > 0").select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 1, F.col("ask_blocks")).otherwise(F.col("own_blocks")) - 1)).alias("o"))
    asks = F.col("kind") == 0
    looks = looks.select("t", "bucket", F.lit(0).alias("kind"), F.when(asks, F.col("block")).otherwise(F.col("o")).alias("i"), F.when(asks, F.col("o")).otherwise(F.col("block")).alias("j"), (1 - F.col("kind")).alias("first"), "rep", "copies", "code")
    dealt = among.unionByName(looks).join(classes.select("rep", "v"), "rep").select("t", "bucket", "kind", "i", "j", "first", "rep", "copies", "code", "v")
    dealt = dealt.repartition(n_tasks, "t", "bucket", "kind", "i", "j").sortWithinPartitions("t", "bucket", "kind", "i", "j", "rep")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in vectors.groups(batches, 5):
            if group.num_rows > 1:
                yield from _verified(group, threshold, radius, tables, packed)

    links = found.union(dealt.mapInArrow(lean(verify), "rep long, root long, links long")) if not large.isEmpty() else found
    links = scratch.write(links)
    degrees = links.groupBy("rep").agg(F.sum("links").alias("links"))
    forest = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    of_class = classes.join(degrees, "rep", "left").join(forest, classes["rep"] == forest["id"], "left")
    of_class = of_class.select("h1", "h2", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    # the same rows once more, each with its class; written, so that a join can split a large class
    of_row = good.select("id", *key).join(scratch.write(of_class), ["h1", "h2"]).groupBy("id").agg(F.min("component").alias("component"), F.max("links").alias("links"))
    return _result(everyone, id_col, of_row)


def _pack(substrings: np.ndarray, width: int) -> bytes:
    """Each substring in ``width`` bytes, little-endian."""
    return np.ascontiguousarray(substrings.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def _unpack(codes: pa.Array, tables: int, width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), tables, width)
    out = np.zeros((len(codes), tables, 4), np.uint8)
    out[:, :, :width] = raw
    return out.view("<u4").reshape(len(codes), tables).astype(np.int64)


def _verified(group: pa.RecordBatch, threshold: float, radius: int, tables: int, width: int) -> Iterator[pa.RecordBatch]:
    t, kind, i, j = (group.column(k)[0].as_py() for k in (0, 2, 3, 4))
    first, rep, copies = (group.column(k).to_numpy() for k in (5, 6, 7))
    codes, x = _unpack(group.column(8), tables, width), vectors.matrix(group.column(9))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    one = kind == 1 and i == j
    a, b = (np.arange(len(x)),) * 2 if one else (np.flatnonzero(first == 1), np.flatnonzero(first == 0))
    if not len(a) or not len(b):
        return
    # by Hamming distance first; pairs that an earlier table has together were verified there
    apart, earlier = np.zeros((len(a), len(b)), np.int16), np.zeros((len(a), len(b)), bool)
    for k in range(tables):
        d = np.bitwise_count(codes[a, k][:, None] ^ codes[b, k][None, :]).astype(np.int16)
        apart += d
        if k < t:
            earlier |= d <= 1
    near = (apart <= radius) & ~earlier
    if one:
        near = np.triu(near, 1)
    if not near.any():
        return
    cos = unit[a] @ unit[b].T
    near &= cos >= threshold - _MARGIN
    p, q = np.nonzero(near & (cos < threshold + _MARGIN))
    if len(p):
        near[p, q] = cosines(x[a[p]], x[b[q]]) >= threshold
    if not near.any():
        return
    links = np.zeros(len(x), np.int64)
    links[a] += near @ copies[b]
    np.add.at(links, b, near.T @ copies[a])
    # spanning forest: the least row reachable, by spreading labels over the pairs until they settle
    label = np.arange(len(x))
    while True:
        best = label.copy()
        best[a] = np.minimum(best[a], np.where(near, label[b][None, :], len(x)).min(1))
        np.minimum.at(best, b, np.where(near, best[a][:, None], len(x)).min(0))
        best = np.minimum(best, best[best])
        if (best == label).all():
            break
        label = best
    hit = links > 0
    yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(rep[label[hit]]), pa.array(links[hit])], ["rep", "root", "links"])


def _result(everyone: DataFrame, id_col: str, of_row: DataFrame | None = None) -> DataFrame:
    if of_row is None:
        joined = everyone.select("id", F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("links"))
    else:
        joined = everyone.join(of_row, "id", "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
