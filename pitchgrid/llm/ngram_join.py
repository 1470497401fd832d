"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Each chunk of documents hashes its shingles and sends them, sorted and packed by hash range, to where the range is
   counted. Only shingles of two documents or more come back, with their document frequency: a shingle of one document
   can't be shared, yet as the rarest it fills the document's prefix first.
2. Documents with equal sets are one class. Each class has a prefix: as many of its rarest shingles as any partner at
   the threshold must share one of. Classes join on prefix shingles; length, position and the hash histogram of the
   shared shingles bound the overlap; each pair that is left is verified once, on whole sets.
3. Each prefix shingle's classes are first paired with one leader of theirs. Of shingles whose classes these links don't
   all connect, those of few classes then give all their pairs, filtered, each once. Classes that share a shingle of many
   form clusters; the rest of their pairs are looked at inside tasks, split by bands of lengths that can link and by
   salt, and a task gives a forest, so no group is expanded into rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.common import Scratch, lean, log2_ceil, partitions, rows_of, settled, texts
from pitchgrid.llm.components import components
from pitchgrid.llm.shingles import doc_shingles, mix
from pitchgrid.llm.vectors import groups

_SENT = "p int, chunk long, k int, id long, n int, f1 long, f2 long, size int, blob binary"
_SENT_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
_SENT_NAMES = [x.split()[0] for x in _SENT.split(", ")]
#: Bins of the histogram by which the suffix filter bounds an overlap.
_BINS = 8


def _planes(x: np.ndarray) -> bytes:
    """The bytes of a number array by significance: the high bytes of sorted numbers compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(map(_planes, columns)))


def _unpack(blob: bytes, size: int, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        end = at + size * np.dtype(kind).itemsize
        out.append(_from_planes(raw[at:end], kind))
        at = end
    return out


def _histogram(hashes: np.ndarray) -> np.ndarray:
    return np.bincount(hashes & (_BINS - 1), minlength=_BINS).astype(np.int32)


def prefix_length(n: Column, percent: int) -> Column:
    """So many of a set's n rarest shingles that a partner at the threshold shares one of them."""
    return n - F.ceil(n * percent / 100).cast("int") + 1


def _needed(na: Column, nb: Column, percent: int) -> Column:
    """The least overlap at the threshold: 100 I >= percent (na + nb - I)."""
    return F.ceil((na + nb) * percent / (100 + percent))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length, positional and suffix filters on two entries (structs n, pos, hist) of one prefix shingle."""
    na, nb, pa_, pb = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    need = _needed(na, nb, percent)
    length = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    position = F.least(pa_, pb) + F.least(na - pa_, nb - pb) >= need
    suffix = F.aggregate(F.zip_with(f"{a}.hist", f"{b}.hist", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x) >= need
    return length & position & suffix


def shingle_classes(docs: DataFrame, scratch: Scratch, kept: Scratch, id_col: str, text_col: str, words: int, percent: int, chunk_bytes: int = 3 << 19) -> tuple[DataFrame, DataFrame]:
    """Written tables: per input row (id, n, rep), in ``kept``; per class that can link (rep, n, alone, hist, shared): ``alone``
    shingles are its own only, ``shared`` are the others' hashes, rarest first, ``hist`` counts these by hash."""
    spark, tasks = docs.sparkSession, partitions(docs.sparkSession)
    bits = min(20, log2_ceil(8 * tasks))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for c, (ids, whole) in enumerate(rows_of(batches, chunk_bytes)):
            for lo in range(0, len(ids), 1 << 16):
                chunk = at + (c << 8) + (lo >> 16)
                part = whole[lo : lo + (1 << 16)]
                doc, h = doc_shingles(part, words)
                n = np.bincount(doc, minlength=len(part))
                # fingerprints of the sets: two independent sums over the shingles
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h, salt), dtype=np.uint64)]) for salt in (101, 202)]
                last = np.cumsum(n)
                f1, f2 = ((s[last] - s[last - n]).view(np.int64) for s in sums)
                m = len(part)
                none = pa.nulls(m, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(((chunk >> 8) + (chunk >> 32) * 31 + np.arange(m)) % (1 << bits), pa.int32()), pa.array(np.full(m, chunk)), pa.array(np.arange(m, dtype=np.int32)), pa.array(ids[lo : lo + m], pa.int64()),
                        pa.array(n.astype(np.int32)), pa.array(f1), pa.array(f2), pa.array(np.zeros(m, np.int32)), none,
                    ],
                    _SENT_NAMES,
                )
                order = np.argsort(h)
                h, doc = h[order], doc[order].astype("<u2")
                cuts = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).tolist()
                rows = [[p, chunk, -1, None, 0, 0, 0, b - a, _pack(h[a:b], doc[a:b])] for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                for k in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows[k : k + 64], strict=True), _SENT_KINDS, strict=True)], _SENT_NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 1):
            plain = group.column(8).is_null()
            yield group.filter(plain)
            blobs = group.filter(pc.invert(plain))
            if not blobs.num_rows:
                continue
            sizes = blobs.column(7).to_pylist()
            got = [_unpack(b, s, "<u8", "<u2") for b, s in zip(blobs.column(8).to_pylist(), sizes, strict=True)]
            h, doc = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            source = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(h, kind="stable")
            runs = np.concatenate([[0], np.flatnonzero(h[order][1:] != h[order][:-1]) + 1, [len(h)]])
            df = np.empty(len(h), "<u4")
            df[order] = np.repeat(np.diff(runs), np.diff(runs))
            kept = np.flatnonzero(df > 1)
            at = np.searchsorted(source[kept], np.arange(len(sizes) + 1)).tolist()
            p, chunks = group.column(0)[0].as_py(), blobs.column(1).to_pylist()
            for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if b > a:
                    x = kept[a:b]
                    row = [p, chunks[k], -1, None, 0, 0, 0, b - a, _pack(h[x], doc[x], df[x])]
                    yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, _SENT_KINDS, strict=True)], _SENT_NAMES)

    # tasks number their rows, and the numbers meet again below
    sent = settled(texts(docs, id_col, text_col), scratch).mapInArrow(lean(send), _SENT)
    counted = scratch.write(sent.repartition(tasks, "p").sortWithinPartitions("p").mapInArrow(lean(count), _SENT))
    rows = counted.filter(F.col("blob").isNull()).select("chunk", "k", "id", "n", "f1", "f2")
    # the least id of equal sets stands for them; one row of that id carries the set
    # written, so that the join deals both sides anew and a large group of copies can be split
    reps = scratch.write(rows.filter("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min(F.struct("id", "chunk", "k")).alias("rep")))
    rows = kept.write(rows.join(reps, ["n", "f1", "f2"], "left").select("chunk", "k", "id", "n", F.col("rep.id").alias("rep"), ((F.col("rep.chunk") == F.col("chunk")) & (F.col("rep.k") == F.col("k"))).alias("carries")))
    carriers = rows.filter("carries").select("chunk", "k", "rep", "n", F.lit(0).alias("size"), F.lit(None).cast("binary").alias("blob"))
    answers = counted.filter(F.col("blob").isNotNull()).select("chunk", "k", F.lit(None).cast("long").alias("rep"), "n", "size", "blob")
    share = percent

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 1):
            plain = group.column(5).is_null()
            docs_, blobs = group.filter(plain), group.filter(pc.invert(plain))
            if not docs_.num_rows or not blobs.num_rows:
                continue
            got = [_unpack(b, s, "<u8", "<u2", "<u4") for b, s in zip(blobs.column(5).to_pylist(), blobs.column(4).to_pylist(), strict=True)]
            h, doc, df = (np.concatenate([g[j] for g in got]) for j in range(3))
            order = np.lexsort((h, df, doc))
            h, doc = h[order].view(np.int64), doc[order]
            k, rep, n = docs_.column(1).to_numpy(), docs_.column(2).to_pylist(), docs_.column(3).to_numpy().astype(np.int64)
            lo, hi = np.searchsorted(doc, k), np.searchsorted(doc, k, side="right")
            alone = n - (hi - lo)
            # a prefix of shingles that no one shares can't meet a partner
            able = np.flatnonzero((hi > lo) & (n + (-n * share // 100) + 1 > alone))
            for s in range(0, len(able), 500):
                x = able[s : s + 500]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rep[i] for i in x], pa.int64()), pa.array(n[x], pa.int32()), pa.array(alone[x], pa.int32()), *(pa.array([f(h[lo[i] : hi[i]]) for i in x], pa.list_(kind)) for f, kind in ((_histogram, pa.int32()), (np.asarray, pa.int64())))],
                    ["rep", "n", "alone", "hist", "shared"],
                )

    both = carriers.unionByName(answers).repartition(tasks, "chunk").sortWithinPartitions("chunk")
    sets = scratch.write(both.select("chunk", "k", "rep", "n", "size", "blob").mapInArrow(lean(gather), "rep long, n int, alone int, hist array<int>, shared array<long>"))
    scratch.release(counted, reps)
    return rows.select("id", "n", "rep"), sets


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those at the threshold, by their whole sets."""
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").filter(both * 100 >= (F.col("na") + F.col("nb") - both) * percent).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    percent: int = 75,
    words: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    star_rounds: int = 1,
    direct_rows: int = 32,
    block_rows: int = 1_024,
) -> DataFrame:
    """One row per input row: the id, ``n_shingles`` and ``component_id``, the least id reachable by links, itself
    included. Two documents link where 100 * intersection >= ``percent`` * union of their sets of distinct
    ``words``-word shingles (words: runs of other characters than space and 0x09-0x0D, A-Z lower-cased).

    A text with fewer words has one shingle, its whole sequence; null and empty texts have none and link with
    nothing. Rows with a null id get the component of equal documents, else null. Repeated rows of an id are one
    node. An empty table gives an empty result; other columns are left out; a text of any length is taken whole.
    Shingles are compared by 64-bit hashes of 64-bit word hashes, sets by 128 bits. No limit on partners, candidates or
    document frequency: what the star rounds leave unconnected is compared in full, pair by pair for shingles of up to
    ``direct_rows`` classes, and for the others in blocks of ``block_rows`` classes inside tasks.
    """
    scratch, kept = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    rows, sets = shingle_classes(docs, scratch, kept, id_col, text_col, words, percent)
    links = linked(sets, scratch, percent, star_rounds, direct_rows, block_rows)
    found = kept.write(components(links, scratch))
    # the result reads the rows and their components only
    scratch.drop()
    return (
        rows.join(found.withColumnRenamed("id", "rep"), "rep", "left")
        .select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))
    )


def linked(sets: DataFrame, scratch: Scratch, percent: int, star_rounds: int, direct_rows: int, block_rows: int) -> DataFrame:
    """Links (a, b) between classes that connect all that are at the threshold, if not each of their pairs."""
    prefix = F.slice("shared", F.lit(1), F.greatest(F.lit(0), prefix_length(F.col("n"), percent) - F.col("alone")))
    entries = sets.select("rep", "n", "alone", "hist", F.posexplode(prefix).alias("place", "key"))
    entries = scratch.write(entries.select("key", "rep", F.struct("n", (F.col("alone") + F.col("place") + 1).alias("pos"), "hist").alias("e")))
    spark = sets.sparkSession
    tasks = partitions(spark)
    links = spark.createDataFrame([], "a long, b long")
    tested = spark.createDataFrame([], "a long, b long")

    now = entries.withColumn("c", F.col("rep"))
    for k in range(star_rounds):
        open_ = _open_keys(now, F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("o"), "rep", "e", "c")))
        met = now.join(open_, "key").filter("c <> hub.c").withColumns({"o": F.col("hub.e"), "r": F.col("hub.rep")})
        pairs = met.filter(_may_link("e", "o", percent)).select(F.least("rep", "r").alias("a"), F.greatest("rep", "r").alias("b")).distinct()
        pairs = scratch.write(pairs.join(tested, ["a", "b"], "left_anti") if k else pairs)
        links, tested = scratch.write(links.union(_verified(pairs, sets, percent))), tested.union(pairs)
        label = components(links, scratch)
        now = entries.join(label, entries["rep"] == label["id"], "left").withColumn("c", F.coalesce("component", "rep")).drop("id", "component")

    # shingles of few classes: all pairs that the links don't connect, each verified once
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 1):
            rep, c, n, pos = (group.column(j).to_numpy().astype(np.int64) for j in range(1, 5))
            hist = group.column(5).flatten().to_numpy().reshape(len(rep), -1).astype(np.int64)
            x, y = np.triu_indices(len(rep), 1)
            ok = c[x] != c[y]
            x, y = x[ok], y[ok]
            need = -((-(n[x] + n[y]) * percent) // (100 + percent))
            ok = np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent
            ok &= np.minimum(pos[x], pos[y]) + np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need
            ok &= np.minimum(hist[x], hist[y]).sum(1) >= need
            if ok.any():
                a, b = rep[x[ok]], rep[y[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    open_ = scratch.write(_open_keys(now, F.count(F.lit(1))))
    few = now.join(open_.filter(F.col("hub") <= direct_rows), "key").select("key", "rep", "c", "e.n", "e.pos", "e.hist")
    pairs = few.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(lean(pair), "a long, b long").distinct()
    pairs = scratch.write(pairs.join(tested, ["a", "b"], "left_anti"))
    links = scratch.write(links.union(_verified(pairs, sets, percent)))
    # shingles of many classes: clusters of classes that share one hold all pairs that are left
    many = now.join(open_.filter(F.col("hub") > direct_rows).select("key"), "key")
    open_ = scratch.write(many.join(_open_keys(many, F.min("rep")), "key").select("rep", "c", "hub"))
    if open_.isEmpty():
        return links
    clusters = components(open_.select(F.col("rep").alias("a"), F.col("hub").alias("b")), scratch)
    # lengths of neighbouring bands at most can link
    band = F.floor(F.log(F.col("n").cast("double")) / (np.log(100 / percent) + 1e-9)).cast("int") if percent < 100 else F.col("n")
    members = open_.select("rep", "c").distinct().join(clusters, F.col("rep") == F.col("id")).drop("id")
    members = scratch.write(members.join(sets.select("rep", band.alias("band")), "rep"))
    blocks = members.groupBy("component", "band").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    near = blocks.select("component", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), F.col("band").alias("other"), "blocks")
    near = scratch.write(near.groupBy("component", "band").agg(F.map_from_entries(F.collect_list(F.struct("other", "blocks"))).alias("near")))
    members = members.join(near, ["component", "band"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.element_at("near", F.col("band"))).cast("int"))
    # each member goes to the pairs of blocks of its own band and of the bands beside it
    members = members.select("component", "band", "own", "rep", "c", F.explode("near").alias("other_band", "blocks"))
    members = members.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    mine, theirs = F.struct("band", F.col("own").alias("block")), F.struct(F.col("other_band").alias("band"), F.col("other").alias("block"))
    members = members.select("component", F.least(mine, theirs).alias("i"), F.greatest(mine, theirs).alias("j"), mine.alias("at"), "rep", "c")
    members = members.join(sets.withColumn("prefix", F.size(prefix)).select("rep", "n", "prefix", "hist", "shared"), "rep")
    members = members.select("component", F.col("i.band").alias("ib"), F.col("i.block").alias("i"), F.col("j.band").alias("jb"), F.col("j.block").alias("j"), (F.col("at") == F.col("i")).alias("first"), "rep", "c", "n", "prefix", "hist", "shared")
    dealt = members.repartition(tasks, "component", "ib", "i", "jb", "j").sortWithinPartitions("component", "ib", "i", "jb", "j", "rep")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 5):
            if group.num_rows > 1:
                yield from _block_links(group, percent)

    return scratch.write(links.union(dealt.mapInArrow(lean(verify), "a long, b long")))


def _open_keys(entries: DataFrame, hub: Column) -> DataFrame:
    """(key, hub) of the shingles whose classes aren't all connected."""
    keys = entries.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), hub.alias("hub"))
    return keys.filter("c0 <> c1").select("key", "hub")


def _block_links(group: pa.RecordBatch, percent: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links in a block, or between two: pairs stay inside the task.

    Candidates share a prefix shingle, aren't connected yet and pass the length and suffix filters. A class takes them
    by falling number of shared prefix shingles, and leaves out those that it has meanwhile been connected with."""
    ib, i, jb, j = (group.column(k)[0].as_py() for k in range(1, 5))
    first = group.column(5).to_numpy(zero_copy_only=False).astype(bool)
    rep, c, n, m = (group.column(k).to_numpy().astype(np.int64) for k in range(6, 10))
    hist = group.column(10).flatten().to_numpy().reshape(len(rep), -1).astype(np.int64)
    ends = np.cumsum([0, *group.column(11).value_lengths().to_pylist()])
    flat = group.column(11).flatten().to_numpy()
    sets = [np.sort(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    one = (ib, i) == (jb, j)
    rows, cols = (np.arange(len(rep)),) * 2 if one else (np.flatnonzero(first), np.flatnonzero(~first))
    if not len(rows) or not len(cols):
        return
    # prefix shingles that occur on both sides, numbered; then shared counts by products of slices of the 0-1 matrix
    take = lambda side: (np.repeat(np.arange(len(side)), m[side]), np.concatenate([flat[ends[k] : ends[k] + m[k]] for k in side]))
    (ra, ka), (rb, kb) = take(rows), take(cols)
    names = np.intersect1d(ka, kb)
    shared = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, len(names), 4_096):
        part = names[lo : lo + 4_096]
        side = []
        for r, k, size in ((ra, ka, len(rows)), (rb, kb, len(cols))):
            at = np.minimum(np.searchsorted(part, k), len(part) - 1)
            ok = part[at] == k
            x = np.zeros((size, len(part)), np.float32)
            x[r[ok], at[ok]] = 1
            side.append(x)
        shared += side[0] @ side[1].T
    tree = {x: x for x in np.unique(c).tolist()}

    def root(x: int) -> int:
        while tree[x] != x:
            tree[x] = tree[tree[x]]
            x = tree[x]
        return x

    found: list[tuple[int, int]] = []
    for x, a in enumerate(rows.tolist()):
        ok = (shared[x] > 0) & (c[cols] != c[a])
        if one:
            ok[: x + 1] = False
        nb = n[cols]
        need = -((-(n[a] + nb) * percent) // (100 + percent))
        ok &= (np.minimum(n[a], nb) * 100 >= np.maximum(n[a], nb) * percent) & (np.minimum(hist[a], hist[cols]).sum(1) >= need)
        at = np.flatnonzero(ok)
        at = at[np.argsort(-shared[x, at], kind="stable")]
        step = 1
        while len(at):
            mine = root(int(c[a]))
            at = at[[root(y) != mine for y in c[cols[at]].tolist()]]
            now, at = at[:step], at[step:]
            step = min(256, 4 * step)
            if not len(now):
                continue
            others = [sets[k] for k in cols[now].tolist()]
            sizes = np.array([len(o) for o in others])
            both = np.concatenate(others)
            hit = sets[a][np.minimum(np.searchsorted(sets[a], both), len(sets[a]) - 1)] == both
            for b, w in zip(cols[now].tolist(), np.add.reduceat(hit, np.cumsum(sizes) - sizes).tolist(), strict=True):
                if 100 * w >= percent * (n[a] + n[b] - w):
                    found.append((a, b))
                    u, v = root(int(c[a])), root(int(c[b]))
                    tree[max(u, v)] = min(u, v)
    if found:
        a, b = np.array(found).T
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(rep[a], rep[b])), pa.array(np.minimum(rep[a], rep[b]))], ["a", "b"])
