"""Removal of repeated byte strings by sorted suffixes.

1. Documents become chunks, written once and bucketed, so that later joins on the chunk don't move the texts again.
2. Every window of ``length`` bytes has an anchor, the least hash of the ``gram``-byte strings in it, which depends on
   the window's bytes only. Chunks send their distinct anchors, sorted and packed by hash range; those that occur in
   two documents come back. A window that recurs in another document has such an anchor: nothing is missed. A message
   holds an anchor at least, so there are never more messages than rows (chunk, anchor).
3. Neighbouring windows with one shared anchor travel together to the shard of that anchor, each distinct string of a
   chunk once, with the least and the largest id that have it there. Windows of an anchor with many different strings
   travel alone, to the shard of their own hash. Equal windows so always meet in one shard. Each shard is sorted by
   external induced sorting of suffixes with common-prefix values, see suffix_sort; suffixes whose common prefix
   reaches ``length`` are one string, and the least document of it keeps it. Beyond its memory a shard is on disk.
4. What is less elsewhere returns to the chunk, which finds its strings again and unites the removed runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pitchgrid.llm.common import Scratch, lean, log2_ceil, partitions, rows_of, texts
from pitchgrid.llm.ngram_join import _from_planes, _pack, _planes, _unpack
from pitchgrid.llm.shingles import _bytes_table, _powers, mix
from pitchgrid.llm.suffix_sort import Spool, Store, sorted_places, sorted_suffixes
from pitchgrid.llm.vectors import groups

#: Bits of an anchor by which sharing is decided; a chance match only sends more to the shards.
_KEY_BITS = 48
#: Never in UTF-8.
_GAP = b"\xff"
_SLICE = 1 << 18
_BLOCK = 1 << 16


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchor_runs(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor, hash of the bytes) of each run of neighbouring windows with one anchor.

    ``raw`` holds documents parted by _GAP; windows across a gap don't count. Bounded memory: slices overlap."""
    b = np.frombuffer(raw, np.uint8)
    out = []
    up, down = _powers(1 << max(16, int(_SLICE + length).bit_length()))
    for at in range(0, max(0, len(b) - length + 1), _SLICE):
        part = b[at : at + _SLICE + length - 1]
        total = np.concatenate([[np.uint64(0)], np.cumsum(_bytes_table()[part] * up[: len(part)], dtype=np.uint64)])
        n = len(part) - gram + 1
        h = mix((total[gram:] - total[:n]) * down[:n], 7)
        gaps = np.concatenate([[0], np.cumsum(part == _GAP[0])])
        m = _least(h, length - gram + 1)
        good = gaps[length:] == gaps[: len(m)]
        edge = np.ones(len(m), bool)
        edge[1:] = (m[1:] != m[:-1]) | (good[1:] != good[:-1])
        first = np.flatnonzero(edge)
        size = np.diff(np.concatenate([first, [len(m)]]))
        keep = good[first]
        first, size = first[keep], size[keep]
        content = mix((total[first + size + length - 1] - total[first]) * down[first], 8)
        out.append((first + at, size, m[first], content))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _raw(row: dict) -> tuple[bytes, np.ndarray]:
    """The chunk's documents parted by gaps, and where each begins."""
    raw = zstandard.ZstdDecompressor().decompress(row["blob"])
    starts = np.concatenate([[0], np.cumsum(np.array(row["sizes"], np.int64) + 1)[:-1]])
    return raw, starts


def _window_hashes(raw: bytes, first: np.ndarray, length: int) -> np.ndarray:
    """Hashes of single windows."""
    b = np.frombuffer(raw, np.uint8)
    out = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            out = out * np.uint64(0x2545F4914F6CDD1D) + _bytes_table()[b[first + j]]
    return mix(out, 10)


def _strings(row: dict, raw: bytes, starts: np.ndarray, length: int, gram: int, shards: int) -> Iterator[tuple]:
    """What a chunk has for each shard: (shard, its distinct strings, and of each place that holds one: which string,
    document and start in ``raw``). The same whenever it is called."""
    shared = [_unpack(s["blob"], s["size"], "<u8", "u1") for s in row["shared"] or []]
    if not shared:
        return
    keys, hot = (np.concatenate(x) for x in zip(*shared, strict=True))
    first, size, anchor, _ = anchor_runs(raw, length, gram)
    key = anchor >> np.uint64(64 - _KEY_BITS)
    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    known = np.array([i is not None for i in row["ids"]])
    doc = np.searchsorted(starts, first, side="right") - 1
    hit = (keys[place] == key) & known[doc]
    first, size, anchor, doc, alone = first[hit], size[hit], anchor[hit], doc[hit], hot[place[hit]] > 0
    shard = mix(anchor, 9)
    if alone.any():
        many = size[alone]
        begin = np.repeat(first[alone] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        first, size = np.concatenate([first[~alone], begin]), np.concatenate([size[~alone], np.ones(len(begin), size.dtype)])
        doc, shard = np.concatenate([doc[~alone], np.repeat(doc[alone], many)]), np.concatenate([shard[~alone], _window_hashes(raw, begin, length)])
    shard = (shard % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1)).tolist()
    for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            x = order[a:b]
            seen: dict[bytes, int] = {}
            which = [seen.setdefault(raw[f:e], len(seen)) for f, e in zip(first[x].tolist(), (first[x] + size[x] + length - 1).tolist(), strict=True)]
            yield p, list(seen), np.array(which, np.int64), doc[x], first[x]


def _places_of_segments(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin``, ``count`` of them, one after the other."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Shard:
    """Strings of one shard, each with the least and largest id that have it in the chunk that sent it."""

    def __init__(self, length: int, memory: int):
        self.length, self.memory = length, memory
        share = max(1 << 12, memory // 8)
        self.bytes, self.sizes, self.low, self.high, self.one, self.two = (Spool(k, share) for k in ("u1", "<u4", "<i8", "<i8", "<u8", "<u8"))
        self.sources: list[tuple[int, int]] = []
        self.on_disk = 0

    def add(self, source: int, strings: list[bytes], low: np.ndarray, high: np.ndarray) -> None:
        self.sources.append((source, len(strings)))
        self.bytes.add(np.frombuffer(b"".join(strings), np.uint8))
        self.sizes.add(np.array([len(s) for s in strings], "<u4"))
        self.low.add(low)
        self.high.add(high)
        digests = np.frombuffer(b"".join(hashlib.blake2b(s, digest_size=16).digest() for s in strings), "<u8").reshape(-1, 2)
        self.one.add(digests[:, 0])
        self.two.add(digests[:, 1])

    def less(self) -> Iterator[tuple]:
        """For each call of ``add``: (source, numbers of its strings that a smaller document has as a whole and that
        document's id; numbers of strings, first window, number of windows that are in other strings of documents
        smaller than the string's least)."""
        length, store = self.length, Store(self.memory // 2)
        raw, sizes, low, high, one, two = (x.array() for x in (self.bytes, self.sizes, self.low, self.high, self.one, self.two))
        n = len(sizes)
        ends = store.array(n, np.int64)
        at = 0
        for a in range(0, n, _BLOCK):
            ends[a : a + _BLOCK] = np.cumsum(sizes[a : a + _BLOCK], dtype=np.int64) + at
            at = int(ends[min(n, a + _BLOCK) - 1])
        # equal strings are one class; what chance gives two classes is found by the suffixes all the same
        order = sorted_places(one, store)
        cls, n_classes, last = store.array(n, np.int64), 0, None
        heads = store.array(n, bool)
        for a in range(0, n, _BLOCK):
            x = order[a : a + _BLOCK]
            k = np.stack([one[x], two[x]])
            new = np.ones(len(x), bool)
            new[1:] = (k[:, 1:] != k[:, :-1]).any(0)
            new[0] = last is None or (k[:, 0] != last).any()
            number = np.cumsum(new) + n_classes - 1
            cls[x] = number
            heads[a : a + len(x)] = new
            n_classes, last = int(number[-1]) + 1, k[:, -1]
        least = store.array(n_classes, np.int64)
        least[:] = np.iinfo(np.int64).max
        for a in range(0, n, _BLOCK):
            np.minimum.at(least, cls[a : a + _BLOCK], low[a : a + _BLOCK])
        # the text: a string of each class, and a gap after it
        starts, width = store.array(n_classes + 1, np.int64), store.array(n_classes, np.int64)
        chosen = order[store.where(heads)]
        for a in range(0, n_classes, _BLOCK):
            width[a : a + _BLOCK] = sizes[chosen[a : a + _BLOCK]]
            starts[a + 1 : a + _BLOCK + 1] = np.cumsum(width[a : a + _BLOCK] + 1) + starts[a]
        text = store.array(int(starts[-1]), np.uint8)
        for a in range(0, n_classes, 4_096):
            x = chosen[a : a + 4_096]
            w = width[a : a + 4_096]
            out = np.full(int((w + 1).sum()), _GAP[0], np.uint8)
            out[_places_of_segments(starts[a : a + len(x)] - starts[a], w)] = raw[_places_of_segments(ends[x] - w, w)]
            text[int(starts[a]) : int(starts[a]) + len(out)] = out + np.uint8(2)
        store.done(one, two, order, heads)
        self._flag(text, starts, width, least, store)
        of, window, many = self._segments
        # segments of a class, and back to the strings that were sent
        bounds = np.searchsorted(of, np.arange(n_classes + 1)) if len(of) else None
        at = 0
        for source, m in self.sources:
            c = np.asarray(cls[at : at + m])
            mine = least[c]
            whole = np.flatnonzero(mine < high[at : at + m])
            if bounds is None:
                parts = np.zeros((3, 0), np.int64)
            else:
                which = np.flatnonzero(mine == low[at : at + m])
                count = bounds[c[which] + 1] - bounds[c[which]]
                x = _places_of_segments(bounds[c[which]], count)
                parts = np.stack([np.repeat(which, count), window[x], many[x]])
            at += m
            if len(whole) or parts.shape[1]:
                yield source, whole, mine[whole], parts
        self.on_disk = store.on_disk

    def _flag(self, text: np.ndarray, starts: np.ndarray, width: np.ndarray, least: np.ndarray, store: Store) -> None:
        """Windows of the text that are in a string of a smaller document; as segments of neighbouring ones."""
        length = self.length
        flags = store.array(len(text), bool)

        def settle(pos: np.ndarray, head: np.ndarray) -> None:
            of = np.searchsorted(starts, pos, side="right") - 1
            doc, first = least[of], np.flatnonzero(head)
            small = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(pos))))
            # a run whose strings cross the end of theirs is such a run throughout, as the gap is at one place in all
            flags[pos[(small < doc) & (pos - starts[of] + length <= width[of])]] = True

        # runs of equal strings, completed across blocks
        held, first = np.zeros(0, np.int64), np.zeros(0, bool)
        for pos, lcp in sorted_suffixes(text, length, self.memory // 2, store):
            pos = np.concatenate([held, pos])
            head = np.concatenate([first, lcp < length])
            cut = int(np.flatnonzero(head)[-1]) if head.any() else 0
            if cut:
                head[0] = True
                done = head[:cut].copy()
                # only runs of two or more
                several = ~done
                several[:-1] |= ~done[1:]
                if several.any():
                    settle(pos[:cut][several], done[several])
            held, first = pos[cut:].astype(np.int64), head[cut:]
        if len(held) > 1:
            first[0] = True
            settle(held, first)
        at = store.where(flags)
        of = np.searchsorted(starts, at, side="right") - 1 if len(at) else at
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (of[1:] != of[:-1])
        begin = np.flatnonzero(new)
        self._segments = of[begin], at[begin] - starts[of[begin]], np.diff(np.append(begin, len(at)))


def remove_repeats(
    docs: DataFrame,
    length: int = 50,
    gram: int = 25,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = 3 << 20,
    shard_memory: int = 64 << 20,
    hot_strings: int = 20_000,
    carry: Sequence[str] = (),
    whole_characters: bool = False,
) -> DataFrame:
    """One row per input row: the id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept``
    (binary: the remaining bytes), with the columns named in ``carry`` before them. With ``whole_characters``, ``kept``
    also lacks the bytes that are left of characters cut in part, so that it is text.

    Removed is each UTF-8 byte covered by a ``length``-byte string that also starts in a document with a smaller id;
    strings are judged on the input. Null and empty texts have 0 bytes. A null id neither removes nor loses bytes;
    rows of one id don't count as smaller than each other; an empty table gives an empty result; a text of any
    length is taken whole, and matches never cross documents. Other columns are left out, unless carried. A shard holds
    some ``shard_memory`` bytes and has what exceeds them on the task's disk. An anchor with more than ``hot_strings``
    strings is split over all shards.
    """
    spark = docs.sparkSession
    scratch, tasks = Scratch(spark), partitions(spark)
    bits = min(20, log2_ceil(4 * tasks))
    shards = 8 * tasks
    keep_bits = np.uint64(64 - _KEY_BITS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for k, (ids, whole, extra) in enumerate(rows_of(batches, chunk_bytes)):
            coded = [t.encode() for t in whole]
            blob = zstandard.ZstdCompressor(level=3).compress(_GAP.join(coded))
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(extra_kind), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip([at + k, ids, [len(c) for c in coded], extra, blob], kinds, strict=True)], ["chunk", "ids", "sizes", "extra", "blob"])

    plain = texts(docs, id_col, text_col, F.struct(*carry, F.lit(True).alias("_")).alias("extra"))
    extra_type = plain.schema["extra"].dataType
    extra_kind = to_arrow_type(extra_type)
    # by types: names of carried columns may hold any character
    longs = T.ArrayType(T.LongType())
    chunk_type = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", longs), T.StructField("sizes", longs), T.StructField("extra", T.ArrayType(extra_type)), T.StructField("blob", T.BinaryType())])
    done_type = T.StructType([T.StructField("id", T.LongType()), T.StructField("extra", extra_type), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    chunks = scratch.write_bucketed(plain.mapInArrow(lean(cut), chunk_type), tasks, "chunk")

    def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}

    packed = "p int, chunk long, size int, blob binary"

    def one(p: int, chunk: int, size: int, blob: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([chunk], pa.int64()), pa.array([size], pa.int32()), pa.array([blob], pa.binary())], ["p", "chunk", "size", "blob"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                raw, starts = _raw(row)
                first, _, anchor, content = anchor_runs(raw, length, gram)
                key, doc = anchor >> keep_bits, np.searchsorted(starts, first, side="right")
                order = np.lexsort((content, key))
                key, doc, content = key[order], doc[order], content[order]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                head = np.flatnonzero(new)
                if not len(head):
                    continue
                several = np.maximum.reduceat(doc, head) != np.minimum.reduceat(doc, head)
                other = new.copy()
                other[1:] |= content[1:] != content[:-1]
                count = np.add.reduceat(other.astype(np.int64), head)
                key = key[head]
                cuts = np.searchsorted(key >> np.uint64(_KEY_BITS - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).tolist()
                for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if b > a:
                        yield one(p, row["chunk"], b - a, _pack(key[a:b], several[a:b].astype(np.uint8), count[a:b].astype("<u4")))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 1):
            sizes, p = group.column(2).to_pylist(), group.column(0)[0].as_py()
            got = [_unpack(b, s, "<u8", "u1", "<u4") for b, s in zip(group.column(3).to_pylist(), sizes, strict=True)]
            key, several, count = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.argsort(key, kind="stable")
            runs = np.concatenate([[0], np.flatnonzero(key[order][1:] != key[order][:-1]) + 1])
            n = np.diff(np.concatenate([runs, [len(key)]]))
            shared, hot = np.empty(len(key), bool), np.empty(len(key), bool)
            shared[order] = np.repeat((n > 1) | (np.maximum.reduceat(several[order], runs) > 0), n)
            hot[order] = np.repeat(np.add.reduceat(count[order].astype(np.int64), runs) > hot_strings, n)
            at = 0
            for chunk, size in zip(group.column(1).to_pylist(), sizes, strict=True):
                x = np.flatnonzero(shared[at : at + size]) + at
                at += size
                if len(x):
                    yield one(p, chunk, len(x), _pack(key[x], hot[x].astype(np.uint8)))

    asked = chunks.select("chunk", "sizes", "blob").mapInArrow(lean(ask), packed)
    # written: it is read twice
    shared = scratch.write(asked.repartition(tasks, "p").sortWithinPartitions("p").mapInArrow(lean(share), packed))
    shared = shared.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("p", "size", "blob"))).alias("shared"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                raw, starts = _raw(row)
                ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
                for p, strings, which, doc, _ in _strings(row, raw, starts, length, gram, shards):
                    low, high = np.full(len(strings), np.iinfo(np.int64).max), np.full(len(strings), np.iinfo(np.int64).min)
                    np.minimum.at(low, which, ids[doc])
                    np.maximum.at(high, which, ids[doc])
                    numbers = _planes(np.array([len(s) for s in strings], "<u4")) + _planes(low) + _planes(high)
                    yield one(p, row["chunk"], len(strings), zstandard.ZstdCompressor(level=3).compress(numbers + b"".join(strings)))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results(p: int, shard: Shard) -> Iterator[pa.RecordBatch]:
            for source, whole, ids, parts in shard.less():
                head = np.array([len(whole), parts.shape[1]], "<u4").tobytes()
                blob = head + whole.astype("<u4").tobytes() + ids.astype("<i8").tobytes() + b"".join(x.astype("<u4").tobytes() for x in parts)
                yield one(p, source, len(whole), zstandard.ZstdCompressor(level=1).compress(blob))

        at, shard = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                p, chunk, n, blob = (c[k].as_py() for c in batch.columns)
                if p != at:
                    if shard:
                        yield from results(at, shard)
                    at, shard = p, Shard(length, shard_memory)
                raw = zstandard.ZstdDecompressor().decompress(blob)
                sizes = _from_planes(raw[: 4 * n], "<u4").astype(np.int64)
                low, high = (_from_planes(raw[a : a + 8 * n], "<i8") for a in (4 * n, 12 * n))
                ends = (np.cumsum(sizes) + 20 * n).tolist()
                shard.add(chunk, [raw[a:b] for a, b in zip([20 * n, *ends[:-1]], ends, strict=True)], low, high)
        if shard:
            yield from results(at, shard)

    with_keys = chunks.join(shared.hint("merge"), "chunk").select("chunk", "ids", "sizes", "blob", "shared")
    sent = with_keys.mapInArrow(lean(send), packed)
    runs = scratch.write(sent.repartition(tasks, "p").sortWithinPartitions("p").mapInArrow(lean(sort), packed))
    runs = runs.groupBy("chunk").agg(F.collect_list(F.struct("p", "blob")).alias("runs"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                raw, starts = _raw(row)
                sizes = np.array(row["sizes"], np.int64)
                change = np.zeros(len(raw) + 2, np.int32)
                found = {r["p"]: r["blob"] for r in row["runs"] or []}
                ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
                for p, strings, which, doc, start in _strings(row, raw, starts, length, gram, shards) if found else ():
                    if p in found:
                        for a, n in _removed(zstandard.ZstdDecompressor().decompress(found[p]), strings, which, ids[doc], start, length):
                            np.add.at(change, a, 1)
                            np.add.at(change, a + n, -1)
                gone = np.cumsum(change)[: len(raw) + 1] > 0
                sums, edges = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(np.diff(np.concatenate([[False], gone]).view(np.int8)) == 1)])
                removed, spans = sums[starts + sizes] - sums[starts], edges[starts + sizes] - edges[starts]
                b = np.frombuffer(raw, np.uint8)
                held, rows = 0, []
                for k, (i, a, n) in enumerate(zip(row["ids"], starts.tolist(), sizes.tolist(), strict=True)):
                    kept = b[a : a + n][~gone[a : a + n]].tobytes() if removed[k] else raw[a : a + n]
                    if whole_characters and removed[k]:
                        kept = kept.decode("utf-8", "ignore").encode()
                    rows.append((i, row["extra"][k], n, int(removed[k]), int(spans[k]), kept))
                    held += n
                    if held >= 1 << 21:
                        yield _batch(rows, extra_kind)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, extra_kind)

    joined = chunks.join(shared.hint("merge"), "chunk", "left").join(runs.hint("merge"), "chunk", "left").select("ids", "sizes", "extra", "blob", "shared", "runs")
    done = joined.mapInArrow(lean(unite), done_type)
    return done.select(F.col("id").alias(id_col), *(F.col("extra")[c].alias(c) for c in carry), "n_bytes", "n_removed", "n_spans", "kept")


def _removed(blob: bytes, strings: list[bytes], which: np.ndarray, ids: np.ndarray, start: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, lengths) of what goes of the places that hold ``strings``, by a shard's answer."""
    m, k = np.frombuffer(blob, "<u4", 2).tolist()
    whole, by = np.frombuffer(blob, "<u4", m, 8), np.frombuffer(blob, "<i8", m, 8 + 4 * m)
    of, window, many = np.frombuffer(blob, "<u4", 3 * k, 8 + 12 * m).reshape(3, k).astype(np.int64)
    least = np.full(len(strings), np.iinfo(np.int64).max)
    least[whole] = by
    # documents after the first of a string lose it whole; the first loses what smaller ones have in other strings
    later = ids > least[which]
    size = np.array([len(s) for s in strings], np.int64)
    yield start[later], size[which[later]]
    if k:
        bounds = np.searchsorted(of, np.arange(len(strings) + 1))
        x = np.flatnonzero(~later)
        count = bounds[which[x] + 1] - bounds[which[x]]
        part = _places_of_segments(bounds[which[x]], count)
        yield np.repeat(start[x], count) + window[part], many[part] + length - 1


def _batch(rows: list[tuple], extra_kind: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64(), extra_kind, *[pa.int64()] * 3, pa.binary()]
    names = ["id", "extra", "n_bytes", "n_removed", "n_spans", "kept"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
