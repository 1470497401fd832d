"""Token ids as compressed binary files with a shared zstandard dictionary.

File format (one Parquet data set, so that writes commit whole and a lost task is simply run again): each row is a
block of neighbouring documents, ``shard`` and ``block`` in ascending document order, with

* ``payload``: the documents' zstandard frames one after the other, each compressed on its own;
* the offset index: ``doc_ids``, ``offsets`` (of each frame in the payload, and its end) and ``n_tokens`` by document;
* ``first`` (ids of the shard before this block), ``tokens`` (ids of the block), ``width`` (bytes of an id,
  little-endian) and ``dict_sha256`` of the dictionary, which is stored beside the blocks under that hash.

Reading one short document takes the index columns, one slice of one payload and the dictionary.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchgrid.llm import vocabularies
from pitchgrid.llm.common import Scratch, lean, partitions, rows_of, texts

_BLOCKS = "shard int, block int, dict_sha256 string, width int, first long, tokens long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"
#: What Python splits at and the tokenizer doesn't take for white space.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_WORDS = re.compile(r"(?:[^\s]|[\x1c-\x1f])+")
#: What the tokenizer's pre-tokenizer takes for a part of a lower-cased ASCII word.
_ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class _WordIds:
    """Serialized ids of words, each encoded once while it is remembered.

    Words are remembered in two generations: when the young one has ``keep`` words it becomes the old one, so words
    that recur stay. New words go to the library joined by spaces, which its pre-tokenizer drops; an id that ends a
    pre-token is known from the vocabulary, so counting a word's pre-tokens tells its ids apart. Words whose
    pre-tokens can't be counted for sure are encoded alone.
    """

    def __init__(self, path: str, keep: int):
        self.library, self.kind, self.keep = vocabularies.tokenizer(path), id_type(path), keep
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def of(self, docs: list[list[str]]) -> list[bytes]:
        young, old = self.young, self.old
        new = []
        for w in {w for words in docs for w in words}:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    new.append(w)
        self._learn(new)
        found = young.__getitem__
        out = [b"".join(map(found, words)) for words in docs]
        if len(young) > self.keep:
            self.young, self.old = {}, young
        return out

    def _learn(self, new: list[str]) -> None:
        joined, counts, alone = [], [], []
        for w in new:
            if w.isalpha() and w.lower().isalpha():
                joined.append(w)
                counts.append(1)
            elif w.isascii() and "<|" not in w:
                joined.append(w)
                counts.append(len(_ASCII_PARTS.findall(w.lower())))
            else:
                alone.append(w)
        for k in range(0, len(joined), 20_000):
            words, n = joined[k : k + 20_000], np.array(counts[k : k + 20_000], np.int64)
            texts_ = [" ".join(words[j : j + 50]) for j in range(0, len(words), 50)]
            ids = np.array([*chain.from_iterable(e.ids for e in self.library.encode_batch_fast(texts_, add_special_tokens=False))], self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != n.sum() or not n.all():
                alone += words
                continue
            width, raw = ids.itemsize, ids.tobytes()
            at = [0, *(stops[np.cumsum(n) - 1] * width).tolist()]
            self.young.update((w, raw[a:b]) for w, a, b in zip(words, at[:-1], at[1:], strict=True))
        for k in range(0, len(alone), 20_000):
            words = alone[k : k + 20_000]
            coded = self.library.encode_batch(words, add_special_tokens=False)
            self.young.update((w, np.array(e.ids, self.kind).tobytes()) for w, e in zip(words, coded, strict=True))


#: One per worker process and file, so that tasks after the first find words known.
_KNOWN: dict[str, _WordIds] = {}


def _word_ids(path: str, keep: int) -> _WordIds:
    if path not in _KNOWN:
        _KNOWN[path] = _WordIds(path, keep)
    return _KNOWN[path]


def encode_ids(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = 4 << 20,
    keep: int = 500_000,
) -> DataFrame:
    """One row per input row: ``id``, ``n_tokens`` and ``ids``, a zstandard frame of little-endian ids.

    For tokenizers whose normaliser and pre-tokenizer drop white space and act within words, and whose words end in
    ``</w>``: each distinct word is encoded once while a worker remembers it (``keep``, see _WordIds). ``end_id`` is
    appended to every document. Null and empty texts have no other id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pitchgrid.llm.token_files import _word_ids  # the worker's own, not a pickled copy

        kind = np.dtype(id_type(tokenizer_path))
        words_of = _word_ids(tokenizer_path, keep)
        pack = zstandard.ZstdCompressor(level=3)
        end = b"" if end_id is None else np.array([end_id], kind).tobytes()
        for ids, whole in rows_of(batches, batch_bytes):
            coded = [c + end for c in words_of.of([_WORDS.findall(t) if _NOT_SPACE.search(t) else t.split() for t in whole])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(c) // kind.itemsize for c in coded], pa.int64()),
                    pa.array([pack.compress(c) for c in coded], pa.binary()),
                ],
                ["id", "n_tokens", "ids"],
            )

    return texts(docs, id_col, text_col).mapInArrow(lean(run), "id long, n_tokens long, ids binary")


def id_type(tokenizer_path: str) -> str:
    return "<u2" if vocabularies.tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def train_dictionary(encoded: DataFrame, dict_bytes: int = 64 << 10, samples: int = 2_000, sample_tokens: int = 2_048) -> bytes:
    """A zstandard dictionary from at most ``samples`` serialized id arrays of at most ``sample_tokens`` ids.

    The samples are those with the least hashes of their id, so reruns agree and the driver holds a bounded
    number of bytes. Empty where there is too little to train on; frames are then compressed without one.
    """
    fit = encoded.filter((F.col("n_tokens") > 0) & (F.col("n_tokens") <= sample_tokens)).withColumn("h", F.xxhash64("id"))
    # the hashes first: tasks send numbers, not ids, until the cut is known
    last = fit.select("h").orderBy("h").limit(samples).agg(F.max("h").alias("h")).first()["h"]
    if last is None:
        return b""
    rows = fit.filter(F.col("h") <= last).select("h", "ids").orderBy("h", "ids").limit(samples).collect()
    unpack = zstandard.ZstdDecompressor()
    data = [unpack.decompress(bytes(r["ids"])) for r in rows]
    size = min(dict_bytes, sum(map(len, data)) // 8)
    try:
        return zstandard.train_dictionary(size, data).as_bytes() if size >= 256 and len(data) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_files(encoded: DataFrame, path: str, width: int, dictionary: bytes, block_bytes: int = 4 << 20, n_shards: int | None = None, level: int = 6) -> None:
    """Writes ``encoded`` (see ``encode_ids``) to ``path`` in ascending id order, ties by content, null ids first."""
    spark = encoded.sparkSession
    digest = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=level, dict_data=shared)
        unpack = zstandard.ZstdDecompressor()
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        sizes: list[int] = []
        offsets, payload = [0], []

        def flush() -> pa.RecordBatch:
            row = [[shard], [block], [digest], [width], [first], [sum(sizes)], [ids], [sizes], [offsets], [b"".join(payload)]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in _BLOCKS.split(", ")])

        for batch in batches:
            for i, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload.append(pack.compress(unpack.decompress(frame)))
                ids.append(i)
                sizes.append(n)
                offsets.append(offsets[-1] + len(payload[-1]))
                if offsets[-1] >= block_bytes:
                    yield flush()
                    block, first = block + 1, first + sum(sizes)
                    ids, sizes, offsets, payload = [], [], [0], []
        if ids:
            yield flush()

    n = n_shards or partitions(spark)
    placed = encoded.select("id", "n_tokens", "ids", F.xxhash64("ids").alias("tie")).repartitionByRange(n, "id", "tie")
    blocks = placed.sortWithinPartitions("id", "tie", "ids").select("id", "n_tokens", "ids").mapInArrow(lean(run), _BLOCKS)
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_sha256 string, dictionary binary").write.parquet(f"{path}/dictionaries")


def _dictionary(spark: SparkSession, path: str) -> dict[str, bytes]:
    return {r["dict_sha256"]: bytes(r["dictionary"]) for r in spark.read.parquet(f"{path}/dictionaries").collect()}


def _frames(batches: Iterator[pa.RecordBatch], stored: dict[str, bytes]) -> Iterator[tuple[dict, int, np.ndarray]]:
    """(block, number in the block, ids) of every document."""
    readers: dict[str, zstandard.ZstdDecompressor] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            digest = row["dict_sha256"]
            if digest not in readers:
                raw = stored[digest]
                if hashlib.sha256(raw).hexdigest() != digest:
                    raise ValueError(f"dictionary {digest} is damaged")
                readers[digest] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
            body, at = memoryview(row["payload"]), row["offsets"]
            for j in range(len(row["doc_ids"])):
                yield row, j, np.frombuffer(readers[digest].decompress(body[at[j] : at[j + 1]]), f"<u{row['width']}")


def read_files(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per document of the files: the id, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids_crc32`` (of the ids as unsigned 32-bit integers) and, if asked for, ``ids`` array<int>."""
    stored = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    # one row per shard, so as many as files: their running sum is a small window
    totals = blocks.groupBy("shard").agg(F.sum("tokens").alias("in_shard"))
    before = totals.select(
        "shard",
        F.coalesce(F.sum("in_shard").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        start, held = 0, 0
        for row, j, ids in _frames(batches, stored):
            start = row["shard_start"] + row["first"] if j == 0 else start
            out.append((row["doc_ids"][j], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids if with_ids else None))
            start += len(ids)
            held += len(ids) * with_ids
            if len(out) >= 10_000 or held >= 1 << 21:
                yield _rows(out, id_col, with_ids)
                out, held = [], 0
        if out:
            yield _rows(out, id_col, with_ids)

    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.join(F.broadcast(before), "shard").mapInArrow(lean(run), schema)


def _rows(out: list[tuple], id_col: str, with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + ([pa.array(cols[4], pa.list_(pa.int32()))] if with_ids else [])
    return pa.RecordBatch.from_arrays(arrays, [id_col, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)


def lookup(spark: SparkSession, path: str, wanted: list[int]) -> dict[int, list[list[int]]]:
    """The ids of a few documents: only blocks whose index names them are read, and only their frames unpacked."""
    stored = _dictionary(spark, path)
    found: dict[int, list[list[int]]] = {}
    blocks = spark.read.parquet(f"{path}/blocks").filter(F.arrays_overlap("doc_ids", F.array(*map(F.lit, wanted)).cast("array<long>")))
    for r in blocks.toLocalIterator():
        raw = stored[r["dict_sha256"]]
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        for j, doc in enumerate(r["doc_ids"]):
            if doc in wanted:
                frame = bytes(r["payload"][r["offsets"][j] : r["offsets"][j + 1]])
                found.setdefault(doc, []).append(np.frombuffer(unpack.decompress(frame), f"<u{r['width']}").tolist())
    return found


def store_and_read(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes, writes the files into the shared scratch folder and reads them back (see ``read_files``).

    Nulls: a null text is empty, so holds the end id only; a null id sorts first and stays null. Repeated rows are
    separate documents, in the order of their content. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    encoded = scratch.write(encode_ids(docs, tokenizer_path, end_id, id_col, text_col))
    path = f"{scratch.path}/files"
    write_files(encoded, path, int(id_type(tokenizer_path)[-1]), train_dictionary(encoded))
    return read_files(docs.sparkSession, path, id_col, with_ids)
