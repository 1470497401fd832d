"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

1. Documents become chunks. A chunk keeps, for each document, the positions of its pre-tokens as indices into the
   chunk's distinct words; chunks are written once, bucketed by chunk, so that joining them doesn't move them again.
2. The distinct words of all chunks are exploded and shuffled by word hash, packed by hash range: a message holds a
   word at least, so there are never more messages than rows (chunk, distinct word). A range has all occurrences of its
   words, and each distinct word is encoded once. Words that are a token themselves need no merge and stay out of the
   shuffle, and with them nearly all hot words.
3. The words' ids are joined back on the chunk, and each document's ids are put together by position.

Decoding joins the ids with the token-byte table on the map side: the table is broadcast, as its size is that of the
vocabulary, which is checked.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchgrid.llm import vocabularies
from pitchgrid.llm.common import Scratch, lean, partitions, rows_of, texts
from pitchgrid.llm.token_counts import pieces

_CHUNK = "chunk long, parts array<struct<ids: array<long>, units_of: array<int>, units: binary>>, words_of binary, words binary, own binary, asks array<struct<p: int, words: binary>>"
#: Bytes of text that are Python objects at one time, and distinct units that a chunk remembers.
_PART, _UNITS = 1 << 20, 400_000


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned numbers below 2 ** 32 by byte planes, as the high bytes of small numbers compress to nothing."""
    return _pack(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_numbers(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpack(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


def pack_words(words: list[bytes]) -> bytes:
    sizes = np.array([len(w) for w in words], "<u4").tobytes()
    return _pack(len(words).to_bytes(4, "little") + sizes + b"".join(words))


def unpack_words(blob: bytes) -> list[bytes]:
    raw = _unpack(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64)) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1]], ends, strict=True)] if n else []


def gather(flat: np.ndarray, ends: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that end at ``ends``, in the order of ``picked``, one after the other; their lengths."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    n = (ends - starts)[picked] if len(ends) else np.zeros(0, np.int64)
    shift = np.repeat(starts[picked] - (np.cumsum(n) - n), n) if len(ends) else np.zeros(0, np.int64)
    return flat[shift + np.arange(len(shift))], n


def _counter() -> defaultdict:
    seen: defaultdict = defaultdict()
    seen.default_factory = seen.__len__
    return seen


class _Chunk:
    """Gathers documents. Units are the texts cut at safe boundaries; only distinct units are cut into pre-tokens."""

    def __init__(self, find):
        self.find = find
        number = itertools.count().__next__
        # units that begin a text, and the others, which have lost the space before them; numbered together
        self.heads, self.rest = defaultdict(number), defaultdict(number)
        self.words, self.parts, self.words_of, self.flat, self.held = _counter(), [], [], [], 0

    @property
    def units(self) -> int:
        return len(self.heads) + len(self.rest)

    def add(self, ids: list, whole: list[str]) -> None:
        heads, rest, known = len(self.heads), len(self.rest), self.units
        seqs: list[int] = []
        units_of = []
        for t in whole:
            cut = pieces(t)
            seqs.append(self.heads[cut[0]])
            seqs.extend(map(self.rest.__getitem__, cut[1:]))
            units_of.append(len(cut))
            self.held += len(t)
        self.parts.append({"ids": ids, "units_of": units_of, "units": pack_numbers(np.array(seqs, np.int64))})
        new: list = [None] * (self.units - known)
        for u, k in itertools.islice(self.heads.items(), heads, None):
            new[k - known] = self.find(u)
        for u, k in itertools.islice(self.rest.items(), rest, None):
            new[k - known] = self.find(" " + u)
        self.words_of.append(np.array([len(c) for c in new], np.int32))
        self.flat.append(np.array([self.words[w] for c in new for w in c], np.int32))

    def row(self, key: int, ranks: dict[bytes, int], n_parts: int) -> list:
        """A row of _CHUNK."""
        coded = [w.encode() for w in self.words]
        own = np.array([ranks.get(w, -1) for w in coded], np.int64)
        # words in an order that the answers come back in: the chunk's own, then those asked for by part
        part = np.array([-1 if o >= 0 else zlib.crc32(w) % n_parts for w, o in zip(coded, own.tolist(), strict=True)], np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        n_own = int((part < 0).sum())
        asks = []
        if len(order) > n_own:
            for run in np.split(order[n_own:], np.flatnonzero(np.diff(part[order][n_own:])) + 1):
                asks.append({"p": int(part[run[0]]), "words": pack_words([coded[k] for k in run.tolist()])})
        flat = np.concatenate(self.flat)
        return [key, self.parts, pack_numbers(np.concatenate(self.words_of)), pack_numbers(place[flat]), pack_numbers(own[order][:n_own]), asks]


_PART_KIND = pa.struct([("ids", pa.list_(pa.int64())), ("units_of", pa.list_(pa.int32())), ("units", pa.binary())])
_CHUNK_KINDS = [pa.int64(), pa.list_(_PART_KIND), *[pa.binary()] * 3, pa.list_(pa.struct([("p", pa.int32()), ("words", pa.binary())]))]
_CHUNK_NAMES = ["chunk", "parts", "words_of", "words", "own", "asks"]


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = 32 << 20,
    tokens: DataFrame | None = None,
) -> DataFrame:
    """One row per input row: the id, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers, binary); with
    ``tokens``, also ``decoded`` as ``decode`` gives it of the ids, in the same pass over them.

    The ids are those of the tiktoken library for the rank file and the pattern, without special tokens: each match
    of the pattern separately. The pattern must let a single space between two other characters start a match, as
    all patterns with `` ?\\p{L}+`` do. Null and empty texts have no ids; a null id stays null; repeated rows each
    give a row; an empty table gives none; other columns are left out. A chunk is full at ``chunk_bytes``
    characters or some 400,000 distinct units; a text of any length is in one chunk whole.
    """
    spark = docs.sparkSession
    scratch, n = Scratch(spark), partitions(spark)
    n_parts = 8 * n
    width = "<u2" if len(vocabularies.ranks(ranks_path)) <= 1 << 16 else "<u4"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, find = vocabularies.ranks(ranks_path), regex.compile(pattern).findall
        keys = itertools.count(TaskContext.get().partitionId() << 32)

        def full(chunk: _Chunk) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(chunk.row(next(keys), ranks, n_parts), _CHUNK_KINDS, strict=True)], _CHUNK_NAMES)

        chunk = _Chunk(find)
        for ids, whole in rows_of(batches, min(_PART, chunk_bytes)):
            chunk.add(ids, whole)
            if chunk.held >= chunk_bytes or chunk.units >= _UNITS:
                yield full(chunk)
                chunk = _Chunk(find)
        if chunk.parts:
            yield full(chunk)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = vocabularies.byte_encoder(ranks_path, pattern)._core_bpe.encode_single_piece
        known: dict[bytes, list[int]] = {}
        at = None
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, p, blob = (c[k].as_py() for c in batch.columns)
                if p != at:
                    # no word of this range is in another
                    known, at = {}, p
                words = unpack_words(blob)
                for w in words:
                    if w not in known:
                        known[w] = piece(w)
                coded = [known[w] for w in words]
                sizes = np.array([len(c) for c in coded], np.int64)
                flat = np.array([i for c in coded for i in c], width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([p], pa.int32()), pa.array([pack_numbers(sizes)]), pa.array([_pack(flat.tobytes())])],
                    ["chunk", "p", "sizes", "flat"],
                )

    lookup = _broadcast_tokens(tokens) if tokens is not None else None

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for part in _assemble({c: batch.column(c)[k].as_py() for c in batch.schema.names}, width, id_col):
                    yield from _with_bytes([part], "ids", "decoded", lookup.value) if lookup else [part]

    chunks = scratch.write_bucketed(texts(docs, id_col, text_col).mapInArrow(lean(cut), _CHUNK), n, "chunk")
    asks = chunks.select("chunk", F.explode("asks").alias("a")).select("chunk", "a.p", "a.words")
    answers = asks.repartition(n, "p").sortWithinPartitions("p").mapInArrow(lean(answer), "chunk long, p int, sizes binary, flat binary")
    answers = answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("p", "sizes", "flat"))).alias("answers"))
    joined = chunks.drop("asks").join(answers.hint("merge"), "chunk", "left")
    return joined.mapInArrow(lean(join), f"{id_col} long, n_tokens long, ids binary" + ", decoded binary" * (lookup is not None))


def _assemble(row: dict, width: str, id_col: str) -> Iterator[pa.RecordBatch]:
    own = unpack_numbers(row["own"])
    answers = row["answers"] or []
    flat = np.concatenate([own, *(np.frombuffer(_unpack(a["flat"]), width).astype(np.int64) for a in answers)]).astype("<u4")
    ends = np.cumsum(np.concatenate([np.ones(len(own), np.int64), *(unpack_numbers(a["sizes"]) for a in answers)]))
    # the ids of each distinct unit, one after the other
    by_unit, n_words = gather(flat, ends, unpack_numbers(row["words"]))
    unit_ends = np.concatenate([[0], np.cumsum(n_words)])[np.cumsum(unpack_numbers(row["words_of"]))]
    for part in row["parts"]:
        coded, n_units = gather(by_unit, unit_ends, unpack_numbers(part["units"]))
        doc_last = np.cumsum(np.array(part["units_of"], np.int64))
        doc_ends = np.concatenate([[0], np.cumsum(n_units)])[doc_last].tolist()
        out, held, at = [], 0, 0
        for i, end in zip(part["ids"], doc_ends, strict=True):
            out.append((i, end - at, coded[at:end].tobytes()))
            held += end - at
            at = end
            if held >= 1 << 19:
                yield _batch(out, id_col)
                out, held = [], 0
        if out:
            yield _batch(out, id_col)


def _batch(out: list[tuple], id_col: str) -> pa.RecordBatch:
    a, b, c = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], [id_col, "n_tokens", "ids"])


def token_table(spark: SparkSession, ranks_path: str) -> DataFrame:
    """The token-byte table of a rank file: ``id`` and ``bytes``, a row per token."""
    return spark.createDataFrame([(r, b) for b, r in vocabularies.ranks(ranks_path).items()], "id int, bytes binary")


def _broadcast_tokens(tokens: DataFrame, max_tokens: int = 1 << 21):
    """The sizes of the tokens by id (-1 where there is none) and their bytes joined, as a broadcast variable."""
    rows = tokens.select(F.col("id").cast("long").alias("id"), "bytes").limit(max_tokens + 1).toArrow()
    if len(rows) > max_tokens:
        raise ValueError(f"more than {max_tokens} tokens: too many to broadcast")
    by_id = dict(zip(rows["id"].to_pylist(), rows["bytes"].to_pylist(), strict=True))
    sizes = np.full(max(by_id, default=-1) + 2, -1, np.int64)
    sizes[list(by_id)] = [len(b) for b in by_id.values()]
    return tokens.sparkSession.sparkContext.broadcast((sizes, b"".join(by_id[i] for i in sorted(by_id))))


def _with_bytes(batches: Iterator[pa.RecordBatch], ids_col: str, out_col: str, table: tuple[np.ndarray, bytes]) -> Iterator[pa.RecordBatch]:
    """The batches with the bytes of each row's ids: the map side of the join."""
    sizes, joined = table
    ends, flat = np.cumsum(np.maximum(sizes, 0)), np.frombuffer(joined, np.uint8)

    def bytes_of(ids: bytes | None) -> bytes | None:
        if ids is None:
            return None
        at = np.minimum(np.frombuffer(ids, "<u4").astype(np.int64), len(sizes) - 1)
        if (sizes[at] < 0).any():
            raise ValueError("an id that the token table lacks")
        return gather(flat, ends, at)[0].tobytes()

    for batch in batches:
        at = batch.schema.get_field_index(ids_col)
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            out = [bytes_of(x) for x in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, out_col])


def decode(encoded: DataFrame, tokens: DataFrame, ids_col: str = "ids", out_col: str = "decoded", max_tokens: int = 1 << 21) -> DataFrame:
    """``encoded`` with ``out_col``, the bytes of its ids, by a map-side join with ``tokens`` (see ``token_table``).

    The table is broadcast, which its size must allow: more than ``max_tokens`` rows raise. Null ids give null, no ids
    empty bytes; an id that the table lacks raises; an empty table gives an empty result; a column that has the name
    ``out_col`` is replaced."""
    encoded = encoded.drop(out_col)
    table = _broadcast_tokens(tokens, max_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _with_bytes(batches, ids_col, out_col, table.value)

    schema = encoded.select("*", F.lit(None).cast("binary").alias(out_col)).schema
    return encoded.mapInArrow(lean(run), schema)
