"""Token counts: batch encoding in an Arrow function that returns lengths only.

Texts are gathered into batches balanced by bytes. A long text is split at safe boundaries, and so is every other
one: a single space between two characters that aren't white space always starts a new pre-token in byte-level BPE,
so the pieces' lengths add up to the whole text's. Pieces that recur within a batch are encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pitchgrid.llm import vocabularies
from pitchgrid.llm.common import lean, rows_of, texts

#: A text with one of these has a space that isn't a safe boundary.
_UNSAFE = re.compile(r"\s | \s|\A | \Z")
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """The text cut at its safe boundaries; every piece but the first has lost the space before it."""
    return _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")


class _Lengths:
    """Lengths of pieces, encoded in batches of ``batch_bytes``; remembers at most ``keep`` pieces."""

    def __init__(self, path: str, batch_bytes: int, keep: int):
        self.encode = vocabularies.tokenizer(path).encode_batch
        self.batch_bytes, self.keep, self.known = batch_bytes, keep, {}

    def learn(self, cut: list[list[str]]) -> None:
        """Encodes what isn't known of these pieces; forgets the others first where there are many."""
        if len(self.known) > self.keep:
            self.known.clear()
        known, part, held = self.known, [], 0
        for piece in {p for parts in cut for p in parts if p not in known}:
            part.append(piece)
            held += len(piece)
            if held >= self.batch_bytes:
                self._encode(part)
                part, held = [], 0
        self._encode(part)

    def _encode(self, part: list[str]) -> None:
        if part:
            self.known.update(zip(part, map(len, self.encode(part, add_special_tokens=False)), strict=True))


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    batch_bytes: int = 1 << 20,
    keep: int = 400_000,
) -> DataFrame:
    """One row per input row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    ``tokenizer_path``: a byte-level BPE file of the tokenizers library whose pre-tokenizer lets a space lead the
    next word. Counts are those of encoding the whole text without begin or end tokens; special strings in a text
    count as the library's default has it. Null and empty texts have 0 tokens; a null id stays null; repeated rows
    each give a row; an empty table gives none; other columns are left out. A text of any length is encoded whole:
    pieces without a safe boundary go to the library uncut. ``batch_bytes``: how much text one call encodes.
    ``keep``: how many pieces a Python worker remembers between batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _Lengths(tokenizer_path, batch_bytes, keep)
        for ids, whole in rows_of(batches, batch_bytes):
            cut = []
            for t in whole:
                parts = pieces(t)
                # the pieces after the first begin with the space that was cut off
                cut.append([parts[0], *map(" ".__add__, parts[1:])] if len(parts) > 1 else parts)
            lengths.learn(cut)
            known = lengths.known
            n = np.array([sum(map(known.__getitem__, parts)) for parts in cut], np.int64)
            size = np.array([len(t.encode()) for t in whole], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(size), pa.array(n), pa.array(n > limit)],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs, id_col, text_col).mapInArrow(lean(run), f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean")
