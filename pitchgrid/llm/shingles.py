"""Hashed word shingles of many texts at once.

Each distinct word gets 64 bits of BLAKE2b, and a shingle's hash mixes the numbers of its words; a sum over the bytes of
a text modulo 2 ** 64 would give some different words one number whatever its multiplier is."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections import defaultdict

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix finaliser)."""
    x = x + _U((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = _U(pow(int(_MULTIPLIER), -1, 2**64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[_U(1)], np.full(n, _MULTIPLIER)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[_U(1)], np.full(n, inverse)]), dtype=np.uint64)
    return up, down


@functools.lru_cache(1)
def _bytes_table() -> np.ndarray:
    """A random number for each byte; A-Z have those of a-z."""
    t = mix(np.arange(256, dtype=np.uint64), 1)
    t[65:91] = t[97:123]
    return t


def _segments(texts: list[bytes], most: int = 1 << 18) -> list[list[int]]:
    out, held = [[]], 0
    for k, t in enumerate(texts):
        if held and held + len(t) > most:
            out.append([])
            held = 0
        out[-1].append(k)
        held += len(t) + 1
    return out


def doc_shingles(texts: list[str], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of each distinct shingle of ``words`` words, sorted by both.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased: what splitting and lower-casing do to
    bytes. A text with fewer words has one, of its whole sequence; a text without words has none."""
    raw = [t.encode() for t in texts]
    docs, hashes = [], []
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    known = np.zeros(0, np.uint64)
    for seg in _segments(raw):
        if not seg:
            continue
        flat: list[int] = []
        n = np.zeros(len(seg), np.int64)
        for j, k in enumerate(seg):
            split = raw[k].lower().split()
            n[j] = len(split)
            flat.extend(map(number.__getitem__, split))
        new = [hashlib.blake2b(w, digest_size=8).digest() for w in itertools.islice(number, len(known), None)]
        known = np.concatenate([known, np.frombuffer(b"".join(new), "<u8")])
        h = known[np.array(flat, np.int64)]
        doc = np.repeat(np.arange(len(seg)), n)
        with np.errstate(over="ignore"):
            m = len(h) - words + 1
            if m > 0:
                s = np.zeros(m, np.uint64)
                for j in range(words):
                    s = s * _U(0x2545F4914F6CDD1D) + h[j : j + m]
                inside = doc[:m] == doc[words - 1 :]
                docs.append(np.array(seg)[doc[:m][inside]])
                hashes.append(mix(s[inside], 3))
            last = np.cumsum(n)
            for k in np.flatnonzero((n > 0) & (n < words)).tolist():
                s = _U(0)
                for x in h[last[k] - n[k] : last[k]]:
                    s = s * _U(0x2545F4914F6CDD1D) + x
                docs.append(np.array([seg[k]]))
                hashes.append(mix(np.array([s]), 4 + int(n[k])))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, h = np.concatenate(docs).astype(np.int64), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]
