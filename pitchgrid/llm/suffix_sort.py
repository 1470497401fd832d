"""External induced sorting of suffixes with common-prefix values.

All suffixes of a text are sorted from a few seeds, the S* suffixes (smaller than their successor, with a larger
predecessor). Seeds are ranked by names: the pieces of text from seed to seed are sorted and named, and the reduced
string of names is sorted in turn, each round naming pairs of the names before, until names differ or reach the depth
asked for. Then the larger (L) suffixes are induced from left to right and the smaller (S) ones from right to left.
Induction runs on priority queues, one run of suffix tuples (position, common prefix with the tuple before) for each
first byte: tuples enter in the order of the suffix that induces them, so a queue is read as it was written. The common
prefix of two neighbours in a queue is one more than the least on the way between their inducing suffixes.

Nothing of the text's size need be in memory: text, types, names and seeds are arrays of a ``Store``, which maps them
from files beyond its memory, they are sorted by runs and ranges, and queues spill.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

_BLOCK = 1 << 16
#: Pieces of text are eight bytes long at most, so that a number holds one.
_STEP = 7


class Store:
    """Arrays of one sort: in memory up to ``memory`` bytes in all, beyond that mapped from files without a name."""

    def __init__(self, memory: int):
        self.memory = self.left = memory
        self.on_disk = 0

    def array(self, n: int, kind) -> np.ndarray:
        """An array of zeros."""
        size = n * np.dtype(kind).itemsize
        if size <= self.left or not n:
            self.left -= size
            return np.zeros(n, kind)
        self.on_disk += size
        with tempfile.TemporaryFile() as f:
            f.truncate(size)
            return np.memmap(f, kind, "r+", shape=(n,))

    def done(self, *arrays: np.ndarray) -> None:
        """The caller drops these arrays."""
        self.left += sum(x.nbytes for x in arrays if not isinstance(x, np.memmap))

    def where(self, flags: np.ndarray, kind=np.int64) -> np.ndarray:
        """The places of true flags."""
        out = self.array(sum(int(np.count_nonzero(flags[a : a + _BLOCK])) for a in range(0, len(flags), _BLOCK)), kind)
        at = 0
        for a in range(0, len(flags), _BLOCK):
            got = np.flatnonzero(flags[a : a + _BLOCK]) + a
            out[at : at + len(got)] = got
            at += len(got)
        return out


class Spool:
    """Numbers of one kind that are appended and then read as an array of a store."""

    def __init__(self, kind, memory: int):
        self.kind, self.memory, self.held, self.n, self.blocks, self.file = np.dtype(kind), memory, 0, 0, [], None

    def add(self, x: np.ndarray) -> None:
        self.blocks.append(np.ascontiguousarray(x, self.kind))
        self.held += self.blocks[-1].nbytes
        self.n += len(x)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for x in self.blocks:
            self.file.write(x.tobytes())
        self.blocks, self.held = [], 0

    def array(self) -> np.ndarray:
        if not self.file:
            return np.concatenate([np.zeros(0, self.kind), *self.blocks])
        self._spill()
        self.file.flush()
        with self.file as f:
            return np.memmap(f, self.kind, "r+", shape=(self.n,))


def sorted_places(keys: np.ndarray, store: Store) -> np.ndarray:
    """The places of unsigned 64-bit keys in ascending order, stable: runs are sorted, then ranges of keys merged."""
    n, run = len(keys), max(1 << 12, store.memory // 64)
    if n <= run:
        return np.argsort(keys, kind="stable")
    by_run, places = store.array(n, np.uint64), store.array(n, np.int64)
    cuts = list(range(0, n, run))
    probes = []
    for a in cuts:
        part = np.asarray(keys[a : a + run])
        order = np.argsort(part, kind="stable")
        by_run[a : a + run], places[a : a + run] = part[order], order + a
        probes.append(by_run[a : a + run][:: max(1, run // 64)])
    # ranges between probes, and the probes themselves: a key that recurs often has a range of its own
    probe = np.unique(np.sort(np.concatenate(probes))[:: max(1, 32)])
    edges = []
    for a in cuts:
        part = by_run[a : a + run]
        both = np.stack([np.searchsorted(part, probe, "left"), np.searchsorted(part, probe, "right")], 1).ravel()
        edges.append(np.concatenate([[0], both, [len(part)]]) + a)
    out = store.array(n, np.int64)
    at = 0
    for k in range(2 * len(probe) + 1):
        slices = [(int(e[k]), int(e[k + 1])) for e in edges if e[k + 1] > e[k]]
        size = sum(b - a for a, b in slices)
        if k % 2:  # equal keys: runs one after the other are in order
            for a, b in slices:
                out[at : at + b - a] = places[a:b]
                at += b - a
        elif size:
            got = np.concatenate([places[a:b] for a, b in slices])
            out[at : at + size] = got[np.argsort(np.concatenate([by_run[a:b] for a, b in slices]), kind="stable")]
            at += size
    store.done(by_run, places)
    return out


class DiskQueues:
    """A first-in-first-out run of (position, prefix) tuples per key; beyond ``memory`` bytes, runs go to a file."""

    def __init__(self, keys: int, memory: int):
        self.blocks: list[list[tuple]] = [[] for _ in range(keys)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks[key].append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for run in self.blocks:
            for k, block in enumerate(run):
                if len(block) == 2:
                    at = self.file.tell()
                    self.file.write(block[0].tobytes())
                    self.file.write(block[1].tobytes())
                    run[k] = (at, len(block[0]), block[0].dtype)
        self.held = 0

    def _load(self, block: tuple) -> tuple[np.ndarray, np.ndarray]:
        if len(block) == 2:
            return block
        at, n, kind = block
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * kind.itemsize), kind), np.frombuffer(self.file.read(n), np.uint8)

    def take(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of about _BLOCK tuples in order, including those pushed meanwhile; they leave the queue."""
        run = self.blocks[key]
        while run:
            now, self.blocks[key] = run, []
            held, size = [], 0
            for k, block in enumerate(now):
                got = self._load(block)
                now[k] = None
                if len(block) == 2:
                    self.held -= got[0].nbytes + got[1].nbytes
                held.append(got)
                size += len(got[0])
                if size >= _BLOCK:
                    yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    held, size = [], 0
            if held:
                yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            run = self.blocks[key]

    def take_back(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks from the last to the first."""
        run, self.blocks[key] = self.blocks[key], []
        while run:
            block = run.pop()
            got = self._load(block)
            if len(block) == 2:
                self.held -= got[0].nbytes + got[1].nbytes
            yield got

    def close(self) -> None:
        if self.file:
            self.file.close()


class _Induction:
    """Pushes what a scanned run of suffixes induces, with common prefixes by least-on-the-way."""

    def __init__(self, text: np.ndarray, small: np.ndarray, wanted: bool, queues: DiskQueues, cap: int):
        self.text, self.small, self.wanted, self.queues, self.cap = text, small, wanted, queues, cap
        self.pending = np.full(256, 255, np.uint8)
        self.fresh = np.ones(256, bool)

    def scan(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        m = len(pos)
        before = pos - 1
        at = np.flatnonzero((pos > 0) & (self.small[before] == self.wanted))
        low = lcp.min()
        if not len(at):
            np.minimum(self.pending, low, out=self.pending)
            return
        first_byte = self.text[before[at]]
        order = np.argsort(first_byte, kind="stable")
        key, j = first_byte[order], at[order]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        start = np.zeros(len(j), np.int64)
        start[1:] = j[:-1] + 1
        start[head] = 0
        levels = [lcp]
        while 2 << (len(levels) - 1) <= m:
            half = 1 << (len(levels) - 1)
            top = levels[-1].copy()
            np.minimum(top[: m - half], levels[-1][half:], out=top[: m - half])
            levels.append(top)
        table = np.concatenate(levels)

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            k = np.frexp((b - a + 1).astype(np.float64))[1].astype(np.int64) - 1
            return np.minimum(table[k * m + a], table[k * m + b - (1 << k) + 1])

        value = least(start, j)
        heads = key[head]
        value[head] = np.minimum(value[head], self.pending[heads])
        value = np.minimum(value, self.cap - 1) + 1
        value[head] = np.where(self.fresh[heads], 0, value[head])
        np.minimum(self.pending, low, out=self.pending)
        tail = np.ones(len(key), bool)
        tail[:-1] = head[1:]
        last, tails = j[tail], key[tail]
        inner = last < m - 1
        self.pending[tails] = 255
        if inner.any():
            self.pending[tails[inner]] = least(last[inner] + 1, np.full(int(inner.sum()), m - 1))
        self.fresh[heads] = False
        ends = [*np.flatnonzero(head)[1:].tolist(), len(key)]
        begin = 0
        moved, value = before[j], value.astype(np.uint8)
        for k, end in zip(heads.tolist(), ends, strict=True):
            # copies: a slice would keep its whole block in memory
            self.queues.push(k, moved[begin:end].copy(), value[begin:end].copy())
            begin = end


class _Eight:
    """Eight bytes of a text from each position as a big-endian number; beyond the end, zeros."""

    def __init__(self, text: np.ndarray):
        self.n = max(0, len(text) - 7)
        self.words = np.ndarray((self.n,), ">u8", buffer=text, strides=(1,)) if self.n else None
        self.tail = np.concatenate([text[self.n :], np.zeros(16, np.uint8)])

    def at(self, pos: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pos), np.uint64)
        inner = pos < self.n
        if self.n and inner.all():
            return self.words[pos].astype(np.uint64)
        if self.n:
            out[inner] = self.words[pos[inner]]
        rest = np.minimum(pos[~inner] - self.n, 8)
        key = np.zeros(len(rest), np.uint64)
        for j in range(8):
            key = (key << np.uint64(8)) | self.tail[rest + j].astype(np.uint64)
        out[~inner] = key
        return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bytes that two big-endian numbers share."""
    x, n = a ^ b, np.zeros(len(a), np.int64)
    for j in range(8):
        n += (x >> np.uint64(8 * (7 - j))) == 0
    return n


def _types(text: np.ndarray, store: Store) -> np.ndarray:
    """Whether each suffix is smaller than its successor; at the end, a suffix is larger."""
    n = len(text)
    small = store.array(n, bool)
    carry = False
    for b in range(n, 0, -(4 * _BLOCK)):
        a = max(0, b - 4 * _BLOCK)
        part = text[a : min(n, b + 1)].astype(np.int16)
        step = np.sign(np.diff(part))
        if b == n:
            step = np.concatenate([step, [-1]])
        m = len(step)
        # the next place where the byte changes decides, beyond the block what was found there
        nxt = np.where(step != 0, np.arange(m), m)
        nxt = np.minimum.accumulate(nxt[::-1])[::-1]
        small[a:b] = np.concatenate([step > 0, [carry]])[nxt]
        carry = bool(small[a])
    return small


def _ranked_seeds(text: np.ndarray, small: np.ndarray, cap: int, store: Store, kind) -> np.ndarray:
    """The S* positions in the order of their suffixes, to a depth of ``cap`` bytes."""
    n, eight = len(text), _Eight(text)
    flags = store.array(n, bool)
    for a in range(1, n, _BLOCK):
        b = min(n, a + _BLOCK)
        flags[a:b] = small[a:b] & ~small[a - 1 : b - 1]
    stars = store.where(flags, kind)
    if not len(stars):
        return stars
    # samples: the seeds, and every seventh place between distant ones; a piece goes from a sample through the next one
    extra = lambda a: (np.append(stars[a + 1 : a + _BLOCK + 1], n if a + _BLOCK >= len(stars) else [])[: len(stars[a : a + _BLOCK])] - stars[a : a + _BLOCK] - 1) // _STEP
    total = sum(int(extra(a).sum()) + len(stars[a : a + _BLOCK]) for a in range(0, len(stars), _BLOCK))
    samples, is_star = store.array(total, kind), store.array(total, bool)
    at = 0
    for a in range(0, len(stars), _BLOCK):
        part, many = stars[a : a + _BLOCK], extra(a).astype(np.int64) + 1
        first = np.cumsum(many) - many
        inner = np.arange(int(many.sum())) - np.repeat(first, many)
        samples[at : at + len(inner)] = np.repeat(part, many) + inner * _STEP
        is_star[at : at + len(inner)] = inner == 0
        at += len(inner)
    keys = store.array(total, np.uint64)
    for a in range(0, total, _BLOCK):
        pos = np.asarray(samples[a : a + _BLOCK]).astype(np.int64)
        after = np.append(samples[a + 1 : a + _BLOCK + 1], np.full(int(a + _BLOCK >= total), n + 8)).astype(np.int64)
        # beyond the next sample nothing counts: there, a piece that ends is larger than one that goes on
        size = np.minimum(8, after - pos + 1)
        fill = np.where(size < 8, np.uint64(2**64 - 1) >> (8 * np.minimum(size, 7)).astype(np.uint64), np.uint64(0))
        keys[a : a + _BLOCK] = eight.at(pos) | fill
    order = sorted_places(keys, store)
    # names: the first rank of equal pieces
    names, tied = store.array(total, np.uint32), store.array(total, bool)
    _name(lambda a, b: keys[order[a:b]], lambda a, b: order[a:b], total, lambda a, b: np.arange(a, b), names, tied)
    store.done(keys)
    reach = 1
    while 2 * reach < cap:
        places = store.where(tied)
        m = len(places)
        if not m:
            break
        pairs, who = store.array(m, np.uint64), store.array(m, np.int64)
        for a in range(0, m, _BLOCK):
            idx = order[places[a : a + _BLOCK]]
            then = idx + reach
            second = np.where(then < total, names[np.minimum(then, total - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
            pairs[a : a + _BLOCK] = (names[idx].astype(np.uint64) << np.uint64(32)) | second
            who[a : a + _BLOCK] = idx
        again = sorted_places(pairs, store)
        for a in range(0, m, _BLOCK):
            order[places[a : a + _BLOCK]] = who[again[a : a + _BLOCK]]
        _name(lambda a, b, p=pairs, g=again: p[g[a:b]], lambda a, b, w=who, g=again: w[g[a:b]], m, lambda a, b, q=places: q[a:b], names, tied)
        store.done(places, pairs, who, again)
        reach *= 2
    out = store.array(len(stars), kind)
    at = 0
    for a in range(0, total, _BLOCK):
        idx = order[a : a + _BLOCK]
        got = samples[idx[is_star[idx]]]
        out[at : at + len(got)] = got
        at += len(got)
    store.done(flags, stars, samples, is_star, names, tied)
    return out


def _name(key, who, n: int, rank, names: np.ndarray, tied: np.ndarray) -> None:
    """Names of items in the order of their keys: the rank of the first equal one. Items and ranks are read by ranges."""
    last, name = None, 0
    for a in range(0, n, _BLOCK):
        b = min(n, a + _BLOCK)
        ahead = key(a, min(n, b + 1))
        now = ahead[: b - a]
        new = np.ones(b - a, bool)
        new[1:] = now[1:] != now[:-1]
        new[0] = last is None or now[0] != last
        ranks = np.asarray(rank(a, b))
        own = np.where(new, ranks, -1)
        own[0] = ranks[0] if new[0] else name
        own = np.maximum.accumulate(own)
        names[who(a, b)] = own
        follows = np.zeros(b - a, bool)
        follows[: len(ahead) - 1] = ahead[1:] == ahead[: len(ahead) - 1]
        tied[ranks] = ~new | follows
        last, name = now[-1], own[-1]


def _run(text: np.ndarray, at: int, cap: int) -> int:
    part = text[at : at + cap]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def _prefixes(eight: _Eight, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffix pairs, at most ``cap``."""
    out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    for depth in range(0, cap, 8):
        same = _common(eight.at(a[open_] + depth), eight.at(b[open_] + depth))
        out[open_] += same
        open_ = open_[same == 8]
        if not len(open_):
            break
    return np.minimum(out, cap)


def sorted_suffixes(text: np.ndarray, cap: int, memory: int = 256 << 20, store: Store | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (position, common prefix with the suffix before it, at most ``cap``), from the largest suffix down.

    ``text``: bytes from 1 to 254 (0 stands for the end), which may be a memory map; ``cap`` is 254 at most. Suffixes that
    agree in ``cap`` bytes come in an arbitrary order. Arrays and queues hold some ``memory`` bytes and have the rest on
    disk."""
    n = len(text)
    if not n:
        return
    store = store or Store(memory // 2)
    kind = np.int32 if n < 1 << 31 else np.int64
    small = _types(text, store)
    seeds = _ranked_seeds(text, small, cap, store, kind)
    eight = _Eight(text)
    firsts = np.zeros(256, np.int64)
    for a in range(0, len(seeds), _BLOCK):
        firsts += np.bincount(text[seeds[a : a + _BLOCK]], minlength=256)
    starts = np.concatenate([[0], np.cumsum(firsts)]).tolist()
    queue, larger = DiskQueues(256, memory // 4), DiskQueues(256, memory // 4)
    up = _Induction(text, small, False, queue, cap)
    queue.push(int(text[n - 1]), np.array([n - 1], kind), np.zeros(1, np.uint8))
    up.fresh[text[n - 1]] = False
    for c in range(256):
        last = None
        for pos, lcp in queue.take(c):
            lcp = lcp.copy()
            if last is None:
                lcp[0] = 0
            larger.push(c, pos, lcp)
            up.scan(pos, lcp)
            last = int(pos[-1])
        for a in range(starts[c], starts[c + 1], _BLOCK):
            b = min(a + _BLOCK, starts[c + 1])
            pos = np.asarray(seeds[a:b])
            lcp = np.zeros(b - a, np.uint8)
            before = a if a == starts[c] else a - 1
            wide = np.asarray(seeds[before:b]).astype(np.int64)
            lcp[b - a - len(wide) + 1 :] = _prefixes(eight, wide[1:], wide[:-1], cap)
            if a == starts[c]:
                lcp[0] = 0 if last is None else min(_run(text, last, cap), _run(text, int(pos[0]), cap))
            up.scan(pos, lcp)
    store.done(seeds)
    del seeds
    queue.close()
    queue = DiskQueues(256, memory // 4)
    down = _Induction(text, small, True, queue, cap)
    for c in range(255, -1, -1):
        last = None
        for pos, lcp in queue.take(c):
            lcp = lcp.copy()
            if last is None:
                lcp[0] = 0
            down.scan(pos, lcp)
            yield pos, lcp
            last = int(pos[-1])
        after = 0
        for pos, lcp in larger.take_back(c):
            pos, ahead = pos[::-1], int(lcp[0])
            # each one's prefix with the next larger suffix
            lcp = np.concatenate([[np.uint8(after)], lcp[1:][::-1]]).astype(np.uint8)
            if last is not None:
                lcp[0] = min(_run(text, last, cap), _run(text, int(pos[0]), cap))
                last = None
            down.scan(pos, lcp)
            yield pos, lcp
            after = ahead
    queue.close()
    larger.close()
    store.done(small)
