"""Near-duplicates, repeated bytes, components and suffix sorting against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitchgrid.llm import components, itq_dedup, ngram_join, shingles, suffix_dedup, suffix_sort
from pitchgrid.llm.common import Scratch

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4)))
    base = [[word() for _ in range(rng.randint(8, 120))] for _ in range(12)]
    passage = [word() for _ in range(60)]
    out = [None, "", " \n ", "one two", "One TWO", "a b c d e", "ñ" * 60, "x y " * 200, "z" * 400, "tail " + "z" * 300]
    for k in range(70):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(len(words))] = word()
        if k % 7 == 0:
            words[3:3] = passage
        out.append(rng.choice([" ", "  ", "\n"]).join(words))
    out += ["exact copy of one text that has more than fifty bytes in it"] * 30
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3, t, k % 2, "c") for k, t in enumerate(corpus())] + [(None, "exact copy of one text that has more than fifty bytes in it", 0, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, rep string").repartition(5)


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def sets_of(texts):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(_LOWER))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("rounds", "direct", "block"), [(0, 3, 4), (1, 32, 1024), (2, 2, 20), (0, 1000, 7)])
def test_ngram_join(docs, rounds, direct, block):
    sets = sets_of({k * 3: t for k, t in enumerate(corpus())})
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    got = ngram_join.near_duplicates(docs, star_rounds=rounds, direct_rows=direct, block_rows=block).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
        else:
            assert r["component_id"] == min(i for i in sets if sets[i] == sets[max(sets)])
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_different_words_that_sums_modulo_a_power_of_two_confuse(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, word, "x"), (2, word.translate(str.maketrans("ab", "ba")), "x"), (3, long, "x"), (4, long.replace("w7 ", "w8 ", 1), "x"), (5, long[: len(long) // 2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got[1] == (1, 1) and got[2] == (1, 2) and got[3] == (59_996, 3) and got[4][1] == 3 and got[5][1] == 5


def test_a_large_group_around_the_threshold(spark):
    """Near copies of one text at similarities on both sides of the threshold, under very common shingles."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(60)]
    texts = {}
    for k in range(160):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"own{k}x{rng.random()}"
        texts[k] = " ".join(words[: rng.choice([60, 60, 50, 40])])
    sets = sets_of(texts)
    want = roots(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (1024, 9):
        assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs, direct_rows=4, block_rows=block).collect()} == want


@pytest.mark.parametrize("hot", [20_000, 1])
def test_remove_repeats(docs, hot):
    texts = {k * 3: (t or "").encode() for k, t in enumerate(corpus())}
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            first.setdefault(texts[i][k : k + 50], i)
    got = suffix_dedup.remove_repeats(docs, chunk_bytes=2000, shard_memory=2000, hot_strings=hot, carry=["n"]).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
            continue
        b = texts[r["doc_id"]]
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < r["doc_id"]:
                gone[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["n"]) == (len(b), int(gone.sum()), spans, r["doc_id"] // 3 % 2)
        assert bytes(r["kept"]) == bytes(x for x, g in zip(b, gone, strict=False) if not g)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=90), st.integers(1, 60), st.sampled_from([64, 1 << 20]), st.integers(1, 3), st.sampled_from([3, 64, 1 << 16]))
def test_sorted_suffixes(values, cap, memory, times, block):
    text = np.array(values * times, np.uint8)
    raw = text.tobytes()
    real, suffix_sort._BLOCK = suffix_sort._BLOCK, block
    try:
        got = [(int(p), int(c)) for pos, lcp in suffix_sort.sorted_suffixes(text, cap, memory) for p, c in zip(pos, lcp, strict=True)]
    finally:
        suffix_sort._BLOCK = real
    assert sorted(p for p, _ in got) == list(range(len(raw)))
    for (p, _), (q, c) in zip(got[:-1], got[1:], strict=True):
        a, b = raw[p : p + cap], raw[q : q + cap]
        assert a >= b
        assert c == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_keys_sorted_by_runs_on_disk():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 50_000, 300_000).astype(np.uint64)
    keys[::3] = 7
    store = suffix_sort.Store(1 << 18)
    assert (suffix_sort.sorted_places(keys, store) == np.argsort(keys, kind="stable")).all() and store.on_disk > 0


def test_a_shard_far_larger_than_its_memory():
    """Ten times the memory and more: arrays go to disk, and what is removed is what brute force removes."""
    rng = random.Random(3)
    phrase = bytes(rng.randrange(97, 123) for _ in range(25))
    memory = 80_000
    strings, ids = [], []
    for k in range(14_000):
        own = bytes(rng.randrange(97, 123) for _ in range(40))
        strings.append(own[:25] + phrase + own[25:] if k % 7 else strings[rng.randrange(len(strings))][rng.choice([0, 8]) :] if strings else own + phrase)
        ids.append(rng.randrange(5_000))
    first = {}
    for s, i in zip(strings, ids, strict=True):
        for p in range(len(s) - 49):
            first[s[p : p + 50]] = min(i, first.get(s[p : p + 50], i))
    shard, sent = suffix_dedup.Shard(50, memory), []
    for a in range(0, len(strings), 700):
        seen = {}
        for s, i in zip(strings[a : a + 700], ids[a : a + 700], strict=True):
            low, high = seen.get(s, (i, i))
            seen[s] = min(low, i), max(high, i)
        sent.append(list(seen))
        shard.add(a, list(seen), np.array([x[0] for x in seen.values()]), np.array([x[1] for x in seen.values()]))
    assert sum(map(len, strings)) > 10 * memory
    tracemalloc.start()
    got = {source: (whole, by, parts) for source, whole, by, parts in shard.less()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert shard.on_disk > 10 * memory and peak < 12_000_000
    for a, own in zip(range(0, len(strings), 700), sent, strict=True):
        whole, by, parts = got.get(a, (np.zeros(0, int), np.zeros(0, int), np.zeros((3, 0), int)))
        less, windows = dict(zip(whole.tolist(), by.tolist(), strict=True)), {}
        for j, p, n in parts.T.tolist():
            windows.setdefault(j, set()).update(range(p, p + n))
        place = {s: j for j, s in enumerate(own)}
        for s, i in zip(strings[a : a + 700], ids[a : a + 700], strict=True):
            want = {p for p in range(len(s) - 49) if first[s[p : p + 50]] < i}
            j = place[s]
            mine = set(range(len(s) - 49)) if less.get(j, i) < i else windows.get(j, set())
            assert mine == want


def test_shingles_ignore_case_and_space():
    doc, h = shingles.doc_shingles(["A b c d e", "a  B\nC d E", "a b c d f", "", "a b", "a b c d e a b c d e"])
    by = {k: set(h[doc == k].tolist()) for k in range(6)}
    assert by[0] == by[1] and not by[0] & by[2] and not by[3] and len(by[4]) == 1 and len(by[5]) == 5


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(1, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)] + [(500, 501), (501, 500), (7, 7)] + [(900, 900 + k) for k in range(1, 80)]
    edges = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    want = roots({x for e in links for x in e}, links)
    got = {r["id"]: r["component"] for r in components.components(edges, Scratch(spark)).collect()}
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in links)}
    assert components.components(edges.limit(0), Scratch(spark)).count() == 0


def test_itq(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x[200:260] = x[7] + rng.normal(size=(60, 16)) * 0.12
    x[260:280] = x[9]
    x[280:290] *= 0
    rows = [(int(k), [float(v) for v in r], "x") for k, r in enumerate(x)]
    rows += [(900, None, "x"), (901, [], "x"), (902, [float("nan")] * 16, "x"), (903, [None, *[1.0] * 15], "x"), (904, [float("inf")] * 16, "x"), (None, [float(v) for v in x[9]], "x")]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, links string")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = roots(range(300), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    for direct, block in ((32, 1024), (4, 16), (1000, 1024)):
        got = {r["vec_id"]: r for r in itq_dedup.near_duplicates(e, direct_rows=direct, block_rows=block).collect()}
        assert len(got) == len(rows)
        for k in range(300):
            assert (got[k]["n_links"], got[k]["component_id"]) == (int(near[k].sum()), want[k])
        assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(900, 905)) and got[None]["component_id"] is None
    assert itq_dedup.near_duplicates(e.limit(0)).count() == 0


def test_itq_on_vectors_off_the_origin():
    """Recall measured against brute force, and no crowded bucket, also where all vectors share a direction."""
    rng = np.random.default_rng(7)
    for shift in (0.0, 1.0, 3.0):
        x = rng.normal(size=(4_000, 32))
        x[2_000:] = x[:2_000] + rng.normal(size=(2_000, 32)) * rng.uniform(0.1, 0.5, (2_000, 1))
        x += shift
        codes, radius, measured = itq_dedup.fit(x[:1500], 4_000, 0.95, 0.99, 24, 1)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
        some = rng.permutation(len(a))[:20_000]
        apart = itq_dedup.differing(codes.substrings(x[a[some]]), codes.substrings(x[b[some]]))
        found = ((apart <= 1).any(1) & (apart.sum(1) <= radius)).mean()
        assert found >= 0.98 and measured >= 0.98
        sizes = np.unique(codes.substrings(x)[:, 0], return_counts=True)[1]
        assert sizes.max() <= 0.25 * len(x)
        assert abs(codes.bits_of(x).mean() - 0.5) < 0.05


def test_itq_at_the_threshold(spark):
    """Pairs whose cosine is the threshold to the last digits: one formula decides, in pairs and in blocks alike."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 16))
    pair = np.vstack([x, x + rng.normal(size=x.shape) * 0.25])
    cos = itq_dedup.cosines(pair[:60], pair[60:])
    e = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(pair)], "vec_id long, embedding array<double>")
    at = float(np.sort(cos)[30])
    for threshold in (at, float(np.nextafter(at, 2))):
        want = int((cos >= threshold).sum())
        for direct in (0, 32):
            got = itq_dedup.near_duplicates(e, threshold=threshold, direct_rows=direct, block_rows=13).collect()
            assert sum(r["n_links"] for r in got) == 2 * want
    assert not any((itq_dedup.cosines(pair[:60], pair[60:]) >= t).sum() != (itq_dedup.cosines(pair[60:], pair[:60]) >= t).sum() for t in cos)
