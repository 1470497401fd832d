"""Mixing, search, toxicity, HTML extraction and the pipeline."""

import html.parser
import math
import re
import time

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from pitchgrid.llm import hilbert_search, html_text, mixing, queries, suffix_dedup, toxicity
from pitchgrid.llm.common import table


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [1 + k % 3 for k in range(len(sizes))]
    t = mixing.targets(sizes, weights, 3, sum(sizes))
    assert t.sum() == pytest.approx(sum(sizes)) and all(t <= 3 * np.array(sizes) + 1e-6)
    free = [x / w for x, w, s in zip(t, weights, sizes, strict=True) if x < 3 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))


def test_integral_inverse(spark):
    pieces = mixing.integral([(0, 0.5), (0.4, 2.0), (1, 0.0)])
    kind = "array<struct<start: double, weight: double, slope: double, before: double>>"
    rows = spark.createDataFrame([(k / 20, pieces) for k in range(21)], f"share double, p {kind}").select("share", mixing._time(F.col("share"), F.col("p")).alias("t")).collect()
    for r in rows:
        grid = np.linspace(0, r["t"], 20_001)
        w = np.interp(grid, [0, 0.4, 1], [0.5, 2.0, 0.0])
        assert np.trapezoid(w, grid) / np.trapezoid([0.5, 2.0, 0.0], [0, 0.4, 1]) == pytest.approx(r["share"], abs=1e-4)


def test_mixing(spark):
    rows = [(k, " ".join(["w"] * (k % 50 + 1)), ["b", "a", None, "big"][min(k % 9, 3)], 0) for k in range(3000)] + [(None, None, "a", 0), (9000, "", "c", 0), (9001, "x y", "tiny", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    p = mixing.plan(docs, lambda k, s: 1.0 + k % 3, lambda k, s: mixing.RISING, rows_per_bucket=100)
    got = p.join(docs.select("doc_id", "source"), "doc_id", "left").collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        if r["doc_id"] is not None:
            by.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    assert all(abs(taken - target) <= 1 for taken, target in by.values())
    assert sorted(map(str, p.collect())) == sorted(map(str, mixing.plan(docs.repartition(7), lambda k, s: 1.0 + k % 3, lambda k, s: mixing.RISING, rows_per_bucket=100).collect()))
    order = [r["position"] for r in mixing.training_order(p).collect()]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1
    assert mixing.plan(docs.limit(0), lambda k, s: 1.0).count() == 0


@pytest.mark.parametrize("n", [5, 600])
def test_search(spark, n):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 24)) * rng.uniform(0.5, 2, (n, 1))
    rows = [(int(k), [float(v) for v in r], 0) for k, r in enumerate(x)] + [(n, None, 0), (n + 1, [0.0] * 24, 0), (None, [1.0] * 24, 0), (0, [float(v) for v in x[0]], 0)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in hilbert_search.search(e, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    hits = total = 0
    for q in range(0, n, 20):
        best = np.argsort(-s[q], kind="stable")[: min(20, n - 1)]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert all(m[2] == pytest.approx(s[q, m[1]], rel=1e-12) for m in mine) and [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        hits, total = hits + len({m[1] for m in mine} & set(best.tolist())), total + len(best)
    assert hits / total >= 0.9
    assert hilbert_search.search(e.limit(0), F.lit(True)).count() == 0


def test_search_ranks_equal_vectors_by_id(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 24))
    rows = [(k * 300 + j, [float(v) for v in x[j]], "x") for k in range(3) for j in range(300)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(7)
    got = {}
    for r in hilbert_search.search(e, F.col("vec_id") % 20 == 0, query_slice=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert len(got) == 45
    for found in got.values():
        found.sort()
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        by = {}
        for _, i, score in found:
            by.setdefault(i % 300, set()).add(score)
        assert all(len(v) == 1 for v in by.values())


def test_search_window_stays_where_neighbours_are_near(spark):
    """Clustered vectors: the measured window doesn't follow the size of the table."""
    rng = np.random.default_rng(5)
    windows = []
    for n in (1500, 6000):
        centres = rng.normal(size=(n // 30, 12))
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
        x = np.repeat(centres, 30, axis=0) + rng.normal(size=(n // 30 * 30, 12)) * 0.01
        e = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
        seen = []
        real = hilbert_search._window
        hilbert_search._window = lambda *a, seen=seen: seen.append(real(*a)) or seen[-1]
        try:
            got = hilbert_search.search(e, F.col("vec_id") % 20 == 0)
        finally:
            hilbert_search._window = real
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        hits = [r["vec_id"] in set(np.argsort(-s[r["query_id"]])[:20].tolist()) for r in got.collect()]
        assert np.mean(hits) >= 0.9
        windows.append(seen[0])
    assert windows[1] < 2.5 * windows[0]


def test_hilbert_keys_are_a_walk():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert_search.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    word = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "klmn"]
    bad = ["awful", "nasty", "vile"]
    rows, labels, held = [], [], {}
    for k in range(1500):
        words = list(rng.choice(word, 40))
        n = rng.integers(1, 9) if k % 6 == 0 else 0
        words[:n] = rng.choice(bad, n)
        rows.append((k, " ".join(words), 1))
        (labels.append((k, int(n > 0))) if k < 1000 else held.__setitem__(k, n > 0))
    docs = spark.createDataFrame([*rows, (None, None, 1), (5000, "", 1)], "doc_id long, text string, severity int")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"), severe_words=4)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    got = toxicity.score(docs, model).collect()
    assert len(got) == 1502
    assert all(r["toxic"] == held[r["doc_id"]] for r in got if r["doc_id"] in held)
    by_count = {}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 1500:
            by_count.setdefault(sum(w in bad for w in rows[r["doc_id"]][1].split()), []).append(r["severity"])
    assert np.mean(by_count[0]) < np.mean(by_count[1]) < np.mean(by_count[8])
    assert toxicity.clean(docs, model).count() == sum(not r["toxic"] for r in got)
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert toxicity.score(docs.limit(0), None).count() == 0 and not any(r["toxic"] for r in toxicity.score(docs, None).collect())


def plain_loss(x, y, w, th, penalty):
    """The balanced log loss of the cumulative-link model, document by document, and the L1 penalty."""
    total = penalty * sum(abs(v) for v in w)
    n_bad = sum(g > 0 for g in y)
    for row, grade in zip(x, y, strict=True):
        at_most = [0.0, *(1 / (1 + math.exp(-(t - row @ w))) for t in th), 1.0]
        total -= math.log(max(at_most[grade + 1] - at_most[grade], 1e-12)) / (2 * n_bad if grade > 0 else 2 * (len(y) - n_bad))
    return total


def test_the_fit_is_the_minimum():
    """By the loss told plainly: no point nearby is better, and its differences vanish where weights aren't zero."""
    rng = np.random.default_rng(1)
    n, d, penalty = 300, 6, 0.01
    x = (rng.random((n, d)) < 0.4).astype(float)
    y = np.clip(np.round(x @ [2, 1, 0, 0, -1, 0] + rng.normal(0, 0.7, n)), 0, 2).astype(int)
    rows, cols = np.nonzero(x)
    w, th = toxicity.fit_ordinal(rows, cols, (n, d), y, penalty, rounds=4000)
    best = plain_loss(x, y, w, th, penalty)
    assert th[0] < th[1] and w[0] > w[1] > 0 > w[4]
    for k in range(d + 2):
        for step in (1e-2, -1e-2, 1e-1, -1e-1):
            v = np.concatenate([w, th])
            v[k] += step
            assert plain_loss(x, y, v[:d], v[d:], penalty) >= best - 1e-6
    for k in (*np.flatnonzero(np.abs(w) > 0.1), d, d + 1):
        up, down = (np.concatenate([w, th]) + s * 1e-4 * (np.arange(d + 2) == k) for s in (1, -1))
        assert abs(plain_loss(x, y, up[:d], up[d:], penalty) - plain_loss(x, y, down[:d], down[d:], penalty)) / 2e-4 < 2e-3


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- c --><div class="ad">Buy</div>
<article><h1>Head &amp; more</h1><p><b>First
  part<br>second<p>Third &lt;3 &am</p><div class="comments"><p>I disagree</p></div><form><p>mail</p></form></article><aside>side</aside><footer>&copy; foot</footer>"""


def test_page_text():
    assert html_text.parse(PAGE)[0] == "Head & more First part second Third <3 &am"
    assert html_text.parse("")[0] == "" and html_text.parse("plain < text & more")[0] == "plain < text & more"
    assert html_text.parse("<div>a<b>b</b>c</div><p>d<p>e</div>f<script>x")[0] == "abc d ef"
    assert html_text.parse('<main><p title="a>b">x</p></main><p>out</p>')[0] == "x"


@pytest.mark.parametrize(
    "html, want",
    [
        ("<!-- <article> --><script>'<main>'</script><div>The post</div>", "The post"),
        ('<div>The post</div><article class="comment">I disagree</article>', "The post"),
        ('<div>The post</div><div id="comments"><article>I disagree</article></div>', "The post"),
        ("<main><nav>menu</nav></main><div>The post</div>", "The post"),
        ('<article class="post comments-open category-notices">The post</article><p>out</p>', "The post"),
        ('<div class="content no-sidebar"><article>The post</article></div><p>out</p>', "The post"),
        ('<div class="widget"><article>The post</article></div><p>out</p>', "The post"),
        ('<div class="page-banner"><main><div class="sidebar"><article>The post</article></div></main></div><p>out</p>', "The post"),
        ('<main><article>The post</article><div id="comments" class="comments-area"><article class="comment-body">I disagree</article></div></main>', "The post"),
        ('<article>The post<div class="post-comments"><article>I disagree</article></div></article>', "The post"),
        ('<div class="related"><article class="comment">All there is</article></div>', "All there is"),
        ("<nav><article>menu</article></nav>", ""),
    ],
)
def test_the_article_is_kept(html, want):
    assert html_text.parse(html)[0] == want


def test_raw_elements_end_where_they_do():
    dots = "\u0130" * 30
    assert html_text.parse(f"<div>{dots}<script>x</SCRIPT><b>bold</b> tail</div>")[0] == f"{dots}bold tail"


@pytest.mark.parametrize(
    "html, want",
    [
        ("<script>if(a<b)x</script><p>one</p>", "one"),
        ("<style>a<b{}</style><p>one</p>", "one"),
        ("<script>var s='</div>';if(a</b/)y</script ><p>one</p>", "one"),
        ("<scripted>text</scripted>", "text"),
        ("<!--><p>one</p>", "one"),
        ("\u0130" * 16 + "<script>1</script><p>one</p>", "\u0130" * 16 + " one"),
        ('<article class="post no-sidebar"><p>body</p></article>', "body"),
        ('<div id="content" class="with-sidebar"><p>body</p></div>', "body"),
        ('<div class="content sidebar-left"><p>body</p></div>', "body"),
        ('<div class="widget-area"><p>all there is</p></div>', "all there is"),
        ('<div class="sidebar"><p>aside</p></div><p>body</p>', "body"),
    ],
)
def test_raw_elements_and_names(html, want):
    assert html_text.parse(html)[0] == want


def test_deep_pages_take_time_in_proportion():
    shapes = [lambda d: "<div>" * d + "deep" + "</div>" * d, lambda d: "<p><button>" + "<div>" * d + "deep", lambda d: "<span>" * d + "deep" + "</b>" * d, lambda d: "<article>" * d + "deep"]
    for shape in shapes:
        took = []
        for d in (5_000, 20_000):
            began = time.perf_counter()
            got = html_text.parse(shape(d))[0]
            took.append(time.perf_counter() - began)
            assert got in ("deep", "")  # a button's content isn't text
        assert took[1] < 12 * took[0] + 0.2


class _Outside(html.parser.HTMLParser):
    """Text outside of elements that hold none, by the standard library's parser; blocks part words."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "div", "ul", "li", "nav", "br"):
            self.out.append(" ")
        if tag != "br":
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in ("p", "div", "ul", "li", "nav"):
            self.out.append(" ")
        while self.open and self.open.pop() != tag:
            pass

    def handle_data(self, data):
        if not {"nav", "script", "style"} & set(self.open):
            self.out.append(data)


_words = st.text("ab<&; \n1\u00e9", max_size=6).map(lambda t: t.replace("<", "&lt;").replace("&", "&amp;", 0))
_tree = st.recursive(
    _words, lambda inner: st.tuples(st.sampled_from(["div", "b", "span", "nav", "script", "ul", "br"]), st.lists(inner, max_size=4)), max_leaves=20
)


def _written(node, raw=False):
    if isinstance(node, str):
        return "" if raw else node
    tag, inner = node
    if tag == "br":
        return "<br>"
    if tag == "script":
        return "<script>if(a<b)'</div>'+x</script>"
    return f"<{tag}>{''.join(map(_written, inner))}</{tag}>"


@settings(max_examples=300, deadline=None)
@given(st.lists(_tree, max_size=5))
def test_text_as_another_parser_has_it(trees):
    page = "".join(map(_written, trees))
    other = _Outside()
    other.feed(page)
    other.close()
    assert html_text.parse(page)[0] == " ".join("".join(other.out).split())


def test_site_templates(spark):
    body = lambda k, t: f"<html><body><div><p>Welcome to the site</p></div>{'<article>' if t else ''}<p>Story {k} itself</p><div><span>Shared box</span></div><p>Common line</p>{'</article>' if t else ''}</body></html>"
    rows = [(k, f"https://One.example.com:80/{k}", body(k, k % 2), "x") for k in range(40)] + [(100, "http://two.example.com/", body(100, 0), "x"), (101, None, None, "x"), (None, "nonsense", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert len(got) == len(rows) and got[101] == "" and got[None] == ""
    assert got[0] == "Story 0 itself" and got[1] == "Story 1 itself Common line" and got[100] == "Welcome to the site Story 100 itself Shared box Common line"
    assert html_text.extract(pages.limit(0)).count() == 0


def test_site_templates_by_an_absolute_count(spark):
    page = lambda k: f"<article><p>Story {k}</p><div>Advert {k % 12}</div><section>Copied {k % 50}</section></article>"
    rows = [(k, "http://big.example.com/", page(k)) for k in range(96)]  # each advert on 8 pages, a twelfth
    rows += [(1000 + k, f"http://copies.example.com/{k}", "<article><div>One page, copied</div></article>") for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages.repartition(3)).collect()}
    assert len(got) == len(rows) and got[95] == "Story 95 Copied 45" and got[0] == "Story 0 Copied 0"
    assert {got[1000 + k] for k in range(8)} == {"One page, copied"}


def test_mix_takes_rows_without_an_id_one_by_one(spark):
    rows = [(None, " ".join([f"w{k}"] * (k % 7)), "en", ["a", "b"][k % 2], k) for k in range(60)] + [(k, f"x{k} y z", "en", "c", 7) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mix_sources(spark, docs.repartition(3), SF)
    assert out.columns == docs.columns
    planned = mixing.plan(docs, lambda k, s: 1.0 + k % 3, lambda k, s: (mixing.FADING, mixing.CONSTANT, mixing.RISING)[k % 3], whole=True, carry=["text"])
    want = {r["text"]: len(r["copies"]) for r in planned.filter("size > 0 and doc_id is null").collect()}
    # the words w0 to w59 tell the rows apart
    got = {}
    for r in out.filter("doc_id is null").collect():
        got[r["text"]] = got.get(r["text"], 0) + 1
    assert got == {t: n for t, n in want.items() if n} and len(got) > 10 and "" not in got


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, n_removed int, n_bytes string, kept string, size int, copies string, _id string, position double, component_id long, id string, n int, _row string, _none string, toxic string, component string, ids string, `a.b` string"


def odd_documents(spark, rows=True):
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    data = [(k, body(k), "en", "ab"[k % 2], 7, 1, "b", "k", 2, "c", "i", 0.5, 9, "x", 3, "r", "none", "t", "c", "d", "dot") for k in range(20)]
    rest = data[0][5:]
    data += [(None, body(100), "en", "a", 7, *rest), (None, None, None, None, None, *rest), (30, None, "en", "a", 0, *rest), (31, "", "en", None, 0, *rest), (3, body(3), "en", "b", 7, *rest), (40, body(5) + " tail", "en", "a", 7, *rest), (50, "word " * 60_000, "en", "b", 7, *rest)]
    return spark.createDataFrame(data if rows else [], CLASHING)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_nulls_and_clashing_names(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = odd_documents(spark)
    out = stage(spark, docs, SF)
    rows = out.collect()
    empty = stage(spark, odd_documents(spark, False), SF)
    assert empty.count() == 0 and empty.columns == out.columns
    if k == 4:
        assert len(rows) == docs.count() and sum(r["n_tokens"] == 0 for r in rows) == 3
        return
    assert out.columns == docs.columns and [f.dataType for f in out.schema.fields] == [f.dataType for f in docs.schema.fields]
    own = {(r["kept"], r["_id"], r["a.b"], r["n_removed"], r["size"], r["_none"]) for r in rows}
    assert own == {("k", "i", "dot", 1, 2, "none")}
    texts = [r["text"] for r in rows]
    if name == "toxicity":
        assert len(rows) == docs.count()
    if name == "near_duplicates":
        # the repeated row and the near copy go; rows without an id, and texts without words, stay
        assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [*range(20), 30, 31, 50] and texts.count(None) == 2
    if name == "repeats":
        assert texts.count(None) == 2 and texts.count("") == 1 and [r["text"] for r in rows if r["doc_id"] == 40][0].endswith("tail")
        assert all(r["n_chars"] in (7, 0, None) or r["n_chars"] == len(r["text"]) for r in rows)
    if name == "mix":
        assert None not in texts and "" not in texts and 50 in {r["doc_id"] for r in rows}


def test_near_duplicates_keep_the_same_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"text number {k % 3} of one id", "en", "a", k) for k in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [corpus_pipeline.drop_near_duplicates(spark, docs.repartition(n), SF).collect() for n in (1, 4)]
    assert kept[0] == kept[1] and len(kept[0]) == 1


def test_queries_return_their_columns(spark):
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 11))
    want = {"op2_mix_sources": ["doc_id", "size", "source_size", "target", "taken"], "op9_html_text": ["page_id", "url", "text", "n_chars"], "op3_hilbert_search": ["query_id", "rank", "vec_id", "score"]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, SF).columns[: len(columns)] == columns


def test_pipeline(spark, tmp_path):
    assert [f for _, f in corpus_pipeline.STAGES] == [corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_duplicates, corpus_pipeline.remove_repeats, corpus_pipeline.mix_sources, corpus_pipeline.encode_tokens]
    docs = table(spark, SF, "documents")
    odd = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    repeated = docs.limit(1)
    docs, before = docs.unionByName(odd).unionByName(repeated), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and None in ids
        if name == "repeats":
            plain = {r["doc_id"]: bytes(r["kept"]).decode("utf-8", "ignore") for r in suffix_dedup.remove_repeats(before).collect()}
            assert all(plain[r["doc_id"]] == (r["text"] or "") for r in docs.collect())
    assert docs.count() == before.count() and docs.filter("n_tokens is null or ids_sha256 is null").count() == 0
