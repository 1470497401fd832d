"""Main text of web pages, with site template removal.

Element subtrees are hashed and counted per host in Spark; a subtree that recurs across many pages of its host is
template and is deleted. What a page marks as its article (or main part) is kept to, boilerplate elements go by their
tag, role, class or id, and what is left becomes text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.common import Scratch, lean, partitions

_TAG = re.compile(
    r"""<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*?)(?:>|\Z)"""
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

# Elements by their part in the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't parsed; how it ends. Positions in html.lower() would be others: U+0130 becomes two characters there.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I | re.A) for t in "script style textarea title noscript iframe xmp noframes".split()}
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: What an open element of the second kind is closed by.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
_NO_P_INSIDE = _BLOCK - frozenset("br body html head caption tbody td tfoot th thead tr li dd dt option optgroup title".split())
_BOILERPLATE = frozenset("nav footer aside form menu dialog button select svg template canvas object head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal "
    "overlay sidebar nav navbar navigation menu breadcrumb breadcrumbs masthead footer comment comments respond replies discussion disqus share sharing social "
    "related recommended newsletter subscribe subscription widget pagination pager login signup skip".split()
)
#: First words of names of parts that hold articles other than the page's own.
_OTHERS = frozenset("comment comments respond replies discussion disqus related recommended".split())
#: Names of the part that holds the page's own text; other words beside them don't mark it.
_OWN = frozenset("content main article post entry story".split())
#: Names like no-sidebar and comments-open tell of a page's state.
_BEFORE, _AFTER = frozenset("no not has with without".split()), frozenset("open closed enabled disabled".split())
_TOP = frozenset("html body main article".split())
#: Inside an article, only such containers can be template: a paragraph that recurs there is still the article's.
_CONTAINERS = frozenset("div section ul ol dl table details figure center".split())


def _level(names: str) -> int:
    """How far class and id mark boilerplate: 0 not, 1 by a later word of a name, 2 by its first word, 3 as others' articles."""
    if _NAMES.isdisjoint(re.split(r"[\s_\-]+", names)):
        return 0
    level = 0
    for name in names.split():
        words = [w for w in re.split(r"[_\-]+", name) if w]
        if words and words[0] not in _BEFORE and words[-1] not in _AFTER and not _NAMES.isdisjoint(words):
            level = max(level, 3 if words[0] in _OTHERS else 2 if words[0] in _NAMES else 1)
    return level if level == 3 or _OWN.isdisjoint(names.split()) else 0


def _marked(attributes: str) -> tuple[bool, int, str, bool]:
    """Whether role or aria-hidden mark boilerplate; how far class and id do; class and id; whether the main part is marked."""
    if not attributes or "=" not in attributes:
        return False, 0, "", False
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    role = found.get("role", "").lower()
    return role in _ROLES or "hidden" == found.get("aria-hidden"), _level(names), names.strip(), role == "main"


class _Node:
    """An element: its tag, what its attributes say, and pieces of its content (texts and digests) for its own digest."""

    __slots__ = ("tag", "bad", "level", "names", "role_main", "inner", "digest")

    def __init__(self, tag: str, bad: bool, level: int, names: str, role_main: bool):
        self.tag, self.bad, self.level, self.names, self.role_main = tag, bad, level, names, role_main
        self.inner: list[bytes] = []
        self.digest = b""


#: Of main text: start, end and hash of each subtree that holds any.
Spans = list[tuple[int, int, int]]


def parse(html: str, templates: frozenset[int] | set[int] = frozenset()) -> tuple[str, set[int]]:
    """The main text, without the subtrees whose hashes are in ``templates``; the hashes of the page's subtrees."""
    text, spans, hashes = scan(html)
    return without(text, spans, templates), hashes


def without(text: str, spans: Spans, templates: frozenset[int] | set[int]) -> str:
    """The text that ``scan`` returned, less the spans whose hashes are in ``templates``, with single spaces."""
    kept, at = [], 0
    for start, end, _ in sorted((s for s in spans if s[2] in templates), key=lambda s: (s[0], -s[1])):
        if start >= at:
            kept += [text[at:start], " "]
            at = end
    return " ".join("".join([*kept, text[at:]]).split())


def _tree(html: str) -> tuple[list, list[_Node]]:
    """The page as events in its order: a text, 0 for a break, n for the start and -n for the end of the n-th element.

    One pass; its work doesn't grow with the depth, as the places of open elements are kept by tag."""
    nodes = [_Node("", False, 0, "", False)]
    events: list = []
    stack = [0]
    places: dict[str, list[int]] = {}  # by tag, places in the stack
    blocks: list[int] = []  # of block elements other than br

    def text(s: str) -> None:
        if s and not s.isspace():
            s = unescape(s)
            nodes[stack[-1]].inner.append(b"=" + " ".join(s.split()).encode("utf-8", "surrogatepass"))
            events.append(s)
        elif s:
            events.append(" ")

    def close() -> None:
        k = stack.pop()
        e = nodes[k]
        places[e.tag].pop()
        if e.tag in _BLOCK:
            blocks.pop()
        h = hashlib.blake2b(f"{e.tag}\x1e{e.names}".encode("utf-8", "surrogatepass"), digest_size=8)
        for piece in e.inner:
            h.update(b"\x1f" + piece)
        e.digest = h.digest()
        nodes[stack[-1]].inner.append(b"<" + e.digest)
        e.inner = e.inner[:1]  # whether there is any
        events.append(-k)

    def close_to(tags, barrier) -> None:
        at = max((places[t][-1] for t in tags if places.get(t)), default=0)
        if at and at > max((places[t][-1] for t in barrier if places.get(t)), default=0):
            while len(stack) > at:
                close()

    at = 0
    while m := _TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if places.get(tag):
                # an inline end tag doesn't reach out of the block it stands in
                if tag in _BLOCK or not blocks or places[tag][-1] > blocks[-1]:
                    close_to((tag,), ())
            elif tag in ("br", "p"):
                events.append(0)
        elif m[2]:
            tag = m[2].lower()
            if tag in _RAW:
                nodes[stack[-1]].inner.append(b"<" + tag.encode())
                end = _RAW[tag].search(html, at)
                at = end.start() if end else len(html)
                continue
            if tag in _VOID:
                if tag in _BLOCK:
                    events.append(0)
                continue
            if tag in _NO_P_INSIDE and places.get("p"):
                close_to(("p",), ("td", "th", "button", "object", "template"))
            if tag in _CLOSES:
                close_to(_CLOSES[tag], ("ul", "ol", "dl", "table", "select", "menu"))
            bad, level, names, role_main = _marked(m[3])
            places.setdefault(tag, []).append(len(stack))
            if tag in _BLOCK:
                blocks.append(len(stack))
            stack.append(len(nodes))
            events.append(len(nodes))
            nodes.append(_Node(tag, bad, level, names, role_main))
            if m[3].endswith("/") and tag in ("svg", "path", "rect", "circle", "use"):
                close()
    text(html[at:])
    while len(stack) > 1:
        close()
    return events, nodes


def scan(html: str) -> tuple[str, Spans, set[int]]:
    """The main text as it stands, the spans of subtrees in it, and the hashes of all of the page's subtrees.

    Names never cost a page its text: where no article gives text, those that names dropped are taken back, first
    all but others' articles, and these too where nothing else on the page is text. Without any, the main part is the
    text, and where that is empty or there is none, the whole body; where names dropped all of that, it without them."""
    events, nodes = _tree(html)
    best = None
    lost = False
    if any(e.tag in ("article", "main") or e.role_main for e in nodes):
        best, has_text, from_article, lost = _select(events, nodes, 2)
        if lost and not from_article:
            more, _, from_article, _ = _select(events, nodes, 3)
            if from_article:
                return more
        if has_text:
            return best
    body, has_text, _, _ = _select(events, nodes, 0)
    if lost and not has_text:
        return _select(events, nodes, 4)[0]
    return body if has_text else _select(events, nodes, -1)[0]


def _select(events: list, nodes: list[_Node], least: int) -> tuple[tuple[str, Spans, set[int]], bool, bool, bool]:
    """What ``scan`` returns, of articles and main parts that names mark less than ``least``, of the body for 0, or of
    the body whatever names say but those of others' articles for -1; whether it has text; whether any is from an
    article; whether names alone dropped an article or main part."""
    has_main = least > 0
    # of each open element: skip, level, main, article, template candidate, parts before it, solid texts before it
    stack = [(False, 0, not has_main, False, False, 0, 0)]
    solid, from_article, lost = 0, False, False
    parts: list[str] = []
    hashes: set[int] = set()
    found: Spans = []  # by parts
    for x in events:
        skip, level, main, article, candidate, n_parts, n_solid = stack[-1]
        if x.__class__ is str:
            if main and not skip and not level:
                parts.append(x)
                if not x.isspace():
                    solid += 1
                    from_article |= article
            continue
        if not x:
            parts.append(" ")
        elif x > 0:
            e = nodes[x]
            tag = e.tag
            if tag in _BLOCK:
                parts.append(" ")
            holds = tag in ("article", "main") or e.role_main
            skip = skip or e.bad and (tag not in _TOP or tag == "article") or tag in _BOILERPLATE or tag == "header" and not (main and has_main)
            own = e.level if tag == "article" or tag not in _TOP and not e.role_main else 0
            level = max(level, own if least >= 0 or own == 3 else 0)
            if holds and has_main and not article:
                # a later word of an article's own name is no mark: category-notices
                lost |= level >= least and not skip
                level = level if level >= least else 0
            inside = has_main and main
            candidate = tag in _BLOCK and tag not in _TOP and (not inside or tag in _CONTAINERS)
            stack.append((skip, level, main or holds, article or tag == "article", candidate, len(parts), solid))
        else:
            e = nodes[-x]
            stack.pop()
            if e.tag in _BLOCK:
                parts.append(" ")
            if candidate and e.inner:
                h = int.from_bytes(e.digest, "little", signed=True)
                hashes.add(h)
                if solid > n_solid:
                    found.append((n_parts, len(parts), h))
    starts = [0, *accumulate(map(len, parts))]
    return ("".join(parts), [(starts[a], starts[b], h) for a, b, h in found], hashes), solid > 0, from_article, lost


def host_of(url_col: str):
    """The host of a URL in lower case without port; empty for null or where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url_col, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


#: Pages and characters of html after which a chunk is full.
_CHUNK = 200, 4_000_000
_CHUNK_COLUMNS = "chunk long, ids array<long>, urls array<string>, texts array<string>, spans array<array<long>>, at_host array<int>, hosts array<string>, asked array<array<long>>, pages array<struct<host: string, page: binary, subtrees: array<long>>>"


def _digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _chunk(rows: list[tuple]) -> dict:
    """Pages (id, url, host, html) as one row: main texts with their spans, what each host's subtrees in them are, and
    all subtrees of each distinct page."""
    ids, urls, of, htmls = zip(*rows, strict=True)
    hosts = {h: k for k, h in enumerate(dict.fromkeys(of))}
    asked: list[set[int]] = [set() for _ in hosts]
    texts, spans, pages = [], [], {}
    for host, html in zip(of, htmls, strict=True):
        text, found, hashes = scan(html)
        texts.append(text)
        spans.append([x for s in found for x in s])
        asked[hosts[host]].update(s[2] for s in found)
        pages[host, _digest(html)] = hashes
    return {
        "chunk": int.from_bytes(os.urandom(8), "little", signed=True), "ids": ids, "urls": urls, "texts": texts, "spans": spans,
        "at_host": [hosts[h] for h in of], "hosts": list(hosts), "asked": [list(a) for a in asked],
        "pages": [{"host": h, "page": p, "subtrees": list(x)} for (h, p), x in pages.items()],
    }


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = 5,
) -> DataFrame:
    """One row per input row: the id, the URL, ``text`` (main text, empty if none) and ``n_chars``.

    A subtree is template where it stands in ``min_pages`` distinct pages of its host, however many pages the host
    has; pages with the same html are one page. Each page is parsed once; chunks of texts are written bucketed, and
    the subtrees that they hold, once per chunk and host, are joined to the counts, so no list of a host's templates is
    made and a host with a third of all pages is no burden. A page with an article or main part gives the text in
    it; within it only containers can be template. Null html is empty; a null URL belongs to the host ''; repeated
    rows each give a row; an empty table gives none; other columns are left out.
    """
    scratch = Scratch(pages.sparkSession)
    named = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        host_of(url_col).alias("host"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("urls", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
            ("spans", pa.list_(pa.list_(pa.int64()))), ("at_host", pa.list_(pa.int32())), ("hosts", pa.list_(pa.string())), ("asked", pa.list_(pa.list_(pa.int64()))),
            ("pages", pa.list_(pa.struct([("host", pa.string()), ("page", pa.binary()), ("subtrees", pa.list_(pa.int64()))]))),
        ])
        rows, held = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 50):
                for row in zip(*(c.to_pylist() for c in batch.slice(k, 50).columns), strict=True):
                    rows.append(row)
                    held += len(row[3])
                    if len(rows) >= _CHUNK[0] or held >= _CHUNK[1]:
                        yield pa.RecordBatch.from_pylist([_chunk(rows)], schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([_chunk(rows)], schema)

    chunks = scratch.write_bucketed(named.mapInArrow(lean(chunked), _CHUNK_COLUMNS), partitions(pages.sparkSession), "chunk")
    distinct = chunks.select(F.explode("pages").alias("p")).groupBy("p.host", "p.page").agg(F.first("p.subtrees").alias("subtrees"))
    counted = distinct.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
    templates = scratch.write(counted.filter(F.col("n") >= min_pages).select("host", "subtree"))
    asked = chunks.select("chunk", F.posexplode(F.arrays_zip("hosts", "asked")).alias("h", "of"))
    asked = asked.select("chunk", "h", F.col("of.hosts").alias("host"), F.explode("of.asked").alias("subtree"))
    hits = asked.join(templates, ["host", "subtree"], "left_semi").groupBy("chunk").agg(F.collect_list(F.struct("h", "subtree")).alias("hits"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, urls, texts, spans, at_host, hits = (c[0].as_py() for c in batch.slice(k, 1).columns)
                known: dict[int, set[int]] = {}
                for hit in hits or ():
                    known.setdefault(hit["h"], set()).add(hit["subtree"])
                out = [without(t, [*zip(s[::3], s[1::3], s[2::3], strict=True)], known.get(h, frozenset())) for t, s, h in zip(texts, spans, at_host, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                    [id_col, url_col, "text", "n_chars"],
                )

    joined = chunks.select("chunk", "ids", "urls", "texts", "spans", "at_host").join(hits, "chunk", "left")
    return joined.select("ids", "urls", "texts", "spans", "at_host", "hits").mapInArrow(lean(cut), f"{id_col} long, {url_col} string, text string, n_chars long")
