"""Main text of HTML pages by nearest-URL page differencing.

1. *Lines.*  A page is parsed into text lines, one per block element, with character references
   decoded and white space collapsed.  A line knows the kind of place it stands in: the page's
   article (``article``, ``main`` or ``role=main``), a place that never is one (menus, headers,
   footers, sidebars, adverts, notices, forms, reader comments, by element, role or class), or
   neither; and whether it is mostly links.
2. *Pairs.*  Pages are put in the order of (host, path) by range partitions, so that a host
   of any size spreads over many tasks; each page meets its neighbours in that order, across
   partition edges too.  Pages of a host with the same lines stand there once.  Only line
   hashes move, not texts.
3. *Differencing.*  A page is aligned with the neighbour of its host that shares the longest
   path prefix, by longest common subsequence of line hashes (bit-parallel, with linear-space
   splitting).  Lines in common are deleted: they are the site's, not the page's.  A neighbour
   which shares most of the page's own text (its article without lines that stand on nearly all
   pages of the host) is a copy of it, not another page of the site, and says nothing: runs of
   copies in URL order are passed over, to the page before and the page after the run.  Prose inside the article goes too, unless a count
   over the host shows it to be a passage that articles quote: one that stands on fewer than
   ``SITE_PAGES`` distinct pages, or that fewer than ``SITE_SHARE`` of the pages which have it
   share with their nearest page (site text is met at almost every neighbour, a quotation by chance).
4. The text is the lines that stay in the article, or, in a page without one, all lines that
   stay outside of the places that never are one.

Defined results: null, empty and text-free pages give an empty text; broken markup is read as
browsers do (open elements end with their parents; text after an unclosed script is its code);
null urls are one host; pages that tie in url are in the order of a digest, and repeated rows each get the same
text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from claimforge.llm.common import byte_slices, cut, texts_of

SLICE_BYTES = 8 << 20
COPY_SHARE = 0.5
LINK_SHARE = 0.5
#: A line on so many of a host's distinct pages does not make two pages copies, where a page has so much other text.
HOST_SHARE = 0.8
OWN_SHARE = 0.1
SITE_PAGES = 3
SITE_SHARE = 0.75
DIRECT_BITS = 1 << 27
OUTSIDE, PLAIN, ARTICLE = range(3)
SOFT = 4  # added to the place of a line that goes if shared
HOST = 8  # added to the place of a line on nearly all pages of the host

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|![^>]*(?:>|\Z)|\?[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
# Elements, by what they do to text.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
SKIPPED = frozenset("nav footer aside form button select option datalist dialog menu svg math canvas object audio video head map".split())
# Elements whose end tag may be left out: a start tag ends the last open one of these, unless one of those was opened after it.
_BLOCKS = "article aside blockquote details dialog fieldset figure footer form header main nav section table td th".split()
_ROW_PARTS, _CELLS = "tbody thead tfoot".split(), "td th".split()
ENDED_BY = {
    "li": (["li"], ["ul", "ol", "menu", "dir", "dl", *_BLOCKS]),
    **dict.fromkeys(["dt", "dd"], (["dt", "dd"], ["dl", "ul", "ol", "menu", "dir", *_BLOCKS])),
    **dict.fromkeys(_CELLS, (_CELLS, ["tr", "table"])),
    "tr": (["tr"], ["table", *_ROW_PARTS]),
    **dict.fromkeys(_ROW_PARTS, (_ROW_PARTS, ["table"])),
}
# Words of class, id and role values that name places beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments reply replies respond disqus share sharing social related recommended recommendations "
    "popup modal overlay widget login signup search pagination pager toolbar contentinfo complementary hidden".split()
)


class _Open:
    """An open element."""

    __slots__ = ("name", "beside", "article", "link")

    def __init__(self, name, beside, article, link):
        self.name, self.beside, self.article, self.link = name, beside, article, link


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(text)}


def _is_beside(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    if name in SKIPPED or name == "header" and not in_article or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if name in ("html", "body", "main") or name == "article" and not in_article and "comment" not in attrs.get("class", "").lower():
        return False
    words = re.split(r"[^a-z0-9]+", " ".join(attrs.get(k, "") for k in ("class", "id", "role")).lower())
    # "with-sidebar" and the like describe what is around
    return any(w in BESIDE and before not in ("with", "has", "no", "without") for before, w in zip(["", *words], words))  # noqa: B905


_MARKS = 1 << 12  # start tags that a worker remembers, and their longest text


def _marks(name: str, text: str, in_article: bool) -> tuple[bool, bool]:
    """(begins an article, is beside one) of a start tag with attributes."""
    attrs = _attributes(text)
    return name in ("article", "main") or attrs.get("role") == "main", _is_beside(name, attrs, in_article)


_known_marks = lru_cache(_MARKS)(_marks)  # pages repeat their tags


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, place, mostly links) of each text line of a page, in order."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = 0
    stack = [_Open("", False, False, False)]
    opened: dict[str, list[int]] = {}  # by name, the places of open elements in the stack
    at, size = 0, len(page)

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                place = OUTSIDE if top.beside else ARTICLE if top.article else PLAIN
                lines.append((text, place, linked > LINK_SHARE * len(text)))
            parts.clear()
        linked = 0

    def last(names: Iterable[str]) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=0)

    def close(to: int):
        while len(stack) > to:
            opened[stack.pop().name].pop()

    def add(text: str):
        nonlocal linked
        if text:
            text = entities.unescape(text)
            parts.append(text)
            if stack[-1].link:
                linked += len(text)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        m = _TAG.match(page, lt)
        if not m:
            add(page[at : lt + 1])  # a bare sign
            at = lt + 1
            continue
        add(page[at:lt])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if opened.get(name):
                if name not in INLINE:
                    flush()
                close(opened[name][-1])
            continue
        if name == "br" or name == "hr":
            parts.append(" ")
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            stop = page.find(">", end.start()) if end else -1
            at = stop + 1 if stop >= 0 else size
            continue
        if name not in INLINE:
            flush()
        if name in ENDED_BY:
            ended, within = ENDED_BY[name]
            if (at_open := last(ended)) > last(within):
                close(at_open)
        if name == "option" and stack[-1].name == name or stack[-1].name == "p" and name not in INLINE:
            close(len(stack) - 1)  # ends by itself
        top = stack[-1]
        marks = _known_marks if len(m[3]) < _MARKS else _marks
        article, beside = marks(name, m[3], top.article)
        opened.setdefault(name, []).append(len(stack))
        stack.append(_Open(name, top.beside or beside, top.article or article, top.link or name == "a"))
    flush()
    return lines


def lcs_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which items of ``a`` are in a longest common subsequence of ``a`` and ``b``."""
    out = np.zeros(len(a), bool)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    out[:lo] = True
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    if hi:
        out[-hi:] = True
    mid_a, mid_b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    keep_a, mid_b = np.flatnonzero(np.isin(mid_a, mid_b)), mid_b[np.isin(mid_b, mid_a)]
    if len(keep_a):
        out[lo + keep_a[_lcs(mid_a[keep_a].tolist(), mid_b.tolist())]] = True
    return out


def _lengths(a: list[int], b: list[int], keep: bool = False):
    """Bit-parallel alignment: the last row of bits (0 where the length grows), and all rows if asked."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            rows.append(v)
    return v, rows


def _lcs(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence."""
    if not a or not b:
        return []
    if len(a) * len(b) <= DIRECT_BITS or len(a) == 1:
        _, rows = _lengths(a, b, keep=True)
        out, i, j = [], len(a) - 1, len(b) - 1
        while i >= 0 and j >= 0:
            if rows[i] >> j & 1:
                j -= 1  # the length does not grow at j
            elif i and not rows[i - 1] >> j & 1:
                i -= 1  # it grows there without this item too
            else:
                out.append(i)
                i, j = i - 1, j - 1
        return out[::-1]
    half = len(a) // 2
    grow = lambda v: np.concatenate([[0], np.cumsum(1 - np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)].astype(np.int64))])
    left = grow(_lengths(a[:half], b)[0])
    right = grow(_lengths(a[half:][::-1], b[::-1])[0])[::-1]
    cut_at = int(np.argmax(left + right))
    return _lcs(a[:half], b[:cut_at]) + [half + i for i in _lcs(a[half:], b[cut_at:])]


def own_weights(weights: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Characters of each line that count when pages are compared for being copies (0: the line is not the page's own)."""
    kinds = places & 3
    inside = np.where(kinds == ARTICLE if (kinds == ARTICLE).any() else kinds != OUTSIDE, weights, 0)
    own = np.where(places & HOST, 0, inside)
    return own if own.sum() > OWN_SHARE * inside.sum() else inside


def shared_lines(hashes: np.ndarray, own: np.ndarray, others: list[np.ndarray]) -> np.ndarray | None:
    """Lines in common with the first of the other pages that is no copy of this one (None: all are)."""
    total = own.sum()
    for other in others:
        common = lcs_rows(hashes, other)
        if total == 0 or own[common].sum() <= COPY_SHARE * total:
            return common
    return None


def are_copies(first: dict, second: dict) -> bool:
    """Whether the smaller of two pages shares most of its own text with the other."""
    a, b = (own_weights(np.frombuffer(r["weights"], "<u4").astype(np.int64), np.frombuffer(r["places"], np.uint8)) for r in (first, second))
    least = min(a.sum(), b.sum())
    common = lcs_rows(np.frombuffer(first["lines"], "<u8"), np.frombuffer(second["lines"], "<u8"))
    return bool(least and a[common].sum() > COPY_SHARE * least)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host and path of a URL (what is no URL is all path)."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or ""), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        return "", url or ""


def lines_key(host: str, lines: list[tuple[str, int, bool]]) -> tuple[bytes, bytes]:
    """(line hashes, key): pages of a host with the same lines have the same key."""
    hashes = np.array([xxh3_64_intdigest(t) for t, _, _ in lines], "<u8").tobytes()
    kinds = bytes(2 * p + b for _, p, b in lines)
    return hashes, xxh3_128_digest(host.encode("utf-8", "surrogatepass") + b"\0" + kinds + b"\0" + hashes)


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        n += 1
    return n


def page_hashes(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``key, host, path, lines, weights, places`` of each host's distinct pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            for lo, hi in byte_slices(texts, SLICE_BYTES):
                urls, cols = b.column(0)[lo:hi].to_pylist(), [[] for _ in range(6)]
                for url, page in zip(urls, texts[lo:hi].to_pylist(), strict=True):
                    lines = page_lines(page)
                    soft = {i for _, i, s in staying_lines(lines) if s}
                    host, path = host_and_path(url)
                    hashes, key = lines_key(host, lines)
                    row = [key, host, path, hashes, np.array([len(t) for t, _, _ in lines], "<u4").tobytes()]
                    row.append(bytes(p + SOFT * (i in soft) for i, (_, p, _) in enumerate(lines)))
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                kinds = [pa.binary(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "host", "path", "lines", "weights", "places"])

    schema = "key binary, host string, path string, lines binary, weights binary, places binary"
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, schema).groupBy("key")
    return rows.agg(F.first("host").alias("host"), F.min("path").alias("path"), *[F.first(c).alias(c) for c in ("lines", "weights", "places")])


def mark_host_lines(hashed: DataFrame) -> DataFrame:
    """The pages with HOST added to the places of lines that stand on nearly all distinct pages of their host."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, lines = [], []
            for host, line, place in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                some = np.unique(np.frombuffer(line, "<i8")[np.frombuffer(place, np.uint8) & 3 != OUTSIDE])
                hosts.extend([host] * len(some))
                lines.append(some)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(np.concatenate([*lines, np.zeros(0, np.int64)]), pa.int64())], ["host", "line"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = []
            for line, place, common in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("lines", "places", "common")), strict=True):
                where = np.isin(np.frombuffer(line, "<i8"), np.array(common or [], np.int64))
                places.append((np.frombuffer(place, np.uint8) + HOST * where.astype(np.uint8)).tobytes())
            cols = [b.column(b.schema.get_field_index(c)) for c in names[:-1]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(places, pa.binary())], names)

    names = ["key", "host", "path", "lines", "weights", "places"]
    counts = hashed.select("host", "lines", "places").mapInArrow(explode, "host string, line long").groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    pages = hashed.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= SITE_PAGES)
    common = counts.filter(F.col("n") >= SITE_PAGES).join(pages, "host").filter(F.col("n") >= HOST_SHARE * F.col("pages"))
    # a host has at most 1 / HOST_SHARE times the lines of its mean page; written first, so that the join is planned from its true size
    common = cut(common.groupBy("host").agg(F.collect_list("line").alias("common")), "host-lines")
    met = hashed.join(common, "host", "left").select(*names, "common")
    return met.mapInArrow(mark, "key binary, host string, path string, lines binary, weights binary, places binary")


def neighbours(hashed: DataFrame) -> DataFrame:
    """Each distinct page with the lines and places of the pages before and after it in URL order."""
    ordered = hashed.repartitionByRange("host", "path", "key").select("*", F.spark_partition_id().alias("part"))
    ordered = cut(ordered, "url-order")  # one order, whatever is computed again
    place = F.struct("host", "path", "key")
    row = F.struct("host", "path", "key", "lines", "weights", "places")
    # the first and last page of each part also stand in the parts beside it
    ends = ordered.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    parts = Window.partitionBy(F.lit(0)).orderBy("part")  # one row per partition
    ends = ends.select(F.lead("part").over(parts).alias("after"), F.lag("part").over(parts).alias("before"), "first", "last")
    guests = ends.select(F.col("after").alias("part"), F.col("last").alias("r")).unionByName(ends.select(F.col("before").alias("part"), F.col("first").alias("r")))
    guests = guests.filter("part IS NOT NULL").select("r.*", "part", F.lit(True).alias("guest"))
    rows = ordered.withColumn("guest", F.lit(False)).unionByName(guests, allowMissingColumns=True)
    order = Window.partitionBy("part").orderBy(place)
    rows = rows.select("*", F.lag(row).over(order).alias("before"), F.lead(row).over(order).alias("after"))
    return rows.filter("NOT guest").drop("guest")


def mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page with ``starts`` and ``ends``: no copy of it stands before, or after it.  In URL order a row's pair with
    the page after it is the next row's with the page before it, and is compared once."""
    met, same = None, False  # the last two pages compared, by key, and whether they are copies

    def copies(first: dict, second: dict | None) -> bool:
        nonlocal met, same
        if not first or not second or first["host"] != second["host"]:
            return False
        if met != (pair := (first["key"], second["key"])):  # the next row meets this pair again
            met, same = pair, are_copies(first, second)
        return same

    for b in batches:
        starts, ends = [], []
        for r in b.to_pylist():
            starts.append(not copies(r["before"], r))
            ends.append(not copies(r, r["after"]))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts, pa.bool_()), pa.array(ends, pa.bool_())], [*b.schema.names, "starts", "ends"])


def past_copies(pairs: DataFrame) -> DataFrame:
    """Each page with ``others``: the pages before and after its run of copies in URL order, then the ends of
    the run (a long run may drift away from the page), then its neighbours."""

    schema = ", ".join(f"{c} {t}" for c, t in pairs.dtypes)
    rows = cut(pairs.mapInArrow(mark_runs, f"{schema}, starts boolean, ends boolean"), "copy-runs")
    place, pick = F.struct("host", "path", "key"), lambda c: F.struct(*[F.col(f"{c}{k}").alias(k) for k in ("host", "path", "key", "lines")])
    opened = F.struct(F.when(F.col("before").isNotNull(), pick("before.")).alias("beyond"), pick("").alias("end"))
    closed = F.struct(F.when(F.col("after").isNotNull(), pick("after.")).alias("beyond"), pick("").alias("end"))
    # runs that go on from part to part
    parts = rows.groupBy("part").agg(
        F.max_by(F.when(F.col("starts"), opened), F.when(F.col("starts"), place)).alias("o"), F.min_by(F.when(F.col("ends"), closed), F.when(F.col("ends"), place)).alias("c")
    )
    over = Window.partitionBy(F.lit(0)).orderBy("part")  # one row per partition
    far = parts.select(
        "part",
        F.last("o", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("o"),
        F.first("c", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("c"),
    )
    so_far = [Window.unboundedPreceding, Window.currentRow]
    up = Window.partitionBy("part").orderBy("host", "path", "key").rowsBetween(*so_far)
    down = Window.partitionBy("part").orderBy(*[F.desc(c) for c in ("host", "path", "key")]).rowsBetween(*so_far)
    rows = rows.withColumn("opened", F.last(F.when(F.col("starts"), opened), ignorenulls=True).over(up))
    rows = rows.withColumn("closed", F.last(F.when(F.col("ends"), closed), ignorenulls=True).over(down)).join(F.broadcast(far), "part", "left")
    rows = rows.withColumn("opened", F.coalesce("opened", "o")).withColumn("closed", F.coalesce("closed", "c"))
    near = [F.when(F.col(c).isNotNull(), pick(f"{c}.")) for c in ("before", "after")]
    others = F.array("opened.beyond", "closed.beyond", "opened.end", "closed.end", *near)
    return rows.select("key", "host", "path", "lines", "weights", "places", others.alias("others"))


def compared_lines(pairs: DataFrame) -> DataFrame:
    """``key, host, line, spot, soft, has, met, shared`` of the lines that differencing can take out of a page.

    These are the soft lines shared with the nearest page, and all article lines.  ``has`` is 1 on the first
    line of its text in the page's article, and ``met`` is 1 there if one of that text is shared.
    """
    kinds = [pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_()]
    names = ["key", "host", "line", "spot", "soft", "has", "met", "shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[] for _ in names]
            for r in b.to_pylist():
                tried = {r["key"]}
                others = []
                for pair in (r["others"][k : k + 2] for k in (0, 2, 4)):
                    pair.sort(key=lambda o: -_prefix(o["path"], r["path"]) if o else 0)  # stable: the one before wins ties
                    for o in pair:
                        if o and o["host"] == r["host"] and o["key"] not in tried:
                            tried.add(o["key"])
                            others.append(np.frombuffer(o["lines"], "<u8"))
                lines, places = np.frombuffer(r["lines"], "<u8"), np.frombuffer(r["places"], np.uint8)
                common = shared_lines(lines, own_weights(np.frombuffer(r["weights"], "<u4").astype(np.int64), places), others)
                if common is None:
                    continue
                soft = places & SOFT > 0
                prose = (places & 3 == ARTICLE) & ~soft
                met = set(lines[prose & common].tolist())
                seen = set()
                for i in np.flatnonzero(prose | soft & common).tolist():
                    x = int(lines[i])
                    first = bool(prose[i]) and x not in seen
                    if first:
                        seen.add(x)
                    row = (r["key"], r["host"], x - (x >> 63 << 64), i, bool(soft[i]), int(first), int(first and x in met), bool(common[i]))
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return pairs.mapInArrow(run, "key binary, host string, line long, spot int, soft boolean, has int, met int, shared boolean")


def shared_positions(pairs: DataFrame) -> DataFrame:
    """``key, shared``: of each page the lines (by position) that are the site's."""
    lines = cut(compared_lines(pairs), "compared-lines")
    counts = lines.filter("has = 1").groupBy("host", "line").agg(F.sum("has").alias("n"), F.sum("met").alias("n_met"))
    site = counts.filter((F.col("n") >= SITE_PAGES) & (F.col("n_met") >= SITE_SHARE * F.col("n"))).select("host", "line")
    site = cut(site, "site-lines")  # few: the join is planned from its true size
    shared = lines.filter("shared")
    gone = shared.filter("soft").select("key", "spot").unionByName(shared.filter("NOT soft").join(site, ["host", "line"]).select("key", "spot"))
    return gone.groupBy("key").agg(F.collect_list("spot").alias("shared"))


def staying_lines(lines: list[tuple[str, int, bool]]) -> list[tuple[str, int, bool]]:
    """(text, position in the page, goes if shared without a count over the host) of the lines that structure lets stay."""
    article = any(place == ARTICLE for _, place, _ in lines)
    out = []
    for i, (text, place, links) in enumerate(lines):
        if place == ARTICLE or place == PLAIN and not article and not links:
            out.append((text, i, not article or links))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of each row."""
    hashed = mark_host_lines(cut(page_hashes(pages, url_col, html_col), "page-lines"))
    shared = cut(shared_positions(past_copies(neighbours(hashed))), "shared-lines").withColumnRenamed("key", "k")
    line = pa.struct([("text", pa.string()), ("spot", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(2))
            for lo, hi in byte_slices(texts, SLICE_BYTES):
                urls, some = b.column(1)[lo:hi], texts[lo:hi].to_pylist()
                parsed = [page_lines(t) for t in some]
                keys = [lines_key(host_and_path(u)[0], p)[1] for u, p in zip(urls.to_pylist(), parsed, strict=True)]
                stay = [[{"text": t, "spot": i} for t, i, _ in staying_lines(p)] for p in parsed]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], urls, pa.array(keys, pa.binary()), pa.array(stay, pa.list_(line))], ["id", "url", "key", "lines"])

    kind = dict(pages.dtypes)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.mapInArrow(run, f"id {kind[id_col]}, url {kind[url_col]}, key binary, lines array<struct<text:string,spot:int>>")
    met = rows.join(shared, F.col("key") == F.col("k"), "left")
    gone = lambda x: F.coalesce(F.array_contains("shared", x["spot"]), F.lit(False))
    text = F.array_join(F.transform(F.filter("lines", lambda x: ~gone(x)), lambda x: x["text"]), " ")
    met = met.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"))
    return met.withColumn("n_chars", F.length("text").cast("long"))
