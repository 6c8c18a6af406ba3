import random
import time

import numpy as np
import pytest

from claimforge.llm import page_text as pt

SCHEMA = "page_id long, url string, html string"


def _dp(a, b):
    n = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            n[i + 1, j + 1] = n[i, j] + 1 if a[i] == b[j] else max(n[i, j + 1], n[i + 1, j])
    return n[-1, -1]


@pytest.mark.parametrize("bits", [1 << 27, 1])
def test_alignment_is_longest(monkeypatch, bits):
    monkeypatch.setattr(pt, "DIRECT_BITS", bits)
    rng = random.Random(bits)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        rows = pt.lcs_rows(np.array(a, np.uint64), np.array(b, np.uint64))
        common = [x for x, k in zip(a, rows) if k]
        it = iter(b)
        assert all(x in it for x in common) and len(common) == _dp(a, b)


def test_long_pages_stay_fast():
    began = time.time()
    a = np.arange(20_000, dtype=np.uint64) % 7
    assert pt.lcs_rows(a, a[::-1].copy()).sum() > 0
    for t in ("<" * 200_000, "<div>" * 50_000 + "x", "<a b=\"" * 50_000, "<!--" * 100_000, "<script>" * 50_000, "</p>" * 100_000, "&amp;" * 100_000, "x " * 300_000):
        pt.page_lines(t)
    assert time.time() - began < 30


CASES = [
    ("<article><h1>T &amp; U</h1><p>a<b>b</b>  c<br>d</p> e</article>", "T & U ab c d e"),
    ("<nav><a>m</a></nav><header>h</header><article><p>x</p><aside>s</aside><form>f</form><p>y<script>'</p>'</script>z</p><div class='ad'>q</div></article><footer>f</footer>", "x yz"),
    ("<main><section id=comments><p>c</p></section><p>one<p>two</main>", "one two"),
    ("<body class=has-sidebar><div class='content with-sidebar'><p>body</p></div><div id=sidebar>s</div>", "body"),
    ("<article><div hidden>n</div><div style='display: none'>n</div><!-- c -->t&copy;&#233;&am</article>", "t©é&am"),
    ("plain text", "plain text"),
    ("<article>a < b &lt; c</article>", "a < b < c"),
    ("<div><ul><li><a href=x>link</a></li></ul><p>text <a href=y>in</a> line</p></div>", "text in line"),
    ("<article><p>open", "open"),
    (None, ""),
    ("", ""),
    ("<p> </p>", ""),
    ("<article><article class=comment>c</article>kept</article>", "kept"),
    ("<ARTICLE><STYLE>p{}</STYLE>Up</ARTICLE>", "Up"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.x/{i}", h) for i, (h, _) in enumerate(CASES)], SCHEMA).selectExpr("*", "1 AS text", "2 AS key", "3 AS host")
    got = {r["page_id"]: r for r in pt.extract(df).collect()}
    for i, (h, want) in enumerate(CASES):
        assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want)), h


def _site(rng, n):
    rows = []
    for i in range(n):
        body = "".join(f"<p>{' '.join(rng.choice('abcdefgh') * 3 for _ in range(12))} {i} {k}.</p>" for k in range(4))
        host = "big.x" if i % 3 else f"h{i % 5}.x"
        rows.append((i, f"http://{host}/{rng.choice('ab')}/{rng.randrange(10**6)}", f"<div><p>Site name of {host}</p>{body}<p>All rights kept by {host}</p></div>"))
    return rows


def test_lines_of_the_site_go_whatever_the_partitions(spark):
    rng = random.Random(5)
    rows = _site(rng, 60)
    rows += [(100, rows[0][1] + "#top", rows[0][2]), (101, rows[0][1], rows[0][2]), (101, rows[0][1], rows[0][2]), (102, None, "<p>Site name of none</p>"), (103, "http://[bad", "<p>q</p>")]
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted((r["page_id"], r["text"]) for r in pt.extract(df.repartition(5)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] and len(results[0]) == len(rows)
    text = dict(results[0])
    for i, _, _ in rows[:60]:
        assert "Site name" not in text[i] and "All rights" not in text[i] and text[i].count(".") == 4
    assert text[102] == "Site name of none" and text[103] == "q" and text[100] == text[0]


def test_neighbours_are_those_of_the_whole_order(spark):
    rows = _site(random.Random(6), 80)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r["path"]: r for r in pt.neighbours(pt.page_hashes(df, "url", "html")).collect()}
    order = sorted(pt.host_and_path(u) for _, u, _ in rows)
    for k, (host, path) in enumerate(order):
        r = got[path]
        assert (r["before"] and (r["before"]["host"], r["before"]["path"])) == (order[k - 1] if k else None)
        assert (r["after"] and (r["after"]["host"], r["after"]["path"])) == (order[k + 1] if k + 1 < len(order) else None)


def test_empty_table(spark):
    assert pt.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_site_text_inside_the_article_goes_and_quoted_passages_stay(spark):
    rows = []
    for i in range(24):
        quote = "<p>A passage that some articles quote.</p>" if i % 6 == 0 else ""
        body = "".join(f"<p>Own sentence {i} {k} of this page, long enough to be its text.</p>" for k in range(4))
        rows.append((i, f"http://site.x/{i:03}", f"<article><h1>Title {i}</h1><div><p>Reprints need the consent of the site.</p></div>{quote}{body}<p>Read more on our pages.</p></article>"))
    rows += [(100 + i, f"http://two.x/{i}", f"<main><p>Quoted by both.</p><p>Alone {i}, with a text of its own.</p></main>") for i in range(2)]
    text = {r["page_id"]: r["text"] for r in pt.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for i in range(24):
        assert "Reprints" not in text[i] and "Read more" not in text[i]
        assert text[i].startswith(f"Title {i} ") and text[i].count("Own sentence") == 4
        assert ("A passage that some articles quote." in text[i]) == (i % 6 == 0)
    assert text[100] == "Quoted by both. Alone 0, with a text of its own."


def test_runs_of_near_copies_and_short_pages_lose_the_text_of_the_site(spark):
    site = "<p>Site name of the copies</p>", "<p>All rights kept</p>"
    rows, want = [], {}

    def add(path, own, host="copies.x", shared=site):
        rows.append((len(rows), f"http://{host}/{path}", f"<div>{shared[0]}{''.join(f'<p>{t}</p>' for t in own)}{shared[1]}</div>"))
        want[len(rows) - 1] = " ".join(own)

    for i in range(9):  # 0-2 and 6-8 are pages of their own, 3-5 ten near copies each
        for k in range(10 if 3 <= i <= 5 else 1):
            add(f"{i}/{k}", [f"Sentence {i} {j} of a text that has many more of them." for j in range(6)] + [f"Printed on day {i} {k}."])
    menu = tuple(f"<p>{' '.join(f'entry{c}{j}' for j in range(20))}</p>" for c in "ab")
    for i in range(12):  # the menu is longer than the text
        add(f"{i:02}", [f"Short text number {i}, just this one line of the page {i * 7919}."], "short.x", menu)
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r["page_id"]: r["text"] for r in pt.extract(df.repartition(3)).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n", [3, 33, 400])
def test_end_tags_count_at_any_depth(n):
    stays = lambda page: [t for t, _, _ in pt.staying_lines(pt.page_lines(page))]
    terms = "".join(f"<dt>t{i}<dd><a>d{i}</a>" for i in range(n))
    assert stays(f"<nav><dl>{terms}</dl></nav><article><p>text</p></article>") == ["text"]
    assert stays(f"<nav><dl>{''.join(f'<dt><i>t{i}<dd><b>d{i}' for i in range(n))}</dl></nav><article><p>text</p></article>") == ["text"]
    assert stays(f"<article>{'<p><b>a<br>' * n}</article><div>b</div>") == ["a"] * n
    cells = "".join(f"<tr><td>c{i}<th>h{i}" for i in range(n))
    assert stays(f"<aside><table><tbody>{cells}</table></aside><main>{'<li><b>x' * n}</main><div>b</div>") == ["x"] * n


def test_items_end_by_their_own_rules():
    page = "<main><ul><li class=ad>ad<li>one<ul><li>two</ul><li>three</ul><table><tr><td class=ad>ad<td>cell<table><tr><td>inner</table><tr><td>next</table><dl><dt class=ad>ad<dd>text</dl></main>"
    assert [t for t, _, _ in pt.staying_lines(pt.page_lines(page))] == ["one", "two", "three", "cell", "inner", "next", "text"]


def test_neighbouring_pages_are_compared_for_copies_once(spark, monkeypatch):
    rows = [(i, f"http://one.x/{i:02}", f"<p>Page {i // 2}, of a text that comes two times.</p><p>Its end {i}</p>") for i in range(20)]
    pairs = pt.neighbours(pt.page_hashes(spark.createDataFrame(rows, SCHEMA), "url", "html")).coalesce(1).toArrow().combine_chunks().to_batches()
    seen, real = [], pt.are_copies
    monkeypatch.setattr(pt, "are_copies", lambda a, b: seen.append((a["key"], b["key"])) or real(a, b))
    got = [r for b in pt.mark_runs(iter(pairs)) for r in b.to_pylist()]
    assert len(got) == 20 and len(seen) == len(set(seen)) == 19
    for r in got:
        assert r["starts"] == (not r["before"] or not real(r["before"], r))
        assert r["ends"] == (not r["after"] or not real(r, r["after"]))


def test_marks_of_start_tags_are_read_once(monkeypatch):
    seen, real = [], pt._is_beside
    monkeypatch.setattr(pt, "_is_beside", lambda *a: seen.append(a) or real(*a))
    pt._known_marks.cache_clear()
    page = "<div class='ad one'><p>x</p></div><div role=main><div class='ad one'>y</div><div class='own'>z</div></div>"
    lines = [pt.page_lines(page + f"<p>{i}</p>") for i in range(50)]
    assert lines[0][:-1] == [("x", pt.OUTSIDE, False), ("y", pt.OUTSIDE, False), ("z", pt.ARTICLE, False)] and len(seen) < 10
    long = f"<div class='ad {'w ' * pt._MARKS}'>x</div>"
    assert pt.page_lines(long) == pt.page_lines(long) == [("x", pt.OUTSIDE, False)]
