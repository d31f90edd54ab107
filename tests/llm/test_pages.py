"""URL filters and page text."""

import re

import duckdb
import pytest

from flowlake.llm import page_text as pt
from flowlake.llm import url_filters as uf

RULES = {r.name: r for r in uf.SITE_RULES}


@pytest.mark.parametrize(
    ("url", "rule"),
    [
        ("http://a.com/x", "com/"),
        ("http://com/x", "com/"),
        ("http://a.com", None),
        ("http://xcom/", None),
        ("http://example.com/en/1", "example.com/en/"),
        ("http://m.EXAMPLE.com/en/1", "example.com/en/"),
        ("http://www.example.com/en/1", "www.example.com/en/"),
        ("http://a.www.example.com/en/?q", "www.example.com/en/"),
        ("http://example.com/EN/1", "com/"),
        ("http://notexample.com/en/1", "com/"),
        ("http://b.net/fr/", "net/fr/"),
        ("http://b.net/fr", None),
        ("http://b.net/?u=http://a.com/", None),
        ("ftp://b.net#://a.com/", None),
        ("a.com/x", None),
        (None, None),
        ("", None),
        ("x://", None),
    ],
)
def test_site_rules(url, rule):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    target = found[1].lower() + found[2] if found else ""
    for counts in ({}, {"com": 9, "example": 1, "en": 5, "net": 2, "fr": 7, "es": 1, "www": 3}):
        assert uf.RuleIndex(uf.SITE_RULES, counts).decide(target) == (RULES[rule] if rule else None)


def test_rules_are_filed_under_their_rarest_token():
    index = uf.RuleIndex(uf.SITE_RULES, {"com": 9, "example": 1, "en": 5, "net": 20, "fr": 7, "es": 1, "www": 3})
    filed = {entry[1].name: token for token, entries in index.by_token.items() for entry in entries}
    assert filed == {"com/": "com", "example.com/en/": "example", "www.example.com/en/": "example", "net/es/": "es", "net/fr/": "fr"}
    free = uf.UrlRule("any", "block", r"\.exe\Z", ())
    assert uf.RuleIndex((free,), {}).decide("h/x.exe") is free


def test_op6_and_its_sql(spark):
    d = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{d}/pages.parquet')")
    columns = ("page_id", "host", "path", "rule", "verdict")
    got = sorted(map(str, (tuple(r[c] for c in columns) for r in uf.op6_url_filters(spark, d).collect())))
    assert got == sorted(map(str, db.execute(f"SELECT {', '.join(columns)} FROM ({uf.OP6_SQL})").fetchall()))


def test_url_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "no host", "x"), (4, "http://casino.shop/" + "a" * 100_000, "x"), (4, "http://casino.shop/", "x"), (None, "http://fine.shop/casino", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = uf.judge_urls(pages).collect()
    assert sorted(r.verdict for r in got) == ["allow"] * 4 + ["block"] * 2 and {r.rule for r in got if r.verdict == "block"} == {"casino"}
    assert uf.judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", []),
        ("<p>a</p><div class='sidebar'>s</div><p>b<br>c</p>", ["a", "b c"]),
        ("<div><a href=x>m1</a> <a href=y>m2</a></div><p>text <a>l</a> more words here</p>", ["text l more words here"]),
        ("<article><header><h1>T</h1></header><p>x &amp; y&nbsp;z<form>f</form><div class='comments'><p>c</p></div></article><p>o", ["x & y z"]),
        ("<p>unclosed <b>bold<p>next", ["unclosed bold", "next"]),
        ("<main><h1>A</h1>txt<ul><li>1<li>2</ul></main><footer>f", ["A", "txt", "1", "2"]),
        ("<p>a<script>x</p></script>b</p><!-- c --><p>d<div cla", ["ab", "d"]),
        ("<div id='cookie-notice'>x</div>plain", ["plain"]),
        ("<article class='comment'><p>c</p></article><article><p>t</p></article>", ["t"]),
        ("a < b <p>c", ["a < b", "c"]),
        ("<div role='navigation'>n</div><aside>a</aside><p style='display: none'>h</p><p>&#233;&lt;&hellip;</p>", ["é<…"]),
    ],
)
def test_blocks(html, text):
    assert [block[0] for block in pt.blocks_of(html) if block[1]] == text


def test_common_lines_are_longest():
    def brute(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    import random

    draw = random.Random(4)
    for _ in range(200):
        a, b = (["abcd"[draw.randrange(4)] for _ in range(draw.randrange(12))] for _ in range(2))
        found = pt.common_lines(a, b)
        assert len(found) == brute(a, b) == len(set(found))
        rest = iter(b)
        assert all(a[k] in rest for k in found)  # a subsequence of b as well


def page(*lines):
    return "".join(f"<div>{x}</div>" for x in lines)


SITE = [
    (1, "http://s.com/a/1", page("Site name", "first story, long enough to be one", "All rights reserved")),
    (2, "http://s.com/a/2", page("Site name", "second story, long enough to be one", "All rights reserved")),
    (3, "http://t.com/a/3", page("Site name", "third story", "All rights reserved")),
    (4, "http://u.com/a/4", page("Copied story of some length", "tail")),
    (5, "http://u.com/a/5", page("Copied story of some length", "other")),
    (6, None, page("Site name", "no url")),
    (7, None, None),
    (8, "http://u.com/z/9", "<article>" + page("Copied story of some length", "tail") + "</article>"),
]


def test_shared_lines_go(spark, monkeypatch):
    expected = {
        1: "first story, long enough to be one",
        2: "second story, long enough to be one",
        3: "Site name\n\nthird story\n\nAll rights reserved",
        4: "Copied story of some length\n\ntail",
        5: "Copied story of some length\n\nother",
        6: "Site name\n\nno url",
        7: "",
        8: "Copied story of some length\n\ntail",
    }
    pages = spark.createDataFrame([(*r, "x") for r in SITE], "page_id long, url string, html string, text string").repartition(3)
    for rows in (256, 1):
        monkeypatch.setattr(pt, "ROWS", rows)
        assert {r.page_id: r.text for r in pt.extract(pages).collect()} == expected
    assert pt.extract(pages.limit(0)).count() == 0
    assert pt.extract(pages.unionByName(pages)).count() == 2 * len(SITE)


def test_op2_against_one_pass(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    monkeypatch.setattr(pt, "ROWS", 10)
    rows = []
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        m = re.search(r"://([^/?#]*)([^?#]*)", r.url)
        rows.append((r.page_id, (m[1].lower(), m[2], pt.blocks_of(r.html))))
    rows.sort(key=lambda r: (r[1][0] + "\x01" + r[1][1], r[0]))
    pages = [p for _, p in rows]
    expected = {i: pt.article_text(p, [pages[k - 1] if k else None, pages[k + 1] if k + 1 < len(pages) else None]) for k, (i, p) in enumerate(rows)}
    got = {r.page_id: (r.text, r.n_chars) for r in pt.op2_page_text(spark, d).collect()}
    assert got == {i: (t, len(t)) for i, t in expected.items()}
