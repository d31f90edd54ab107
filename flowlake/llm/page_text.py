"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by host and url path. A page is compared with the neighbour in that order that shares its host and the longer
start of its path; the lines of both are aligned by a longest common subsequence, and what they share is the site's and goes.
A neighbour that shares more than half of a page's text is a copy of it and says nothing about the site: then the other
neighbour is taken, and without one the page keeps its lines. Lines come from the page's blocks; blocks inside elements that say
what they are (menus, adverts, forms and the like) are not text of the article, and where a page has articles, only they are.
A shared line that stands in the article element of its page may be a passage that both articles have: it goes if it recurs over
the host, in the articles of a third of the host's pages and of 4 at least, unless such lines are more than half of the page.

Html moves once: pages are dealt to buckets by ranges of the order, sorted there, and the pages at the edge of a bucket are also
sent to its neighbour, as are the lines that recur over a host. A host that holds a third of all pages is many ranges. Bucket bounds come from a sample of urls and the
edges from an aggregation over all urls; they change no result.

Defined cases: null html is an empty page; a page without host has no neighbour; pages that repeat a url are ordered by page_id;
an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import small_batches, table
from flowlake.llm.url_filters import with_host_and_path

BUCKETS, ROWS = 8, 256
#: From this share of a page's text on, what it has in common with a neighbour makes it a copy.
COPY = 0.5
#: A line in articles is the site's if so many of a host's pages have it, and this share of them.
SITE_PAGES, SITE_SHARE = 4, 1 / 3
#: Outside of articles, a block with this share of its characters in links is a menu.
MOSTLY_LINKS = 0.6

#: Elements of HTML by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noframes textarea title xmp".split())
DROPPED = frozenset(
    "head nav header footer aside form script style noscript template iframe noframes textarea title xmp button select option "
    "object svg canvas dialog menu audio video label".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words in a class or id that name what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs byline comment comments consent cookie "
    "cookies discussion disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "pager pagination popup promo promoted promotion related reply replies respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription tags toc toolbar widget widgets warning alert disclaimer".split()
)
DISCUSSION = frozenset("comment comments discussion disqus reply replies respond".split())
#: Words that may stand beside a mark in one name; others, as in has-sidebar, say that the name is about something else.
NEUTRAL = frozenset(
    "area bar block body bottom box center col column container content foot group head holder inner item items left line link links list "
    "middle module panel primary right row secondary section site small sticky strip text title top unit wrap wrapper main page post".split()
)
MAIN = frozenset(("article", "main"))

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^<>]*(?:>|\Z)|([^<]+|<)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile("[A-Za-z]+")
#: A paragraph ends where one of these begins.
_ENDS_PARAGRAPH = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}


def _marked(value: str) -> int:
    """2 if a class or id names a discussion, 1 if it names something else that is not the article: all words of one of its names."""
    found = 0
    for name in value.split():
        words = _WORD.findall(name)
        if words and all(word in MARKS or word in NEUTRAL for word in words) and not MARKS.isdisjoint(words):
            found = max(found, 1 if DISCUSSION.isdisjoint(words) else 2)
    return found


def _is_dropped(name: str, attributes: str) -> tuple[bool, int]:
    """Whether the element goes in any case, and the mark that its class or id gives it."""
    if name in DROPPED:
        return True, 0
    if not attributes.strip() or name in ("body", "html", "main"):
        return False, 0  # what holds the whole page is judged by name, but a comment can be an article too
    mark = 0
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            mark = max(mark, _marked(value))
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True, 0
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True, 0
    return False, mark


def _released(marks: list[list], out: list[list]) -> set[int]:
    """Marked elements that hold the article after all.

    An element with an article or main and more than half of the page's text is a wrapper with a name that says something else;
    where no article or main is outside of marked elements, one of the two is enough. A discussion is one only if the page has no
    other text.
    """
    live = any(not dropped and article and not around for _, dropped, article, _, around in out)
    own, total, plain = [0] * len(marks), 0, False
    for text, dropped, _, _, around in out:
        if not dropped:
            total += len(text)
            if around:
                own[around[-1]] += len(text)
            plain = plain or all(marks[k][0] == 1 for k in around)
    found: set[int] = set()
    for k, (mark, around, holds) in enumerate(marks):
        most = own[k] * 2 > total
        if (holds and most if live else holds or most) and (not plain or all(marks[j][0] == 1 for j in (*around, k))):
            found.update(around, (k,))
    return found


def blocks_of(html: str) -> list[tuple[str, bool, bool]]:
    """The page's blocks in order: text, whether it may be the article's, whether the markup says that it is."""
    out: list[list] = []  # text, in a dropped element, in an article, share of links, marked elements around
    marks: list[list] = []  # mark, marked elements around, whether it is or holds an article or main
    parts: list[str] = []
    links = [0]
    stack: list[tuple[str, bool, bool, tuple]] = []  # name, dropped, article, marks: of the element or any around it
    linked = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, dropped, article, around = stack[-1] if stack else ("", False, False, ())
                out.append([text, dropped, article, links[0] / max(1, len(text)), around])
            parts.clear()
            links[0] = 0

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        text = m[4]
        if text is not None:
            text = unescape(text)
            parts.append(text)
            if linked:
                links[0] += len(text.strip())
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                linked = 0
            if name in BLOCKS:
                flush()
            elif name == "br":
                parts.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in BLOCKS and any(n in BLOCKS and n != "p" for n, *_ in stack[k + 1 :]):
                        break  # an inline end tag closes no block
                    if any(d or m for _, d, _, m in stack[k:]):
                        flush()
                    del stack[k:]
                    break
            continue
        if name in BLOCKS:
            flush()
            if name in _ENDS_PARAGRAPH:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCKS:
                        break
            if name == "li" and stack and stack[-1][0] == "li":
                stack.pop()
        elif name in ("br", "img", "input", "wbr"):
            if name != "wbr":
                parts.append(" ")
        if name in VOID:
            continue
        if name == "a":
            linked = 1
        around = stack[-1] if stack else ("", False, False, ())
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(html, at)
            at = close.end() if close else end
            continue
        if m[3].rstrip().endswith("/") and name not in BLOCKS:
            continue
        dropped, mark = _is_dropped(name, m[3])
        dropped = around[1] or dropped
        if mark or dropped and not around[1]:
            flush()
        main = name in MAIN or "main" in m[3].lower() and re.search(r"""role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articleBody""", m[3], re.I) is not None
        inside = around[3]
        if mark and not dropped:
            marks.append([mark, inside, False])
            inside = (*inside, len(marks) - 1)
        if main and not dropped:
            for k in inside:
                marks[k][2] = True
        stack.append((name, dropped, around[2] or main and not dropped, inside))
    flush()
    free = _released(marks, out) if marks else set()
    blocks = [(text, dropped or any(k not in free for k in around), article, share) for text, dropped, article, share, around in out]
    scoped = any(article and not dropped for _, dropped, article, _ in blocks)
    return [
        (text, not dropped and (article if scoped else linked_share < MOSTLY_LINKS), scoped and article and not dropped)
        for text, dropped, article, linked_share in blocks
    ]


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Indices of ``a`` that a longest common subsequence with ``b`` has (Hunt and Szymanski)."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = [*range(head), *range(len(a) - tail, len(a))]
    places: dict[str, list[int]] = {}
    for j in range(head, len(b) - tail):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # ends[k]: least end in b of a common subsequence of k + 1 lines
    chains: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in reversed(places.get(a[i], ())):
            k = bisect_left(ends, j)
            chain = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(chain)
            elif j < ends[k]:
                ends[k], chains[k] = j, chain
    chain = chains[-1] if chains else None
    while chain is not None:
        found.append(chain[0])
        chain = chain[1]
    return sorted(found)


def _closeness(a: str, b: str) -> tuple[int, int]:
    """Path segments, then characters, that two paths start with alike."""
    same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:same].count("/"), same


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - 2**63


def article_text(page: tuple, neighbours: list[tuple], site: frozenset[int] | set[int] = frozenset()) -> str:
    """The blocks of the page that may be the article's and that neither a neighbour shares nor the site repeats in articles."""
    host, path, blocks = page
    lines = [block[0] for block in blocks]
    kept = [k for k, (_, may_be, _) in enumerate(blocks) if may_be]
    near = [n for n in neighbours if n is not None and host and n[0] == host]
    size = sum(len(lines[k]) for k in kept)
    for _, _, others in sorted(near, key=lambda n: _closeness(path, n[1]), reverse=True):
        shared = set(common_lines(lines, [block[0] for block in others]))
        if sum(len(lines[k]) for k in kept if k in shared) <= COPY * size:
            kept = [k for k in kept if k not in shared or blocks[k][2]]
            break
    if site:
        own = [k for k in kept if not (blocks[k][2] and line_hash(lines[k]) in site)]
        if sum(len(lines[k]) for k in kept) - sum(len(lines[k]) for k in own) <= COPY * size:
            kept = own
    return "\n\n".join(lines[k] for k in kept)


def site_lines(pages: DataFrame) -> DataFrame:
    """(host, line) of line hashes that recur in the articles of a host, from pages with host and _html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, lines = [], []
            for host, source in zip(batch.column("host").to_pylist(), batch.column("_html").to_pylist(), strict=True):
                found = {line_hash(text) for text, _, article in blocks_of(source or "") if article}
                hosts += [host] * len(found)
                lines += found
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(lines, pa.int64())], ["host", "line"])

    pages = pages.filter("host <> ''").select("host", "_html")
    often = pages.mapInArrow(run, "host string, line long").groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SITE_PAGES)
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return often.join(sizes, "host").filter(F.col("n") >= SITE_SHARE * F.col("pages")).select("host", "line")


def extract(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """The pages without their html, with ``text`` (empty if none)."""
    spark = pages.sparkSession
    small_batches(spark)
    kept = [f for f in pages.schema.fields if f.name not in (html, "text")]
    names = [f.name for f in kept]
    order = F.concat(F.col("host"), F.lit("\x01"), F.col("path"))
    urls = with_host_and_path(pages.select(F.col(url).alias("_url")), "_url").select(order.alias("_order"))
    n = urls.count()
    buckets = max(1, min(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), n // ROWS))
    some = urls.sample(min(1.0, 20 * buckets / max(1, n)), seed=13).distinct()
    sampled = sorted(row["_order"] for row in some.collect())  # some 20 for each bucket
    starts = sorted({sampled[len(sampled) * k // buckets] for k in range(1, buckets)}) if len(sampled) > buckets else []

    @F.pandas_udf("int")
    def bucket_of(orders: pd.Series) -> pd.Series:
        return orders.map(lambda value: bisect_right(starts, value))

    # first and last of each bucket: two texts for each bucket
    edges = urls.select("_order", bucket_of("_order").alias("b")).groupBy("b").agg(F.min("_order").alias("first"), F.max("_order").alias("last"))
    edges = {row["b"]: (row["first"], row["last"]) for row in edges.collect()}
    filled = sorted(edges)
    before, after = dict(zip(filled[1:], filled, strict=False)), dict(zip(filled, filled[1:], strict=False))

    @F.pandas_udf("array<struct<bucket:int,side:int>>")
    def places(orders: pd.Series) -> pd.Series:
        """side 1: the bucket that the page is in; 0 and 2: it is looked at from the bucket after and before."""
        out = []
        for value in orders:
            b = bisect_right(starts, value)
            row = [(b, 1)]
            if b in before and value == edges[b][0]:
                row.append((before[b], 2))
            if b in after and value == edges[b][1]:
                row.append((after[b], 0))
            out.append([{"bucket": x, "side": y} for x, y in row])
        return pd.Series(out)

    rows = with_host_and_path(pages.select(*names, F.col(html).alias("_html"), F.col(url).alias("_url")), "_url")
    known = site_lines(rows)  # some for each host, to each bucket that the host is in
    ends = [bucket_of(F.concat("host", F.lit(c))) for c in ("\x01", "\x02")]
    known = known.select("host", "line", *(e.alias(c) for e, c in zip(ends, ("low", "high"), strict=True)))
    known = known.select(F.col("host").alias("_host"), F.col("line").alias("_line"), F.explode(F.sequence("low", "high")).alias("_bucket"))
    rows = rows.select(*names, "_html", F.struct("host", "path").alias("_at"), order.alias("_order"))
    rows = rows.withColumn("_place", F.explode(places("_order"))).withColumns({"_bucket": F.col("_place.bucket"), "_side": F.col("_place.side")})
    rows = rows.select(*names, "_html", F.col("_at.host").alias("_host"), F.col("_at.path").alias("_path"), "_order", "_bucket", "_side")
    rows = rows.unionByName(known.withColumn("_side", F.lit(-1)), allowMissingColumns=True)
    rows = rows.repartition("_bucket").sortWithinPartitions("_bucket", "_side", "_order", key, "_html")
    schema = T.StructType([*kept, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: deque = deque(maxlen=2)  # the page before, and the page whose successor is next: (page, batch columns, side)
        bucket = None
        done: list[tuple[tuple, str]] = []
        sites: dict[str, set[int]] = {}  # lines that recur over the bucket's hosts

        def settle(following: tuple | None) -> None:
            """Extract the window's last page, now that its successor is known."""
            if window and window[-1][2] == 1:
                page, row, _ = window[-1]
                done.append((row, article_text(page, [window[0][0] if len(window) > 1 else None, following], sites.get(page[0], frozenset()))))

        def out(types: list[pa.DataType]) -> pa.RecordBatch:
            columns = list(zip(*(row for row, _ in done), strict=True)) if done else [[] for _ in names]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)] + [pa.array([t for _, t in done], pa.string())]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(n).type for n in names]
            columns = [batch.column(n).to_pylist() for n in names]
            parts = [batch.column(c).to_pylist() for c in ("_html", "_host", "_path", "_bucket", "_side", "_line")]
            for k, (source, host, path, b, side, line) in enumerate(zip(*parts, strict=True)):
                if b != bucket:
                    settle(None)
                    window.clear()
                    sites.clear()
                    bucket = b
                if side == -1:
                    sites.setdefault(host, set()).add(line)
                    continue
                if side == 2 and window and window[-1][2] == 2:
                    continue  # only the first page after the bucket counts
                page = (host, path, blocks_of(source or ""))
                settle(page)
                window.append((page, tuple(c[k] for c in columns) if side == 1 else (), side))
            yield out(types)
        settle(None)
        if done:
            yield out(types)

    return rows.mapInArrow(run, schema)


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
