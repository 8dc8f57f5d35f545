"""Main text of web pages: blocks of the article, and differencing with the page of the nearest URL.

A page is cut into blocks (paragraphs, headings, list items ...). Elements that are never part of the
text, by their name, role or class, are left out: menus, page headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments. The text of a page is made of the blocks of its articles, else of those of a main
element, else of all blocks. The lines of a page that are compared are these and, beside an article, its other blocks.

Pages are sorted by host and path, those of a host with the same lines once; a page's partner is the
neighbour on the same host whose path agrees longest, of those that share lines. The lines of both are aligned by their longest common subsequence, and shared
ones are deleted: they belong to the site. Articles are compared with articles: two of them may rightly share a passage, so their
shared line is the site's if it is shared with a second neighbour too, which is no copy of the first. Nothing is
deleted when most of the text is shared, as partners are then copies of one page.

Pages are numbered in sorted order with one count per task, and meet their neighbours by an equality
join on that number: a host with many pages is dealt out like any other.

Defined cases: null or empty html gives the empty text; a null URL, or one without "://", has an empty
host and path and is still compared; unclosed elements end with their parent; pages that repeat are
copies of each other. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtspark.llm.common import small_batches, stage
from courtspark.llm.url_filter import host_and_path

#: Shared lines of more than this part of a page's frame mean that both pages are copies.
COPY_SHARE = 0.6
#: Neighbours in the sorted order that are tried, the one with the longest common path first.
STEPS = (-1, 1, -2, 2)

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe template svg math".split())
NEVER = frozenset("nav footer aside form button select dialog menu head object audio video canvas".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo cookie cookies consent gdpr notice notices alert newsletter subscribe "
    "popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus respond replies share sharing social "
    "related footer pagination pager widget login search".split()
)
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PART = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _left_out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NEVER or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "article", "main") or "=" not in attributes and "hidden" not in attributes:
        return False
    got = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in got or got.get("aria-hidden") == "true" or got.get("role") in ROLES or _HIDDEN.search(got.get("style", "")):
        return True
    names = set(_PART.split(f"{got.get('class', '')} {got.get('id', '')}"))
    return bool(names & NAMES) or "header" in names and not in_article


def blocks(html: str | None) -> list[tuple[str, str]]:
    """Pairs of place ("article", "main" or "") and text, in page order."""
    text = html or ""
    stack: list[tuple[str, bool]] = []
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    skip, deep, at = 0, {"article": 0, "main": 0}, 0

    def flush() -> None:
        line = " ".join("".join(parts).split())
        parts.clear()
        if line:
            out.append(("article" if deep["article"] else "main" if deep["main"] else "", line))

    def pop(to: int) -> None:
        nonlocal skip
        while len(stack) > to:
            tag, hides = stack.pop()
            skip -= hides
            if tag in deep and not skip and not hides:
                deep[tag] -= 1

    while at < len(text):
        found = _TAG.search(text, at)
        stop = found.start() if found else len(text)
        if stop > at and not skip:
            parts.append(entities.unescape(text[at:stop]))
        if not found:
            break
        at = found.end()
        close, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCKS and not skip:
            flush()
        elif tag == "br":
            parts.append(" ")
        if close:
            where = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if where is not None:
                pop(where)
            continue
        if tag in BLOCKS:  # a new block ends an open paragraph; these end the head
            ends = {"p"} | ({tag} if tag in ("li", "dt", "dd", "tr", "td", "th") else set()) | (set() if tag in ("title", "head", "html") else {"head"})
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    pop(i)
                    break
                if stack[i][0] in ("ul", "ol", "table", "article", "main", "div", "nav", "form", "body"):
                    break
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        hides = _left_out(tag, attributes, bool(deep["article"]))
        stack.append((tag, hides))
        if tag in deep and not skip and not hides:
            deep[tag] += 1
        skip += hides
    if not skip:
        flush()
    return out


def shared_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``; rows of bits instead of a table."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    row, rows = every, []
    for x in a:
        same = row & where.get(x, 0)
        row = ((row + same) | (row - same)) & every
        rows.append(row)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not (i and not rows[i - 1] >> (j - 1) & 1):
            j -= 1
            out.append(i)
    return out[::-1]


def _hash(line: str, inside: bool) -> int:
    """The lowest bit tells whether the line is inside an article: such lines only equal each other."""
    return (xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63) | 1) - (not inside)


def _parse(batches):
    for batch in batches:
        frame, hashes = [], []
        for text in batch.column("html"):
            got = blocks(text.as_py())
            place = next((p for p in ("article", "main") if any(q == p for q, _ in got)), "")
            if place != "article":
                got = [(q, x) for q, x in got if q == place]
            frame.append([x if q == place else None for q, x in got])  # what is beside an article is compared, but is no text
            hashes.append([_hash(x, q == "article") for q, x in got])
        columns = [batch.column(c) for c in ("page_id", "url", "host", "path")]
        columns += [pa.array(frame, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "path", "frame", "lines"])


def _number(batches):
    """The task and the place in it of every row."""
    at, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        n = batch.num_rows
        columns = [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n)), *batch.columns]
        at += n
        yield pa.RecordBatch.from_arrays(columns, names=["part", "pos", *batch.schema.names])


def _agreement(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def shared_with_neighbour(host: str, path: str, lines: list, others: list[tuple[str, str, list]], copy_share: float = COPY_SHARE, inside: frozenset = frozenset()) -> list[int]:
    """Places of the lines shared with the nearest page of the host that shares some and is no copy. If there are places
    ``inside`` an article, of those the ones shared with a second such page, too."""
    near = [(-_agreement(path, p), k, ls) for k, (h, p, ls) in enumerate(others) if h == host]
    size, mine, first = len(inside) or len(lines), set(lines), None
    for *_, theirs in sorted(near, key=lambda x: x[:2]):
        if mine.isdisjoint(theirs):
            continue
        got = [i for i in shared_lines(lines, theirs) if not inside or i in inside]
        if not 0 < len(got) <= copy_share * size:
            continue
        if not inside:
            return got
        if first is None:
            first, site = (got, theirs), set()
        elif len(shared_lines(theirs, first[1])) <= copy_share * min(len(theirs), len(first[1])):
            site |= set(got)
    return [i for i in first[0] if i in site] if first else []


def _compare(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            inside = frozenset(i for i, x in enumerate(r["lines"]) if x & 1)
            out.append(shared_with_neighbour(r["host"], r["path"], r["lines"], [(o["host"], o["path"], o["lines"]) for o in r["others"]], inside=inside))
        columns = [batch.column(c) for c in ("host", "same", "n")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.int64()))], names=["host", "same", "n", "gone"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = small_batches(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"), "html")
    kind = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, host string, path string, frame array<string>, lines array<bigint>"
    parsed = stage(rows.mapInArrow(_parse, kind).withColumn("same", F.xxhash64("lines")).withColumn("n", F.size("lines")), "parsed")

    # pages of a host with the same lines are taken once, so that no page's partner is its own copy
    frames = parsed.groupBy("host", "same", "n").agg(F.min("path").alias("path"), F.any_value("lines").alias("lines"))
    order = frames.repartitionByRange("host", "path", "same").sortWithinPartitions("host", "path", "same")
    order = stage(order.select("host", "same", "n", "path", "lines").mapInArrow(_number, "part long, pos long, host string, same long, n int, path string, lines array<bigint>"), "order")
    counts = order.groupBy("part").agg(F.count("*").alias("rows"))  # one row per task
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = stage(counts.select("part", before.alias("first")), "places")
    order = stage(order.join(place, "part").withColumn("at", F.col("first") + F.col("pos")).drop("part", "pos", "first"), "order")

    pairs = order
    for step in STEPS:
        beside = order.select((F.col("at") - step).alias("at"), F.struct("host", "path", "lines").alias(f"beside_{STEPS.index(step)}"))
        pairs = pairs.join(beside, "at", "left")
    pairs = pairs.select("host", "same", "n", "path", "lines", F.array_compact(F.array(*[f"beside_{k}" for k in range(len(STEPS))])).alias("others"))
    gone = stage(pairs.mapInArrow(_compare, "host string, same long, n int, gone array<bigint>").where("size(gone) > 0"), "gone")
    out = parsed.join(gone, ["host", "same", "n"], "left")
    left = F.filter("frame", lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<bigint>")), i.cast("long")))
    text = F.array_join(left, "\n")  # leaves out the nulls
    return out.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
