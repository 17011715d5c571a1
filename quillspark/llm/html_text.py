"""Main text of web pages: page structure, and differences between pages with neighbouring URLs."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, release, ship, small_side, stash
from .url_filter import parts

#: Elements whose content is never text, that hold the main text, that hold none of it, that break blocks, and that
#: have no content.
_RAW = frozenset({"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "select"})
_MAIN = frozenset({"article", "main"})
_ASIDE = frozenset({"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head", "figure"})
_BLOCK = frozenset({"address", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}) | _MAIN | _ASIDE
_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
#: Words of class, id and role that mark an element as something other than the main text.
_MARKS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|adverts|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo|related|replies|reply|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget|contentinfo|complementary|search)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: Elements that an opening tag closes if they are open: the end tags of paragraphs and list items may be left out.
_IMPLIED = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
MAIN, OPEN, ASIDE = 2, 1, 0
#: Rows of a side that may be broadcast.
SMALL_ROWS = 200_000


def blocks(page: str) -> list[tuple[int, str]]:
    """The page's blocks of text in order, each with its region: MAIN, ASIDE, or OPEN (neither is marked)."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements that matter, with the region inside
    region, pieces, at, end = OPEN, [], 0, len(page)

    def flush() -> None:
        if pieces:
            text = _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                out.append((region, text))

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            pieces.append(page[at:])
            break
        if m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in _BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    region = stack[-1][1] if stack else OPEN
                    break
            continue
        if name in _RAW:
            if not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if name in _BLOCK:
            flush()
        elif name == "br":
            pieces.append(" ")
        if name in _VOID:
            continue
        while stack and stack[-1][0] in _IMPLIED.get(name, ()):
            stack.pop()
        outer = stack[-1][1] if stack else OPEN
        marked = any(_MARKS.search(a or b or c or "") for a, b, c in _ATTRIBUTE.findall(m[3])) if m[3] and name not in ("html", "body") else False
        own = ASIDE if outer == ASIDE or name in _ASIDE and not (name == "header" and outer == MAIN) and not (name == "figure" and outer == MAIN) or marked else MAIN if name in _MAIN else outer
        if name in _BLOCK or marked:
            stack.append((name, own))
        region = own if name in _BLOCK or marked else region
    flush()
    return out


def main_text(found: list[tuple[int, str]], shared: frozenset[int] = frozenset()) -> str:
    """Page differencing with structure as its guard: shared lines go, but not those of an article (MAIN), and what is
    marked as something else (ASIDE) goes though it isn't shared. Beside an article, unmarked lines (OPEN) go too."""
    article = any(r == MAIN for r, _ in found)
    return "\n\n".join(t for i, (r, t) in enumerate(found) if r == MAIN or r == OPEN and not article and i not in shared)


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions in a of a longest common subsequence of a and b; by divide and conquer, in memory linear in b."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    inner, other = a[head : len(a) - tail], b[head : len(b) - tail]
    middle = np.zeros(0, np.int64)
    if len(inner) == 1:
        middle = np.flatnonzero(np.isin(inner, other))
    elif len(inner) and len(other):
        mask = np.isin(inner, other)
        index, other = np.flatnonzero(mask), other[np.isin(other, inner)]
        if len(index) == 1:
            middle = index
        elif len(index):
            middle = index[_divide(inner[index], other)]
    return np.concatenate([np.arange(head), middle + head, np.arange(len(a) - tail, len(a))]).astype(np.int64)


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences of a with each prefix of b; one big number holds a row of the table, so
    that a step costs len(b) / 64 words."""
    at: dict[int, int] = {}
    for i, x in enumerate(b.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a.tolist():
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(b) or not len(a):
        return np.zeros(0, np.int64)
    if len(a) == 1:
        return np.zeros(1 if a[0] in b else 0, np.int64)
    mid = len(a) // 2
    k = int(np.argmax(_row(a[:mid], b) + _row(a[mid:][::-1], b[::-1])[::-1]))
    return np.concatenate([_divide(a[:mid], b[:k]), _divide(a[mid:], b[k:]) + mid])


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of pages to the hashes of their lines."""
    import xxhash

    for batch in batches:
        lines = [np.array([xxhash.xxh64_intdigest(t) for _, t in blocks(page.as_py() or "")], np.uint64).view(np.int64) for page in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lines, pa.list_(pa.int64()))], names=["host", "path", "page_key", "lines"])
    release()


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with the lines of both neighbours to the positions of lines that the nearer one shares."""
    for batch in batches:
        shared = []
        for path, own, before, after in zip(*(batch.column(k) for k in (1, 2, 3, 4)), strict=True):
            path, own = path.as_py(), np.array(own.as_py(), np.int64)
            near = [n for n in (before.as_py(), after.as_py()) if n is not None]
            if not near:
                shared.append([])
                continue
            same = lambda p: next((i for i, (x, y) in enumerate(zip(path, p, strict=False)) if x != y), min(len(path), len(p)))
            partner = max(near, key=lambda n: same(n["path"]))
            shared.append(common_lines(own, np.array(partner["lines"], np.int64)).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared, pa.list_(pa.int64()))], names=["page_key", "shared"])


def _neighbours(outlines: DataFrame) -> DataFrame:
    """Each page with the lines of the pages before and after it in its host's order of paths.

    One order over all pages, dealt by ranges, so that a host with a third of the pages is split. Only the first and
    last page of each range are exchanged between ranges.
    """
    key = ["host", "path", "page_key"]
    n = int(outlines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = stash(outlines.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("range", F.spark_partition_id()), "ordered")
    page = F.struct("host", "path", "page_key", "lines")
    ends = ordered.groupBy("range").agg(F.min(page).alias("head"), F.max(page).alias("tail"))
    every = Window.orderBy("range")  # as many rows as ranges
    ends = ends.select("range", F.lag("tail").over(every).alias("outer_before"), F.lead("head").over(every).alias("outer_after"))
    inside = Window.partitionBy("range").orderBy(*key)
    rows = ordered.withColumn("before", F.lag(page).over(inside)).withColumn("after", F.lead(page).over(inside)).join(small_side(stash(ends, "ends"), 10_000), "range")
    for side in ("before", "after"):
        rows = rows.withColumn(side, F.coalesce(side, f"outer_{side}"))
        rows = rows.withColumn(side, F.when(F.col(f"{side}.host") == F.col("host"), F.struct(f"{side}.path", f"{side}.lines")))
    return rows.select("page_key", "path", "lines", "before", "after")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, shared = [], []
        for page, lines in zip(batch.column(2), batch.column(3), strict=True):
            lines = frozenset(lines.as_py() or ())
            texts.append(main_text(blocks(page.as_py() or ""), lines))
            shared.append(len(lines))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(shared, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_shared"])
    release()


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page.

    pages: page_id long, url string, html string; other columns are ignored. Returns page_id, url, text, n_chars (code
    points), n_shared. Every page becomes lines (blocks of text), pages are put in the order of their paths within each
    host, and the neighbour with the longer common path is the partner (ties: the one before). n_shared lines are on a
    longest common subsequence of both pages' lines: those are deleted, unless an article or main element holds them,
    for neighbouring articles may quote each other. Elements and class names that stand for menus, notices, adverts,
    forms, comments and the like are taken out whether they are shared or not, and so is what stands beside an article.

    Lines are compared by 64-bit hashes; they are written once, and only they are ordered and joined. Null html is
    empty, null urls form a host of their own, null page_ids and repeated rows are returned as they are. A page without
    partner shares nothing.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    key = F.xxhash64("page_id", "url", "html")
    host, path = parts(F.col("url"))
    outlines = stash(rows.select(host.alias("host"), path.alias("path"), key.alias("page_key"), "html").mapInArrow(_outline, "host string, path string, page_key long, lines array<long>"), "outlines")
    near = _neighbours(outlines)
    shared = stash(near.mapInArrow(_difference, "page_key long, shared array<long>").where(F.size("shared") > 0).groupBy("page_key").agg(F.min("shared").alias("shared")), "shared")
    discard(outlines)
    joined = rows.withColumn("page_key", key).join(small_side(shared, SMALL_ROWS), "page_key", "left").select("page_id", "url", "html", "shared")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long, n_shared long")
