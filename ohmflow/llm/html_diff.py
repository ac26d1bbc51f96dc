"""Main text of web pages by structure and nearest-URL page differencing.

A page is read into text lines (one per block element). Elements that are
boilerplate by name, role or class (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments) give no lines. Lines inside a
declared article are the article's own. All other lines are open: they may be
template text, and are settled by differencing.

Differencing orders the pages of a host by URL path and pairs each page with
the neighbour that shares the longest path prefix. The lines of the two pages
are aligned by longest common subsequence, and open lines that both share are
deleted. Pages with the same set of lines are copies of one another and prove
nothing about a template; they are passed over when pairing.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequence import with_ordinal
from .store import stored

# fixed values: element names and words in class, id or role that mark boilerplate
_RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "math", "textarea",
        "title"}
_DROP = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select",
         "option", "input", "label", "fieldset", "head"} | _RAW
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
         "source", "track", "wbr"}
_BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div",
          "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html",
          "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
          "th", "thead", "tr", "ul"} | _DROP - {"button", "select", "option", "input", "label"}
_WORDS = {"ad", "ads", "advert", "advertisement", "advertising", "adverts", "banner", "breadcrumb",
          "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer",
          "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
          "notice", "notices", "pagination", "popup", "promo", "promoted", "related", "respond",
          "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar",
          "widget", "complementary", "contentinfo", "search", "alert"}
_MAIN = {"article", "main"}
_ROOTS = _MAIN | {"html", "body"}
_CLOSES_P = _BLOCK - {"html", "body", "head", "title"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
         "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = {"ul", "ol", "dl", "table", "menu"}
_ASIDE = re.compile(r"!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)", re.S)
_NAME_END, _MARK = re.compile(r"[\s/>]"), re.compile("[>\"']")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)"
                   r"(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_SPACE = re.compile(r"\s+")


def _boilerplate(name: str, attrs: str) -> bool:
    if name in _DROP:
        return True
    for key, value in _ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" \
                or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key in ("class", "id", "role") and name not in _ROOTS \
                and _WORDS & set(re.split(r"[^a-z]+", value)):
            return True
    return False


class _Tags:
    """Tags of a page from left to right. Every search that runs ahead is
    remembered, so a page of unclosed tags or quotes costs no more than its length."""

    def __init__(self, page: str):
        self.page = page
        self.next = {_NAME_END: (0, -1), _MARK: (0, -1)}    # searched from, found at
        self.open_ended: set[int] = set()                   # marks that no tag end follows

    def _ahead(self, what: re.Pattern, at: int) -> int:
        since, found = self.next[what]
        if not since <= at <= found:
            m = what.search(self.page, at)
            self.next[what] = at, found = at, m.start() if m else len(self.page)
        return found

    def _end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag, outside quotes; -1 if there is none."""
        page, seen, mark = self.page, [], self._ahead(_MARK, at)
        while mark < len(page) and mark not in self.open_ended:
            if page[mark] == ">":
                return mark
            seen.append(mark)
            close = page.find(page[mark], mark + 1)
            m = _MARK.search(page, close + 1) if close >= 0 else None
            mark = m.start() if m else len(page)
        self.open_ended.update(seen)
        return -1

    def after(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, closing, attributes) of the next tag at or after ``at``;
        comments and declarations have no name. Any other ``<`` is text."""
        page, start = self.page, self.page.find("<", at)
        while start >= 0:
            first = page[start + 1:start + 2]
            if first in ("!", "?"):
                return start, _ASIDE.match(page, start + 1).end(), "", False, ""
            closing = first == "/"
            begin = start + 1 + closing
            if page[begin:begin + 1].isascii() and page[begin:begin + 1].isalpha():
                stop = self._ahead(_NAME_END, begin)
                end = self._end(stop)
                if end >= 0:
                    return start, end + 1, page[begin:stop].lower(), closing, page[stop:end]
            start = page.find("<", start + 1)
        return None


def lines_of(page: str) -> list[tuple[str, bool]]:
    """(line, open) per text block in page order. Character references are
    decoded, white space runs become one space, empty blocks vanish. Unclosed
    elements end with the element around them. Time grows with the page's length,
    whatever is left open in it."""
    stack: list[tuple[str, bool, bool]] = [("", False, False)]   # name, dropped, in article
    blocks: list[int] = []                                       # places of block elements in it
    named: Counter[str] = Counter()                              # open elements by name
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    tags = _Tags(page)

    def end_block():
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append((text, not stack[-1][2]))

    def pop(k: int):
        if blocks and blocks[-1] >= k:
            end_block()
        while blocks and blocks[-1] >= k:
            blocks.pop()
        named.subtract(n for n, _, _ in stack[k:])
        del stack[k:]

    at, raw_until = 0, None
    while at < len(page):
        if raw_until:
            m = re.compile(f"</{raw_until}\\s*>", re.I).search(page, at)
            at = m.end() if m else len(page)
            raw_until = None
            continue
        tag = tags.after(at)
        if not stack[-1][1]:
            parts.append(page[at:tag[0] if tag else len(page)])
        if not tag:
            break
        _, at, name, closing, attrs = tag
        if not name:
            continue
        if closing:
            if named[name] > 0:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                pop(k)
            elif name in _BLOCK and not stack[-1][1]:
                end_block()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _CLOSES_P or name in _SAME:
            for k in reversed(blocks):
                n = stack[k][0]
                if n == "p" and name in _CLOSES_P or n in _SAME.get(name, ()):
                    pop(k)
                    break
                if n not in ("p", "li", "dt", "dd", "td", "th"):
                    break
        if name in _BLOCK and not stack[-1][1]:
            end_block()
        if name in _VOID:
            continue
        if name in _RAW:
            raw_until = name
            if name in _BLOCK and not stack[-1][1]:
                end_block()
            continue
        if attrs.rstrip().endswith("/") and name not in _BLOCK:
            continue
        _, dropped, inside = stack[-1]
        if name in _BLOCK:
            blocks.append(len(stack))
        named[name] += 1
        stack.append((name, dropped or _boilerplate(name, attrs), inside or name in _MAIN))
    if not stack[-1][1]:
        end_block()
    return out


def common_lines(a: Sequence[int], b: Sequence[int]) -> set[int]:
    """Places in ``a`` that one longest common subsequence of both uses. Bit
    vectors hold one row of the alignment each, so n lines against m cost
    n * m / 64 steps."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    kept = set(range(lo)) | set(range(len(a) - hi, len(a)))
    x, y = a[lo:len(a) - hi], b[lo:len(b) - hi]
    where: dict[int, int] = {}
    for k, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << k
    full = (1 << len(y)) - 1
    rows, v = [], full
    for value in x:
        u = v & where.get(value, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    i, j = len(x), len(y)
    while i and j:
        bit = 1 << (j - 1)
        if rows[i - 1] & bit:
            j -= 1
        elif i > 1 and not rows[i - 2] & bit:
            i -= 1
        else:
            kept.add(lo + i - 1)
            i, j = i - 1, j - 1
    return kept


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, url, html hash, lines, open): the lines of every whole page."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]):
        for pdf in frames:
            got = [lines_of(h or "") for h in pdf["html"]]
            pdf["lines"] = [[t for t, _ in g] for g in got]
            pdf["open"] = [[o for _, o in g] for g in got]
            yield pdf.drop(columns="html")

    return pages.select("page_id", "url", "html").mapInPandas(
        run, f"page_id {kind}, url string, lines array<string>, open array<boolean>")


def nearest_pages(keys: DataFrame) -> DataFrame:
    """(row, other): for each row of keys(row, host, path, same) the neighbour in
    path order on its host that shares the longest path prefix (the earlier one
    on ties). Rows that are alike (``same``) are folded into one before pairing.
    Rows are range-partitioned by (host, path): a large host is many tasks."""
    one = keys.groupBy("host", "path", "same").agg(F.min("row").alias("row"))
    one = one.groupBy("host", "same").agg(F.min_by(F.struct("path", "row"), F.struct("path", "row"))
                                          .alias("x")).select("host", "same", "x.path", "x.row")
    placed = stored(with_ordinal(one, ["host", "path", "row"]), "places")
    beside = placed.select(
        F.col("host").alias("h2"), F.col("path").alias("p2"), F.col("row").alias("other"),
        F.col("_ord").alias("o2"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("d"))
    pairs = placed.join(beside, F.col("_ord") == F.col("o2") + F.col("d")).where("host = h2")
    n = F.least(F.length("path"), F.length("p2"))
    shared = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0),
        lambda s, k: F.when((s == k - 1) & (k <= n) & (F.substring("path", F.lit(1), k)
                                                       == F.substring("p2", F.lit(1), k)), k)
        .otherwise(s))
    best = (pairs.withColumn("shared", shared).groupBy("host", "same")
            .agg(F.max_by("other", F.struct(F.col("shared"), -F.col("_ord") + 2 * F.col("d")))
                 .alias("other")))
    return keys.join(best, ["host", "same"]).select("row", "other")


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, lines_deleted.

    A null or empty html has an empty text. A null url has no host and is not
    paired; page without a neighbour on its host keeps its open lines. Copies of
    a page count as one page when pairing. Rows that repeat a page_id are pages
    of their own. Unclosed or stray tags do not lose text. Empty tables give an
    empty result; other columns are ignored.
    """
    # numbers are stored with the rows: numbers given on reading change with the file splits
    rows = stored(page_lines(pages).withColumn("row", F.monotonically_increasing_id()), "lines")
    doubtful = F.exists("open", lambda x: x)
    keys = rows.where("url is not null").select(
        "row", F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
        .alias("host"),
        F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
        .alias("path"), F.sha2(F.array_join("lines", "\n"), 256).alias("same"),
        doubtful.alias("doubtful")).where("host <> ''")
    # hosts without any open line have nothing to settle
    hosts = keys.groupBy("host").agg(F.max("doubtful").alias("d")).where("d").select("host")
    near = nearest_pages(keys.join(hosts, "host", "left_semi").drop("doubtful"))
    asked = rows.where(doubtful).join(near, "row", "left")
    theirs = rows.select(F.col("row").alias("other"), F.transform("lines", lambda x: F.xxhash64(x))
                         .alias("their"))
    settled = (asked.withColumn("mine", F.transform("lines", lambda x: F.xxhash64(x)))
               .join(theirs, "other", "left").mapInPandas(
                   _settle, rows.select("page_id", "url", "lines", "open").schema))
    done = settled.select("page_id", "url", "lines", "open").unionByName(
        rows.where(~doubtful).select("page_id", "url", "lines", "open"))
    kept = F.filter(F.zip_with("lines", "open", lambda t, gone: F.when(~gone, t)),
                    lambda t: t.isNotNull())
    final = done.withColumn("text", F.array_join(kept, "\n"))
    return final.select("page_id", "url", "text", F.size(F.filter("open", lambda x: x))
                        .alias("lines_deleted"))


def _settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``open`` becomes: deleted, as the paired page shares the line."""
    for pdf in frames:
        gone = []
        for mine, their, open_ in zip(pdf["mine"], pdf["their"], pdf["open"]):
            shared = common_lines(list(mine), list(their)) if their is not None else set()
            gone.append([bool(o) and k in shared for k, o in enumerate(open_)])
        yield pdf[["page_id", "url", "lines"]].assign(open=gone)
