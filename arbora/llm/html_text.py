"""Main text of web pages by nearest-URL page differencing.

Every page is parsed into text lines, one a block, each with its zone: inside the
page's article or main element, inside a boilerplate element (navigation, header,
footer, sidebar, advert, notice, form, comments, by element or by class, id and
role), or free. Pages are paired with the next page by URL path within their host;
the free lines of a pair are aligned by their longest common subsequence, and so are
the lines of their articles; shared lines go, on both sides of a pair. Boilerplate zones
go too. A page that has an article or main element keeps of that zone's lines those
that not each of its neighbours shares, so that a passage copied from one of them stays; other
pages keep the free lines that no neighbour shares. Articles that are near copies of each
other are spared: if the shared lines have at least ``COPY`` of the characters of the
shorter article, the pair takes nothing from either.

Defined cases: null and empty html give an empty text; a null url is a host of its
own with an empty path; pages of one url (ties) are ordered by page_id and html; repeated
rows are extracted alike; broken markup is read as a browser would, unclosed
elements end with their parent; an empty table gives an empty result; other columns
are ignored. The whole html is read; nothing else is dropped or capped.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm._shared import batches

MAIN, FREE, BOILER = 2, 1, 0
#: Articles are near copies if they share so much of the shorter one.
COPY = 0.5
#: Keys of pages that set the ranges; they shape the work, never the result.
SAMPLE = 20_000
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template head title svg math object iframe canvas audio video select option datalist textarea button".split())
_BOILER = frozenset("nav footer aside form dialog menu fieldset".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul legend caption".split())
_WORDS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|banner|footer|sidebar|side|aside|ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|social|share|sharing|comments?|replies|respond|disqus|related|recommended|widget|toolbar|copyright|login|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_CLOSES_P = _BLOCK - {"html", "body"}
_SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Collects ``(zone, text)`` lines."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []
        self.lines: list[tuple[int, str]] = []
        self.parts: list[str] = []
        self.zone, self.silent = FREE, False

    def _end_line(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((self.zone, text))
            self.parts = []

    def _enter(self) -> None:
        self.zone, self.silent = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (FREE, False)

    def _close(self, upto: int) -> None:
        if any(t in _BLOCK or s for t, _, s in self.stack[upto:]):
            self._end_line()
        del self.stack[upto:]
        self._enter()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body" or tag in _BLOCK and tag not in ("html", "head"):
            self._close_open("head", ("body",))
        if tag in _BLOCK:
            if tag in _CLOSES_P:
                self._close_open("p", ("article", "main", "section", "div", "table", "td", "li", "blockquote", "button", "object", "body"))
            if tag == "li":
                self._close_open("li", ("ul", "ol", "menu"))
            self._end_line()
        elif tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        zone, silent = self.zone, self.silent or tag in _SILENT
        if zone != BOILER:
            named = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden")}
            label = f"{named.get('class', '')} {named.get('id', '')}"
            if tag in _BOILER or tag == "header" and zone != MAIN or named.get("role", "").lower() in _ROLES or "hidden" in named or named.get("aria-hidden") == "true" or tag not in ("html", "body", "article", "main") and _WORDS.search(label):
                zone = BOILER
            elif tag in ("article", "main") or named.get("role", "").lower() in ("main", "article"):
                zone = MAIN
        self.stack.append((tag, zone, silent))
        self.zone, self.silent = zone, silent

    def _close_open(self, tag: str, bounds: tuple[str, ...]) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self._close(at)
                return
            if self.stack[at][0] in bounds:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self._close(at)
                return
        if tag in _BLOCK:
            self._end_line()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)

    def finish(self) -> list[tuple[int, str]]:
        self.close()
        self._end_line()
        return self.lines


def lines_of(html: str | None) -> list[tuple[int, str]]:
    if not html:
        return []
    reader = Lines()
    reader.feed(html)
    return reader.finish()


def shared_lines(left: list[str], right: list[str]) -> tuple[set[int], set[int]]:
    """Indices on either side of one longest common subsequence.

    Equal ends are matched first; the middle is aligned by dynamic programming,
    one row of lengths at a time with one bit a cell kept for the way back.
    """
    head = 0
    while head < min(len(left), len(right)) and left[head] == right[head]:
        head += 1
    tail = 0
    while tail < min(len(left), len(right)) - head and left[-1 - tail] == right[-1 - tail]:
        tail += 1
    a_of, b_of = set(range(head)), set(range(head))
    a_of |= set(range(len(left) - tail, len(left)))
    b_of |= set(range(len(right) - tail, len(right)))
    # only lines that occur on both sides can be shared
    both = set(left[head : len(left) - tail]) & set(right[head : len(right) - tail])
    code = {s: n for n, s in enumerate(sorted(both))}
    ia = [k for k in range(head, len(left) - tail) if left[k] in both]
    ib = [k for k in range(head, len(right) - tail) if right[k] in both]
    a, b = np.array([code[left[k]] for k in ia], np.int64), np.array([code[right[k]] for k in ib], np.int64)
    if len(a) and len(b):
        row, keep = np.zeros(len(b) + 1, np.int32), []
        for x in a:
            best = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
            keep.append(np.packbits(best > row[1:]))
            row = np.concatenate([[0], best]).astype(np.int32)
        i, j = len(a), len(b)
        while i and j:
            if np.unpackbits(keep[i - 1], count=len(b))[j - 1]:
                while b[j - 1] != a[i - 1]:
                    j -= 1
                a_of.add(ia[i - 1])
                b_of.add(ib[j - 1])
                j -= 1
            i -= 1
    return a_of, b_of


def shared_parts(left: list[str], right: list[str]) -> tuple[set[int], set[int]]:
    """As ``shared_lines``, but nothing for articles that are near copies."""
    a, b = shared_lines(left, right)
    size = lambda lines: sum(map(len, lines))
    if size(left[k] for k in a) >= COPY * min(size(left), size(right)):
        return set(), set()
    return a, b


def _paths(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, host, path``; host and path empty without ``://``."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.coalesce(F.lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"))


def _bounds(keyed: DataFrame, parts: int) -> list[tuple]:
    """Keys that cut the pages into about ``parts`` ranges of equal numbers, from at most ``SAMPLE`` keys."""
    if parts < 2:
        return []
    seen = keyed.select("host", "path", "page_id").orderBy(F.xxhash64("host", "path", "page_id")).limit(SAMPLE).collect()
    keys = sorted({_key(*r) for r in seen})
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []


def _key(host: str, path: str, page_id: int | None) -> tuple:
    """A page's place in the order that Spark sorts by: nulls first."""
    return host, path, page_id is not None, page_id or 0


def _dealt(pages: DataFrame) -> DataFrame:
    """The pages with their ``range`` of the order, and copies (``guest``) of each range's last page in the next and of its first in the one before.

    So every page meets both its neighbours, whatever the ranges are.
    """
    keyed = _paths(pages)
    bounds = _bounds(keyed, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number = lambda h, p, i: bisect_right(bounds, _key(h, p, None if i != i or i is None else int(i)))

    @F.pandas_udf("int")
    def place(host: pd.Series, path: pd.Series, page_id: pd.Series) -> pd.Series:
        return pd.Series([number(*k) for k in zip(host, path, page_id, strict=True)], dtype="int32")

    text_id = F.col("page_id").cast("string")
    ends = keyed.select("host", "path", "page_id").withColumn("range", place("host", "path", text_id)).groupBy("range").agg(*[f(F.struct("host", "path", "page_id")).alias(n) for n, f in (("first", F.min), ("last", F.max))]).orderBy("range").collect()
    guests: dict[tuple, list[int]] = {}
    for one, other in zip(ends, ends[1:], strict=False):
        guests.setdefault(_key(*one["last"]), []).append(other["range"])
        guests.setdefault(_key(*other["first"]), []).append(one["range"])

    @F.pandas_udf("array<int>")
    def places(host: pd.Series, path: pd.Series, page_id: pd.Series) -> pd.Series:
        out = []
        for h, p, i in zip(host, path, page_id, strict=True):
            out.append([2 * number(h, p, i), *(2 * g + 1 for g in guests.get(_key(h, p, None if i != i or i is None else int(i)), ()))])
        return pd.Series(out)

    each = keyed.withColumn("at", F.explode_outer(places("host", "path", text_id)))
    return each.select("page_id", "url", "html", "host", "path", F.shiftright("at", 1).alias("range"), (F.col("at") % 2 == 1).alias("guest")).repartitionByRange(max(1, len(ends)), "range")


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, a row for each page.

    Pages are dealt by ranges of (host, path, page_id), so that a host with a third of all pages
    becomes many parts, and sorted; each range has copies of the pages next to it. Each
    task parses a page and meets it with the page before, two pages at a time.
    """
    ranged = _dealt(pages)

    def pair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place: tuple | None = None
        held: tuple | None = None

        def of(page: tuple, zone: int) -> list[str]:
            return [text for z, text in page[1] if z == zone]

        def done(page: tuple) -> list[tuple]:
            row, lines, gone = page
            if row.guest:
                return []
            zone = MAIN if any(z == MAIN for z, _ in lines) else FREE
            text = "\n".join(t for k, t in enumerate(of(page, zone)) if k not in (gone[zone] or ()))
            return [(row.page_id, row.url, text, len(text))]

        for frame in batches(frames):
            out = []
            for row in frame.itertuples(index=False):
                page = (row, lines_of(row.html), {MAIN: None, FREE: set()})
                if held is not None:
                    if place == (row.range, row.host):
                        for zone, shared in ((FREE, shared_lines), (MAIN, shared_parts)):
                            a, b = shared(of(held, zone), of(page, zone))
                            for gone, own in ((held[2], a), (page[2], b)):
                                gone[zone] = own if gone[zone] is None else gone[zone] | own if zone == FREE else gone[zone] & own
                    out += done(held)
                held, place = page, (row.range, row.host)
            yield pd.DataFrame(out, columns=["page_id", "url", "text", "n_chars"])
        if held is not None:
            yield pd.DataFrame(done(held), columns=["page_id", "url", "text", "n_chars"])

    return ranged.sortWithinPartitions("range", "host", "path", "page_id", F.xxhash64("html")).mapInPandas(pair, "page_id long, url string, text string, n_chars long")
