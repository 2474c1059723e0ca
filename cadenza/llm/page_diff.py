r"""HTML extraction by nearest-URL page differencing.

1. Each page is cut into lines, one for each block of text, and each line keeps the zone it stands in: `main` (inside
   an article), `off` (inside a menu, header, footer, sidebar, form, notice, advert or comments, by tag, role, class
   or id; an article's own header is part of it) or `open` (neither). Scripts, styles, markup and HTML comments are no
   lines. Character references are decoded and white space inside a line is one space.
2. Pages of a host are sorted by URL path, and each page is paired with its nearest neighbour in that order: the one before or
   after it that shares the longer prefix of the path (the one before, if equal). No host is gathered in one task: a sample
   of the keys (host, path, id, url) cuts their order into blocks of about `BLOCK_PAGES` pages, one task each, and the first
   and last page of each block also go, as guests, to the block before and after it. So each page meets its true
   neighbours, wherever the cuts are. Lines are shuffled, not html.
3. The lines of both pages are aligned by longest common subsequence, and `open` lines that both share are deleted: what is
   the same on neighbouring pages is the site's frame. If both share all `open` lines, the page is a copy of that neighbour,
   which says nothing of the frame, and the other neighbour is taken; if it is a copy of both, all lines stay.

The text is the `main` lines and what the difference leaves of the `open` ones, in page order. `main` lines are proof
against deletion, as pages that repeat an article, or a passage of one, would otherwise lose text of theirs; `off` lines go
whether shared or not, as an advert of its own on each page is no main text either. A host's only page keeps all its `open`
lines.

Defined cases: null html is empty and gives an empty text; a null or unusual URL has an empty host and path, as pages of one
host; equal URLs go by page id; repeated rows are pages of their own; no rows give no rows; unclosed and truncated markup
ends at the end of the page, an unclosed quote in a tag at the next quote; only the named columns are read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags and names of page parts.
SKIP = frozenset("script style noscript template svg math iframe object canvas head title select textarea button audio video".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
OFF_TAGS = frozenset("nav header footer aside form dialog menu fieldset".split())
MAIN_TAGS = frozenset(["article"])
HEADING = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html"
    " legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OFF_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|header|footer|sidebar|side-bar|aside|breadcrumbs?|cookies?|consent|notice|banner|ads?|adverts?|advertisement|sponsor(?:ed)?|promo"
    r"|popup|modal|newsletter|subscribe|share|sharing|social|related|recommended|comments?|respond|disqus|pagination|pager|toolbar|login|signup|search)(?:$|[\s_-])", re.I)
OFF_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
OFF, OPEN, MAIN, HIDDEN = "-", "o", "m", "x"
#: Pairs of equal lines, for each line, from which bits are faster than lists of pairs.
MANY = 8


def _zone(tag: str, attrs: str, inside: str) -> str | None:
    if tag in OFF_TAGS and not (tag == "header" and inside == MAIN):
        return OFF
    if attrs:
        for m in _NAMED.finditer(attrs):
            value = m[2] or m[3] or m[4] or ""
            if inside == MAIN and m[1].lower() != "role":
                value = HEADING.sub(" ", value)
            if value.lower() in OFF_ROLES if m[1].lower() == "role" else OFF_NAMES.search(value):
                return OFF if tag not in ("html", "body") and tag not in MAIN_TAGS else None
    return MAIN if tag in MAIN_TAGS else None


def lines_of(page: str | None) -> list[str]:
    """Lines of a page; the first character of each is its zone."""
    out: list[str] = []
    if not page:
        return out
    buffer: list[str] = []
    stack: list[tuple[str, str]] = []  # of elements that set a zone, or hide their text
    zone, at, end = OPEN, 0, len(page)

    def flush() -> None:
        if buffer:
            line = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if line and zone != HIDDEN:
                out.append(zone + line)

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            if any(t == tag for t, _ in stack):
                flush()
                while stack.pop()[0] != tag:
                    pass
                zone = stack[-1][1] if stack else OPEN
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            buffer.append(" ")
            continue
        if tag in BLOCK:
            flush()
        elif tag == "br":
            buffer.append(" ")
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        new = HIDDEN if tag in SKIP else _zone(tag, m[3], zone)
        if tag == "body":  # ends a head that was left open
            stack.clear()
            zone = OPEN
        elif new or any(t == tag for t, _ in stack):  # nested elements of the same name close in pairs
            flush()
            new = zone if zone == HIDDEN or (zone == OFF and new != HIDDEN) else new or zone
            stack.append((tag, new))
            zone = new
    flush()
    return out


def shared_lines(one: list[str], two: list[str]) -> list[bool]:
    """For each line of `one`, whether it is in the longest common subsequence of both. Common ends are matched first; between
    them by Hunt and Szymanski: the longest increasing run over the places of equal lines, in (matches) log (lines)."""
    out = [False] * len(one)
    lo, hi_a, hi_b = 0, len(one), len(two)
    while lo < hi_a and lo < hi_b and one[lo] == two[lo]:
        out[lo] = True
        lo += 1
    while hi_a > lo and hi_b > lo and one[hi_a - 1] == two[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
        out[hi_a] = True
    places: dict[str, list[int]] = {}
    for j in range(hi_b - 1, lo - 1, -1):
        places.setdefault(two[j], []).append(j)
    if sum(len(places.get(x, ())) for x in one[lo:hi_a]) > MANY * (hi_a + hi_b):  # lines that repeat often: by bits instead
        for i in _common_by_bits(one[lo:hi_a], two[lo:hi_b]):
            out[lo + i] = True
        return out
    tails: list[int] = []
    links: list[tuple | None] = []
    for i in range(lo, hi_a):
        for j in places.get(one[i], ()):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        out[link[0]] = True
        link = link[1]
    return out


def _lengths(one: list[str], two: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of `one` and each beginning of `two`, from the shortest; a row of the table
    is one whole number, in which a 0 marks a place where the length grows."""
    masks: dict[str, int] = {}
    for j, x in enumerate(two):
        masks[x] = masks.get(x, 0) | 1 << j
    full = row = (1 << len(two)) - 1
    for x in one:
        if m := masks.get(x, 0):
            both = row & m
            row = ((row + both) | (row - both)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(two) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(two)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common_by_bits(one: list[str], two: list[str]) -> Iterator[int]:
    """Places in `one` of a longest common subsequence: halves of `one` against the two parts of `two` that do best, again and
    again. Memory grows with the lines, time with their product over the bits of a word."""
    if not one or not two:
        return
    if len(one) == 1:
        if one[0] in two:
            yield 0
        return
    k = len(one) // 2
    cut = int(np.argmax(_lengths(one[:k], two) + _lengths(one[k:][::-1], two[::-1])[::-1]))
    yield from _common_by_bits(one[:k], two[:cut])
    yield from (k + i for i in _common_by_bits(one[k:], two[cut:]))


def main_text(lines: list[str], *neighbours: list[str]) -> tuple[str, int, int]:
    """What stays of a page's lines beside its neighbours', in one line; how many lines it shares with the neighbour that
    decided, and how many of them were deleted. The next neighbour is asked only if all open lines are shared with one."""
    shared = [False] * len(lines)
    for near in neighbours:
        shared = shared_lines(lines, near)
        if not all(s for x, s in zip(lines, shared, strict=True) if x[0] == OPEN):
            gone = [s and x[0] == OPEN for x, s in zip(lines, shared, strict=True)]
            break
    else:
        gone = [False] * len(lines)
    text = " ".join(x[1:] for x, g in zip(lines, gone, strict=True) if x[0] != OFF and not g)
    return text, sum(shared), sum(gone)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def _nearest(page, before, after) -> list:
    """Of rows (host, path, ...), those of the same host, the one whose path shares the longer prefix first."""
    found = [x for x in (before, after) if x is not None and x[0] == page[0]]
    return sorted(found, key=lambda x: -_common(x[1], page[1]))


OUT = "page_id long, url string, text string, n_shared long, n_deleted long"
#: Pages of a block, keys sampled for each block, and the most blocks there are (beyond them, blocks grow; tasks read them in order).
BLOCK_PAGES, SAMPLE, MOST_BLOCKS = 4096, 32, 20_000


def _pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (block, key, host, path, guest, page_id, url, lines) in order of block and key to OUT, guests left out."""
    held: list[tuple] = []  # the page before and the page itself, once cut into lines

    def rows() -> Iterator[tuple | None]:
        for b in batches:
            yield from zip(b.host, b.path, b.block, b.guest, b.page_id, b.url, map(list, b.lines), strict=True)
            yield None  # the end of a batch

    def result(before, page, after) -> tuple:
        mates = [x if x is not None and x[2] == page[2] else None for x in (before, after)]
        return (page[4], page[5], *main_text(page[6], *[x[6] for x in _nearest(page, *mates)]))

    done: list[tuple] = []
    frame = lambda: pd.DataFrame(done, columns=["page_id", "url", "text", "n_shared", "n_deleted"]).astype({"page_id": "Int64"})
    for row in rows():
        if row is None:
            if done:
                yield frame()
                done = []
            continue
        if held and not held[-1][3]:
            done.append(result(held[-2] if len(held) > 1 else None, held[-1], row))
        held = [*held[-1:], row]
    if held and not held[-1][3]:
        done.append(result(held[-2] if len(held) > 1 else None, held[-1], None))
    if done:
        yield frame()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _lines(html: pd.Series) -> pd.Series:
    return html.map(lines_of)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", blocks: int | None = None) -> DataFrame:
    """One row per page row: page_id, url, text, n_shared and n_deleted (lines shared with the neighbour, and deleted for it)."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), _lines(F.coalesce(F.col(html), F.lit(""))).alias("lines"))
    part = lambda pattern: F.coalesce(F.regexp_extract("url", pattern, 1), F.lit(""))
    digits = lambda c: F.lpad(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")  # noqa: E731  in the order of the numbers
    rows = rows.withColumns({"host": F.lower(part(_HOST)), "path": part(_PATH)})
    key = F.concat_ws("\0", "host", "path", F.coalesce(digits(F.col("page_id")), F.lit("")), F.coalesce("url", F.lit("")))
    keys = rows.select(key.alias("key"))  # of two narrow columns
    n = keys.count()
    blocks = blocks or min(max(-(-n // BLOCK_PAGES), 8), MOST_BLOCKS)
    drawn = keys if n <= SAMPLE * blocks else keys.where(F.pmod(F.xxhash64("key"), F.lit(n)) < SAMPLE * blocks)
    drawn = sorted(r[0] for r in drawn.limit(64 * SAMPLE * blocks).collect())  # the limit guards the driver; the cuts decide nothing but evenness
    cuts = sorted({drawn[len(drawn) * k // blocks] for k in range(1, blocks)}) if drawn else []

    @F.pandas_udf("int")
    def block_of(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_right(cuts, k)).astype("int32")

    ends = keys.select(block_of("key").alias("block"), "key").groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    ends = sorted((r["block"], r["first"], r["last"]) for r in ends.collect())  # one row per block
    guests: dict[str, list[int]] = {}
    for (b, _, last), (after, first, _) in zip(ends, ends[1:], strict=False):
        guests.setdefault(last, []).append(after)
        guests.setdefault(first, []).append(b)

    @F.pandas_udf("array<int>")
    def seats(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: [bisect_right(cuts, k), *guests.get(k, ())])

    rows = rows.withColumn("key", key)
    rows = rows.select("key", "host", "path", "page_id", "url", "lines", F.posexplode(seats("key")).alias("seat", "block"))
    rows = rows.withColumn("guest", F.col("seat") > 0).drop("seat")
    rows = rows.repartition(blocks, "block").sortWithinPartitions("block", "key", F.xxhash64("lines"))
    return rows.mapInPandas(_pair, OUT)
