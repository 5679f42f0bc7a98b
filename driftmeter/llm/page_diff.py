"""Main text of web pages, by differencing with the page of the nearest URL.

Pages are parted into blocks of text (lines). Within a host pages are put in the order of their URL paths, and each page
is paired with the neighbour whose path has more leading segments in common with its own, the earlier one of ties. The
lines of both are aligned by a longest common subsequence, and lines that are shared are deleted: menus, notices, adverts
and footers that a site repeats. Two things are known from the page itself and go before that: text in elements whose
tag, role or class says that it is furniture goes even when the neighbour lacks it, and text in an article element stays
even when the neighbour quotes or copies it. What lies outside articles is judged by the alignment on every page, whether
it has articles or not: an article may be a mere teaser. Lines of the neighbour's articles are main text there and mark
nothing as repeated. Pages that are the same as their neighbour in all lines are copies; they tell nothing about what is
shared, and lose nothing.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmeter.llm.common import ship, shuffle_partitions, stored, unused

#: Elements of HTML that begin and end blocks.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements of HTML without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, up to their end tag.
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
#: Elements whose text is not main text.
FURNITURE = frozenset("nav header footer aside form script style head title menu button select textarea noscript template iframe svg dialog search object canvas audio video".split())
#: An element's role, or a word of its class or id, that says the same.
SIGNS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar menu breadcrumb breadcrumbs header masthead "
    "footer sidebar aside complementary contentinfo search notice notices cookie cookies consent popup modal dialog alert newsletter subscribe "
    "subscription share sharing social related recommended comment comments respond replies disqus login signup widget widgets pager pagination".split()
)
MAIN = frozenset(("article", "main"))
#: Bits of an alignment of two pages that are held at once.
ROW_BITS = 1 << 23
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_SIGN = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[A-Za-z0-9]+")
_SPACE = re.compile(r"\s+")


def _is_furniture(tag: str, attributes: str) -> bool:
    if tag in FURNITURE:
        return True
    for _, *values in _SIGN.findall(attributes) if "=" in attributes else ():
        if any(w.lower() in SIGNS for v in values for w in _WORD.findall(v)):
            return tag not in ("html", "body", "article", "main")
    return False


def blocks(html: str | None) -> list[tuple[str, str]]:
    """(kind, text) of each block in page order; kind is "main" (in an article), "rest" or "off" (furniture).

    White space within a block is one space. Character references are decoded once, after the markup is gone. End tags
    without a start are passed over; an end tag ends what was left open within its element.
    """
    out: list[tuple[str, str]] = []
    open_: list[tuple[str, bool, bool]] = []  # tag, furniture, main: of the element and those around it
    held: list[str] = []
    html, at = html or "", 0

    def flush() -> None:
        text = _SPACE.sub(" ", unescape("".join(held))).strip()
        held.clear()
        if text:
            off, main = open_[-1][1:] if open_ else (False, False)
            out.append(("off" if off else "main" if main else "rest", text))

    while m := _TAG.search(html, at):
        held.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        furniture = not m[1] and _is_furniture(tag, m[3])
        if tag in BLOCKS or furniture or tag in RAW:
            flush()
        if m[1]:
            if any(t == tag for t, _, _ in open_):
                if any(t in BLOCKS or f for t, f, _ in open_[max(i for i, x in enumerate(open_) if x[0] == tag) :]):
                    flush()
                while open_.pop()[0] != tag:
                    pass
            continue
        off, main = open_[-1][1:] if open_ else (False, False)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            if tag == "title" or tag == "textarea":
                open_.append((tag, True, main))
                held.append(html[at : end.start() if end else len(html)])
                flush()
                open_.pop()
            at = end.end() if end else len(html)
            continue
        if tag == "p" and open_ and any(t == "p" for t, _, _ in open_):
            # a paragraph ends the one that is open, unless an element between them holds it
            k = max(i for i, x in enumerate(open_) if x[0] == "p")
            if not any(t in BLOCKS for t, _, _ in open_[k + 1 :]):
                del open_[k:]
                off, main = open_[-1][1:] if open_ else (False, False)
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            open_.append((tag, off or furniture, main or tag in MAIN))
    held.append(html[at:])
    flush()
    return out


def _masks(right: list[int]) -> Callable[[int], int]:
    """For a line the bits of its places in right. Only lines that stand in many places are kept as bits."""
    places: dict[int, list[int]] = {}
    for j, v in enumerate(right):
        places.setdefault(v, []).append(j)
    kept: dict[int, int] = {}
    many = math.isqrt(len(right))

    def mask(v: int) -> int:
        if v in kept:
            return kept[v]
        bits = bytearray(len(right) // 8 + 1)
        for j in places[v]:
            bits[j >> 3] |= 1 << (j & 7)
        out = int.from_bytes(bits, "little")
        if len(places[v]) > many:
            kept[v] = out
        return out

    return mask


def _rows(left: list[int], right: list[int]) -> Iterator[int]:
    """For each line of left the row of its alignment: a 0 bit marks where the longest one so far grows by one."""
    mask, whole = _masks(right), (1 << len(right)) - 1
    row = whole
    for v in left:
        match = row & mask(v)
        row = ((row + match) | (row - match)) & whole
        yield row


def _lengths(left: list[int], right: list[int]) -> np.ndarray:
    """Length of the longest alignment of left with each beginning of right."""
    row = deque(_rows(left, right), maxlen=1)[0]
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(right) // 8 + 1, "little"), np.uint8), count=len(right), bitorder="little")
    return np.concatenate(([0], np.cumsum(bits == 0)))


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence of a and b.

    Common ends are cut off, lines that the other page lacks are left out; the rest is aligned row by row with the bits
    of one long number, one for each line of b. Where all rows would take more than ROW_BITS, only the last one is held:
    a is halved, and b is parted where the alignments of both halves are longest together.
    """
    first, last = 0, 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    shared = set(range(first)) | set(range(len(a) - last, len(a)))
    x, y = a[first : len(a) - last], b[first : len(b) - last]
    both = set(x) & set(y)
    left = [i for i, v in enumerate(x) if v in both]
    right = [v for v in y if v in both]
    if not left:
        return shared
    if len(left) > 1 and len(left) * len(right) > ROW_BITS:
        lines, half = [x[i] for i in left], len(left) // 2
        part = _halves(lines, right, half)
        found = common_lines(lines[:half], right[:part]) | {half + k for k in common_lines(lines[half:], right[part:])}
        return shared | {first + left[k] for k in found}
    whole = (1 << len(right)) - 1
    rows = list(_rows([x[i] for i in left], right))
    length = lambda r, j: j - (r & ((1 << j) - 1)).bit_count()
    j = len(right)
    for k in range(len(left) - 1, -1, -1):
        before = rows[k - 1] if k else whole
        here = length(rows[k], j)
        if not here:
            break
        if length(before, j) == here:
            continue
        while length(rows[k], j - 1) == here:
            j -= 1
        shared.add(first + left[k])
        j -= 1
    return shared


def _halves(left: list[int], right: list[int], half: int) -> int:
    """Where right is parted so that both parts align best with the two halves of left."""
    return int((_lengths(left[:half], right) + _lengths(left[half:][::-1], right[::-1])[::-1]).argmax())


def main_text(page: list[tuple[str, str]], hashes: list[int], neighbour: list[int]) -> str:
    """Blocks that stay, joined by line ends. hashes: those of the page; neighbour: those of the other one, or none."""
    shared = common_lines(hashes[1:], neighbour[1:]) if hashes != neighbour else set()
    kept, k = [], 0
    for kind, text in page:
        if kind == "main" or kind == "rest" and k not in shared:
            kept.append(text)
        k += kind != "main"
    return "\n".join(kept)


def _hashes(page: list[tuple[str, str]]) -> list[int]:
    """A hash of all lines in articles, then one for each line outside them."""
    articles = xxhash.xxh3_64_intdigest("\n".join(text for kind, text in page if kind == "main"))
    return [articles, *(xxhash.xxh3_64_intdigest(text) for kind, text in page if kind != "main")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in small letters and path of a URL, without scheme, user, port, query and fragment; empty where there is none."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(bare, "/.*$", ""), "^.*@|:[0-9]*$", ""))
    return host, F.regexp_replace(F.regexp_extract(bare, "/.*$", 0), "/+$", "")


def neighbours(pages: DataFrame) -> DataFrame:
    """pages (row, host, path) to (row, other): the page of the nearest path of the host, null where the host has one page.

    The order of all pages by host and path is a range sort; each part hands its first and last page to its neighbours,
    so a host of any size is spread over parts.
    """
    placed = pages.repartitionByRange(shuffle_partitions(pages.sparkSession), "host", "path", "row")
    placed = stored(placed.withColumn("part", F.spark_partition_id()), "url-order")
    page = F.struct("host", "path", "row")
    ends = placed.groupBy("part").agg(F.min(page).alias("first"), F.max(page).alias("last"))
    along = Window.orderBy("part")  # one row for each part
    ends = ends.select("part", F.lag("last").over(along).alias("last_before"), F.lead("first").over(along).alias("first_after"))
    within = Window.partitionBy("part").orderBy("host", "path", "row")
    both = placed.withColumn("before", F.lag(page).over(within)).withColumn("after", F.lead(page).over(within)).join(ends, "part")
    both = both.withColumn("before", F.coalesce("before", "last_before")).withColumn("after", F.coalesce("after", "first_after"))

    def alike(side: str) -> Column:
        """Leading path segments in common; -1 in another host, or where there is no page."""
        mine, other = F.split("path", "/"), F.split(F.col(f"{side}.path"), "/")
        same = F.transform(F.sequence(F.lit(0), F.least(F.size(mine), F.size(other)) - 1), lambda k: F.get(mine, k) == F.get(other, k))
        first = F.array_position(same, F.lit(False))
        return F.when(F.col(f"{side}.host") == F.col("host"), F.when(first == 0, F.size(same)).otherwise(first - 1)).otherwise(-1)

    near = F.when(F.greatest(alike("before"), alike("after")) < 0, None).when(alike("before") >= alike("after"), F.col("before.row")).otherwise(F.col("after.row"))
    return both.select("row", near.alias("other"))


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages with text, the main text of each (empty if there is none), in place of a column of that name.

    Null pages count as empty; pages without a URL share an empty host. Rows that are the same in URL and page are
    paired with each other and are copies. All other columns stay. An empty table gives an empty result.
    """
    ship(pages.sparkSession)
    rows = pages.drop("text") if "text" not in (html, url) else pages
    host, path = host_and_path(F.col(url))
    own, row, shared, main = (unused(pages.columns, name) for name in ("_own", "_row", "_lines", "_main"))
    keyed = rows.withColumn(own, F.xxhash64(F.col(url), F.col(html)))

    @F.pandas_udf("array<long>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[h - (1 << 63) for h in _hashes(blocks(x))] for x in batch])

    lines = keyed.select(F.col(own).alias("row"), host.alias("host"), path.alias("path"), F.col(html).alias("h")).dropDuplicates(["row"])
    lines = stored(lines.select("row", "host", "path", hashed("h").alias("lines")), "page-lines")
    pairs = neighbours(lines.select("row", "host", "path"))
    other = pairs.join(lines.select(F.col("row").alias("other"), "lines"), "other", "left").select(F.col("row").alias(row), F.col("lines").alias(shared))

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages_, others in batches:
            out = []
            for x, o in zip(pages_, others, strict=True):
                page = blocks(x)
                out.append(main_text(page, [h - (1 << 63) for h in _hashes(page)], [] if o is None else list(o)))
            yield pd.Series(out, dtype=object)

    found = keyed.join(other, keyed[own] == other[row], "left").withColumn(main, text(F.col(html), F.col(shared)))
    rest = [F.col(f"`{c}`") for c in pages.columns if c != "text"]
    return found.select(*rest, F.col(main).alias("text"))
