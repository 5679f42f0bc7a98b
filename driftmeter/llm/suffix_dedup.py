"""Exact removal of 200-byte strings that occur more than once in a corpus, by suffix sorting.

The suffixes of all texts cannot be sorted in one place, so the windows (strings of ``length`` bytes) are first brought
together by content. Each window is owned by its smallest 64-byte gram, the anchor: equal windows have equal anchors at
equal offsets. A run of windows with one owner covers a short string, its context. Grouped by anchor,

* an anchor that occurs once owns no repeated window;
* a context that occurs twice or more has all its windows repeated;
* what is left, different contexts of one anchor, mostly the edges of shared passages, goes to suffix arrays. A context
  is first trimmed to the bytes around its anchor that another context of the anchor shares on that side at all; what
  is then equal is kept once. The rest is suffix-sorted block by block, by linear grouping (:func:`suffix_array`), and
  windows at neighbouring suffixes are compared byte by byte. A group of contexts too large for one task is spread
  over several, untrimmed, and one too large for a block is cut into several after trimming; the windows of such blocks
  then meet once more by 128-bit digests, counted with map-side combine.

Contexts are told apart by a 64-bit anchor hash together with a 64-bit context digest, texts by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmeter.llm.common import bucketed, ship, shuffle_partitions, stored, unused

LENGTH = 200
GRAM = 64
#: Bytes whose suffixes are sorted together, about.
BLOCK_BYTES = 1 << 17
#: Bytes of contexts of one anchor that one task takes; a larger group is spread, in parts of some BLOCK_BYTES.
GROUP_BYTES = 1 << 23
#: Rows of one batch of results.
_BATCH = 10_000
#: Window starts taken at once in a long text; their positions fit the low bits of a key.
_PIECE = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_M = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def suffix_array(text: bytes) -> list[int]:
    """Start positions of the suffixes of text in lexicographic order (a suffix comes after its own prefixes).

    Groups hold the suffixes that agree in a prefix, in the end their Lyndon prefix. They are taken from the largest
    down. A taken suffix points to the nearest earlier position whose suffix is smaller and not yet taken (its previous
    smaller one); that position's prefix is lengthened by the taken group's prefix, once for each suffix that points
    to it, so it moves to a new group right above its own. In the end the groups are emitted upwards: the suffix before
    each emitted one, and its chain of previous smaller ones, take the next places of their groups.
    """
    n = len(text)
    members: list[set[int]] = [set() for _ in range(256)]
    for i, c in enumerate(text):
        members[c].add(i)
    below = list(range(-1, 255))  # linked list of groups in order
    above = list(range(1, 256)) + [-1]
    group = list(text)
    open_at = list(range(n + 1))  # open_at[i + 1]: leads to the nearest position <= i that is not yet taken, plus 1
    previous = [-1] * n
    now = 255
    while now >= 0:
        if taken := members[now]:
            for s in taken:
                open_at[s + 1] = s
            children: dict[int, int] = {}
            for s in taken:
                p = s
                while open_at[p] != p:
                    open_at[p] = open_at[open_at[p]]
                    p = open_at[p]
                previous[s] = p - 1
                if p:
                    children[p - 1] = children.get(p - 1, 0) + 1
            by_count: dict[int, list[int]] = {}
            for p, k in children.items():
                by_count.setdefault(k, []).append(p)
            for k in sorted(by_count, reverse=True):  # more copies of the larger prefix: a larger group
                moved: dict[int, int] = {}
                for p in by_count[k]:
                    old = group[p]
                    new = moved.get(old)
                    if new is None:
                        new = moved[old] = len(members)
                        members.append(set())
                        below.append(old)
                        above.append(above[old])
                        if above[old] >= 0:
                            below[above[old]] = new
                        above[old] = new
                    members[old].discard(p)
                    members[new].add(p)
                    group[p] = new
        now = below[now]
    place = [0] * len(members)
    at, total = 0, 0
    while at >= 0:
        place[at] = total
        total += len(members[at])
        at = above[at]
    order, placed = [-1] * n, bytearray(n)
    last = n
    for i in range(-1, n):
        j = (order[i] if i >= 0 else last) - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[place[g]] = j
            place[g] += 1
            placed[j] = 1
            j = previous[j]
    return order


def _grow(n: int) -> None:
    if len(_powers[0]) < n:
        inverse = pow(_M, -1, 1 << 64)
        for k, m in enumerate((_M, inverse)):
            steps = np.full(max(n, 1 << 16), m, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)


def _owners(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a piece of text the position of its anchor; the grams' hashes."""
    n = len(raw)
    _grow(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(raw.astype(np.uint64) * _powers[0][:n], out=sums[1:])
    hashes = (sums[gram:] - sums[:-gram]) * _powers[1][: n - gram + 1]
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(29)
    keys = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    wide = length - gram + 1
    padded = np.full(-(-len(keys) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    boxes = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(boxes[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(boxes, axis=1).ravel()
    windows = n - length + 1
    return (np.minimum(ahead[:windows], behind[wide - 1 : wide - 1 + windows]) & _LOW).astype(np.int64), hashes


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Anchor hash, context digest and place of each run of windows with one owner.

    The place packs the run's first window, its number of windows and the anchor's offset in it (12 bits each).
    """
    out: tuple[list, list, list] = ([], [], [])
    for start in range(0, len(raw) - length + 1, _PIECE):
        piece = raw[start : start + _PIECE + length - 1]
        owner, hashes = _owners(np.frombuffer(piece, np.uint8), length, gram)
        lo = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
        count = np.diff(np.append(lo, len(owner)))
        digest = xxhash.xxh3_64_intdigest
        out[0].append(hashes[owner[lo]])
        out[1].extend(digest(piece[a : a + n + length - 1]) for a, n in zip(lo.tolist(), count.tolist(), strict=True))
        out[2].append((lo + start << 24) | (count << 12) | (owner[lo] - lo))
    if not out[0]:
        return np.zeros(0, np.uint64), [], np.zeros(0, np.int64)
    return np.concatenate(out[0]), out[1], np.concatenate(out[2])


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[list, list, list, list] = ([], [], [], [])
            for u, raw in zip(batch["u"].to_pylist(), batch["raw"], strict=True):
                a, c, p = anchors(raw.as_py(), length, gram)
                found[0].append(a.view(np.int64))
                found[1].append(np.array(c, np.uint64).view(np.int64))
                found[2].append(np.full(len(a), u, np.int64))
                found[3].append(p)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=["a", "c", "u", "p"])

    return run


_SPANS = "u long, lo long, n long, a long, salt int, d1 long, d2 long, copies int"


def _agree(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def _reach(parts: list[bytes]) -> list[int]:
    """For each string the longest prefix that it shares with another one."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for x, y in zip(order, order[1:], strict=False):
        k = _agree(parts[x], parts[y])
        out[x], out[y] = max(out[x], k), max(out[y], k)
    return out


def _trimmed(group: list[dict], length: int) -> dict[bytes, list[tuple[dict, int]]]:
    """Contexts of one anchor, cut to what others share, at least a window long: string to its (context, start)."""
    right = _reach([r["seg"][r["o"] :] for r in group])
    left = _reach([r["seg"][: r["o"]][::-1] for r in group])
    out: dict[bytes, list[tuple[dict, int]]] = {}
    for r, a, b in zip(group, left, right, strict=True):
        if a + b >= length:
            out.setdefault(r["seg"][r["o"] - a : r["o"] + b], []).append((r, r["o"] - a))
    return out


_SPANS = pa.schema([("u", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("copies", pa.int32())])


def _sort_blocks(length: int, block_bytes: int):
    """Contexts (a, salt, spread, copies, u, lo, o, seg), sorted by a and salt, to repeated windows.

    A row with null d1 is a run of n windows from lo that are repeated within their block. Each different window of a
    block of a spread group also has a row with its digest (d1, d2), one of its places, and how often it is certain to
    occur, at most 2. A group that is larger than a block when trimmed is spread over blocks here.
    """

    def settle(strings: list[tuple[bytes, bool, list[tuple[dict, int]]]]) -> Iterator[dict]:
        """strings: (bytes, spread, contexts that hold them); windows that two of them share."""
        text = b"".join(s for s, _, _ in strings)
        owner, at, starts = np.full(len(text), -1, np.int32), 0, []
        for k, (s, _, _) in enumerate(strings):
            starts.append(at)
            owner[at : at + len(s) - length + 1] = k
            at += len(s)
        order = np.array(suffix_array(text), np.int64)
        order = order[owner[order] >= 0].tolist()
        repeated: list[list[int]] = [[] for _ in strings]
        i = 0
        while i < len(order):
            window, j = text[order[i] : order[i] + length], i + 1
            while j < len(order) and text[order[j] : order[j] + length] == window:
                j += 1
            held = [(owner[p], p - starts[owner[p]]) for p in order[i:j]]
            certain = sum(r["copies"] for k, _ in held for r, _ in strings[k][2])
            if certain > 1:
                for k, at in held:
                    repeated[k].append(at)
            k, at = held[0]
            if strings[k][1]:
                digest = np.frombuffer(hashlib.blake2b(window, digest_size=16).digest(), np.int64).tolist()
                r, start = strings[k][2][0]
                yield {"u": r["u"], "lo": r["lo"] + start + at, "n": 1, "d1": digest[0], "d2": digest[1], "copies": min(certain, 2)}
            i = j
        for (_, _, holders), places in zip(strings, repeated, strict=True):
            if places:
                places = np.sort(np.array(places, np.int64))
                for run in np.split(places, np.flatnonzero(np.diff(places) != 1) + 1):
                    for r, start in holders:
                        yield {"u": r["u"], "lo": r["lo"] + start + int(run[0]), "n": len(run), "d1": None, "d2": None, "copies": 0}

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        group: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if group and (row["a"], row["salt"]) != (group[0]["a"], group[0]["salt"]):
                    yield group
                    group = []
                group.append(row)
        if group:
            yield group

    def sent(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
        for some in batched(rows, _BATCH):
            yield pa.RecordBatch.from_pylist(list(some), schema=_SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[bytes, bool, list[tuple[dict, int]]]] = []
        size = 0
        for group in groups(batches):
            if spread := group[0]["spread"]:
                strings = [(r["seg"], [(r, 0)]) for r in group]
            else:
                strings = list(_trimmed(group, length).items())
                if len(strings) == 1:  # one string that several contexts hold
                    s, holders = strings.pop()
                    if len(holders) > 1:
                        yield from sent({"u": r["u"], "lo": r["lo"] + start, "n": len(s) - length + 1, "d1": None, "d2": None, "copies": 0} for r, start in holders)
                spread = sum(len(s) for s, _ in strings) > block_bytes
            for s, holders in strings:
                waiting.append((s, spread, holders))
                size += len(s)
                if spread and size >= block_bytes:
                    yield from sent(settle(waiting))
                    waiting, size = [], 0
            if size >= block_bytes:
                yield from sent(settle(waiting))
                waiting, size = [], 0
        if waiting:
            yield from sent(settle(waiting))

    return run


def repeated_windows(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Runs (u, lo, n) of n windows from byte lo of text u that occur elsewhere too. texts: u (unique), raw."""
    spark = texts.sparkSession
    place = [F.shiftright("p", 24).alias("lo"), F.shiftright("p", 12).bitwiseAND(F.lit(4095)).alias("n"), F.col("p").bitwiseAND(F.lit(4095)).cast("int").alias("o")]
    found = texts.select("u", "raw").filter(F.octet_length("raw") >= length).mapInArrow(_anchor_rows(length, gram), "a long, c long, u long, p long")
    found = stored(found, "anchors")
    # stored: of a join of two tables, not of a count, the planner can split the rows of one anchor
    often = stored(found.groupBy("a").count().filter("count > 1").select("a"), "repeated-anchors")
    shared = stored(found.join(often, "a"), "shared")
    kinds = shared.groupBy("a", "c").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("copies"), F.min(F.struct("u", "p")).alias("x"))
    kinds = stored(kinds.select("a", "c", "copies", "x.u", "x.p"), "contexts")
    whole = shared.join(kinds.filter("copies = 2").select("a", "c"), ["a", "c"], "left_semi").select("u", *place[:2])
    size = F.sum(F.shiftright("p", 12).bitwiseAND(F.lit(4095)) + (length - 1))
    groups = kinds.groupBy("a").agg(F.count("*").alias("kinds"), F.when(size > group_bytes, F.ceil(size / min(block_bytes, group_bytes))).otherwise(1).cast("int").alias("blocks")).filter("kinds > 1").select("a", "blocks")
    left = kinds.join(groups, "a").withColumn("salt", F.pmod(F.xxhash64("u", "p"), F.col("blocks")).cast("int")).select("a", "blocks", "salt", "copies", "u", *place)
    seg = F.expr(f"substring(raw, int(lo + 1), int(n + {length - 1}))").alias("seg")
    seg = left.join(texts.select("u", "raw"), "u").select("a", "salt", (F.col("blocks") > 1).alias("spread"), "copies", "u", "lo", "o", seg)
    dealt = seg.repartition(shuffle_partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", "u", "lo")
    settled = stored(dealt.mapInArrow(_sort_blocks(length, block_bytes), "u long, lo long, n long, d1 long, d2 long, copies int"), "settled")
    spread = settled.filter("d1 is not null")
    met = spread.groupBy("d1", "d2").agg(F.sum("copies").alias("all")).filter("all > 1").select("d1", "d2")
    met = spread.join(met, ["d1", "d2"], "left_semi").select("u", "lo", "n")
    return whole.union(settled.filter("d1 is null").select("u", "lo", "n")).union(met)


def _cut(length: int):
    """Texts with their runs of repeated windows to what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("u", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
        for batch in batches:
            out = []
            for u, raw, copies, runs in zip(batch["u"].to_pylist(), batch["raw"], batch["copies"].to_pylist(), batch["runs"].to_pylist(), strict=True):
                raw = raw.as_py()
                if copies > 1 and len(raw) >= length:
                    spans = [(0, len(raw))]
                else:
                    spans = []
                    for lo, n in sorted((r["lo"], r["n"]) for r in runs or []):
                        if spans and lo <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(spans[-1][1], lo + n + length - 1))
                        else:
                            spans.append((lo, lo + n + length - 1))
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append({"u": u, "n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(spans), "kept": kept})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return run


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary) in place of the text.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same or another text, is
    removed; overlapping strings count, all occurrences go, and all are judged on the input. Null texts count as empty;
    shorter texts stay whole. Repeated rows are copies of each other. Columns named n_bytes, n_removed, n_spans or kept
    are replaced; all others stay. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    docs = docs.drop(*({"n_bytes", "n_removed", "n_spans", "kept"} - {text}))
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    own, found = unused(docs.columns, "_u"), unused(docs.columns, "_text")
    index = stored(docs.select(*rest, F.xxhash64(raw).alias(own)), "index")
    texts = docs.select(F.xxhash64(raw).alias("u"), raw.alias("raw")).groupBy("u").agg(F.count("*").alias("copies"), F.first("raw").alias("raw"))
    texts = bucketed(texts, "u", "texts")  # joined twice by u, so laid out by u: its texts move once
    runs = repeated_windows(texts, length, gram, block_bytes, group_bytes).groupBy("u").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    cut = texts.join(runs.hint("shuffle_hash"), "u", "left").select("u", "raw", "copies", "runs").mapInArrow(_cut(length), "u long, n_bytes long, n_removed long, n_spans long, kept binary")
    cut = cut.withColumnRenamed("u", found)
    return index.join(cut, index[own] == cut[found]).drop(own, found)
