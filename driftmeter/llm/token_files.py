"""Token ids in word-aligned files (Simple-8b), in the order of the documents.

A file is a sequence of segments, each a document's ids or a part of them:

    magic "S8b1", then little-endian: document key (int64), has key (uint8), last segment of its document (uint8),
    number of ids (uint32), of blocks (uint32), of words (uint32), of escapes (uint32); then
    block offsets (uint32 each: index of the block's first word), words (uint64), escapes (uint64)

Ids are coded in blocks of BLOCK; each block starts with a word of its own, so that blocks are independent of each other
and all are decoded side by side. A word holds a selector (4 bits, lowest) and as many ids as the selector says, of the
same number of bits, from low to high. The selector 15 stands for one id that is in the list of escapes, at the index
which the word holds. Segments are separated by one newline byte, which readers skip.

The files are written by Spark's text sink and read by its binary file source, so they go to any storage that Spark
reaches, and a task that is run again leaves one file.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from driftmeter.llm.common import ship, shuffle_partitions, stored, work_folder

MAGIC = b"S8b1"
HEADER = struct.Struct("<4sqBBIIII")
BLOCK = 128
#: Selector to (ids, bits of each) in a word of 60 payload bits.
PACKINGS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
#: Ids in a segment at most; longer documents take several.
SEGMENT = 1 << 19
#: Ids coded or decoded together, about.
TOGETHER = 1 << 18
#: Bytes of the texts that are split into words together, about.
TEXT_BYTES = 4 << 20
CACHED_WORDS = 800_000
#: Bytes of the texts of one file, about.
FILE_BYTES = 128 << 20

_COUNTS = np.array([n for n, _ in PACKINGS] + [0, 1], np.int64)


def pack(parts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Block offsets, words and escapes of each array of unsigned 64-bit ids.

    All blocks of all arrays advance together, one word at a time.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(blocks) - blocks
    index = np.arange(int(blocks.sum()))
    of = np.repeat(np.arange(len(parts)), blocks)
    ends = np.minimum(BLOCK, sizes[of] - (index - first[of]) * BLOCK)
    # rows are padded with zeros: the last word of a block may be filled up with them and never reaches the next block
    table = np.zeros((len(index), BLOCK + PACKINGS[0][0]), np.uint64)
    table[:, :BLOCK][np.arange(BLOCK) < ends[:, None]] = np.concatenate([np.zeros(0, np.uint64), *parts])
    width = np.frexp(table.astype(np.float64))[1].astype(np.uint8)  # rounding may add a bit, which does no harm
    fits = np.full((len(index), BLOCK), len(PACKINGS) - 1, np.int8)
    largest = width[:, :BLOCK].copy()  # of the next 1, 2, 3, ... ids
    selectors = {count: s for s, (count, _) in enumerate(PACKINGS)}
    for count in range(2, PACKINGS[0][0] + 1):
        np.maximum(largest, width[:, count - 1 : count - 1 + BLOCK], out=largest)
        if count in selectors:
            np.copyto(fits, selectors[count], where=largest <= PACKINGS[selectors[count]][1])
    fits[table[:, :BLOCK] >> np.uint64(60) != 0] = ESCAPE
    places, owners, chosen = [index[:0]], [index[:0]], [index[:0]]
    at, live = np.zeros(len(index), np.int64), index
    while len(live):
        place = at[live]
        s = fits[live, place].astype(np.int64)
        owners.append(live)
        places.append(place)
        chosen.append(s)
        at[live] = place = place + _COUNTS[s]
        live = live[place < ends[live]]
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    owner, place, chosen = owner[order], np.concatenate(places)[order], np.concatenate(chosen)[order]
    packed = chosen.astype(np.uint64)
    for s in np.unique(chosen):
        if s != ESCAPE:
            of_s = np.flatnonzero(chosen == s)
            rows, first_id, word = owner[of_s], place[of_s], packed[of_s]
            for k in range(PACKINGS[s][0]):
                word |= table[rows, first_id + k] << np.uint64(4 + k * PACKINGS[s][1])
            packed[of_s] = word
    starts = np.searchsorted(owner, np.arange(len(index) + 1))
    large = (fits == ESCAPE).any(axis=1)
    for k, part in enumerate(parts):
        cut = starts[first[k] : first[k] + blocks[k] + 1]
        own = packed[cut[0] : cut[-1]] if blocks[k] else packed[:0]
        escapes = packed[:0]
        if large[first[k] : first[k] + blocks[k]].any():
            odd = np.flatnonzero(own & np.uint64(15) == ESCAPE)
            own[odd] |= np.arange(len(odd), dtype=np.uint64) << np.uint64(4)
            escapes = part[part >= 1 << 60].astype(np.uint64)
        yield (cut[:-1] - cut[0] if blocks[k] else cut[:0]).astype(np.uint32), own, escapes


def unpack(parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """The ids of each (number of ids, block offsets, words, escapes), all words of all parts side by side.

    The number of ids in a word follows from its selector, so the place of every word's ids is known at once.
    """
    sizes = np.array([p[0] for p in parts], np.int64)
    blocks = np.array([len(p[1]) for p in parts], np.int64)
    lengths = np.array([len(p[2]) for p in parts], np.int64)
    marks = np.cumsum([len(p[3]) for p in parts]) - [len(p[3]) for p in parts]
    words = np.concatenate([np.zeros(0, np.uint64), *[p[2] for p in parts]])
    escapes = np.concatenate([np.zeros(0, np.uint64), *[p[3] for p in parts]])
    first = np.concatenate([np.zeros(0, np.int64), *[p[1].astype(np.int64) + o for p, o in zip(parts, np.cumsum(lengths) - lengths, strict=True)]])
    of = np.repeat(np.arange(len(parts)), blocks)
    within = np.arange(len(of)) - (np.cumsum(blocks) - blocks)[of]
    ends = np.minimum(BLOCK, sizes[of] - within * BLOCK)
    block = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))
    selector = (words & np.uint64(15)).astype(np.int64)
    counts = _COUNTS[selector]
    before = np.cumsum(counts) - counts
    place = before - before[first][block] if len(words) else before
    out = np.zeros((len(first), BLOCK + PACKINGS[0][0]), np.uint64)
    for s in np.unique(selector):
        at = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[block[at], place[at]] = escapes[(words[at] >> np.uint64(4)).astype(np.int64) + marks[of[block[at]]]]
            continue
        count, bits = PACKINGS[s]
        for k in range(count):
            out[block[at], place[at] + k] |= words[at] >> np.uint64(4 + k * bits) & np.uint64((1 << bits) - 1)
    flat = out[:, :BLOCK][np.arange(BLOCK) < ends[:, None]]
    yield from np.split(flat, np.cumsum(sizes)[:-1]) if len(parts) else []


def segments(documents: list[tuple[int | None, np.ndarray]]) -> Iterator[bytes]:
    cuts = [(key, ids[a : a + SEGMENT], a + SEGMENT >= len(ids)) for key, ids in documents for a in range(0, max(1, len(ids)), SEGMENT)]
    for (key, ids, last), (offsets, words, escapes) in zip(cuts, pack([ids for _, ids, _ in cuts]), strict=True):
        head = HEADER.pack(MAGIC, key or 0, key is not None, last, len(ids), len(offsets), len(words), len(escapes))
        yield head + offsets.astype("<u4").tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def read_segments(raw: bytes) -> Iterator[tuple[int | None, bool, np.ndarray]]:
    """Key, whether the document ends, and ids of each segment of a file."""
    at, heads, parts, size = 0, [], [], 0
    while at < len(raw):
        magic, key, has, last, n, blocks, words, escapes = HEADER.unpack_from(raw, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += HEADER.size
        found: list = [n]
        for kind, count in (("<u4", blocks), ("<u8", words), ("<u8", escapes)):
            found.append(np.frombuffer(raw, kind, count, at))
            at += found[-1].nbytes
        at += 1  # the newline
        heads.append((key if has else None, bool(last)))
        parts.append(tuple(found))
        size += n
        if size >= TOGETHER or at >= len(raw):
            for (key, last), ids in zip(heads, unpack(parts), strict=True):
                yield key, last, ids
            heads, parts, size = [], [], 0


#: What stands between words while many are learnt: no tokenizer has this id.
_BETWEEN = b"\xff\xff\xff\xff"
_LATIN = re.compile("[\\x21-\\x7e\\xa1-\\xac\\xae-\\u024f]+").fullmatch


class Words:
    """Ids of texts by a tokenizer that drops white space, and so gives a text what it gives its words one by one.

    Words of Latin letters are put in lower case, which is all that the tokenizer's normalizer does to them, and parted by
    the tokenizer's own pattern, many at a time. The ids of frequent words and parts are kept, as bytes (32 bits each). New
    parts go to the tokenizer's model one by one, in the letters by which it shows bytes.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        rules = json.loads(self.tokenizer.pre_tokenizer.__getstate__())["pretokenizers"]
        self.parts = regex.compile(rules[0]["pattern"]["Regex"] + "| ").findall
        self.model = self.tokenizer.model.tokenize
        self.shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.raw_ids = [k.to_bytes(4, "little") for k in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.known: dict[bytes, bytes] = {}
        self.known_parts: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a binary array. Each distinct word is looked up once; the rest goes by its number."""
        split = pc.ascii_split_whitespace(texts.fill_null(b"").view(pa.string()))
        coded = split.values.dictionary_encode()
        words = coded.dictionary.view(pa.binary()).to_pylist()
        known = self.known
        known[b""] = b""  # before the first and behind the last white space
        new = [w for w in words if w not in known]
        for at in range(0, len(new), 50_000):
            self._learn(new[at : at + 50_000])
        found = [known[w] for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        number = coded.indices.to_numpy()
        n = sizes[number]
        ends = np.append(0, np.cumsum(n))
        shift = (np.cumsum(sizes) - sizes)[number] - ends[:-1]
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(shift, n) + np.arange(ends[-1])]
        cuts = ends[split.offsets.to_numpy()].tolist()
        out = [ids[a:b] for a, b in pairwise(cuts)]
        if len(known) > CACHED_WORDS:
            for w in new:
                del known[w]
        return out

    def _learn(self, new: list[bytes]) -> None:
        text = b" ".join(new).decode()
        if not _LATIN(text.replace(" ", "")):
            # in Latin letters, pattern and lower case mean the same here as in the tokenizer; other words go to it one by one
            odd = [w for w in new if not _LATIN(w.decode())]
            self.known.update((w, self._ids(w.decode()).tobytes()) for w in odd)
            new = list(set(new).difference(odd))
            text = b" ".join(new).decode()
        if not new:
            return
        parts = self.parts(text.lower())
        known = self.known_parts
        known[" "] = _BETWEEN
        fresh = list(set(parts).difference(known))
        self._encode_parts(fresh)
        raw = b"".join(map(known.__getitem__, parts))
        cuts = np.flatnonzero(np.frombuffer(raw, "<u4") == 0xFFFFFFFF) * 4
        starts, ends = [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)]
        self.known.update(zip(new, map(raw.__getitem__, map(slice, starts, ends)), strict=True))
        if len(known) > CACHED_WORDS:
            for p in fresh:
                del known[p]

    def _ids(self, text: str) -> np.ndarray:
        (coded,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(coded.ids, "<u4")

    def _encode_parts(self, parts: list[str]) -> None:
        raw, model, known = self.raw_ids, self.model, self.known_parts
        for part in filter(str.isascii, parts):  # whose letters show themselves
            known[part] = b"".join([raw[token.id] for token in model(part)])
        if odd := [p for p in parts if not p.isascii()]:
            shown = self.shown("\n".join(odd))[0][0].split(self.shown("\n")[0][0])
            for part, letters in zip(odd, shown, strict=True):
                known[part] = b"".join([raw[token.id] for token in model(letters)])


_coders: dict[str, Words] = {}


def _encode(path: str, end: int):
    last = np.array([end], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _coders:
            _coders[path] = Words(path)
        for batch in batches:
            some: list[tuple[int | None, np.ndarray]] = []
            size = 0
            before = np.cumsum(pc.binary_length(batch["raw"]).fill_null(0).to_numpy().astype(np.int64)) // TEXT_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(batch)]
            for at, stop in pairwise(cuts):
                part = batch.slice(at, stop - at)
                for key, ids in zip(part["id"].to_pylist(), _coders[path].encode(part["raw"]), strict=True):
                    some.append((key, np.concatenate([ids, last])))
                    size += len(ids)
                    if size >= TOGETHER:
                        yield pa.RecordBatch.from_arrays([pa.array(segments(some), pa.binary())], names=["value"])
                        some, size = [], 0
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(segments(some), pa.binary())], names=["value"])
        pa.default_memory_pool().release_unused()  # the worker stays, and so would what its batches took

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int, text: str = "text", id_col: str = "doc_id") -> None:
    """The ids of all texts, each with the id ``end`` behind it, as files below path in ascending order of the ids.

    Null texts count as empty. Rows without an id come first; rows of one id are in the order of their texts' hashes, so
    that a range sort may deal them to several tasks. Files are parts of this sort, so the order of names is the order of
    documents. Their number grows with the bytes of all texts, as each is later read as one row.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = max(shuffle_partitions(docs.sparkSession), -(-size // FILE_BYTES))
    mixed = F.xxhash64("text")
    dealt = rows.repartitionByRange(files, F.col("id"), mixed).sortWithinPartitions(F.col("id"), mixed, F.col("text"))
    coded = dealt.select("id", F.col("text").cast("binary").alias("raw")).mapInArrow(_encode(tokenizer, end), "value binary")
    coded.select(F.col("value").cast("string")).write.text(path)  # a cast keeps the bytes; the sink writes them as they are


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name, raw in zip(batch["path"], batch["content"], strict=True):
            out, before, n, crc, place = [], 0, 0, 0, 0
            for key, last, ids in read_segments(raw):
                n += len(ids)
                crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                if last:
                    out.append((name.rpartition("/")[2], place, key, before, n, crc))
                    before, n, crc, place = before + n, 0, 0, place + 1
            frame = pd.DataFrame(out, columns=["file", "place", "id", "before", "n_tokens", "ids_crc32"])
            yield frame.assign(id=frame["id"].astype("Int64"))


def read_tokens(spark, path: str) -> DataFrame:
    """One row for each document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    found = stored(files.mapInPandas(_digest, "file string, place long, id long, before long, n_tokens long, ids_crc32 long"), "tokens")
    sums = found.groupBy("file").agg(F.sum("n_tokens").alias("ids"))  # one row for each file
    base = sums.select("file", (F.sum("ids").over(Window.orderBy("file")) - F.col("ids")).alias("base"))
    return found.join(base, "file").select("id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Writes the files to the shared work folder and returns what is read from them; an empty table gives no rows."""
    path = work_folder(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer, end, text, id_col)
    return read_tokens(docs.sparkSession, path).withColumnRenamed("id", id_col)
