"""Spelling variants: words one edit apart, found by a frontier of states that walks a trie held as an edge table.

The trie of the vocabulary, and that of its words reversed, is a distributed table of edges (parent, first character,
label, child). Nodes are prefixes that branch or end a word; chains between them are one edge, so levels count branchings
and not characters. Nodes are named by 128-bit digests of their prefix.

A state (word, position, node, edits) says that the path to the node equals the first characters of the word but for its
edits. Two words that are one edit apart part where their common prefix ends, and this place is a node. So the frontier
starts with the nodes on each word's own path, edits 0; one step spends the edit there: it replaces the next character,
inserts one, or skips the word's own. From then on each level joins the states with the edges by node and next character
and keeps those whose label the word goes on with, until none is left. States that end with their word at the end of
another word are neighbours.

Where the edit lies in a word's first half, the two words share their second half. So the trie starts at the middle of
each word, and the reversed trie at the middle from the other end: near the root, where nodes have many edges, no edit
is tried.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmeter.llm.common import ship, stored

LEAST_CHARS = 6
LEAST_COUNT = 5
RATIO = 5
#: Of the words of documents, those whose CRC-32 with the document's id this number divides lose a character.
THINNED = 199
#: Different words that a task counts before it hands its counts on.
COUNTED = 200_000
#: Letters a-z and U+00C0 to U+00FF as UTF-8.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")


def _shortened(word: bytes, h: int) -> bytes:
    spelt = word.decode()
    at = h % len(spelt)
    return (spelt[:at] + spelt[at + 1 :]).encode()


def word_counts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", thinned: int | None = THINNED) -> DataFrame:
    """(word, n) of the letter runs of all texts, A-Z lowered.

    With thinned, runs whose CRC-32 of ``<id>:<run>`` it divides lose the character at that number modulo their length;
    rows without an id lose none. Null and empty texts have no words.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(counted: Counter) -> pa.RecordBatch:
            held = [(w, n) for w, n in counted.items() if n and w]
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in held], pa.string()), pa.array([n for _, n in held], pa.int64())], ["word", "n"])

        seen, crc = Counter(), zlib.crc32
        for rows in batches:
            for key, raw in zip(rows.column(0), rows.column(1), strict=True):
                raw, key = raw.as_py(), key.as_py()
                if not raw:
                    continue
                found = _RUN.findall(raw.lower())
                seen.update(found)
                if thinned and key is not None:
                    state = crc(f"{key}:".encode())
                    for word in [w for w in found if not crc(w, state) % thinned]:
                        seen[word] -= 1
                        seen[_shortened(word, crc(word, state))] += 1
                if len(seen) > COUNTED:
                    yield batch(seen)
                    seen = Counter()
        yield batch(seen)

    parts = docs.select(F.col(id_col).cast("string"), F.col(text).cast("binary")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _paths(spelt: DataFrame) -> DataFrame:
    """(id, back, depth, node, next) for every prefix of spelt (id, back, s); next is null for whole words."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("back", pa.bool_()), ("depth", pa.int32()), ("node", pa.binary()), ("next", pa.string())])

        def batch(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

        out: list = []
        for rows in batches:
            for r in rows.to_pylist():
                key, back, s = r["id"], r["back"], r["s"]
                digest = blake2b(b"\1" if back else b"\0", digest_size=16)
                for depth, c in enumerate(s):
                    out.append((key, back, depth, digest.digest(), c))
                    digest.update(c.encode())
                    if len(out) >= 10_000:
                        yield batch(out)
                        out = []
                out.append((key, back, len(s), digest.digest(), None))
        if out:
            yield batch(out)

    return spelt.mapInArrow(prefixes, "id long, back boolean, depth int, node binary, next string")


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of words (id, word): the edges (parent, first, label, child, end_id) of both tries, and the nodes on each word's
    own paths (id, back, depth, node, end_id). end_id is the word that ends at the child or node, if any."""
    spelt = words.select("id", F.lit(False).alias("back"), F.col("word").alias("s")).union(words.select("id", F.lit(True), F.reverse("word")))
    paths = stored(_paths(spelt), "paths")
    nodes = paths.groupBy("node").agg(F.min("next").alias("lo"), F.max("next").alias("hi"), F.min("depth").alias("at"), F.max(F.when(F.col("next").isNull(), F.col("id"))).alias("end_id"))
    nodes = nodes.filter("lo <> hi or end_id is not null or at = 0").select("node", "end_id")
    own = stored(paths.drop("next").join(nodes, "node"), "nodes")
    # a window over the nodes of one word
    along = Window.partitionBy("id", "back").orderBy("depth")
    steps = own.select("id", "back", "depth", F.col("node").alias("parent"), *[F.lead(c).over(along).alias(to) for c, to in (("node", "child"), ("depth", "to"), ("end_id", "end_id"))])
    # every word below a node spells the edge to it alike
    edges = steps.filter("child is not null").groupBy("parent", "child", "back", "depth", "to", "end_id").agg(F.min("id").alias("id"))
    label = F.substr("s", F.col("depth") + 1, F.col("to") - F.col("depth"))
    edges = edges.join(spelt, ["id", "back"]).select("parent", label.alias("label"), "child", F.col("end_id").alias("child_end"))
    return stored(edges.withColumn("first", F.left("label", F.lit(1))), "edges"), own


def neighbours(words: DataFrame) -> DataFrame:
    """(id, near_id): all pairs of different words of words (id, word) that are one edit apart, in both orders.

    Edits insert, delete or replace one character (code point). Words must be distinct.
    """
    ship(words.sparkSession)
    edges, own = trie(words)
    spelt = words.select("id", F.col("word").alias("s"), F.length("word").alias("size"))
    half = F.floor(F.col("size") / 2).cast("int")
    start = own.join(spelt, "id").filter(F.col("depth") >= F.when(F.col("back"), F.col("size") - half).otherwise(half))
    start = start.withColumn("s", F.when(F.col("back"), F.reverse("s")).otherwise(F.col("s")))
    at = lambda pos, count: F.substr("s", pos + 1, count)
    depth, size, labelled = F.col("depth"), F.col("size"), F.length("label")
    tail = F.substr("label", F.lit(2))

    # the edit: leave the own path by another edge, or skip the own character
    left = start.join(edges, start["node"] == edges["parent"]).filter(F.col("first") != at(depth, F.lit(1)))
    moves = F.array(
        F.when((depth + labelled <= size) & (at(depth + 1, labelled - 1) == tail), depth + labelled),
        F.when((depth + labelled - 1 <= size) & (at(depth, labelled - 1) == tail), depth + labelled - 1),
    )
    left = left.select("id", "s", "size", F.explode(moves).alias("pos"), F.col("child").alias("node"), F.col("child_end").alias("end_id")).filter("pos is not null")
    skipped = start.filter(depth < size).select("id", "s", "size", (depth + 1).alias("pos"), "node", "end_id")
    frontier = stored(left.unionByName(skipped), "frontier")
    found = []
    while not frontier.isEmpty():
        found.append(frontier.filter("pos = size and end_id is not null and end_id <> id").select("id", F.col("end_id").alias("near_id")))
        pos = F.col("pos")
        ahead = frontier.filter("pos < size").withColumn("first", at(pos, F.lit(1)))
        on = ahead.join(edges, (ahead["node"] == edges["parent"]) & (ahead["first"] == edges["first"])).filter((pos + labelled <= size) & (at(pos, labelled) == F.col("label")))
        frontier = stored(on.select("id", "s", "size", (pos + labelled).alias("pos"), F.col("child").alias("node"), F.col("child_end").alias("end_id")), "frontier")
    pairs = words.sparkSession.createDataFrame([], "id long, near_id long")
    for level in found:
        pairs = pairs.union(level)
    return pairs.distinct()


def _rooted(forms: DataFrame) -> DataFrame:
    """forms (id, form_id) with root_id: where following the forms ends; pointers double each round."""
    now = stored(forms.select("id", F.coalesce("form_id", "id").alias("root_id")), "roots")
    while True:
        on = now.select(F.col("id").alias("root_id"), F.col("root_id").alias("next_id"))
        moved = stored(now.join(on, "root_id").select("id", F.col("next_id").alias("root_id"), (F.col("next_id") != F.col("root_id")).alias("moved")), "roots")
        now = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return now


def variants(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT,
    ratio: int = RATIO, thinned: int | None = THINNED,
) -> DataFrame:
    """One row (word, form, root, n, n_near, form_n) for each word of at least least_chars characters that occurs at
    least least_count times.

    form is the near word of the largest n, of ties the smallest by code points, if its n is at least ratio times the
    word's, else null; as n grows along forms, following them ends, at root. Null, empty and white texts hold no words;
    repeated rows count each; a table without words gives no rows. Other columns of docs are not read.
    """
    counts = word_counts(docs, text, id_col, thinned).filter((F.col("n") >= least_count) & (F.length("word") >= least_chars))
    words = stored(stored(counts, "counts").withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = neighbours(words.select("id", "word"))
    other = words.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best: Column = F.min(F.struct((-F.col("near_n")).alias("m"), "near", "near_id"))
    near = pairs.join(other, "near_id").groupBy("id").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(near, "id", "left")
    takes = -F.col("best.m") >= ratio * F.col("n")
    known = stored(
        known.select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.m")).alias("form_n"), F.when(takes, F.col("best.near_id")).alias("form_id"),
        ),
        "forms",
    )
    roots = _rooted(known.select("id", "form_id")).join(words.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id")
    return known.join(roots, "id").select("word", "form", "root", "n", "n_near", "form_n")
