"""Mixing sources to target weights, in blocks of words.

The words of each source form one stream, document after document, cut into blocks of a fixed length. The mix is a
sequence of slots, dealt into shards. Per shard the sources' numbers of slots are drawn: the whole part of each expected
count is fixed and the rest is multinomial, so that totals stay near their targets. The slots of a source are numbered
over all shards; slot j takes block perm_e(j mod n) of the source's n blocks, where e = j div n counts how often the
source has been gone through and perm_e is a pseudorandom permutation of the indices (a Feistel network, walked until
the index is below n). Slots and blocks then meet by (source, block).

Nothing is drawn from a random state: all draws are hashes of a seed and their place, so reruns and lost tasks agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmeter.llm.common import ship, stored, unused

#: Weights of the sources in the order of their names (code points), null last, repeating.
WEIGHTS = (5, 2, 1)
#: A source is gone through at most this often.
MOST = 3
BLOCK = 64
SHARD_SLOTS = 4096
SEED = 7
#: Documents of a source that one task brings into order, about.
ORDERED = 20_000
_ROUNDS = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each source of sizes (source, size): source_size and target.

    Targets share the sum of all sizes by weight; none is above ``most`` times its source, and what is cut off is shared
    again by weight. That is min(most * size, level * weight) with the one level at which targets add up to the sum:
    with sources in the order of most * size / weight, the first k are full and the level follows from the rest.
    The windows have one row for each source.
    """
    per = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at + 1).cast("double")).withColumn("cap", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight).withColumn("at", F.row_number().over(order))
    open_ = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("at", "level"))
    level = F.min(open_).over(whole)["level"]  # the level where the first source is not full holds for all
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def _uniform(seed: int, *places: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on the seed and the places only."""
    x = np.full(np.broadcast(*places).shape, seed, np.uint64)
    for p in places:
        x = _mix(x ^ (p.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """perm_key(index) within 0 .. n - 1: a bijection for each n and key."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2)).astype(np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    out, key = index.astype(np.uint64).copy(), key.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> bits[todo], out[todo] & low[todo]
        for r in range(_ROUNDS):
            left, right = right, left ^ (_mix(right ^ _mix(key[todo] + np.uint64(r))) & low[todo])
        out[todo] = left << bits[todo] | right
        todo[todo] = out[todo] >= n[todo].astype(np.uint64)  # outside: walk on along the cycle
    return out.astype(np.int64)


def _streams(units: DataFrame) -> DataFrame:
    """units (row, source, size, copies) with the place of its first word in the stream of its source (start).

    Units are ordered by a hash bucket of the row and then by the row; buckets keep every window small, however large a
    source is.
    """
    rows = units.groupBy("source").agg(F.count("*").alias("rows")).alias("r")
    bucket = F.pmod(F.xxhash64(F.lit(SEED), "u.row"), F.ceil(F.col("rows") / ORDERED)).alias("bucket")
    many = units.alias("u").join(rows, F.col("u.source").eqNullSafe(F.col("r.source"))).select("u.*", bucket)
    many = stored(many, "bucketed")
    words = F.col("size") * F.col("copies")
    base = many.groupBy("source", "bucket").agg(F.sum(words).alias("words"))
    base = base.withColumn("base", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).alias("b")
    inside = F.sum(words).over(Window.partitionBy("source", "bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) - words
    many = many.withColumn("inside", inside).alias("m")
    found = many.join(base, F.col("m.source").eqNullSafe(F.col("b.source")) & (F.col("m.bucket") == F.col("b.bucket")))
    return found.select("m.row", "m.id", "m.source", "m.size", "m.copies", (F.col("base") + F.col("inside")).alias("start"))


def _draws(share: np.ndarray, slots: int, shard_slots: int, seed: int):
    """Shard numbers to the number of slots of each source: expected whole parts, and the rest multinomial.

    share: expected slots of each source. The multinomial is drawn slot by slot from hashes of (seed, shard, slot).
    """
    shares = share / share.sum() if len(share) else share

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["shard"]:
                size = min(shard_slots, slots - shard * shard_slots)
                expected = shares * size
                counts = np.floor(expected + 1e-9).astype(np.int64)
                rest = int(size - counts.sum())
                if rest > 0:
                    part = np.maximum(expected - counts, 0)
                    at = np.cumsum(part if part.sum() > 0 else shares)
                    u = _uniform(seed, np.full(rest, shard), np.arange(rest)) * at[-1]
                    counts += np.bincount(np.minimum(np.searchsorted(at, u, "right"), len(at) - 1), minlength=len(counts))
                yield pd.DataFrame({"source_no": np.arange(len(counts)), "shard": shard, "slots": counts})

    return run


def slots(per: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, most: int = MOST) -> DataFrame:
    """The slots of the mix: shard, source, epoch and block. per: the rows of targets().

    A source is gone through at most ``most`` times; slots drawn beyond that, no more than the draw's noise, are left
    out. The table of sources (one row each) is what the driver and each task hold.
    """
    spark = per.sparkSession
    found = per.filter("source_size > 0").select("source", "source_size", "target").orderBy(F.col("source").asc_nulls_last()).collect()
    size = np.array([r["source_size"] for r in found], np.float64)
    blocks = -(-size.astype(np.int64) // block)
    # a stream's last block may be shorter: a slot is worth the mean of its source's blocks
    share = np.array([r["target"] for r in found], np.float64) / (size / blocks)
    total = int(np.ceil(share.sum() - 1e-6))
    names = spark.createDataFrame([(k, r["source"], int(n)) for k, (r, n) in enumerate(zip(found, blocks, strict=True))], "source_no long, source string, blocks long")
    shards = spark.range(-(-total // shard_slots)).withColumnRenamed("id", "shard")
    drawn = shards.mapInPandas(_draws(share, total, shard_slots, seed), "source_no long, shard long, slots long")
    drawn = stored(drawn, "draws")  # one row for each shard and source
    first = F.sum("slots").over(Window.partitionBy("source_no").orderBy("shard")) - F.col("slots")
    numbered = drawn.withColumn("first", first).join(names, "source_no").filter("slots > 0")

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                j = np.arange(r.first, min(r.first + r.slots, r.blocks * most), dtype=np.int64)
                epoch = j // r.blocks
                key = _mix(_mix(epoch.astype(np.uint64) + np.uint64(r.source_no << 32)) ^ np.uint64(seed))
                at = permuted(j % r.blocks, np.full(len(j), r.blocks), key)
                yield pd.DataFrame({"shard": r.shard, "source": r.source, "epoch": epoch, "block": at})

    return numbered.select("shard", "source_no", "source", "first", "slots", "blocks").mapInPandas(placed, "shard long, source string, epoch long, block long")


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, sources, pieces): the mix of all documents.

    units has one row for each row of docs: row (hash of id, source and text), copy (numbers rows that are the same in
    these), id, source, size in words, start in its source's stream. sources: see targets(). pieces: row, copy, shard,
    epoch, block, from_word and words: which words of which document a slot takes.

    Null and empty texts have no words and are never taken. A null source is a source like any other, the last. Rows
    without an id take part. Other columns of docs are not read. An empty table gives empty results.
    """
    ship(docs.sparkSession)
    row = F.xxhash64(F.col(id_col), F.col(source), F.col(text))
    units = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    units = stored(units.groupBy("row", "id", "source", "size").agg(F.count("*").alias("copies")), "units")
    sources = stored(targets(units.select("source", (F.col("size") * F.col("copies")).alias("size"))), "targets")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    units = _streams(units).select("row", "id", "source", "size", "start", copy).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    units = stored(units, "streams")
    end = F.col("start") + F.col("size")
    spans = units.filter("size > 0").select("row", "copy", "source", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block"))
    spans, taken = spans.alias("s"), slots(sources, block, shard_slots, seed).alias("t")
    met = spans.join(taken, F.col("s.source").eqNullSafe(F.col("t.source")) & (F.col("s.block") == F.col("t.block")))
    lo, hi = F.greatest(F.col("start"), F.col("s.block") * block), F.least(F.col("end"), (F.col("s.block") + 1) * block)
    return units, sources, met.select("row", "copy", "shard", "epoch", "s.block", (lo - F.col("start")).alias("from_word"), (hi - lo).alias("words"))


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id (the id), size, source_size, target and taken (words the mix takes, repeats counted) of each row of docs."""
    units, sources, pieces = mix(docs, **options)
    taken = pieces.groupBy("row", "copy").agg(F.sum("words").alias("taken"))
    found = units.join(taken, ["row", "copy"], "left").alias("u").join(sources.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source")))
    return found.select(F.col("u.id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The words of text in ranges (first word, number), in order, with the white space between them; ranges that don't
    touch are joined by a space. All words: the whole text."""
    spans = [m.span() for m in _WORD.finditer(text)]
    joined: list[list[int]] = []
    for lo, n in sorted(ranges):
        if joined and joined[-1][1] == lo:
            joined[-1][1] = lo + n
        else:
            joined.append([lo, lo + n])
    if joined == [[0, len(spans)]]:
        return text
    return " ".join(text[spans[a][0] : spans[b - 1][1]] for a, b in joined)


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix as documents: a row of docs once for each time its source is gone through, with the words taken then.

    All columns stay; n_chars, if there, is counted anew. Documents without taken words go.
    """
    source, id_col = options.get("source", "source"), options.get("id_col", "doc_id")
    _, _, pieces = mix(docs, text, **options)
    taken = pieces.groupBy("row", "copy", "epoch").agg(F.collect_list(F.struct("from_word", "words")).alias("ranges"))
    row, held, ranges = (unused(docs.columns, name) for name in ("_row", "_held", "_ranges"))
    taken = taken.select(F.col("row").alias(held), F.col("ranges").alias(ranges))
    whole = docs.withColumn(row, F.xxhash64(F.col(id_col), F.col(source), F.col(text)))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, [(r["from_word"], r["words"]) for r in at]) for t, at in zip(texts, ranges, strict=True)], dtype=object)

    found = whole.dropDuplicates([row]).join(taken, F.col(row) == taken[held]).withColumn(text, cut(F.col(text), F.col(ranges)))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
