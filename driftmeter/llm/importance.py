"""Target-distribution importance resampling over hashed word runs, by a head-tail vocabulary.

A feature is a run of 1 to ``longest`` consecutive words, joined by one space; its bucket is the CRC-32 of its bytes
modulo ``buckets``. A CRC goes on from a state, so the run ``a b`` needs the state of ``a`` and the bytes of `` b`` alone.
The head of the vocabulary, the most frequent words of the whole corpus, is sent to all tasks with its exact states, and
the most frequent pairs of head words with their buckets; every feature outside it, the tail, is computed directly. Both
give the same bucket for the same feature, so the totals of the buckets are exact whatever the head holds.

A bucket's gain is the scaled logarithm of how much more often the target holds it than the corpus, a document's weight
is its mean gain, and adding seeded Gumbel noise to the weights and taking the largest draws without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmeter.llm.common import ship, stored

BUCKETS = 10_000
LONGEST = 1
#: Words and pairs sent to the tasks at most; what is left out costs time only.
HEAD_WORDS = 60_000
HEAD_PAIRS = 60_000
#: Different words or pairs that a task counts before it hands its counts on.
COUNTED = 200_000
LEAST_WORDS = 20
SEED = "2024"
#: A-Z become a-z, other ASCII characters but digits become spaces; bytes of other characters stay.
_CLEAN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def words(raw: bytes | None) -> list[bytes]:
    """Runs of digits, letters and all characters beyond ASCII, as UTF-8; only A-Z are lowered."""
    return raw.translate(_CLEAN).split() if raw else []


class _States(dict):
    """CRC-32 of words: of the head by look-up, of the tail directly."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


@dataclass
class Vocabulary:
    """states: CRC-32 of the head's words; pairs: buckets of the head's pairs."""

    buckets: int = BUCKETS
    longest: int = LONGEST
    states: dict[bytes, int] = field(default_factory=_States)
    pairs: dict[tuple[bytes, bytes], int] = field(default_factory=dict)

    @classmethod
    def of(cls, head: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int = BUCKETS, longest: int = LONGEST) -> Vocabulary:
        states = _States((w, zlib.crc32(w)) for w in head)
        return cls(buckets, longest, states, {(a, b): zlib.crc32(b" " + b, states[a]) % buckets for a, b in pairs})

    def features(self, some: list[bytes]) -> np.ndarray:
        """The buckets of all runs of 1 to longest words, the shorter runs first."""
        state = list(map(self.states.__getitem__, some))
        parts = [np.array(state, np.int64) % self.buckets]
        for size in range(2, self.longest + 1):
            last = some[size - 1 :]
            if size == 2:
                get = self.pairs.get
                found = [get(p) for p in zip(some, last, strict=False)]
                crc, n = zlib.crc32, self.buckets
                parts.append(np.array([crc(b" " + b, s) % n if k is None else k for k, b, s in zip(found, last, state, strict=False)], np.int64))
                if self.longest == 2:
                    break
            state = [zlib.crc32(b" " + w, s) for w, s in zip(last, state, strict=False)]
            if size > 2:
                parts.append(np.array(state, np.int64) % self.buckets)
        return np.concatenate(parts)


def _counts(docs: DataFrame, text: str, units, what: str) -> DataFrame:
    """(unit binary, n): how often each unit of the words occurs. Tasks hand on counts of COUNTED units at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(counted):
            return pa.RecordBatch.from_arrays([pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], ["unit", "n"])

        seen: Counter = Counter()
        for rows in batches:
            for raw in rows.column(0):
                seen.update(units(words(raw.as_py())))
                if len(seen) > COUNTED:
                    yield batch(seen)
                    seen = Counter()
        if seen:
            yield batch(seen)

    parts = docs.select(F.col(text).cast("binary")).mapInArrow(count, "unit binary, n long")
    return parts.groupBy("unit").agg(F.sum("n").alias("n"))


def _top(counts: DataFrame, limit: int) -> list[bytes]:
    """The most frequent units, limit at most: whole classes of like counts, so that no task sends more than those."""
    counts = stored(counts.withColumn("class", F.floor(F.log2("n") * 16)), "counts")
    room, cut = limit, None
    for r in counts.groupBy("class").agg(F.count("*").alias("units")).orderBy(F.desc("class")).collect():  # 16 classes for each doubling
        if (room := room - r["units"]) < 0:
            break
        cut = r["class"]
    return [] if cut is None else [bytes(r["unit"]) for r in counts.filter(F.col("class") >= cut).orderBy("unit").collect()]


def vocabulary(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS) -> Vocabulary:
    """The head: the head_words most frequent words of all docs and, for longer runs, their most frequent pairs."""
    ship(docs.sparkSession)
    head = _top(_counts(docs, text, lambda ws: ws, "words"), head_words)
    pairs: list[tuple[bytes, bytes]] = []
    if longest > 1:
        known = docs.sparkSession.sparkContext.broadcast(frozenset(head))  # head_words words at most

        def both(ws):
            return [a + b" " + b for a, b in zip(ws, ws[1:], strict=False) if a in known.value and b in known.value]

        pairs = [tuple(p.split(b" ")) for p in _top(_counts(docs, text, both, "pairs"), head_pairs)]
    return Vocabulary.of(head, pairs, buckets, longest)


def kind(buckets: int) -> str:
    """How buckets are stored: in two bytes if these can tell them apart, else in four."""
    return "<u2" if buckets <= 1 << 16 else "<u4"


def hashed(docs: DataFrame, vocab: Vocabulary, columns: list, text: str = "text") -> DataFrame:
    """columns of docs, n_words, n_features and found: the buckets of all features, as numbers of kind() each."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # bounded by the sizes of the head

    def of(batches):
        vocab = shared.value
        for raws in batches:
            out = []
            for raw in raws:
                some = words(raw)
                found = vocab.features(some)
                out.append((len(some), len(found), found.astype(kind(vocab.buckets)).tobytes()))
            yield pa.StructArray.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())],
                ["n_words", "n_features", "found"],
            )

    @F.arrow_udf("n_words long, n_features long, found binary")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return of(a.to_pylist() for a in batches)

    return docs.select(*columns, features(F.col(text).cast("binary")).alias("_f")).select("*", "_f.*").drop("_f")


def totals(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in the found of rows; one row for each bucket comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                sums += np.bincount(np.frombuffer(raw.as_py(), kind(buckets)), minlength=buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(sums[held], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("found").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, buckets: int) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over its share in the source."""
    s_all, t_all = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    dtype = kind(len(gain))

    @F.arrow_udf("long")
    def weight(found: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in found:
            ids = (np.frombuffer(raw, dtype) for raw in batch.to_pylist())
            yield pa.array([int(shared.value[x].sum()) // len(x) if len(x) else 0 for x in ids], pa.int64())

    return rows.withColumn("weight", weight("found")).drop("found")


def _placed(rows: DataFrame, order: list) -> DataFrame:
    """rows with place, from 1, in the given order, which must be total. A range sort numbers the rows of each
    partition; the counts of the partitions before are added, so no task sees more than its range."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged, "ranked").withColumn("_part", F.shiftright("_at", 33))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each partition of the sort
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return ranged.join(before, "_part").withColumn("place", place).drop("_part", "_at", "_n", "_before")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    seed: str = SEED, text: str = "text", id_col: str = "doc_id", head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS,
) -> DataFrame:
    """One row (id, n_features, weight, score, rank) for each row of docs; rank is null for documents that are not drawn.

    Of the documents with at least least_words words, percent in 100 (rounded down) are drawn, those of the largest
    scores; ties go to the smaller id, then to the smaller number of features and weight. Null and empty texts have no
    features and weight 0. A null id hashes like the empty string and comes after all others among ties. Repeated rows
    are rows of their own, with the same noise. An empty target leaves all weight to the smoothing. An empty table gives
    an empty result. No other column of docs or target is read, whatever its name.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    vocab = vocabulary(docs, "text", buckets, longest, head_words, head_pairs)
    found = stored(hashed(docs, vocab, ["id"]), "features")
    wanted = hashed(target.select(F.col(text).alias("text")), vocab, [])
    gain = gains(totals(found, buckets), totals(wanted, buckets), buckets)
    # exact in doubles: 8 hex digits
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    takes_part = F.col("n_words") >= least_words
    scored = _weighted(found, gain).withColumn("score", F.col("weight") + noise).withColumn("takes_part", takes_part)
    # rows that are the same in all columns keep their own place by where they are stored
    scored = stored(scored.withColumn("_row", F.monotonically_increasing_id()), "scores")
    quota = scored.agg(F.count_if("takes_part")).first()[0] * percent // 100
    order = [F.desc("takes_part"), F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("weight"), F.asc("_row")]
    placed = _placed(scored, order)
    rank = F.when(F.col("takes_part") & (F.col("place") <= quota), F.col("place"))
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))
