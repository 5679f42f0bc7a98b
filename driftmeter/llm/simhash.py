"""SimHash near-duplicates: word-shingle fingerprints, linked through a grid over segment bit counts.

Fingerprints are cut into 16 segments of 4 bits and mapped to the vector of their segments' bit counts. The Manhattan
distance of two such vectors never exceeds the bit distance of the fingerprints, so a grid over the vectors finds every
link: lattice points within distance 2 share a point within distance 1 of both, hence each fingerprint is entered in its
own grid cell and those next to it, and only cells with two fingerprints or more go on. There the check is exact:
within a cell a fingerprint stands for the 64-bit words of that cell that are at most one bit away from it, 65 in all
its cells together. Two fingerprints differ in at most 2 bits exactly if they have such a word in common. Each word links its fingerprints to
the smallest of them, so a group of n near copies costs n links and never n * n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmeter.llm.common import components, ship, shuffle_partitions, stored, unused

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Rows of bits summed in one byte at a time.
_ROWS = 255


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text as a signed number; 0 for a text without words, or null."""
    words = raw.lower().split() if raw else []  # of bytes: lowers A-Z only, parts at space and \x09-\x0D only
    n = len(words)
    if not n:
        return 0
    flat = b" ".join(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(flat, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: n - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // _ROWS * _ROWS
    counts = bits[:whole].reshape(-1, _ROWS, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    counts += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(bits), bitorder="little").view("<i8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of each text as a long; texts go to Python in Arrow batches."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in batches:
            yield pd.Series([fingerprint(x, shingle) for x in raw], dtype="int64")

    return of(text.cast("binary"))


def bit_counts(word: Column) -> Column:
    """The bit counts of the 16 segments of 4 bits, packed in 4 bits each."""
    ones = F.lit(int("1" * 16, 16))
    return sum((F.shiftrightunsigned(word, k).bitwiseAND(ones) for k in (1, 2, 3)), word.bitwiseAND(ones))


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect exactly those within 2 bits of each other.

    Not every pair is a row: those that share a word link to the smallest of them, which keeps every component. A
    fingerprint has 65 rows, one for each word, whatever the size of the table; dealt by cell once, they stay where they
    are for the busy cells and for the words, as equal words lie in one cell.
    """
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), b)) for b in range(64)])
    words = prints.select("fp", F.explode(flips).alias("word")).withColumn("cell", bit_counts(F.col("word")))
    words = words.repartition(shuffle_partitions(prints.sparkSession), "cell")
    busy = words.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("cell")
    near = words.join(busy, "cell", "left_semi")
    first = near.groupBy("cell", "word").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("cell", "word", "lo")
    pairs = near.join(first, ["cell", "word"]).filter("fp <> lo")
    return pairs.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("lo"))) <= MAX_BITS).select(F.col("fp").alias("a"), F.col("lo").alias("b")).distinct()


def _classes(marked: DataFrame) -> DataFrame:
    """fp, root for every fingerprint of marked (id, fp): fingerprints with the same root are linked."""
    prints = stored(marked.groupBy("fp").agg(F.min("id").alias("first_id")), "prints")
    roots = stored(components(links(prints.select("fp"))), "roots")
    return prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """One row (id, fp, component_id) for each row of docs; ids reach each other over links of at most 2 bits.

    Words are parted by space and \\x09-\\x0D, A-Z are lowered, shingles keep their repeats. Null and empty texts, and
    texts of white space, have fingerprint 0 and link like any other. component_id is the smallest id reachable; rows
    without an id get it too (null if no row of the component has an id). Repeated rows each give a row. Other columns
    of docs are not read, whatever their names. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    marked = stored(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text), shingle).alias("fp")), "fingerprints")
    of = _classes(marked)
    least = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.join(of.join(least, "root").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of near copies, with all its columns: the one with the smallest id.

    Rows without an id come after those with one; ties go to the smallest hash of the whole row, and of rows that are
    the same in all columns one stays.
    """
    ship(docs.sparkSession)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.struct(F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(1), *columns).alias("g"))
    held = unused(docs.columns, "_row")
    rows = docs.select(*columns, whole.alias(held))
    marked = stored(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text), shingle).alias("fp"), whole.alias("row")), "fingerprints")
    best = marked.join(_classes(marked).select("fp", "root"), "fp").groupBy("root")
    chosen = best.agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row")).alias("best")).select(F.col("best.row").alias(held))
    return rows.join(chosen, held, "left_semi").dropDuplicates([held]).drop(held)
