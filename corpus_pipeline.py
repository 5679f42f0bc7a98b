"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Quality rules drop documents; of each group of near copies one stays; byte strings that repeat across what is left are
cut out; sources are mixed to their target weights, which cuts, drops and repeats documents; the mix is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmeter.llm import byte_bpe, mixing, quality_rules, simhash, suffix_dedup
from driftmeter.llm.common import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base limits nor meet a learned rule."""
    judged = quality_rules.judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.filter("kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked by 2 or fewer differing bits."""
    return simhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that start more than once in the corpus.

    Bytes of a character that was cut apart go too; n_chars is counted anew. All documents stay.
    """

    @F.pandas_udf("string")
    def text(kept):
        return kept.map(lambda raw: raw.decode("utf-8", "ignore"))

    cut = suffix_dedup.remove_repeats(docs).withColumn("text", text("kept"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources as documents: one row for each time a document is taken, with the words taken."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their number of tokens, their ids (decimal, joined by commas) and whether they decode to the text."""
    coded = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    whole = F.col("decoded") == F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return coded.withColumn("round_trip", whole).drop("decoded")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokens),
]

#: No stage but the first could be said in SQL; tests hold the stages against plain definitions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
