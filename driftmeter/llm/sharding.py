"""Shards of a shuffled corpus, by a two-pass external shuffle.

Pass one scatters the rows uniformly into buckets that fit memory, by a seeded hash of id and text. Pass two shuffles each bucket
(Fisher-Yates, from a generator seeded by the bucket) and writes it. Buckets laid end to end are one uniform permutation
of the corpus, which is cut into shards of consecutive places. So shards hold counts of rows that differ by one at most
(the law ``rows``), slots have no gaps, and a bucket writes to few shards.

A bucket's rows are sorted before they are shuffled and generators have fixed seeds, so a lost task that is run again
gives the same rows the same places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from driftmeter.llm.common import ship, stored, work_folder

SHARDS = 40
#: Bytes of text in a bucket, about.
BUCKET_BYTES = 32 << 20
SEED = 11


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of 0 .. n - 1."""
    order = list(range(n))
    # all draws at once: the i-th from the end swaps with one of the i + 1 first
    draws = np.random.default_rng([seed, bucket]).integers(0, np.arange(n, 0, -1)).tolist() if n else []
    for i, j in zip(range(n - 1, 0, -1), draws, strict=False):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _scattered(docs: DataFrame, text: str, id_col: str, bucket_bytes: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Pass one: docs with _bucket, and for each bucket its base (rows before it) and all (rows of all buckets)."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    # the text scatters rows of one id; equal rows without an id have only their place in the input
    place = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text), place), F.lit(max(1, -(-total // bucket_bytes))))
    rows = docs.withColumn("_bucket", bucket)
    sizes = stored(rows.groupBy("_bucket").agg(F.count("*").alias("n")), "buckets").withColumn("chunk", F.floor(F.col("_bucket") / 4096))
    chunks = sizes.groupBy("chunk").agg(F.sum("n").alias("rows"))
    chunks = chunks.select("chunk", (F.sum("rows").over(Window.orderBy("chunk")) - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy()).alias("_all"))
    inside = F.sum("n").over(Window.partitionBy("chunk").orderBy("_bucket")) - F.col("n")
    base = sizes.withColumn("inside", inside).join(chunks, "chunk")
    return rows, base.select("_bucket", (F.col("before") + F.col("inside")).alias("_base"), "_all")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, text: str = "text", id_col: str = "doc_id", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Writes docs, shuffled, as Parquet below path, one folder for each shard; returns what is read from there.

    Rows keep all their columns and get shard (int) and slot (long, from 0 in each shard); columns of docs with these
    names are replaced. Rows with null text or id take part; repeated rows are rows of their own. An empty table gives
    an empty result. Equal texts are not kept together: every row is placed for itself. Only rows that share both id and
    text share a bucket, whatever their number.
    """
    ship(docs.sparkSession)
    docs = docs.drop("shard", "slot")
    # columns keep their names behind a place, so that none is taken for one of this module's own
    names = docs.columns
    own = {c: f"c{i}" for i, c in enumerate(names)}
    docs, text, id_col = docs.toDF(*own.values()), own[text], own[id_col]
    rows, base = _scattered(docs, text, id_col, bucket_bytes, seed)

    def shuffle(key: tuple, bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([(id_col, "ascending"), (text, "ascending")])
        base, n = bucket["_base"][0].as_py(), bucket["_all"][0].as_py()
        place = base + np.arange(len(bucket), dtype=np.int64)
        few, more = divmod(n, shards)  # the first ``more`` shards have one row more
        shard = np.where(place < more * (few + 1), place // (few + 1), more + (place - more * (few + 1)) // max(few, 1))
        slot = place - (shard * few + np.minimum(shard, more))
        out = bucket.drop_columns(["_bucket", "_base", "_all"]).take(fisher_yates(len(bucket), seed, key[0].as_py()))
        return out.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))

    schema = StructType([*docs.schema.fields, StructField("shard", IntegerType()), StructField("slot", LongType())])
    done = rows.join(base, "_bucket").groupBy("_bucket").applyInArrow(shuffle, schema)
    # the partition column is taken out of the files, so the others may have any name
    done.toDF(*names, "shard", "slot").write.partitionBy("shard").parquet(path)
    schema = StructType([*[StructField(c, f.dataType) for c, f in zip(names, docs.schema.fields, strict=True)], *schema.fields[-2:]])
    return docs.sparkSession.read.schema(schema).parquet(path)


def sharded(docs: DataFrame, **options) -> DataFrame:
    """write_shards to a new folder in the shared work folder."""
    return write_shards(docs, work_folder(docs.sparkSession, "shards"), **options)
