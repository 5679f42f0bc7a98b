"""Helpers that the operators of this subpackage share: work folders, stored results, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors share.

    Only where that setting is absent and the session is a local one (tests) a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="llm-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Sends this subpackage to the executors, once for each session's context: their Python workers need not have it
    on their path."""
    context = spark.sparkContext
    if getattr(context, "_llm_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="llm-code-"), "driftmeter_llm.zip")
    with zipfile.ZipFile(archive, "w") as out:
        out.writestr("driftmeter/__init__.py", "")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                out.write(os.path.join(here, name), f"driftmeter/llm/{name}")
    context.addPyFile(archive)
    context._llm_shipped = True


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: a lost executor costs no earlier step."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """A column name like name that no column has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like stored, as a table in hash buckets of key: joins by key then leave its rows where they are."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    table = "llm_" + path.rpartition("/")[2].replace("-", "_")
    df.write.format("parquet").option("path", path).bucketBy(shuffle_partitions(spark), key).saveAsTable(table)
    return spark.table(table)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b), longs: one row (node, root) for each node of an edge.

    root is the smallest node reachable. Alternates large-star and small-star steps (Kiveris et al. 2014) until the
    edges stay the same; each round is stored, so lineage stays short. A hub's neighbours meet its minimum through an
    aggregation with map-side combine and a join on the hub that the adaptive planner may split; no group of
    neighbours is collected.
    """

    def directed(pairs: DataFrame) -> DataFrame:
        return pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(pairs: DataFrame) -> tuple:
        # sum of a decimal, as a sum of hashes may overflow
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = stored(directed(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = directed(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = stored(directed(small), "edges")
        last, seen = seen, mark(now)
        if last == seen:
            break
    child = now.groupBy("u").agg(F.min("v").alias("root"))
    return child.select(F.col("u").alias("node"), "root").union(child.select(F.col("root").alias("node"), "root").distinct())
