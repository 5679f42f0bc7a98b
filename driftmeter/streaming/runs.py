"""A table that grows batch by batch, in folders whose names follow from the number of the batch.

Batch n writes its rows to run n of level 0.  Every FAN runs of a level are
merged into one of the next, so all rows before a batch lie in fewer than
FAN x log(n) folders, and which ones is arithmetic: nothing is listed that the
stream has left behind.  A run is written whole and replaced whole when its
batch is replayed; runs that a replay may still read are left where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

FAN = 16
#: Rows lie in folders by a hash of their key: a batch opens those of its keys only.
BUCKETS = 64


def cover(batches: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, run) of the fewest runs that hold exactly the batches 0 .. batches - 1."""
    level, size = 0, 1
    while size * fan <= batches:
        level, size = level + 1, size * fan
    found, start = [], 0
    while start < batches:
        while size > batches - start:
            level, size = level - 1, size // fan
        found.append((level, start // size))
        start += size
    return found


@dataclass(frozen=True)
class Runs:
    """Rows below ``root`` in buckets by ``keys``; ``folded`` keeps of merged rows what counts.

    Rows carry their batch in the column ``batch``.
    """

    spark: SparkSession
    root: str
    keys: Sequence[str]
    schema: StructType
    folded: Callable[[DataFrame], DataFrame] = lambda rows: rows
    fan: int = FAN
    buckets: int = BUCKETS

    def _path(self, level: int, run: int) -> str:
        return f"{self.root}/level={level}/run={run}"

    def _stored(self) -> StructType:
        return StructType([*self.schema.fields, StructField("batch", LongType()), StructField("bucket", IntegerType())])

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _read(self, runs: Sequence[tuple[int, int]]) -> DataFrame:
        paths = [self._path(*r) for r in runs]
        if not paths:
            return self.spark.createDataFrame([], self._stored())
        rows = None
        for path in paths:
            part = self.spark.read.schema(self._stored()).parquet(path)
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def before(self, batch: int) -> DataFrame:
        """Rows of all batches before this one, with ``batch`` and ``bucket``."""
        return self._read(cover(batch, self.fan))

    def of(self, batch: int) -> DataFrame:
        return self._read([(0, batch)])

    def write(self, rows: DataFrame, batch: int) -> None:
        """The rows of a batch, then the merges that it completes."""
        rows = rows.select(*self.schema.fieldNames()).withColumn("batch", F.lit(batch).cast("long"))
        self._write(self.bucketed(rows), 0, batch)
        level, size = 1, self.fan
        while (batch + 1) % size == 0:
            run = batch // size
            parts = [(level - 1, run * self.fan + i) for i in range(self.fan)]
            self._write(self.bucketed(self.folded(self._read(parts)).drop("bucket")), level, run)
            level, size = level + 1, size * self.fan

    def _write(self, rows: DataFrame, level: int, run: int) -> None:
        # a bucket's rows lie together in the files of the tasks that hold them
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path(level, run))
