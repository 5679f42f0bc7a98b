"""Scanning again as files arrive: a stream of raw rows, scored by what each batch changes.

Files of a commit are scaled against each other, so a commit's score depends on
all its files, and rows may arrive in any number of micro-batches, late ones
too.  Three tables grow with the stream (``runs``): the raw rows, the metrics
of files, and for each commit its feature ranges and the sums n, T = sum b and
X = sum b log2 b that its entropy is made of (``operators.scoring``).  A batch

1. measures anew the files it touches, out of all their raw rows;
2. where their old and new values leave a commit's ranges alone, takes the old
   terms of these files out of n, T and X and adds the new ones;
3. scores a commit again, out of its stored files, where a range moves.

So a batch reads the files it touches and the commits whose ranges it moves;
commits that it does not touch are never read.

Rows are told apart by where they come from (``identity``, for files read by
:func:`read_rows` their path and place), so equal rows count each, and a row
that is delivered twice counts once.  A replayed batch replaces its own runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import scoring
from ..operators.rollup import COMMIT
from ..sources.tables import stored_copy
from .runs import BUCKETS, Runs

ORIGIN, PLACE = "_origin", "_place"
IDENTITY = (ORIGIN, PLACE)


def read_rows(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the rows of the Parquet files in a folder, with the file they come from and their place in it."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).select("*", F.col("_metadata.file_path").alias(ORIGIN), F.col("_metadata.row_index").alias(PLACE))


@dataclass(frozen=True)
class IncrementalScan:
    """Sink of a stream of raw rows that carry (repo, commit_hash) and the columns ``file`` of their file.

    ``to_files`` turns the raw rows of files into file metrics, one row for each
    (repo, commit_hash, path).  ``identity`` names the columns that tell raw
    rows apart; without it, rows that are the same in all columns are one.
    """

    root: str
    to_files: Callable[[DataFrame], DataFrame]
    file: Sequence[str] = ("path",)
    identity: Sequence[str] = ()
    fan: int = 16
    buckets: int = BUCKETS

    def _raw(self, batch: DataFrame) -> Runs:
        same = list(self.identity or batch.columns)
        return Runs(batch.sparkSession, f"{self.root}/raw", [*COMMIT, *self.file], batch.schema, lambda rows: rows.dropDuplicates(same), self.fan, self.buckets)

    def _files(self, spark: SparkSession, schema: StructType) -> Runs:
        return Runs(spark, f"{self.root}/file_metrics", COMMIT, schema, lambda rows: newest(rows, [*COMMIT, "path"]), self.fan, self.buckets)

    def _commits(self, spark: SparkSession) -> Runs:
        return Runs(spark, f"{self.root}/commit_metrics", COMMIT, scoring.state_schema(), lambda rows: newest(rows, COMMIT), self.fan, self.buckets)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        raw = self._raw(batch)
        raw.write(batch, batch_id)
        touched = [*COMMIT, *self.file]
        arrived = raw.of(batch_id)
        # the bucket beside the key lets the join prune folders of older runs
        keys = stored_copy(arrived.select("bucket", *touched).distinct())
        rows = self._kept(raw.before(batch_id), keys, touched).unionByName(arrived).select(*batch.columns)
        measured = self.to_files(rows.dropDuplicates(list(self.identity or batch.columns)))
        files = self._files(spark, measured.schema)
        files.write(measured, batch_id)

        fresh, path = files.of(batch_id), [*COMMIT, "path"]
        names = [c for c in fresh.columns if c not in ("batch", "bucket")]
        commits = fresh.select("bucket", *COMMIT).distinct()
        states = newest(self._kept(self._commits(spark).before(batch_id), commits, COMMIT), COMMIT).select(*scoring.state_schema().fieldNames())
        old = stored_copy(newest(self._kept(files.before(batch_id), fresh, path), path).select(*names))
        judged = stored_copy(scoring.state_judged(states, old, fresh.select(*names)))
        whole = stored_copy(files.bucketed(judged.where("rescored").select(*COMMIT)))
        rest = newest(self._kept(files.before(batch_id), whole, COMMIT), path).select(*names).join(fresh, path, "left_anti")
        again = scoring.state_of(rest.unionByName(fresh.select(*names).join(whole, list(COMMIT), "left_semi")))
        state = scoring.state_moved(judged, old, fresh.select(*names)).unionByName(again)
        self._commits(spark).write(state, batch_id)

    def _kept(self, rows: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Rows of the keys, out of the folders that the keys fall into."""
        buckets = [r["bucket"] for r in keys.select("bucket").distinct().collect()]  # self.buckets at most
        return rows.where(F.col("bucket").isin(buckets)).join(keys.select(*columns), list(columns), "left_semi")

    def start(self, raw: DataFrame, checkpoint: str) -> StreamingQuery:
        """Consume everything available, then stop."""
        return (
            raw.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def _all(self, spark: SparkSession, table: str, keys: Sequence[str]) -> DataFrame:
        # a run that was merged holds no newer row than the merged one
        return newest(spark.read.parquet(f"{self.root}/{table}").drop("level", "run"), keys)

    def commit_metrics(self, spark: SparkSession) -> DataFrame:
        """The newest metrics of every commit."""
        return scoring.entropy_of_state(self._all(spark, "commit_metrics", COMMIT))

    def file_metrics(self, spark: SparkSession) -> DataFrame:
        """The newest metrics of every file of every commit."""
        return self._all(spark, "file_metrics", [*COMMIT, "path"]).drop("batch", "bucket")


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the rows of a key, that of the latest batch."""
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in rows.columns])
