"""The metrics store: commits, file metrics, commit metrics and repositories as Parquet."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import maintenance
from . import schemas

KEYS = {
    "commits": ("repo", "commit_hash"),
    "file_metrics": ("repo", "commit_hash", "path"),
    "commit_metrics": ("repo", "commit_hash"),
    "repos": ("repo",),
}
SCHEMAS = {
    "commits": schemas.COMMITS,
    "file_metrics": schemas.FILE_METRICS,
    "commit_metrics": schemas.COMMIT_METRICS,
    "repos": schemas.REPOS,
}
REPO_BUCKETS = 64
_BUCKET = f"cast(pmod(xxhash64(repo), {REPO_BUCKETS}) as int) as repo_bucket"
# no folder yet, or one without files; any other error is one
NOTHING_STORED = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def work_folder(spark: SparkSession) -> str:
    """A fresh path below the shared folder in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.gettempdir() + "/driftmeter"
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def stored_copy(rows: DataFrame) -> DataFrame:
    """Compute once, keep as Parquet in the work folder, read back.

    Cuts the lineage with files that outlive any executor, and tells the planner
    the true size of the result.
    """
    path = work_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@dataclass(frozen=True)
class MetricsStore:
    """Parquet tables below one root.

    Tables are partitioned by a hash bucket of the repository, so the number of
    directories is fixed however many repositories there are.  Files are sorted
    by key, so their statistics prune by repository and commit, and rebalanced,
    so a huge repository spans many files and small ones share.
    """

    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        return self._read(table, F.lit(True))

    def _read(self, table: str, wanted: Column) -> DataFrame:
        schema = StructType([*SCHEMAS[table].fields])
        try:
            rows = self.spark.read.option("recursiveFileLookup", "false").parquet(self.path(table))
        except AnalysisException as error:
            if error.getCondition() not in NOTHING_STORED:
                raise
            return self.spark.createDataFrame([], schema)
        return rows.where(wanted).select(*schema.names)

    def append(self, table: str, rows: DataFrame) -> None:
        """Append the rows whose key is not stored yet.  Rows are computed once, for their buckets and for the write."""
        rows = stored_copy(rows)
        self._write(table, maintenance.insert_if_absent(rows, self.stored_beside(table, rows), KEYS[table]))

    def stored_beside(self, table: str, rows: DataFrame) -> DataFrame:
        """Stored rows of the buckets that rows fall into, REPO_BUCKETS at most: no other folder is opened."""
        buckets = sorted(r[0] for r in rows.selectExpr(_BUCKET).distinct().collect())
        return self._read(table, F.col("repo_bucket").isin(buckets))

    def _write(self, table: str, rows: DataFrame) -> None:
        columns = SCHEMAS[table].names
        bucketed = rows.selectExpr(*columns, _BUCKET)
        # adaptive execution splits what is too big for a file and joins what is too small;
        # unlike a range partitioning this does not compute the rows once more to sample them
        placed = bucketed.hint("rebalance", "repo_bucket")
        placed.sortWithinPartitions("repo_bucket", *KEYS[table]).write.mode("append").partitionBy("repo_bucket").parquet(self.path(table))

    def add_scan(self, commits: DataFrame, files: DataFrame, metrics: DataFrame) -> None:
        """Store a scan.  Commits go last: a scan that broke off is scanned again and adds what is missing."""
        self.append("file_metrics", files)
        self.append("commit_metrics", metrics)
        self.append("commits", commits)

    def register(self, found: DataFrame) -> None:
        self._write("repos", maintenance.register_repos(found, self.read("repos")))

    def clear(self, repo: str, new_root: str) -> MetricsStore:
        """A new version of the store without one repository's history; its ``repos`` row stays.

        Always written beside the version being read, never over it.
        """
        cleared = MetricsStore(self.spark, new_root)
        for table in ("commits", "file_metrics", "commit_metrics"):
            cleared._write(table, maintenance.clear_history(self.read(table), repo))
        cleared._write("repos", self.read("repos"))
        return cleared
