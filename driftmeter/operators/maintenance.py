"""Incremental and administrative jobs over the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def new_commits(commits: DataFrame, stored: DataFrame) -> DataFrame:
    """Commits that are not stored yet, so scanning again is a no-op."""
    return commits.join(stored.select("repo", "commit_hash"), ["repo", "commit_hash"], "left_anti")


def insert_if_absent(rows: DataFrame, stored: DataFrame, keys: Sequence[str] = ("repo", "commit_hash", "path")) -> DataFrame:
    """The rows to append: one per key, the smallest in the order of its columns, and none whose key is stored."""
    others = [c for c in rows.columns if c not in keys]
    if others:
        rows = rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row")).select(
            *[F.col(f"_row.{c}").alias(c) if c in others else F.col(c) for c in rows.columns]
        )
    else:
        rows = rows.distinct()
    return rows.join(stored.select(*keys), list(keys), "left_anti")


def register_repos(found: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Repositories to add, (repo, remote_url): the first URL of a name wins, stored names stay."""
    fresh = found.groupBy("repo").agg(F.min("remote_url").alias("remote_url"))
    return fresh if stored is None else fresh.join(stored.select("repo"), "repo", "left_anti")


def name_repos(remotes: DataFrame) -> DataFrame:
    """Add ``repo``, the 'owner/repo' name of ``remote_url``."""
    return remotes.withColumn("repo", paths.repo_name(F.col("remote_url")))


def repo_list(repos: DataFrame, commits: DataFrame) -> DataFrame:
    """Repositories by name with their commit counts."""
    counts = commits.groupBy("repo").agg(F.count(F.lit(1)).alias("commit_count"))
    listed = repos.select("repo", "remote_url").join(counts, "repo", "left")
    return listed.fillna(0, ["commit_count"]).orderBy("repo")


def clear_history(table: DataFrame, repo: str) -> DataFrame:
    """What remains of a metrics table once a repository's history is cleared."""
    return table.where(F.col("repo") != repo)
