"""Which files and commits take part: scope filters, languages, kinds, checkpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, paths
from .history import ORDER, add_chunk, in_graph_order, own_time
from .skew import keyed, with_carry


def drop_ignored_directories(files: DataFrame, names: Sequence[str] = fixed.IGNORED_DIRECTORIES) -> DataFrame:
    return files.where(~paths.in_ignored_directory(F.col("path"), names))


def drop_excluded(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Drop files with any path segment matching any exclusion glob."""
    return files.where(~paths.matches_any_segment(F.col("path"), patterns))


def drop_excluded_by_repo(files: DataFrame, pattern_regexes: DataFrame) -> DataFrame:
    """Drop by each repository's own exclusion list; see ``sources.patterns.regex_by_repo``.

    ``pattern_regexes`` holds (repo, regex).  Repositories without one keep all files.
    """
    files = keyed(files, ["repo"])
    excluded = F.coalesce(F.expr("path rlike regex"), F.lit(False))
    return files.join(pattern_regexes.select("repo", "regex"), "repo", "left").where(~excluded).select(*files.columns)


def keep_included(files: DataFrame, patterns: Sequence[str] | None) -> DataFrame:
    """Keep files whose name matches an inclusion glob; an empty list keeps all."""
    return files.where(paths.matches_file_name(F.col("path"), patterns))


def assign_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", paths.language_of(F.col("path")))


def recognised_only(files: DataFrame) -> DataFrame:
    return files.where(F.col("language") != "")


def classify_kind(files: DataFrame, utility_patterns: Sequence[str]) -> DataFrame:
    return files.withColumn("kind", paths.kind_of(F.col("path"), utility_patterns))


def filter_kind(files: DataFrame, kind: str = "all") -> DataFrame:
    """'production' or 'utility', in any case; every other word keeps all files."""
    wanted = {"production": fixed.PRODUCTION, "utility": fixed.UTILITY}.get(kind.lower())
    return files if wanted is None else files.where(F.col("kind") == wanted)


def checkpoint_commits(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """Commits that are tagged or merge several parents."""
    tagged = tags.select("repo", F.lower("commit_hash").alias("_tag")).distinct()
    marked = commits.withColumn("_tag", F.lower("commit_hash")).join(
        tagged.withColumn("_tagged", F.lit(True)), ["repo", "_tag"], "left"
    )
    is_tagged = F.coalesce(F.col("_tagged"), F.lit(False))
    return marked.where((F.size("parents") > 1) | is_tagged).select(
        *commits.columns, is_tagged.alias("is_tagged"), (F.size("parents") > 1).alias("is_merge")
    )


def commits_since(commits: DataFrame, commit_hash: str) -> DataFrame:
    """History from a commit on, inclusive, in each repository that has it, in the order of ``commits_chronological``."""
    position = F.struct(*ORDER)
    start = F.max(F.when(F.col("commit_hash") == commit_hash, position))
    rows = with_carry(add_chunk(in_graph_order(commits)), ["repo"], "_chunk", {"_start": (start, F.max, "all")})
    return own_time(rows.where(position >= F.col("_start"))).select(*commits.columns)


def commits_with_prefix(commits: DataFrame, prefix: str | None) -> DataFrame:
    """Rows whose hash starts with a prefix, ignoring case; no prefix keeps all."""
    if prefix is None:
        return commits
    return commits.where(F.lower("commit_hash").startswith(prefix.lower()))
