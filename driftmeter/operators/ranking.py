"""Top-k lists per commit and the full metrics table.

``row_number() <= k`` lets Spark cut every group to k rows before the shuffle,
so a commit of any size sends at most k rows per task.  Ties break on path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, measures, paths
from . import scoring
from .rollup import COMMIT


def top_files(files: DataFrame, score: Column, top: int = fixed.TOP_FILES, keys: Sequence[str] = COMMIT) -> DataFrame:
    """The ``top`` files of every commit by ``score``, with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(score.desc(), F.col("path"))
    return files.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def top_large_files(files: DataFrame, top: int = fixed.TOP_FILES) -> DataFrame:
    return top_files(files, F.col("sloc"), top)


def top_complex_files(files: DataFrame, top: int = fixed.TOP_FILES) -> DataFrame:
    return top_files(files.where(F.col("cc") > 0), F.col("cc"), top)


def top_smelly_files(files: DataFrame, top: int = fixed.TOP_FILES) -> DataFrame:
    any_smell = (F.col("smells_high") > 0) | (F.col("smells_medium") > 0) | (F.col("smells_low") > 0)
    weighed = files.where(any_smell).withColumn("weighted_smells", measures.weighted_smells())
    return top_files(weighed, F.col("weighted_smells"), top)


def top_coupled_files(files: DataFrame, top: int = fixed.TOP_FILES) -> DataFrame:
    return top_files(files.where(F.col("coupling") > 0), F.col("coupling"), top)


def top_scan_chart(files: DataFrame, top: int = fixed.TOP_FILES) -> DataFrame:
    """By complexity where a commit has any, otherwise by lines.

    Complex files rank ahead of all others, so the first ``top`` rows tell which
    case a commit is; the second window sees only those rows.
    """
    has_cc = F.col("cc") > 0
    value = F.when(has_cc, F.bround("cc", 1)).otherwise(F.col("sloc").cast("double"))
    height = F.when(has_cc, F.col("cc")).otherwise(F.col("sloc").cast("double"))
    order = Window.partitionBy(*COMMIT).orderBy(has_cc.desc(), height.desc(), F.col("path"))
    ranked = (
        files.where(has_cc | (F.col("sloc") > 0))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
    )
    any_cc = F.max(has_cc).over(Window.partitionBy(*COMMIT))
    return (
        ranked.withColumn("_any_cc", any_cc)
        .where(has_cc | ~F.col("_any_cc"))
        .select(
            *COMMIT,
            "rank",
            "path",
            paths.file_name(F.col("path")).alias("file_name"),
            F.when(F.col("_any_cc"), F.lit("cc")).otherwise(F.lit("sloc")).alias("measure"),
            value.alias("value"),
        )
    )


def top_refactor(files: DataFrame, focus: str = "overall", top: int = fixed.TOP_FILES) -> DataFrame:
    """Refactoring candidates with their score relative to the best one."""
    ranked = top_files(scoring.refactor_scores(files, focus), F.col("score"), top)
    best = F.max("score").over(Window.partitionBy(*COMMIT))
    relative = F.col("score") / F.when(best == 0, F.lit(1.0)).otherwise(best)
    return ranked.withColumn("relative_score", relative)


def top_badness(files: DataFrame, top: int = fixed.TOP_FILES) -> DataFrame:
    scored = scoring.badness_by_file(files)
    return top_files(scored.where(F.col("badness") > 0), F.col("badness"), top)


def top_diffusion(files: DataFrame, top: int = fixed.TOP_FILES) -> DataFrame:
    spread = scoring.diffusion_contributions(files)
    return top_files(spread.where(F.col("diffusion") > 0), F.col("diffusion"), top)


def file_metrics_table(files: DataFrame, commit_hash: str | None = None) -> DataFrame:
    """All metrics of one commit (or of every commit), worst file first: one range sort."""
    chosen = files if commit_hash is None else files.where(F.col("commit_hash") == commit_hash)
    return scoring.badness_by_file(chosen).orderBy(*COMMIT, F.desc("badness"), "path")


def health_gauges(history: DataFrame, stats: DataFrame) -> DataFrame:
    """Entropy, complexity and smell gauges of the newest commit of every repository."""
    from .history import head_commit
    from .rollup import gauge_columns

    head = head_commit(history.select("repo", "commit_hash", "ts", "entropy"))
    joined = head.join(stats, ["repo", "commit_hash"], "left").fillna(0.0, ["avg_cc", "avg_smell"])
    gauges = gauge_columns({"entropy": F.col("entropy"), "cc": F.col("avg_cc"), "smells": F.col("avg_smell")})
    return joined.select("repo", "commit_hash", "entropy", "avg_cc", "avg_smell", *gauges)
