"""Stored metrics to a history report and a commit drill-down, as named lazy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff, history, ranking, rollup, scope, scoring


def history_of_kind(files: DataFrame, commits: DataFrame, kind: str = "all", metrics: DataFrame | None = None) -> DataFrame:
    """Commit metrics with times; for one kind they are scored anew on that kind's files.

    Commits without a file of the kind stay, with zeros.
    """
    if kind.lower() in ("production", "utility"):
        scored = scoring.entropy_by_commit(scope.filter_kind(files, kind), commits=commits)
    else:
        scored = metrics if metrics is not None else scoring.entropy_by_commit(files)
    return history.history_join(scored, commits)


def report(
    files: DataFrame, commits: DataFrame, metrics: DataFrame | None = None, kind: str = "all", prefix: str | None = None
) -> dict[str, DataFrame]:
    """The tables of a history report over all repositories."""
    past = history_of_kind(files, commits, kind, metrics)
    wanted = scope.filter_kind(files, kind)
    stats = rollup.commit_file_stats(wanted, commits)
    head = history.head_commit(past.select("repo", "commit_hash", "ts"))
    latest = wanted.join(head.select("repo", "commit_hash"), ["repo", "commit_hash"], "left_semi")
    numbered = history.number_commits(past.select("repo", "commit_hash", "ts"))
    newest_two = numbered.where(F.col("commit_seq") >= F.col("commit_count") - 1)
    recent = wanted.join(newest_two.select("repo", "commit_hash"), ["repo", "commit_hash"], "left_semi")
    return {
        "commits": scope.commits_with_prefix(history.metrics_chronological(past.drop("ts"), commits), prefix),
        "commit_table": history.commit_table(past),
        "troubled": history.troubled_commits(past),
        "heroic": history.heroic_commits(past),
        "gauges": ranking.health_gauges(past, stats),
        "range": history.history_range(past),
        "series": history.chart_series(past, stats),
        "large": ranking.top_large_files(latest),
        "complex": ranking.top_complex_files(latest),
        "smelly": ranking.top_smelly_files(latest),
        "coupled": ranking.top_coupled_files(latest),
        "heat": scoring.heat_rank(latest),
        "top_badness": ranking.top_badness(latest),
        "top_diffusion": ranking.top_diffusion(latest),
        "top_delta": diff.delta_contributors(recent, newest_two),
        "files": ranking.file_metrics_table(latest),
    }


def drill_down(files: DataFrame, past: DataFrame) -> dict[str, DataFrame]:
    """Assessment of each repository's scanned commit against its stored history.

    ``files`` holds the files of one commit per repository, stored or not.
    """
    current = scoring.entropy_by_commit(files)
    previous = history.trend_vs_previous(past).select("repo", "commit_hash", "delta", "trend")
    return {
        "languages": rollup.sloc_by_language(files),
        "files": scope.recognised_only(files),
        "events": history.notable_events(past),
        "assessment": history.drift_level(current).join(previous, ["repo", "commit_hash"], "left"),
        "position": history.percentile_position(past, current),
    }
