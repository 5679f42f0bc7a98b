"""Two snapshots to a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff, history
from ..operators.history import ORDER
from ..sources import snapshot_json


def until(past: DataFrame, commit_hash: str) -> DataFrame:
    """History up to a commit's place in the time order of its repository; repositories without it have no row."""
    place = F.struct(*ORDER)
    named = past.where(F.col("commit_hash") == commit_hash).groupBy("repo").agg(F.min(place).alias("_until"))
    return past.join(named, "repo").where(place <= F.col("_until")).select(*past.columns)


def summary_at(past: DataFrame, commit_hash: str) -> DataFrame:
    """(repo, entropy, files, sloc, commits) as of a commit; see until()."""
    newest = F.max_by(F.struct("entropy", "total_files", "total_sloc"), F.struct(*ORDER))
    rows = until(past, commit_hash).groupBy("repo").agg(newest.alias("_head"), F.count(F.lit(1)).alias("commits"))
    return rows.select(
        "repo",
        F.col("_head.entropy").alias("entropy"),
        F.col("_head.total_files").alias("files"),
        F.col("_head.total_sloc").alias("sloc"),
        "commits",
    )


def compare_documents(baseline: DataFrame, current: DataFrame) -> dict[str, DataFrame]:
    """Everything a comparison of parsed snapshot documents shows.

    Both inputs are (repo, snapshot), one document per repository.  The history
    of a document is in time order already; its position takes the place of time.
    """
    sides = {"baseline": baseline, "current": current}
    summaries = {name: snapshot_json.snapshot_summary(rows) for name, rows in sides.items()}
    files = {name: snapshot_json.snapshot_files(rows) for name, rows in sides.items()}
    past = snapshot_json.snapshot_history(current)
    ordered = past.withColumn("ts", F.timestamp_seconds("position"))
    signals = history.forecast_signals(ordered)
    pairs = diff.pair_snapshots(files["baseline"], files["current"])
    # a document without history has no signals, yet a summary to judge
    now = summaries["current"].select("repo", F.col("entropy").alias("_entropy"))
    judged = (
        now.join(signals.drop("entropy"), "repo", "left")
        .withColumnRenamed("_entropy", "entropy")
        .fillna(0.0, ["trend"])
        .fillna(0, ["commit_count"])
        .fillna(False, ["heat_spike", "heat_wave", "cold_front"])
    )
    return {
        "summary": diff.summary_compare(summaries["baseline"], summaries["current"]),
        "verdict": diff.drift_verdict(summaries["baseline"], judged),
        "observations": diff.observations(summaries["baseline"], summaries["current"], pairs, judged),
        "files": diff.snapshot_diff(files["baseline"], files["current"]),
        "baseline_series": history.downsample(
            snapshot_json.snapshot_history(baseline).withColumn("ts", F.timestamp_seconds("position")), 300
        ),
        "current_series": history.downsample(ordered, 300),
    }
