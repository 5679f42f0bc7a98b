"""Comparing snapshots: file differences, summaries, verdicts, facts.

A snapshot is a table (repo, path, badness, ...) with one row per file; both
sides meet in one full outer join on the unique key (repo, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from . import scoring
from .rollup import COMMIT

_EPS = fixed.EPSILON


def pair_snapshots(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(repo, path, baseline_badness, current_badness, status, delta) for every file of either side.

    ``status`` is new, removed, worsened, improved or same.
    """
    old = baseline.select("repo", "path", F.col("badness").alias("baseline_badness"))
    new = current.select("repo", "path", F.col("badness").alias("current_badness"))
    before, after = F.col("baseline_badness"), F.col("current_badness")
    status = (
        F.when(before.isNull(), "new")
        .when(after.isNull(), "removed")
        .when(after > before + _EPS, "worsened")
        .when(after < before - _EPS, "improved")
        .otherwise("same")
    )
    return (
        old.join(new, ["repo", "path"], "full_outer")
        .withColumn("status", status)
        .withColumn("delta", after - before)
    )


def new_files(baseline: DataFrame, current: DataFrame) -> DataFrame:
    fresh = current.join(baseline.select("repo", "path"), ["repo", "path"], "left_anti")
    return fresh.orderBy("repo", F.desc("badness"), "path")


def removed_files(baseline: DataFrame, current: DataFrame) -> DataFrame:
    return new_files(current, baseline)


def _in_both(baseline: DataFrame, current: DataFrame) -> DataFrame:
    old = baseline.select("repo", "path", F.col("badness").alias("baseline_badness"))
    both = current.select("repo", "path", F.col("badness").alias("current_badness")).join(old, ["repo", "path"])
    return both.withColumn("delta", F.col("current_badness") - F.col("baseline_badness"))


def worsened_files(baseline: DataFrame, current: DataFrame) -> DataFrame:
    risen = F.col("current_badness") > F.col("baseline_badness") + _EPS
    return _in_both(baseline, current).where(risen).orderBy("repo", F.desc("delta"), "path")


def improved_files(baseline: DataFrame, current: DataFrame) -> DataFrame:
    fallen = F.col("current_badness") < F.col("baseline_badness") - _EPS
    return _in_both(baseline, current).where(fallen).orderBy("repo", "delta", "path")


def snapshot_diff(baseline: DataFrame, current: DataFrame, top: int = fixed.TOP_FILES) -> DataFrame:
    """The ``top`` new, removed, worsened and improved files of every repository from one join."""
    weight = F.coalesce(F.abs("delta"), F.col("current_badness"), F.col("baseline_badness"))
    order = Window.partitionBy("repo", "status").orderBy(weight.desc(), F.col("path"))
    return (
        pair_snapshots(baseline, current)
        .where(F.col("status") != "same")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
    )


def summary_compare(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Entropy, files, SLOC and commits side by side.

    Both inputs hold one row per repository: (repo, entropy, files, sloc,
    commits).  A missing side counts as zeros.
    """
    metrics = ["entropy", "files", "sloc", "commits"]

    def long(summary: DataFrame, name: str) -> DataFrame:
        wide = summary.select("repo", *[F.col(m).cast("double").alias(m) for m in metrics])
        return wide.unpivot(["repo"], metrics, "metric", name)

    joined = long(baseline, "baseline").join(long(current, "current"), ["repo", "metric"], "full_outer")
    before = F.coalesce(F.col("baseline"), F.lit(0.0))
    after = F.coalesce(F.col("current"), F.lit(0.0))
    delta = after - before
    higher_is_bad = F.col("metric") == "entropy"
    direction = (
        F.when(delta == 0, "unchanged").when((delta > 0) == higher_is_bad, "worse").otherwise("better")
    )
    return joined.select(
        "repo",
        "metric",
        before.alias("baseline"),
        after.alias("current"),
        delta.alias("delta"),
        F.coalesce(F.try_divide(delta, before), F.lit(0.0)).alias("relative_delta"),
        direction.alias("direction"),
    )


def verdict(baseline_entropy: Column, entropy: Column) -> Column:
    """Forecast from the two scores and the columns of ``history.forecast_signals``."""
    delta = entropy - baseline_entropy
    trend = F.col("trend")
    return (
        F.when((entropy > baseline_entropy) & F.col("heat_wave"), "HeatWave")
        .when((delta > 0) & F.col("heat_spike"), "HeatSpike")
        .when((delta < -fixed.ELEVATION) & F.col("cold_front"), "ColdFront")
        .when((trend > fixed.TREND_DEAD_ZONE) & (delta > fixed.WARMING_DELTA), "Warming")
        .when((trend < -fixed.TREND_DEAD_ZONE) & (delta <= 0), "Cooling")
        .otherwise("Stable")
    )


def drift_verdict(baseline: DataFrame, signals: DataFrame) -> DataFrame:
    """Verdict per repository: ``baseline`` (repo, entropy) against forecast signals with ``entropy``."""
    joined = signals.join(baseline.select("repo", F.col("entropy").alias("baseline_entropy")), "repo", "left")
    before = F.coalesce(F.col("baseline_entropy"), F.lit(0.0))
    return joined.withColumn("baseline_entropy", before).withColumn("verdict", verdict(before, F.col("entropy")))


def drift_verdict_as_of(signals: DataFrame, lag: int) -> DataFrame:
    """Verdict of every commit against the commit ``lag`` steps before it.

    The first ``lag`` commits have none before them to be judged against: baseline and verdict are null.
    """
    earlier = signals.select(
        "repo", (F.col("commit_seq") + lag).alias("commit_seq"), F.col("entropy").alias("baseline_entropy")
    )
    joined = signals.join(earlier, ["repo", "commit_seq"], "left")
    before = F.col("baseline_entropy")
    return joined.withColumn("verdict", F.when(before.isNotNull(), verdict(before, F.col("entropy"))))


def observations(baseline: DataFrame, current: DataFrame, pairs: DataFrame, trends: DataFrame) -> DataFrame:
    """Facts about the change of each repository, as (repo, position, code, amount, share, example).

    ``baseline`` and ``current`` are summaries as for ``summary_compare``,
    ``pairs`` comes from ``pair_snapshots`` and ``trends`` holds (repo,
    commit_count, trend) of the current history.
    """
    def side(summary: DataFrame, prefix: str) -> DataFrame:
        names = ["entropy", "files", "sloc"]
        return summary.select("repo", *[F.col(n).cast("double").alias(f"{prefix}_{n}") for n in names])

    hotter, cooler = F.col("status") == "worsened", F.col("status") == "improved"
    moved = pairs.groupBy("repo").agg(
        F.count_if(hotter).alias("_hotter"),
        F.min(F.when(hotter, F.struct((-F.col("delta")).alias("d"), "path"))).alias("_hottest"),
        F.count_if(cooler).alias("_cooler"),
        F.min(F.when(cooler, F.struct(F.col("delta").alias("d"), "path"))).alias("_coolest"),
    )
    base = (
        side(baseline, "b")
        .join(side(current, "c"), "repo", "full_outer")
        .fillna(0.0)
        .join(moved, "repo", "left")
        .join(trends.select("repo", "commit_count", "trend"), "repo", "left")
    )
    d_entropy = F.col("c_entropy") - F.col("b_entropy")
    d_sloc = F.col("c_sloc") - F.col("b_sloc")
    d_files = F.col("c_files") - F.col("b_files")
    relative = F.coalesce(F.try_divide(d_entropy, F.col("b_entropy")), F.lit(0.0))

    def fact(position: int, code, amount, share=None, example=None) -> Column:
        return F.struct(
            F.lit(position).alias("position"),
            (F.lit(code) if isinstance(code, str) else code).alias("code"),
            amount.cast("double").alias("amount"),
            (F.lit(None) if share is None else share).cast("double").alias("share"),
            (F.lit(None) if example is None else example).cast("string").alias("example"),
        )

    direction = (
        F.when(F.abs(d_entropy) < 0.001, "entropy_unchanged")
        .when(d_entropy < 0, "entropy_dropped")
        .otherwise("entropy_rose")
    )
    inner = (
        F.when(F.col("trend") > fixed.TREND_DEAD_ZONE, "inner_warming")
        .when(F.col("trend") < -fixed.TREND_DEAD_ZONE, "inner_cooling")
        .otherwise("inner_flat")
    )
    growth = (
        F.when((d_sloc > 0) & (d_entropy <= 0), "grew_and_cooled")
        .when((d_sloc > 0) & (d_entropy > 0), "grew_and_rose")
        .when((d_sloc < 0) & (d_entropy < 0), "shrank_and_improved")
    )
    files = F.when(d_files > 0, "files_added").when(d_files < 0, "files_removed")
    facts = F.array(
        fact(1, direction, F.abs(d_entropy), F.abs(relative)),
        F.when(F.col("commit_count") >= 3, fact(2, inner, F.abs("trend"))),
        F.when(growth.isNotNull(), fact(3, growth, F.abs(d_sloc))),
        F.when(files.isNotNull(), fact(4, files, F.abs(d_files))),
        F.when(F.col("_hotter") > 0, fact(5, "files_hotter", F.col("_hotter"), None, F.col("_hottest.path"))),
        F.when(F.col("_cooler") > 0, fact(6, "files_cooler", F.col("_cooler"), None, F.col("_coolest.path"))),
    )
    return base.select("repo", F.explode(facts).alias("_fact")).where(F.col("_fact").isNotNull()).select(
        "repo", "_fact.*"
    )


def delta_contributors(
    files: DataFrame, numbered: DataFrame, top: int | None = fixed.TOP_FILES
) -> DataFrame:
    """Files whose badness rose most from one commit to the next, for every commit.

    Each side is scaled in its own commit.  A file that was absent counts from
    0.  A repository's first commit has nothing before it and gives no rows.
    ``numbered`` holds (repo, commit_hash, commit_seq).
    """
    seq = numbered.select(*COMMIT, "commit_seq")
    scored = scoring.badness_by_file(files, commits=seq)
    placed = scored.select(*COMMIT, "path", "commit_seq", "badness")
    before = placed.select(
        "repo", "path", (F.col("commit_seq") + 1).alias("commit_seq"), F.col("badness").alias("old_badness")
    )
    joined = placed.where(F.col("commit_seq") > 1).join(before, ["repo", "path", "commit_seq"], "left")
    old = F.coalesce(F.col("old_badness"), F.lit(0.0))
    rises = joined.select(
        *COMMIT,
        "path",
        old.alias("old_badness"),
        F.col("badness").alias("new_badness"),
        (F.col("badness") - old).alias("delta"),
    ).where(F.col("delta") > _EPS)
    if top is None:
        return rises
    order = Window.partitionBy(*COMMIT).orderBy(F.desc("delta"), "path")
    return rises.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
