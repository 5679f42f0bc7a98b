"""Time-series operators over commits.

Histories are one row per commit, ordered by (ts, commit_hash) inside a
repository.  A repository may own a large share of all commits, so no window
runs over a whole repository: time is cut into hours and ``skew.with_carry``
hands each hour what lies outside it.  The calendar bounds the summaries of a
repository at 8,766 rows a year, however many commits it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, measures
from .ancestry import settle
from .skew import attach, keyed, with_carry

ORDER = ("ts", "commit_hash")
# scores lie in 0..5, so this many chunks per unit bound the summaries of a repository at 50,000 rows
_SCORE_CHUNKS = 10_000


def _in_chunk():
    return Window.partitionBy("repo", "_chunk").orderBy(*ORDER)


def _so_far():
    return _in_chunk().rowsBetween(Window.unboundedPreceding, 0)


def add_chunk(history: DataFrame, unit: str = "hour") -> DataFrame:
    return history.withColumn("_chunk", F.date_trunc(unit, F.col("ts")))


def _position(rows_before: str = "_rows_before") -> Column:
    return F.coalesce(F.col(rows_before), F.lit(0)) + F.row_number().over(_in_chunk())


def number_commits(commits: DataFrame, unit: str = "hour") -> DataFrame:
    """Add ``commit_seq`` (1 = oldest) and ``commit_count`` of the repository."""
    one = F.count(F.lit(1))
    rows = with_carry(
        add_chunk(commits, unit),
        ["repo"],
        "_chunk",
        {"_rows_before": (one, F.sum, "before"), "commit_count": (one, F.sum, "all")},
    )
    return rows.select(*commits.columns, _position().alias("commit_seq"), "commit_count")


def in_graph_order(commits: DataFrame) -> DataFrame:
    """Commits whose ``ts`` puts no commit before its parents, and their own time as ``_time``.

    Tables without ``parents`` keep their times.
    """
    if "parents" not in commits.columns:
        return commits.withColumn("_time", F.col("ts"))
    return settle(commits).withColumn("_time", F.col("ts")).withColumn("ts", F.col("settled")).drop("settled")


def own_time(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.col("_time")).drop("_time")


def commits_chronological(commits: DataFrame) -> DataFrame:
    """Oldest first, numbered; no commit before its parents, whatever its clock said."""
    return own_time(number_commits(in_graph_order(commits))).drop("commit_count").orderBy("repo", "commit_seq")


def head_commit(commits: DataFrame) -> DataFrame:
    """Newest commit of every repository: the last in the order of ``commits_chronological``."""
    columns, commits = commits.columns, in_graph_order(commits)
    others = [c for c in columns if c not in ("repo", "ts")]
    newest = F.max_by(F.struct(*others, F.col("_time").alias("ts")), F.struct(*ORDER)).alias("_head")
    others = [c for c in columns if c != "repo"]
    return commits.groupBy("repo").agg(newest).select("repo", *[F.col(f"_head.{c}").alias(c) for c in others])


def history_join(metrics: DataFrame, commits: DataFrame) -> DataFrame:
    """Commit metrics with their times.

    Where none of a repository's metrics has a known commit, all its metrics
    are kept with the 3rd of January of year 1, which every time zone can show.
    """
    known = commits.select("repo", "commit_hash", "ts", "parents")
    joined = keyed(metrics, ["repo"]).join(known, ["repo", "commit_hash"], "left")
    found = joined.groupBy("repo").agg(F.count(F.lit(1)).alias("_rows"), F.count("ts").alias("_known"))
    beginning = F.lit("0001-01-03 00:00:00").cast(commits.schema["ts"].dataType)
    rows = attach(joined, found, ["repo"])
    return rows.where(F.col("ts").isNotNull() | (F.col("_known") == 0)).select(
        *metrics.columns,
        F.coalesce(F.col("ts"), beginning).alias("ts"),
        F.coalesce(F.col("parents"), F.array().cast("array<string>")).alias("parents"),
    )


def metrics_chronological(metrics: DataFrame, commits: DataFrame) -> DataFrame:
    """Commit metrics in time order, unknown times last."""
    joined = metrics.join(commits.select("repo", "commit_hash", "ts"), ["repo", "commit_hash"], "left")
    return joined.orderBy("repo", F.asc_nulls_last("ts"), "commit_hash")


# --- steps between commits ---------------------------------------------------------------

def with_previous(history: DataFrame, columns: Sequence[str], unit: str = "hour") -> DataFrame:
    """Add ``commit_seq`` and ``prev_<column>`` of the commit before.  Keeps ``_chunk``."""
    values = F.struct(*columns)
    rows = with_carry(
        add_chunk(history, unit),
        ["repo"],
        "_chunk",
        {
            "_rows_before": (F.count(F.lit(1)), F.sum, "before"),
            "_last_before": (F.max_by(values, F.struct(*ORDER)), F.last, "before"),
        },
    )
    previous = F.coalesce(F.lag(values).over(_in_chunk()), F.col("_last_before"))
    return rows.select(
        *history.columns, "_chunk", _position().alias("commit_seq"), previous.alias("_previous")
    ).select(
        *history.columns,
        "_chunk",
        "commit_seq",
        *[F.col(f"_previous.{c}").alias(f"prev_{c}") for c in columns],
    )


def _deltas(history: DataFrame) -> DataFrame:
    rows = with_previous(history, ["entropy", "total_sloc", "total_files"])
    delta = F.coalesce(F.col("entropy") - F.col("prev_entropy"), F.lit(0.0))
    return rows.select(
        *history.columns,
        "_chunk",
        "commit_seq",
        "prev_entropy",
        delta.alias("delta"),
        F.coalesce(F.try_divide(delta, F.col("prev_entropy")), F.lit(0.0)).alias("relative_delta"),
        F.coalesce(F.col("total_sloc") - F.col("prev_total_sloc"), F.lit(0)).alias("sloc_delta"),
        F.coalesce(F.col("total_files") - F.col("prev_total_files"), F.lit(0)).alias("files_delta"),
    )


def commit_deltas(history: DataFrame) -> DataFrame:
    """Change of entropy, lines and files from one commit to the next; zeros for the first."""
    return _deltas(history).drop("_chunk", "prev_entropy")


def commit_table(history: DataFrame) -> DataFrame:
    """Newest first."""
    return commit_deltas(history).orderBy("repo", F.desc("commit_seq"))


def _population_std(total: Column, squares: Column, n: Column) -> Column:
    mean = total / n
    return F.sqrt(F.greatest(F.lit(0.0), squares / n - mean * mean))


def outlier_commits(
    history: DataFrame,
    sigmas: float = fixed.OUTLIER_SIGMAS,
    min_delta: float = fixed.MIN_NOTABLE_DELTA,
) -> DataFrame:
    """Commits whose entropy step is an outlier of their repository.

    ``event`` is 'troubled' (steep rise) or 'heroic' (steep fall).  The first
    commit has no step and takes no part.
    """
    step = F.when(F.col("commit_seq") > 1, F.col("delta"))
    rows = with_carry(
        _deltas(history),
        ["repo"],
        "_chunk",
        {
            "_steps": (F.count(step), F.sum, "all"),
            "_sum": (F.sum(step), F.sum, "all"),
            "_squares": (F.sum(step * step), F.sum, "all"),
        },
    ).where(F.col("commit_seq") > 1)
    mean = F.col("_sum") / F.col("_steps")
    spread = F.lit(sigmas) * _population_std(F.col("_sum"), F.col("_squares"), F.col("_steps"))
    event = F.when(F.col("delta") >= F.greatest(F.lit(min_delta), mean + spread), F.lit("troubled")).when(
        F.col("delta") <= F.least(F.lit(-min_delta), mean - spread), F.lit("heroic")
    )
    kept = [*history.columns, "commit_seq", "delta", "relative_delta", "sloc_delta", "files_delta"]
    return rows.select(*kept, event.alias("event")).where(F.col("event").isNotNull())


def troubled_commits(history: DataFrame) -> DataFrame:
    found = outlier_commits(history).where(F.col("event") == "troubled")
    return found.orderBy("repo", F.desc("delta"), "commit_hash")


def heroic_commits(history: DataFrame) -> DataFrame:
    found = outlier_commits(history).where(F.col("event") == "heroic")
    return found.orderBy("repo", "delta", "commit_hash")


def notable_events(history: DataFrame, top: int = fixed.TOP_EVENTS) -> DataFrame:
    """The steepest rises and falls of every repository, ``top`` of each."""
    steepest = Window.partitionBy("repo", "event").orderBy(F.desc(F.abs("delta")), "commit_hash")
    return outlier_commits(history).withColumn("rank", F.row_number().over(steepest)).where(F.col("rank") <= top)


def trend_vs_previous(history: DataFrame) -> DataFrame:
    """Step from the commit before and its label; both null for the first commit."""
    rows = _deltas(history)
    step = F.when(F.col("commit_seq") > 1, F.col("delta"))
    return rows.select(*history.columns, "commit_seq", step.alias("delta"), measures.trend_label(step).alias("trend"))


# --- forecasts ---------------------------------------------------------------------------

def entropy_trend(history: DataFrame) -> DataFrame:
    """Mean step of every repository: the steps telescope, so the two ends suffice."""
    order = F.struct(*ORDER)
    ends = history.groupBy("repo").agg(
        F.count(F.lit(1)).alias("commit_count"),
        F.min_by("entropy", order).alias("_first"),
        F.max_by("entropy", order).alias("_last"),
    )
    mean_step = F.try_divide(F.col("_last") - F.col("_first"), F.col("commit_count") - 1)
    return ends.select("repo", "commit_count", F.coalesce(mean_step, F.lit(0.0)).alias("trend"))


def is_heat_spike(n: Column, steepest: Column, mean: Column, deviation: Column) -> Column:
    outlier = steepest > mean + F.lit(fixed.OUTLIER_SIGMAS) * deviation
    return F.coalesce((n >= 3) & outlier & (steepest > fixed.ELEVATION), F.lit(False))


def is_heat_wave(n: Column, reference: Column, lowest: Column, first: Column, last: Column, window: int) -> Column:
    jump = first - reference
    sustained = (lowest > reference + fixed.ELEVATION) & (jump > fixed.ELEVATION) & (F.abs(last - first) < jump)
    return F.coalesce((n >= window + 2) & sustained, F.lit(False))


def is_cold_front(n: Column, falls: Column, window: int) -> Column:
    needed = -int(-window * fixed.COLD_SHARE // 1)
    return F.coalesce((n >= window + 1) & (falls >= needed), F.lit(False))


def forecast_signals(history: DataFrame, window: int = fixed.HEAT_WINDOW) -> DataFrame:
    """Trend, heat spike, heat wave and cold front of each repository's whole history."""
    rows = _deltas(history)
    step = F.when(F.col("commit_seq") > 1, F.col("delta"))
    whole = rows.groupBy("repo").agg(
        F.count(F.lit(1)).alias("commit_count"),
        F.max(step).alias("_steepest"),
        F.avg(step).alias("_mean"),
        F.stddev_pop(step).alias("_deviation"),
    )
    # the limit on the rank is applied before the shuffle, so a task sends window + 1 rows per repository
    newest = Window.partitionBy("repo").orderBy(*[F.desc(c) for c in ORDER])
    tail = (
        rows.withColumn("_back", F.row_number().over(newest))
        .where(F.col("_back") <= window + 1)
        .groupBy("repo")
        .agg(
            F.max(F.when(F.col("_back") == window + 1, F.col("entropy"))).alias("_reference"),
            F.min(F.when(F.col("_back") <= window, F.col("entropy"))).alias("_lowest"),
            F.max(F.when(F.col("_back") == window, F.col("entropy"))).alias("_first"),
            F.max(F.when(F.col("_back") == 1, F.col("entropy"))).alias("_last"),
            F.count_if((F.col("_back") <= window) & (F.col("delta") < 0)).alias("_falls"),
        )
    )
    n = F.col("commit_count")
    return whole.join(tail, "repo").select(
        "repo",
        "commit_count",
        F.coalesce(F.col("_mean"), F.lit(0.0)).alias("trend"),
        is_heat_spike(n, F.col("_steepest"), F.col("_mean"), F.col("_deviation")).alias("heat_spike"),
        is_heat_wave(
            n, F.col("_reference"), F.col("_lowest"), F.col("_first"), F.col("_last"), window
        ).alias("heat_wave"),
        is_cold_front(n, F.col("_falls"), window).alias("cold_front"),
        F.col("_last").alias("entropy"),
    )


def forecast_signals_as_of(history: DataFrame, window: int = fixed.HEAT_WINDOW) -> DataFrame:
    """The same four signals as of every commit, each judged on the history up to it."""
    step = F.when(F.col("commit_seq") > 1, F.col("delta"))
    rows = with_carry(
        _deltas(history),
        ["repo"],
        "_chunk",
        {
            "_sum0": (F.sum(step), F.sum, "before"),
            "_squares0": (F.sum(step * step), F.sum, "before"),
            "_steepest0": (F.max(step), F.max, "before"),
        },
    )

    def so_far(before: str, inside: Column) -> Column:
        return F.coalesce(F.col(before), F.lit(0.0)) + F.coalesce(inside.over(_so_far()), F.lit(0.0))

    steps = F.col("commit_seq") - 1
    running = rows.select(
        "repo",
        "commit_hash",
        "ts",
        "commit_seq",
        "entropy",
        F.try_divide(so_far("_sum0", F.sum(step)), steps).alias("_mean"),
        F.try_divide(so_far("_squares0", F.sum(step * step)), steps).alias("_mean_square"),
        F.greatest(F.col("_steepest0"), F.max(step).over(_so_far())).alias("_steepest"),
    )
    # every commit offers its score to itself and to the `window` commits after it
    offered = running.withColumn("_ahead", F.explode(F.sequence(F.lit(0), F.lit(window))))
    own = F.max(F.when(F.col("_ahead") == 0, F.struct("commit_hash", "ts", "_mean", "_mean_square", "_steepest")))
    seen = (
        offered.groupBy("repo", (F.col("commit_seq") + F.col("_ahead")).alias("commit_seq"))
        .agg(
            own.alias("_own"),
            *[F.max(F.when(F.col("_ahead") == k, F.col("entropy"))).alias(f"_e{k}") for k in range(window + 1)],
        )
        .where(F.col("_own").isNotNull())
    )
    n = F.col("commit_seq")
    mean = F.col("_own._mean")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("_own._mean_square") - mean * mean))
    lowest = F.least(*[F.col(f"_e{k}") for k in range(window)])
    falls = sum(
        (F.when(F.col(f"_e{k}") < F.col(f"_e{k + 1}"), F.lit(1)).otherwise(F.lit(0)) for k in range(window)),
        F.lit(0),
    )
    return seen.select(
        "repo",
        F.col("_own.commit_hash").alias("commit_hash"),
        F.col("_own.ts").alias("ts"),
        "commit_seq",
        F.col("_e0").alias("entropy"),
        F.coalesce(mean, F.lit(0.0)).alias("trend"),
        is_heat_spike(n, F.col("_own._steepest"), mean, deviation).alias("heat_spike"),
        is_heat_wave(
            n, F.col(f"_e{window}"), lowest, F.col(f"_e{window - 1}"), F.col("_e0"), window
        ).alias("heat_wave"),
        is_cold_front(n, falls, window).alias("cold_front"),
    )


# --- position and range ------------------------------------------------------------------

def history_range(history: DataFrame) -> DataFrame:
    return history.groupBy("repo").agg(
        F.min("entropy").alias("entropy_min"),
        F.avg("entropy").alias("entropy_mean"),
        F.max("entropy").alias("entropy_max"),
    )


def percentile_position(history: DataFrame, current: DataFrame | None = None, min_commits: int = 3) -> DataFrame:
    """Share of a repository's history at or below a score, with its range and a label.

    Without ``current`` every stored commit is placed in its own history; with
    it, the given (repo, commit_hash, entropy) rows are, stored or not.
    Repositories with fewer than ``min_commits`` commits give nothing.
    """
    points = history.select("repo", "commit_hash", "entropy", F.lit(1).alias("_stored"))
    if current is not None:
        points = points.unionByName(current.select("repo", "commit_hash", "entropy", F.lit(0).alias("_stored")))
    # equal scores fold first: however many commits share a score, it is one row from here on
    values = (
        points.groupBy("repo", "entropy")
        .agg(F.sum("_stored").alias("_weight"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_chunk", F.floor(F.col("entropy") * _SCORE_CHUNKS))
    )
    stored = F.when(F.col("_weight") > 0, F.col("entropy"))
    placed = with_carry(
        values,
        ["repo"],
        "_chunk",
        {
            "_below": (F.sum("_weight"), F.sum, "before"),
            "history_count": (F.sum("_weight"), F.sum, "all"),
            "entropy_min": (F.min(stored), F.min, "all"),
            "entropy_max": (F.max(stored), F.max, "all"),
            "_sum": (F.sum(F.col("entropy") * F.col("_weight")), F.sum, "all"),
        },
    )
    upward = Window.partitionBy("repo", "_chunk").orderBy("entropy").rowsBetween(Window.unboundedPreceding, 0)
    at_or_below = F.coalesce(F.col("_below"), F.lit(0)) + F.sum("_weight").over(upward)
    ranked = placed.select(
        "repo",
        "entropy",
        "_rows",
        "history_count",
        (at_or_below * F.lit(100.0) / F.col("history_count")).alias("percentile"),
        "entropy_min",
        (F.col("_sum") / F.col("history_count")).alias("entropy_mean"),
        "entropy_max",
    ).where(F.col("history_count") >= min_commits)
    wanted = points.where(F.col("_stored") == (1 if current is None else 0)).drop("_stored")
    rows = attach(wanted, ranked, ["repo", "entropy"]).drop("_rows")
    label = measures.band_below(F.col("percentile"), fixed.POSITION_LABELS, inclusive=True)
    return rows.withColumn("position", label)


def drift_level(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("grade", measures.drift_grade(F.col("entropy")))


def entropy_badge(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("band", measures.badge_band(F.col("entropy")))


# --- series ------------------------------------------------------------------------------

def downsample(history: DataFrame, max_points: int = fixed.CHART_POINTS) -> DataFrame:
    """At most ``max_points`` commits per repository, evenly spaced, both ends kept.

    Point i sits at index round-half-even(i * (n-1) / (max_points-1)).  Whether a
    row is such a point is decided from its own number, so nothing is joined.
    """
    rows = number_commits(history)
    index = F.col("commit_seq") - 1
    step = (F.col("commit_count") - 1).cast("double") / F.lit(float(max_points - 1))
    near = F.rint(F.try_divide(index.cast("double"), step)).cast("bigint")
    hit = F.lit(False)
    for offset in (-1, 0, 1):
        point = near + offset
        inside = (point >= 0) & (point < max_points)
        hit = hit | (inside & (F.rint(point * step).cast("bigint") == index))
    return rows.where((F.col("commit_count") <= max_points) | hit).drop("commit_count")


def growth_series(history: DataFrame) -> DataFrame:
    """Lines, files and lines per file over time."""
    per_file = F.try_divide(F.col("total_sloc").cast("double"), F.col("total_files"))
    return history.select(
        "repo",
        "commit_hash",
        "ts",
        "total_sloc",
        "total_files",
        F.coalesce(per_file, F.lit(0.0)).alias("sloc_per_file"),
    )


def chart_series(
    history: DataFrame,
    stats: DataFrame | None = None,
    max_points: int = fixed.CHART_POINTS,
    stats_points: int = fixed.STATS_POINTS,
) -> DataFrame:
    """Long table (repo, series, x, y) behind the history figures."""
    growth = downsample(history, max_points)
    per_file = F.coalesce(F.try_divide(F.col("total_sloc").cast("double"), F.col("total_files")), F.lit(0.0))
    day = F.date_format("ts", "yyyy-MM-dd").alias("x")
    wide = growth.select(
        "repo",
        "commit_hash",
        day,
        F.col("entropy").alias("entropy"),
        F.col("total_sloc").cast("double").alias("sloc"),
        per_file.alias("sloc_per_file"),
    )
    long = wide.unpivot(["repo", "commit_hash", "x"], ["entropy", "sloc", "sloc_per_file"], "series", "y")
    if stats is None:
        return long
    sampled = downsample(history, stats_points).select("repo", "commit_hash", day)
    quality = sampled.join(stats.select("repo", "commit_hash", "avg_cc", "avg_smell"), ["repo", "commit_hash"])
    return long.unionByName(
        quality.unpivot(["repo", "commit_hash", "x"], ["avg_cc", "avg_smell"], "series", "y")
    )
