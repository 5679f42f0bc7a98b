"""The registered queries: every operator over the whole test tables.

Each entry builds its DataFrame lazily.  ``publish`` fixes the column set, rounds
doubles to six places and widens integers, so that a result compares by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import diff, history, maintenance, ranking, rollup, scope, scoring, snapshots
from ..plans import compare, report
from ..sources import function_csv, patterns, snapshot_json, source_tree, tables
from ..sources.tables import stored_copy
from ..streaming import incremental
from . import trees, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_KEYS = ["repo", "commit_hash"]
_FILE = [*_KEYS, "path"]
_METRICS = [*_KEYS, "total_files", "total_sloc", "entropy"]
_MEASURES = ["language", "sloc", "cc", "mi", "smells_high", "smells_medium", "smells_low", "coupling", "kind"]


def publish(rows: DataFrame, *columns: str) -> DataFrame:
    """The named columns (all, if none), comparable by value."""
    kinds = dict(rows.dtypes)
    out: list[Column] = []
    for name in columns or rows.columns:
        value, kind = F.col(name), kinds[name]
        if kind in ("double", "float"):
            value = F.round(value, 6) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            value = value.cast("bigint")
        elif kind.startswith("timestamp"):
            value = F.date_format(value, "yyyy-MM-dd")
        out.append(value.alias(name))
    return rows.select(*out)


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return register


# --- sources and sinks -------------------------------------------------------------------

@query("source_tree_scan")
def _(spark, sf_dir):
    root = tables.work_folder(spark) + "/tree"
    trees.write_tree(views.source_files(spark, sf_dir), root)
    return publish(source_tree.scan_tree(spark, root, exclude=["*.hpp"], utility=views.UTILITY_PATTERNS))


@query("commit_blob_scan")
def _(spark, sf_dir):
    files = source_tree.scan_commits(
        views.source_files(spark, sf_dir),
        views.document_functions(spark, sf_dir),
        exclude=["*.hpp"],
        utility=views.UTILITY_PATTERNS,
    )
    return publish(files)


@query("commit_blob_totals")
def _(spark, sf_dir):
    files = source_tree.scan_commits(
        views.source_files(spark, sf_dir),
        views.document_functions(spark, sf_dir),
        exclude=["*.hpp"],
        utility=views.UTILITY_PATTERNS,
    )
    return publish(scoring.entropy_by_commit(files))


@query("manifest_scan")
def _(spark, sf_dir):
    source = views.source_files(spark, sf_dir)
    keyed = source.withColumn("content_hash", F.sha2("content", 256))
    blobs = keyed.groupBy("content_hash").agg(F.min("content").alias("content"))
    manifests = keyed.select("repo", "commit_hash", "path", "content_hash")
    return publish(source_tree.scan_manifests(manifests, blobs, utility=views.UTILITY_PATTERNS))


@query("function_csv_source")
def _(spark, sf_dir):
    folder = tables.work_folder(spark) + "/functions"
    trees.write_function_csv(views.functions(spark, sf_dir), folder, root="/scan/root")
    rows = function_csv.read_functions(spark, folder, root="/scan/root")
    return publish(rollup.function_rollup(rows, ()))


@query("snapshot_json_read")
def _(spark, sf_dir):
    snapshots = snapshot_json.parse_snapshots(trees.file_documents(views.file_metrics(spark, sf_dir)), "json")
    # documents carry one history entry and one file each, so their sections join in the row
    summary = snapshot_json.snapshot_summary(snapshots.select("document", "snapshot", F.col("snapshot").alias("s")))
    return publish(trees.flatten_documents(summary))


@query("snapshot_json_history")
def _(spark, sf_dir):
    folder = tables.work_folder(spark)
    trees.write_documents(trees.year_documents(views.history(spark, sf_dir)), folder)
    return publish(trees.document_rows(snapshot_json.read_snapshots(spark, folder)))


@query("snapshot_json_files")
def _(spark, sf_dir):
    snapshots = snapshot_json.parse_snapshots(trees.file_documents(views.file_metrics(spark, sf_dir)), "json")
    return publish(snapshot_json.snapshot_files(snapshots))


def _latest(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    past = views.history(spark, sf_dir)
    head = history.head_commit(views.commit_table(spark, sf_dir)).select(*_KEYS)
    return past, views.file_metrics(spark, sf_dir).join(head, _KEYS, "left_semi")


@query("snapshot_json_write")
def _(spark, sf_dir):
    past, latest = _latest(spark, sf_dir)
    path = tables.work_folder(spark)
    snapshot_json.write_snapshots(snapshot_json.snapshot_lines(past, latest), path)
    lines = snapshot_json.read_written(spark, path)
    entries, files = snapshot_json.parse_snapshot_lines(lines)
    heads = snapshot_json.parse_snapshot_heads(lines).select(
        "repo", F.lit("summary").alias("section"), F.col("commits").cast("string").alias("name"), F.lit("").alias("date"),
        F.col("entropy").alias("value"), "files", "sloc",
    )
    none = F.lit(0).cast("bigint")
    frame = lines.where(F.col("section").isin(2, 4)).select(
        "repo", F.lit("frame").alias("section"), F.col("line").alias("name"), F.lit("").alias("date"),
        F.lit(0.0).alias("value"), none.alias("files"), none.alias("sloc"),
    )
    entries = entries.select(
        "repo", F.lit("history").alias("section"), F.col("hash").alias("name"), "date",
        F.col("entropy").alias("value"), "files", "sloc",
    )
    files = files.select(
        "repo", F.lit("file").alias("section"), F.col("path").alias("name"), F.lit("").alias("date"),
        F.col("badness").alias("value"), F.lit(1).cast("bigint").alias("files"), "sloc",
    )
    return publish(entries.unionByName(files).unionByName(heads).unionByName(frame))


@query("metrics_tables_write")
def _(spark, sf_dir):
    store = tables.MetricsStore(spark, tables.work_folder(spark))
    commits, files = views.commit_table(spark, sf_dir), views.file_metrics(spark, sf_dir)
    store.append("commits", commits)
    store.append("file_metrics", files)
    store.append("file_metrics", files)  # a second run adds nothing
    return publish(rollup.commit_totals(store.read("file_metrics").join(store.read("commits"), _KEYS, "left_semi")))


@query("pattern_file_source")
def _(spark, sf_dir):
    return publish(patterns.pattern_rows(views.source_files(spark, sf_dir)))


@query("chart_series_sink")
def _(spark, sf_dir):
    stats = rollup.commit_file_stats(views.file_metrics(spark, sf_dir))
    return publish(history.chart_series(views.history(spark, sf_dir), stats, max_points=50, stats_points=20))


# --- filters, projections, classification ------------------------------------------------

@query("scope_ignored_dirs")
def _(spark, sf_dir):
    return publish(scope.drop_ignored_directories(views.files(spark, sf_dir)))


@query("scope_exclude_globs")
def _(spark, sf_dir):
    return publish(scope.drop_excluded(views.files(spark, sf_dir), views.EXCLUDE_PATTERNS))


@query("scope_exclude_globs_by_repo")
def _(spark, sf_dir):
    part = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.col("p_brand").alias("repo"))
    files = views.files(spark, sf_dir).join(part, "file_id")
    regexes = patterns.regex_by_repo(trees.brand_pattern_files(views.table(spark, sf_dir, "part")))
    return publish(scope.drop_excluded_by_repo(files, regexes), "file_id", "repo", "path")


@query("scope_include_globs")
def _(spark, sf_dir):
    return publish(scope.keep_included(views.files(spark, sf_dir), views.INCLUDE_PATTERNS))


@query("classify_kind")
def _(spark, sf_dir):
    return publish(scope.classify_kind(views.files(spark, sf_dir), views.UTILITY_PATTERNS))


@query("filter_kind")
def _(spark, sf_dir):
    return publish(scope.filter_kind(views.file_metrics(spark, sf_dir), "Utility"), *_FILE, "kind", "sloc")


@query("language_assign")
def _(spark, sf_dir):
    return publish(scope.assign_language(views.files(spark, sf_dir)))


@query("recognised_only")
def _(spark, sf_dir):
    return publish(scope.recognised_only(scope.assign_language(views.files(spark, sf_dir))))


@query("commits_checkpoint")
def _(spark, sf_dir):
    found = scope.checkpoint_commits(views.commit_table(spark, sf_dir), views.tags(spark, sf_dir))
    return publish(found, *_KEYS, "ts", "is_tagged", "is_merge")


@query("commits_since")
def _(spark, sf_dir):
    return publish(scope.commits_since(views.commit_table(spark, sf_dir), views.START), *_KEYS, "ts")


@query("commits_since_branched")
def _(spark, sf_dir):
    branched = tables.stored_copy(views.branched_commits(spark, sf_dir))
    return publish(scope.commits_since(branched, views.START), *_KEYS, "ts")


@query("commit_prefix_filter")
def _(spark, sf_dir):
    return publish(scope.commits_with_prefix(views.commit_metrics(spark, sf_dir), "1996-"))


# --- lines -------------------------------------------------------------------------------

@query("sloc_by_file")
def _(spark, sf_dir):
    return publish(rollup.sloc_by_file(scope.assign_language(views.source_files(spark, sf_dir))))


@query("coupling_by_file")
def _(spark, sf_dir):
    return publish(rollup.coupling_by_file(scope.assign_language(views.source_files(spark, sf_dir))))


@query("maintainability_index")
def _(spark, sf_dir):
    rows = views.functions(spark, sf_dir).select(*_FILE, F.col("nloc").alias("sloc"), F.col("ccn").alias("cc"))
    return publish(rollup.add_maintainability(rows))


# --- aggregations ------------------------------------------------------------------------

@query("function_rollup")
def _(spark, sf_dir):
    return publish(rollup.function_rollup(views.functions(spark, sf_dir)))


@query("commit_totals")
def _(spark, sf_dir):
    return publish(rollup.commit_totals(views.file_metrics(spark, sf_dir)))


@query("sloc_by_language")
def _(spark, sf_dir):
    return publish(rollup.sloc_by_language(views.file_metrics(spark, sf_dir)))


@query("language_listing")
def _(spark, sf_dir):
    return publish(rollup.language_listing(views.classified_files(spark, sf_dir)))


@query("detected_languages")
def _(spark, sf_dir):
    return publish(rollup.detected_languages(views.file_metrics(spark, sf_dir), ["repo"]))


@query("commit_file_stats")
def _(spark, sf_dir):
    return publish(rollup.commit_file_stats(views.file_metrics(spark, sf_dir)))


@query("history_range")
def _(spark, sf_dir):
    return publish(history.history_range(views.history(spark, sf_dir)))


@query("health_gauges")
def _(spark, sf_dir):
    stats = rollup.commit_file_stats(views.file_metrics(spark, sf_dir))
    return publish(ranking.health_gauges(views.history(spark, sf_dir), stats))


@query("severity_bands")
def _(spark, sf_dir):
    files = scoring.diffusion_contributions(views.file_metrics(spark, sf_dir))
    scales = ["sloc", "cc", "smells", "coupling", "badness", "diffusion"]
    return publish(rollup.severity_bands(files, scales))


@query("delta_bands")
def _(spark, sf_dir):
    numbered = history.number_commits(views.commit_table(spark, sf_dir))
    rises = diff.delta_contributors(views.file_metrics(spark, sf_dir), numbered, top=None)
    return publish(rollup.severity_bands(rises, ["delta"]))


@query("size_gradient_bands")
def _(spark, sf_dir):
    return publish(rollup.size_gradient_bands(views.file_metrics(spark, sf_dir)))


# --- scoring -----------------------------------------------------------------------------

@query("badness_by_file")
def _(spark, sf_dir):
    return publish(scoring.badness_by_file(views.file_metrics(spark, sf_dir)), *_FILE, "badness")


@query("entropy_by_commit")
def _(spark, sf_dir):
    return publish(scoring.entropy_by_commit(views.file_metrics(spark, sf_dir)), *_METRICS)


@query("entropy_by_commit_kind")
def _(spark, sf_dir):
    found = scoring.entropy_by_commit_kind(views.file_metrics(spark, sf_dir))
    return publish(found, *_KEYS, "kind", "total_files", "total_sloc", "entropy")


FOCUSES = {
    "overall": "overall",
    "size": "sloc",
    "size_and_cc": "SLOC, cc",
    "maintainability": "mi",
    "smelliness": "smells",
    "imports": "coupling",
    "all_five": "sloc,cc,mi,smells,coupling",
    "unknown_word": "speed",
}


@query("refactor_scores")
def _(spark, sf_dir):
    return publish(scoring.refactor_scores(views.file_metrics(spark, sf_dir), FOCUSES), *_FILE, *FOCUSES)


@query("diffusion_contributions")
def _(spark, sf_dir):
    return publish(scoring.diffusion_contributions(views.file_metrics(spark, sf_dir)), *_FILE, "diffusion")


@query("heat_rank")
def _(spark, sf_dir):
    return publish(scoring.heat_rank(views.file_metrics(spark, sf_dir)), *_FILE, "badness", "heat", "bar")


# --- history -----------------------------------------------------------------------------

@query("commit_deltas")
def _(spark, sf_dir):
    return publish(history.commit_deltas(views.history(spark, sf_dir)))


_EVENT = [*_KEYS, "commit_seq", "entropy", "delta"]


@query("troubled_commits")
def _(spark, sf_dir):
    return publish(history.troubled_commits(views.history(spark, sf_dir)), *_EVENT)


@query("heroic_commits")
def _(spark, sf_dir):
    return publish(history.heroic_commits(views.history(spark, sf_dir)), *_EVENT)


@query("notable_events")
def _(spark, sf_dir):
    return publish(history.notable_events(views.history(spark, sf_dir)), *_EVENT, "event", "rank")


@query("entropy_trend")
def _(spark, sf_dir):
    return publish(history.entropy_trend(views.history(spark, sf_dir)))


def _signal(name: str) -> None:
    @query(name)
    def _(spark, sf_dir):
        return publish(history.forecast_signals(views.history(spark, sf_dir)), "repo", "commit_count", name)

    @query(f"{name}_as_of")
    def _(spark, sf_dir):
        return publish(history.forecast_signals_as_of(views.history(spark, sf_dir)), *_KEYS, "commit_seq", name)


for _name in ("heat_spike", "heat_wave", "cold_front"):
    _signal(_name)


@query("percentile_position")
def _(spark, sf_dir):
    return publish(history.percentile_position(views.history(spark, sf_dir)))


@query("percentile_position_unstored")
def _(spark, sf_dir):
    past = views.history(spark, sf_dir)
    head = history.head_commit(past)
    stored = past.join(head.select(*_KEYS), _KEYS, "left_anti")
    return publish(history.percentile_position(stored, head))


@query("drift_level")
def _(spark, sf_dir):
    return publish(history.drift_level(views.commit_metrics(spark, sf_dir)), *_KEYS, "entropy", "grade")


@query("trend_vs_previous")
def _(spark, sf_dir):
    return publish(history.trend_vs_previous(views.history(spark, sf_dir)), *_KEYS, "entropy", "delta", "trend")


@query("downsample_series")
def _(spark, sf_dir):
    return publish(history.downsample(views.history(spark, sf_dir), 30), *_KEYS, "commit_seq", "entropy")


@query("growth_series")
def _(spark, sf_dir):
    return publish(history.growth_series(views.history(spark, sf_dir)))


@query("entropy_badge_band")
def _(spark, sf_dir):
    return publish(history.entropy_badge(views.commit_metrics(spark, sf_dir)), *_KEYS, "entropy", "band")


# --- joins and diffs ---------------------------------------------------------------------

@query("history_join")
def _(spark, sf_dir):
    # repository N has no known commits, R only some of them
    commits = views.commit_table(spark, sf_dir).where(
        (F.col("repo") == "A") | ((F.col("repo") == "R") & (F.col("commit_hash") >= views.START))
    )
    joined = history.history_join(views.commit_metrics(spark, sf_dir), commits)
    return publish(joined.withColumn("parents", F.size("parents")), *_METRICS, "ts", "parents")


@query("metrics_chronological")
def _(spark, sf_dir):
    commits = views.commit_table(spark, sf_dir).where(F.col("commit_hash") >= views.START)
    return publish(history.metrics_chronological(views.commit_metrics(spark, sf_dir), commits), *_METRICS, "ts")


@query("attach_function_metrics")
def _(spark, sf_dir):
    files = views.source_files(spark, sf_dir).drop("content")
    rolled = rollup.function_rollup(views.document_functions(spark, sf_dir))
    return publish(rollup.attach_function_metrics(files, rolled))


def _pair(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return views.snapshot(spark, sf_dir, views.BASELINE), views.snapshot(spark, sf_dir, views.CURRENT)


@query("new_files")
def _(spark, sf_dir):
    return publish(diff.new_files(*_pair(spark, sf_dir)), "repo", "path", "badness")


@query("removed_files")
def _(spark, sf_dir):
    return publish(diff.removed_files(*_pair(spark, sf_dir)), "repo", "path", "badness")


@query("worsened_files")
def _(spark, sf_dir):
    return publish(diff.worsened_files(*_pair(spark, sf_dir)))


@query("improved_files")
def _(spark, sf_dir):
    return publish(diff.improved_files(*_pair(spark, sf_dir)))


@query("snapshot_diff")
def _(spark, sf_dir):
    return publish(diff.snapshot_diff(*_pair(spark, sf_dir)))


@query("summary_compare")
def _(spark, sf_dir):
    past = views.history(spark, sf_dir)
    sides = [compare.summary_at(past, month) for month in (views.BASELINE, views.CURRENT)]
    return publish(diff.summary_compare(*sides))


@query("drift_verdict")
def _(spark, sf_dir):
    past = views.history(spark, sf_dir)
    baseline = past.where(F.col("commit_hash") == views.BASELINE)
    verdicts = diff.drift_verdict(baseline, history.forecast_signals(past))
    return publish(verdicts, "repo", "baseline_entropy", "entropy", "trend", "verdict")


@query("drift_verdict_as_of")
def _(spark, sf_dir):
    signals = history.forecast_signals_as_of(views.history(spark, sf_dir))
    verdicts = diff.drift_verdict_as_of(signals, lag=4)
    return publish(verdicts, *_KEYS, "baseline_entropy", "entropy", "trend", "verdict")


@query("observations")
def _(spark, sf_dir):
    past = views.history(spark, sf_dir)
    until = compare.until(past, views.CURRENT)
    return publish(
        diff.observations(
            compare.summary_at(past, views.BASELINE),
            compare.summary_at(past, views.CURRENT),
            diff.pair_snapshots(*_pair(spark, sf_dir)),
            history.entropy_trend(until),
        )
    )


@query("delta_contributors")
def _(spark, sf_dir):
    numbered = history.number_commits(views.commit_table(spark, sf_dir))
    return publish(diff.delta_contributors(views.file_metrics(spark, sf_dir), numbered))


@query("changed_files")
def _(spark, sf_dir):
    return publish(snapshots.changed_in_log(views.changes(spark, sf_dir), tables.stored_copy(views.commit_table(spark, sf_dir))))


@query("changed_files_branched")
def _(spark, sf_dir):
    return publish(snapshots.changed_in_log(views.changes(spark, sf_dir), tables.stored_copy(views.branched_commits(spark, sf_dir))))


@query("snapshot_at_commit")
def _(spark, sf_dir):
    return publish(snapshots.snapshot_at_commit(views.changes(spark, sf_dir), tables.stored_copy(views.commit_table(spark, sf_dir))))


@query("snapshot_at_commit_branched")
def _(spark, sf_dir):
    return publish(snapshots.snapshot_at_commit(views.changes(spark, sf_dir), tables.stored_copy(views.branched_commits(spark, sf_dir))))


# --- sorting and top-k -------------------------------------------------------------------

@query("top_large_files")
def _(spark, sf_dir):
    return publish(ranking.top_large_files(views.file_metrics(spark, sf_dir)), *_FILE, "sloc", "rank")


@query("top_complex_files")
def _(spark, sf_dir):
    return publish(ranking.top_complex_files(views.file_metrics(spark, sf_dir)), *_FILE, "cc", "rank")


@query("top_smelly_files")
def _(spark, sf_dir):
    return publish(ranking.top_smelly_files(views.file_metrics(spark, sf_dir)), *_FILE, "weighted_smells", "rank")


@query("top_coupled_files")
def _(spark, sf_dir):
    return publish(ranking.top_coupled_files(views.file_metrics(spark, sf_dir)), *_FILE, "coupling", "rank")


@query("top_scan_chart")
def _(spark, sf_dir):
    # half of the months lose their complexity, so that both measures occur
    blank = F.substring("commit_hash", 6, 2).isin("01", "03", "05", "07", "09", "11")
    files = views.file_metrics(spark, sf_dir)
    return publish(ranking.top_scan_chart(files.withColumn("cc", F.when(blank, 0.0).otherwise(F.col("cc")))))


@query("top_refactor")
def _(spark, sf_dir):
    found = ranking.top_refactor(views.file_metrics(spark, sf_dir), "sloc,mi")
    return publish(found, *_FILE, "score", "relative_score", "rank")


@query("top_diffusion")
def _(spark, sf_dir):
    return publish(ranking.top_diffusion(views.file_metrics(spark, sf_dir)), *_FILE, "diffusion", "rank")


@query("top_badness")
def _(spark, sf_dir):
    return publish(ranking.top_badness(views.file_metrics(spark, sf_dir)), *_FILE, "badness", "rank")


@query("file_metrics_table")
def _(spark, sf_dir):
    return publish(ranking.file_metrics_table(views.file_metrics(spark, sf_dir)), *_FILE, *_MEASURES, "badness")


@query("head_commit")
def _(spark, sf_dir):
    head = history.head_commit(views.commit_table(spark, sf_dir))
    return publish(head.withColumn("parents", F.size("parents")))


@query("commits_chronological")
def _(spark, sf_dir):
    return publish(history.commits_chronological(views.commit_table(spark, sf_dir)), *_KEYS, "ts", "commit_seq")


@query("head_commit_branched")
def _(spark, sf_dir):
    # half of the history, whose last commits have clocks ahead and behind
    branched = tables.stored_copy(views.branched_commits(spark, sf_dir).where(F.col("commit_hash") < views.CURRENT))
    return publish(history.head_commit(branched).withColumn("parents", F.size("parents")))


@query("commits_chronological_branched")
def _(spark, sf_dir):
    branched = tables.stored_copy(views.branched_commits(spark, sf_dir))
    return publish(history.commits_chronological(branched), *_KEYS, "ts", "commit_seq")


@query("commit_table")
def _(spark, sf_dir):
    return publish(
        history.commit_table(views.history(spark, sf_dir)),
        *_KEYS, "ts", "total_files", "total_sloc", "entropy", "delta", "sloc_delta",
    )


# --- incremental and maintenance jobs ----------------------------------------------------

@query("new_commits")
def _(spark, sf_dir):
    commits = views.commit_table(spark, sf_dir)
    return publish(maintenance.new_commits(commits, commits.where(F.col("commit_hash") < views.START)), *_KEYS, "ts")


@query("insert_if_absent")
def _(spark, sf_dir):
    files = views.file_metrics(spark, sf_dir).select(*_FILE, "sloc")
    stored = files.where(F.col("sloc") % 2 == 0)
    return publish(maintenance.insert_if_absent(files.unionByName(files), stored))


@query("repo_register")
def _(spark, sf_dir):
    remotes = maintenance.name_repos(views.remotes(spark, sf_dir))
    stored = remotes.where(F.col("page_id") % 5 == 0)
    return publish(maintenance.register_repos(remotes, maintenance.register_repos(stored)))


@query("repo_name_from_url")
def _(spark, sf_dir):
    remotes = maintenance.name_repos(views.remotes(spark, sf_dir))
    return publish(remotes.groupBy("repo").agg(F.count(F.lit(1)).alias("url_count")))


@query("repo_list")
def _(spark, sf_dir):
    remotes = maintenance.name_repos(views.remotes(spark, sf_dir))
    commits = remotes.where(F.col("page_id") % 4 != 0)
    return publish(maintenance.repo_list(maintenance.register_repos(remotes), commits))


@query("clear_history")
def _(spark, sf_dir):
    return publish(maintenance.clear_history(views.commit_metrics(spark, sf_dir), "N"))


@query("incremental_scan_stream")
def _(spark, sf_dir):
    # line items arrive in files that split every commit, in two batches
    root = tables.work_folder(spark)
    lineitem = views.table(spark, sf_dir, "lineitem")
    each = trees.write_in_files(lineitem, f"{root}/arriving", 2)
    classified = stored_copy(views.classified_files(spark, sf_dir))
    rows = incremental.read_rows(spark, f"{root}/arriving", lineitem.schema, files_per_batch=each)
    raw = views.functions_by_id(rows, *incremental.IDENTITY)
    raw = raw.withColumn("commit_hash", F.date_format("month", "yyyy-MM"))
    scan = incremental.IncrementalScan(
        f"{root}/store", lambda batch: views.to_file_metrics(batch, classified), file=["file_id"], identity=incremental.IDENTITY, buckets=8
    )
    scan.start(raw, f"{root}/checkpoint").awaitTermination()
    return publish(scan.commit_metrics(spark))


# --- whole commands ----------------------------------------------------------------------

@query("report_production")
def _(spark, sf_dir):
    return publish(
        report.history_of_kind(views.file_metrics(spark, sf_dir), views.commit_table(spark, sf_dir), "production"),
        *_METRICS, "ts",
    )
