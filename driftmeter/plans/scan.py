"""Scanning commits into a store, and the views of one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import maintenance, ranking, rollup, scope, scoring
from ..sources import source_tree
from ..sources.tables import MetricsStore, stored_copy


def scan_history(
    store: MetricsStore,
    commits: DataFrame,
    source_files: DataFrame,
    functions: DataFrame | None = None,
    exclude: Sequence[str] = (),
    utility: Sequence[str] = (),
    remotes: DataFrame | None = None,
) -> None:
    """Scan the commits the store does not hold yet and add them to it.

    ``commits`` decides the extent: all of them, the newest
    (``history.head_commit``), those since one (``scope.commits_since``) or the
    checkpoints (``scope.checkpoint_commits``).  File metrics are stored once
    and scored from there, so text is read a single time.
    """
    if remotes is not None:
        store.register(maintenance.name_repos(remotes))
    fresh = stored_copy(maintenance.new_commits(commits, store.read("commits")))
    # the new commits are stored, so their true size is known: the planner chooses how they meet the texts
    texts = source_files.join(fresh.select(*rollup.COMMIT), list(rollup.COMMIT), "left_semi")
    files = stored_copy(source_tree.scan_commits(texts, functions, exclude, utility))
    store.add_scan(fresh, files, scoring.entropy_by_commit(files, commits=fresh))


def scan_overview(files: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """What a scan shows: totals, languages, the chart lists and the heat map."""
    return {
        "totals": scoring.entropy_by_commit(files),
        "languages": rollup.sloc_by_language(files),
        "files": scope.recognised_only(files),
        "chart": ranking.top_scan_chart(files, top),
        "smells": ranking.top_smelly_files(files, top),
        "heat": scoring.heat_rank(files),
    }
