"""Source files from a directory tree or from a content-addressed store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import escape
from ..operators import rollup, scope


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every file below ``root``, recursively; vanished or unreadable files are skipped.

    Bytes that are not UTF-8 become replacement characters, so a file in any encoding is counted.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true")
        .option("ignoreCorruptFiles", "true")
        .load(root)
    )
    # Spark reports URIs such as file:/a/b or hdfs://host/a/b; the root may be given either way
    tail = escape(root.split(":", 1)[-1].lstrip("/").rstrip("/"))
    relative = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), f"^.*?{tail}/+", "")
    return files.select(relative.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def scan_tree(
    spark: SparkSession,
    root: str,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    utility: Sequence[str] = (),
    functions: DataFrame | None = None,
    recognised: bool = True,
) -> DataFrame:
    """One metrics row per file of a directory.

    The scope filters look at the path only, so Spark never opens the files
    they drop.  As long as no inclusion list is given, files of unknown
    language are left out; ``recognised=False`` keeps them.
    """
    files = scope.drop_ignored_directories(read_tree(spark, root))
    files = scope.keep_included(scope.drop_excluded(files, exclude), include)
    files = scope.assign_language(files)
    if recognised and not include:
        files = scope.recognised_only(files)
    measured = scope.classify_kind(rollup.measure_text(files), utility)
    return _finish(measured, functions, [])


def scan_commits(
    source_files: DataFrame,
    functions: DataFrame | None = None,
    exclude: Sequence[str] = (),
    utility: Sequence[str] = (),
) -> DataFrame:
    """One metrics row per file of every commit of a ``source_files`` table, in one job.

    Files of unknown language count, as they do towards the entropy of a commit.
    """
    files = scope.drop_excluded(scope.drop_ignored_directories(source_files), exclude)
    measured = scope.classify_kind(rollup.measure_text(scope.assign_language(files)), utility)
    return _finish(measured, functions, list(rollup.COMMIT))


def scan_manifests(
    manifests: DataFrame,
    blobs: DataFrame,
    functions: DataFrame | None = None,
    exclude: Sequence[str] = (),
    utility: Sequence[str] = (),
) -> DataFrame:
    """The same for a content-addressed store: each distinct text is read once.

    ``manifests`` holds (repo, commit_hash, path, content_hash) for whole
    snapshots, ``blobs`` (content_hash, content).  A text that fills many paths
    is measured once per language and its counts go back by a join.  An entry
    without its blob stays, as an empty text.
    """
    files = scope.drop_excluded(scope.drop_ignored_directories(manifests), exclude)
    files = scope.assign_language(files)
    uses = files.where("content_hash is not null").select("content_hash", "language").distinct()
    measured = rollup.measure_text(uses.join(blobs, "content_hash"))
    counted = [c for c in measured.columns if c not in ("content_hash", "language")]
    rows = files.join(measured, ["content_hash", "language"], "left").drop("content_hash").fillna(0, counted)
    return _finish(scope.classify_kind(rows, utility), functions, list(rollup.COMMIT))


def _finish(files: DataFrame, functions: DataFrame | None, keys: list[str]) -> DataFrame:
    if functions is None:
        zero = F.lit(0).cast("bigint")
        complete = files.withColumns(
            {"cc": F.lit(0.0), "smells_high": zero, "smells_medium": zero, "smells_low": zero}
        )
    else:
        complete = rollup.attach_function_metrics(files, rollup.function_rollup(functions, keys), keys)
    return rollup.add_maintainability(complete).select(
        *keys, "path", "language", "sloc", "cc", "mi",
        "smells_high", "smells_medium", "smells_low", "coupling", "kind",
    )
