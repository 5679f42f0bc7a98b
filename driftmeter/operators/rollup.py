"""Line measures and aggregations: functions to files, files to languages, commits and bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, measures, text

COMMIT = ("repo", "commit_hash")


# --- text of files -> counts -------------------------------------------------------------

def measure_text(source_files: DataFrame) -> DataFrame:
    """Replace ``content`` by ``sloc`` and ``coupling``.  A map over rows: nothing is shuffled."""
    content = text.without_bom(F.col("content"))
    others = [c for c in source_files.columns if c != "content"]
    return source_files.select(
        *others,
        text.source_lines(content, F.col("language")).alias("sloc"),
        text.import_lines(content, F.col("language")).alias("coupling"),
    )


def sloc_by_file(source_files: DataFrame) -> DataFrame:
    return measure_text(source_files).drop("coupling")


def coupling_by_file(source_files: DataFrame) -> DataFrame:
    return measure_text(source_files).drop("sloc")


def add_maintainability(files: DataFrame) -> DataFrame:
    return files.withColumn("mi", measures.maintainability_index("sloc", "cc"))


# --- functions -> files ------------------------------------------------------------------

def function_rollup(
    functions: DataFrame, keys: Sequence[str] = COMMIT, *extra: Column, file: Column | None = None
) -> DataFrame:
    """Mean complexity and smell counts per file; paths are matched ignoring case.

    ``file`` replaces the path where functions name their file by another key.
    """
    ccn = F.col("ccn")
    file = F.lower("path") if file is None else file
    high, medium, low = fixed.SMELL_HIGH_ABOVE, fixed.SMELL_MEDIUM_ABOVE, fixed.SMELL_LOW_ABOVE
    return functions.groupBy(*keys, file.alias("path_key")).agg(
        F.avg(ccn).alias("cc"),
        F.count_if(ccn > high).alias("smells_high"),
        F.count_if((ccn > medium) & (ccn <= high)).alias("smells_medium"),
        F.count_if((ccn > low) & (ccn <= medium)).alias("smells_low"),
        *extra,
    )


def attach_function_metrics(files: DataFrame, rollup: DataFrame, keys: Sequence[str] = COMMIT) -> DataFrame:
    """Files with the rollup of their functions; 0 where a file has none."""
    measured = ["cc", "smells_high", "smells_medium", "smells_low"]
    joined = files.withColumn("path_key", F.lower("path")).join(
        rollup.select(*keys, "path_key", *measured), [*keys, "path_key"], "left"
    )
    zeros = {"cc": F.lit(0.0)} | {c: F.lit(0).cast("bigint") for c in measured[1:]}
    return joined.select(*files.columns, *[F.coalesce(F.col(c), zeros[c]).alias(c) for c in measured])


# --- files -> commits --------------------------------------------------------------------

def commit_totals(files: DataFrame) -> DataFrame:
    return files.groupBy(*COMMIT).agg(
        F.count(F.lit(1)).alias("total_files"), F.sum("sloc").cast("bigint").alias("total_sloc")
    )


def commit_file_stats(files: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """Mean complexity, mean weighted smell and lines per file of every commit.

    With ``commits``, commits that hold no file appear with zeros.
    """
    stats = files.groupBy(*COMMIT).agg(
        F.avg("cc").alias("avg_cc"),
        F.avg(measures.weighted_smells()).alias("avg_smell"),
        F.try_divide(F.sum("sloc").cast("double"), F.count(F.lit(1))).alias("sloc_per_file"),
    )
    if commits is None:
        return stats
    listed = commits.select(*COMMIT).join(stats, list(COMMIT), "left")
    return listed.fillna(0.0, ["avg_cc", "avg_smell", "sloc_per_file"])


def sloc_by_language(files: DataFrame) -> DataFrame:
    """Files, lines and share of lines per known language.  The window sees one row per language."""
    totals = (
        files.where(F.col("language") != "")
        .groupBy(*COMMIT, "language")
        .agg(F.count(F.lit(1)).alias("file_count"), F.sum("sloc").cast("bigint").alias("total_sloc"))
    )
    whole = F.sum("total_sloc").over(Window.partitionBy(*COMMIT))
    share = F.coalesce(F.try_divide(F.col("total_sloc") * F.lit(100.0), whole), F.lit(0.0))
    return totals.withColumn("share", share).orderBy(*COMMIT, F.desc("total_sloc"), "language")


def language_listing(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return (
        files.where(F.col("language") != "").select(*keys, "path", "language").orderBy(*keys, "language", "path")
    )


def detected_languages(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    known = files.where(F.col("language") != "").select(*keys, "language").distinct()
    return known.orderBy(*keys, "language")


# --- bands -------------------------------------------------------------------------------

_BANDED = {
    "sloc": "sloc",
    "cc": "cc",
    "smells": f"({measures.WEIGHTED_SMELLS})",
    "coupling": "coupling",
    "badness": "badness",
    "diffusion": "diffusion",
    "delta": "delta",
}


def _counted(files: DataFrame, keys: Sequence[str], cells: list[tuple[str, str, str]], label: str) -> DataFrame:
    """Long histogram (keys, scale, <label>, file_count) from (scale, label value as SQL, condition) cells.

    All cells are counters of one aggregation, so a task hands on one row per
    key; they are turned into rows afterwards.  Empty cells are left out.
    """
    counters = [F.expr(f"count_if({condition}) as _cell{i}") for i, (_, _, condition) in enumerate(cells)]
    wide = files.groupBy(*keys).agg(*counters)
    rows = ", ".join(f"'{scale}', {value}, _cell{i}" for i, (scale, value, _) in enumerate(cells))
    long = wide.selectExpr(*keys, f"stack({len(cells)}, {rows}) as (scale, {label}, file_count)")
    return long.where(F.col("file_count") > 0)


def severity_bands(files: DataFrame, scales: Sequence[str], keys: Sequence[str] = COMMIT) -> DataFrame:
    """Files per severity band for several scales: one pass, one shuffle."""
    cells = []
    for scale in scales:
        value, upper = _BANDED[scale], None
        for bound, name in fixed.SEVERITY_SCALES[scale]:
            tests = [f"{value} > {bound}"] if bound is not None else []
            tests += [f"{value} <= {upper}"] if upper is not None else []
            cells.append((scale, f"'{name}'", " and ".join(tests)))
            upper = bound
    return _counted(files, keys, cells, "band")


def size_gradient_bands(
    files: DataFrame, scales: Sequence[str] = tuple(fixed.SIZE_GRADIENTS), keys: Sequence[str] = COMMIT
) -> DataFrame:
    """Histogram of files over the ten-step gradients, lower bounds inclusive."""
    cells = []
    for scale in scales:
        value, bounds = _BANDED[scale], fixed.SIZE_GRADIENTS[scale]
        for step in range(len(bounds) + 1):
            tests = [f"{value} >= {bounds[step - 1]}"] if step > 0 else []
            tests += [f"{value} < {bounds[step]}"] if step < len(bounds) else []
            cells.append((scale, str(step), " and ".join(tests)))
    return _counted(files, keys, cells, "step")


def gauge_columns(values: dict[str, Column]) -> list[Column]:
    """Percent of full scale and colour band for each named gauge."""
    columns = []
    for name, value in values.items():
        percent = F.least(F.lit(100.0), value / F.lit(fixed.GAUGE_FULL_SCALE[name]) * F.lit(100.0))
        columns += [
            percent.alias(f"{name}_pct"),
            measures.band_below(percent, fixed.GAUGE_BANDS).alias(f"{name}_band"),
        ]
    return columns
