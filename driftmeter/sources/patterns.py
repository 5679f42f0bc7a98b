"""Pattern files: one glob per line, blank lines and '#' comments ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text


def _patterns(content: Column) -> Column:
    trimmed = F.transform(F.split(text.without_bom(content), "\n"), text.trim_space)
    return F.filter(trimmed, lambda line: (line != "") & ~line.startswith("#"))


def pattern_rows(pattern_files: DataFrame) -> DataFrame:
    """(…, pattern) for every pattern line of tables holding ``content``."""
    others = [c for c in pattern_files.columns if c != "content"]
    return pattern_files.select(*others, F.explode(_patterns(F.col("content"))).alias("pattern"))


def regex_by_repo(pattern_files: DataFrame) -> DataFrame:
    """(repo, regex) out of one pattern file per repository, for ``scope.drop_excluded_by_repo``.

    Row-wise: a file's lines become one alternation; a file without patterns gives no row.
    """
    usable = F.filter(_patterns(F.col("content")), lambda p: ~p.contains("/"))
    parts = F.transform(usable, lambda p: F.concat(F.lit("(?:"), paths.glob_regex_column(p), F.lit(")")))
    return pattern_files.where(F.size(usable) > 0).select(
        "repo", F.concat(F.lit("(?iu)"), F.array_join(parts, "|")).alias("regex")
    )


def read_patterns(spark: SparkSession, path: str) -> list[str]:
    """The patterns of one file, for plans compiled from a list; an absent file means none.

    The list becomes part of the plan, so it is meant for one hand-written file.
    """
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path, wholetext=True).withColumnRenamed("value", "content")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [row.pattern for row in pattern_rows(rows).toLocalIterator()]
