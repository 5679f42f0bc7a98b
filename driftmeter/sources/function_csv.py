"""Per-function metrics as CSV, one function per line, without a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import escape
from .schemas import FUNCTION_CSV


def parse_functions(rows: DataFrame, root: str | Column = "") -> DataFrame:
    """Usable rows only: a path in the seventh field and a numeric complexity.

    ``root`` is cut off the front of the path; other paths stay as they are.
    """
    ccn = F.expr("try_cast(trim(ccn) as double)")
    if isinstance(root, str):
        prefix = escape(root.rstrip("/"))
        path = F.regexp_replace("file_path", f"^{prefix}/+", "") if root else F.col("file_path")
    else:
        path = F.when(
            F.col("file_path").startswith(root), F.substring(F.col("file_path"), F.length(root) + 1, F.length("file_path"))
        ).otherwise(F.col("file_path"))
    others = [c for c in rows.columns if c not in FUNCTION_CSV.names]
    return rows.where(F.col("file_path").isNotNull() & ccn.isNotNull()).select(
        *others, path.alias("path"), ccn.alias("ccn"), F.expr("try_cast(trim(nloc) as bigint)").alias("nloc")
    )


def read_functions(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """(path, ccn, nloc) of a CSV file or directory; malformed lines are dropped."""
    rows = spark.read.schema(FUNCTION_CSV).csv(path, quote='"', escape='"', mode="PERMISSIVE")
    return parse_functions(rows, root)
