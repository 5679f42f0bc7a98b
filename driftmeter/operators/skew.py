"""Two building blocks that keep hot keys from landing in one task.

``attach``: joining many rows with the statistics of their keys.  It is a plain
equality join, whatever the sizes: statistics come out of an aggregation with
map-side combine, and the adaptive planner splits the rows of a key that holds
too many.  Where a later step groups by the same keys, splitting costs a shuffle
of partial sums, which Spark accepts with
``spark.sql.adaptive.forceOptimizeSkewedJoin``; README names the setting.

``with_carry``: ordered per-group computations (numbering, previous row,
running totals).  A group's order is cut into chunks; what precedes a chunk is
summarised in one row, so a window never spans more than a chunk of rows and
the per-group window sees chunk summaries only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of ``rows`` with ``stats`` on ``keys``: rows' columns first, then those of stats."""
    values = [c for c in stats.columns if c not in keys]
    return rows.join(stats, list(keys)).select(*rows.columns, *values)


def keyed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are set.

    Statistics and rows that both derive from this share every filter Spark
    would otherwise infer on one side of their join, so they share their scans
    and shuffles as well.
    """
    return rows.where(" and ".join(f"`{k}` is not null" for k in keys))


Carry = tuple[Column, Callable[[Column], Column], str]


def with_carry(
    rows: DataFrame,
    group: Sequence[str],
    chunk: str,
    carries: dict[str, Carry],
) -> DataFrame:
    """Give every row what its group holds outside its chunk.

    ``carries`` maps a new column to (aggregate over one chunk, combiner over
    chunks, frame); the frame is 'before' (chunks preceding this one) or 'all'.
    The result is partitioned by (group, chunk), so windows over those keys that
    follow need no further shuffle.
    """
    order = Window.partitionBy(*group).orderBy(chunk)
    frames = {
        "before": order.rowsBetween(Window.unboundedPreceding, -1),
        "all": order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing),
    }
    keys = [*group, chunk]
    per_chunk = rows.groupBy(*keys).agg(*[aggregate.alias(name) for name, (aggregate, _, _) in carries.items()])
    carried = per_chunk.select(
        *keys,
        *[combine(F.col(name)).over(frames[frame]).alias(name) for name, (_, combine, frame) in carries.items()],
    )
    return rows.join(carried, keys)
