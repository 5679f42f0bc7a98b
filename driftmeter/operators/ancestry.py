"""The commit graph: an order that no clock can break, and first-parent lines.

Both come out of pointer doubling over the first-parent forest: a commit knows
the ancestor 2^k steps up, and a join of that table with itself doubles k.  So a
line of n commits takes log n rounds; each round is stored, which keeps lineage
short.  Parents that are not in the table do not exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored_copy
from .rollup import COMMIT

_UP = ["repo", "_up"]


def _edges(commits: DataFrame) -> DataFrame:
    """(repo, commit_hash, parent, place) for every parent that is there; place 0 is the first parent."""
    links = commits.select(*COMMIT, F.posexplode("parents").alias("place", "parent"))
    known = commits.select("repo", F.col("commit_hash").alias("parent")).distinct()
    return links.join(known, ["repo", "parent"]).select(*COMMIT, "parent", "place")


def _first_parents(commits: DataFrame, edges: DataFrame) -> DataFrame:
    first = edges.where("place = 0").select(*COMMIT, F.col("parent").alias("_up"))
    return commits.select(*COMMIT).join(first, list(COMMIT), "left")


# --- order -------------------------------------------------------------------------------

def settle(commits: DataFrame) -> DataFrame:
    """Add ``settled``: the commit's time, or later than its parents by a microsecond where a clock ran ahead.

    It is the latest, over a commit and all its ancestors, of their time plus a
    microsecond for each step of the longest way down.  It grows along every
    edge, so (settled, commit_hash) is a topological order, and it is the time
    itself wherever clocks agree with the graph.

    Along first parents the latest comes by doubling.  Other parents hand theirs
    over one step at a time, and the lines below are doubled again until no
    commit moves: a round for each side branch that a late clock passes through.
    """
    micros = commits.select(*COMMIT, F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"), "parents")
    edges = stored_copy(_edges(micros))
    now = stored_copy(micros.select(*COMMIT, "_at"))
    first = stored_copy(_first_parents(micros, edges))
    while True:
        late = edges.join(now, list(COMMIT)).join(now.select("repo", F.col("commit_hash").alias("parent"), F.col("_at").alias("_before")), ["repo", "parent"])
        late = stored_copy(late.where("_before >= _at").groupBy(*COMMIT).agg((F.max("_before") + 1).alias("_moved")))
        if late.isEmpty():
            break
        seeds = now.join(late, list(COMMIT), "left").select(*COMMIT, F.coalesce("_moved", "_at").alias("_at"))
        now = _latest_down(seeds, first)
    kind = commits.schema["ts"].dataType
    settled = F.timestamp_micros("_at").cast(kind)
    return commits.join(now, list(COMMIT)).select(*commits.columns, settled.alias("settled"))


def _latest_down(seeds: DataFrame, first: DataFrame) -> DataFrame:
    """The latest of each commit's first-parent line, a microsecond later for each step down."""
    # _at: latest over the last _steps commits of the line; _up: the ancestor before those
    now = stored_copy(seeds.join(first, list(COMMIT)).withColumn("_steps", F.lit(1).cast("long")))
    while not now.where("_up is not null").isEmpty():
        above = now.select("repo", F.col("commit_hash").alias("_up"), F.col("_at").alias("_at2"), F.col("_up").alias("_up2"), F.col("_steps").alias("_steps2"))
        latest = F.greatest("_at", F.col("_at2") + F.col("_steps"))
        joined = now.join(above, _UP, "left")
        now = stored_copy(joined.select(*COMMIT, F.coalesce(latest, "_at").alias("_at"), F.col("_up2").alias("_up"), (F.col("_steps") + F.coalesce("_steps2", F.lit(0))).alias("_steps")))
    return now.select(*COMMIT, "_at")


# --- lines -------------------------------------------------------------------------------

def _below(first: DataFrame) -> DataFrame:
    """(repo, commit_hash, _size): how many commits hang on a commit by first parents, itself included."""
    # _size: commits below by fewer than 2^k steps; those of the commits 2^k steps below add theirs
    now = stored_copy(first.withColumn("_size", F.lit(1).cast("long")))
    while not now.where("_up is not null").isEmpty():
        more = now.where("_up is not null").groupBy(*_UP).agg(F.sum("_size").alias("_more")).withColumnRenamed("_up", "commit_hash")
        above = now.select("repo", F.col("commit_hash").alias("_up"), F.col("_up").alias("_up2"))
        joined = now.join(more, list(COMMIT), "left").join(above, _UP, "left")
        now = stored_copy(joined.select(*COMMIT, F.col("_up2").alias("_up"), (F.col("_size") + F.coalesce("_more", F.lit(0))).alias("_size")))
    return now.select(*COMMIT, "_size")


def lines(commits: DataFrame) -> DataFrame:
    """Cut the first-parent forest into lines: (repo, commit_hash, line, place, fork, depth).

    A line goes on with the child that most commits hang on (of ties the
    smallest hash); other children begin lines of their own, so a commit has
    fewer than log2 n lines above it.  ``line`` is the hash of its first commit,
    ``place`` counts from 1, ``fork`` is the parent of that first commit (null
    for roots) and ``depth`` the number of lines above.
    """
    named = commits.select(*COMMIT, "parents").dropDuplicates(list(COMMIT))
    first = stored_copy(_first_parents(named, _edges(named)))
    sizes = _below(first).join(first, list(COMMIT))
    heavy = sizes.where("_up is not null").groupBy(*_UP).agg(F.min(F.struct(-F.col("_size"), "commit_hash")).alias("_best"))
    heavy = heavy.select("repo", F.col("_best.commit_hash").alias("commit_hash"), F.lit(True).alias("_goes_on"))
    marked = first.join(heavy, list(COMMIT), "left").withColumn("fork", F.when(F.col("_goes_on").isNull(), F.col("_up")))
    # line and fork are known at first commits; the others find theirs up the line by doubling
    begins = F.col("_goes_on").isNull()
    now = stored_copy(
        marked.select(
            *COMMIT, F.when(begins, F.col("commit_hash")).alias("line"), "fork", F.when(~begins, F.col("_up")).alias("_up"), F.lit(1).cast("long").alias("place")
        )
    )
    while not now.where("_up is not null").isEmpty():
        above = now.select("repo", F.col("commit_hash").alias("_up"), *[F.col(c).alias(f"{c}2") for c in ("line", "fork", "_up", "place")])
        joined = now.join(above, _UP, "left")
        now = stored_copy(
            joined.select(
                *COMMIT, F.coalesce("line", "line2").alias("line"), F.coalesce("fork", "fork2").alias("fork"), F.col("_up2").alias("_up"),
                (F.col("place") + F.coalesce("place2", F.lit(0))).alias("place"),
            )
        )
    placed = now.drop("_up")
    heads = stored_copy(placed.where("place = 1").select("repo", "line", "fork"))
    depth, level = None, heads.where("fork is null").select("repo", "line", F.lit(0).alias("depth"))
    while True:
        level = stored_copy(level)
        if level.isEmpty():
            break
        depth = level if depth is None else depth.unionByName(level)
        above = placed.join(level, ["repo", "line"]).select("repo", F.col("commit_hash").alias("fork"), "depth")
        level = heads.join(above, ["repo", "fork"]).select("repo", "line", (F.col("depth") + 1).alias("depth"))
    if depth is None:
        return placed.withColumn("depth", F.lit(0))
    return placed.join(depth, ["repo", "line"]).select(*COMMIT, "line", "place", "fork", "depth")
