"""Whole snapshots out of change logs, and changes between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored_copy
from . import ancestry
from .rollup import COMMIT
from .skew import attach, keyed

# commits per block: a block's hashes travel as one array, so this bounds the array
BLOCK = 1024


def line_versions(changes: DataFrame, lines: DataFrame) -> DataFrame:
    """Versions of files along first-parent lines: (repo, line, path, content_hash, first_place, last_place, is_deleted,
    old_hash, changed).

    ``lines`` comes from ``ancestry.lines``.  A line starts with the files of the
    commit it forks from, at place 0; lines are filled in by depth, so that
    commit is known by then.  A version lives until the place before the file's
    next change on the line.  ``old_hash`` is what the file was before, and
    ``changed`` is false for the files a line starts with.
    """
    logged = changes.join(lines, list(COMMIT)).select("repo", "line", "depth", "place", "path", "content_hash", "is_deleted")
    ends = stored_copy(lines.groupBy("repo", "line", "fork", "depth").agg(F.max("place").alias("_length")))
    found, depth, start = None, 0, None
    while not ends.where(F.col("depth") == depth).isEmpty():
        rows = logged.where(F.col("depth") == depth).drop("depth")
        if start is not None:
            rows = rows.unionByName(start)
        level = stored_copy(_placed_versions(rows, ends))
        found = level if found is None else found.unionByName(level)
        # what the lines that fork from this level start with
        forks = ends.where(F.col("depth") == depth + 1).select("repo", F.col("line").alias("_into"), F.col("fork").alias("commit_hash"))
        forks = forks.join(lines.select(*COMMIT, "line", F.col("place").alias("_place")), list(COMMIT)).drop("commit_hash")
        here = level.join(forks, ["repo", "line"]).where("not is_deleted and first_place <= _place and _place <= last_place")
        zero = F.lit(0).cast("long").alias("place")
        start = here.select("repo", F.col("_into").alias("line"), zero, "path", "content_hash", F.lit(False).alias("is_deleted"))
        depth += 1
    return _placed_versions(logged.drop("depth"), ends) if found is None else found


def _placed_versions(rows: DataFrame, ends: DataFrame) -> DataFrame:
    # a file changed in most commits of a line is cut into blocks; each hands its first and last change on
    keys = ["repo", "line", "path"]
    value = F.struct("content_hash", "is_deleted")
    blocked = keyed(rows, keys).join(ends.select("repo", "line", "_length"), ["repo", "line"]).withColumn("_block", F.floor(F.col("place") / BLOCK))
    if ends.where(F.col("_length") >= BLOCK).isEmpty():
        both = blocked.withColumn("_next", F.lit(None)).withColumn("_last", F.lit(None).cast(rows.select(value.alias("_last")).schema["_last"].dataType))
    else:
        # lines of one block have nothing to hand on
        blocks = blocked.where(F.col("_length") >= BLOCK).groupBy(*keys, "_block").agg(F.min("place").alias("_first"), F.max_by(value, "place").alias("_value"))
        along = Window.partitionBy(*keys).orderBy("_block")
        carried = blocks.select(*keys, "_block", F.lead("_first").over(along).alias("_next"), F.lag("_value").over(along).alias("_last"))
        both = blocked.join(carried, [*keys, "_block"], "left")
    order = Window.partitionBy(*keys, "_block").orderBy("place")
    before = F.coalesce(F.lag(value).over(order), F.col("_last"))
    after = F.coalesce(F.lead("place").over(order), F.col("_next"))
    joined = both.withColumn("_before", before).withColumn("_after", after)
    return joined.select(
        *keys, "content_hash", F.col("place").alias("first_place"), F.coalesce(F.col("_after") - 1, F.col("_length")).alias("last_place"), "is_deleted",
        F.when(~F.col("_before.is_deleted"), F.col("_before.content_hash")).alias("old_hash"), (F.col("place") > 0).alias("changed"),
    )


def snapshot_at_commit(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Every file present at every commit: (repo, commit_hash, path, content_hash).

    ``changes`` holds (repo, commit_hash, path, content_hash, is_deleted), one
    row per file that differs from the commit's first parent.  A commit has what
    its nearest ancestor by first parents that changed the file left there.
    """
    lines = stored_copy(ancestry.lines(commits))
    versions = line_versions(changes, lines).where("not is_deleted and last_place > 0")
    # lines unfold like repositories: places are dense, and every place has one commit
    block_of = F.floor((F.col("place") - 1) / BLOCK).alias("_block")
    hashes = lines.groupBy("repo", "line", block_of).agg(F.sort_array(F.collect_list(F.struct("place", "commit_hash")))["commit_hash"].alias("_commits"))
    first, last = F.greatest("first_place", F.lit(1)), F.col("last_place")
    pieces = versions.withColumn("_block", F.explode(F.sequence(F.floor((first - 1) / BLOCK), F.floor((last - 1) / BLOCK))))
    joined = attach(pieces, hashes, ["repo", "line", "_block"])
    start, stop = F.greatest(first, F.col("_block") * BLOCK + 1), F.least(last, (F.col("_block") + 1) * BLOCK)
    span = F.slice(F.col("_commits"), (start - F.col("_block") * BLOCK).cast("int"), (stop - start + 1).cast("int"))
    return joined.select("repo", F.explode(span).alias("commit_hash"), "path", "content_hash")


def changed_in_log(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Like ``changed_files``, out of a change log: every change is held against the version before it.

    No snapshot is unfolded; rows that leave a file as it was are no change.
    """
    lines = stored_copy(ancestry.lines(commits))
    versions = line_versions(changes, lines).where("changed")
    places = lines.select("repo", "line", F.col("place").alias("first_place"), "commit_hash", (F.col("fork").isNull() & (F.col("place") == 1)).alias("_root"))
    new, old = F.when(~F.col("is_deleted"), F.col("content_hash")), F.col("old_hash")
    rows = versions.join(places, ["repo", "line", "first_place"]).withColumn("_new", new)
    differ = rows.where(~F.col("_root") & ~F.col("_new").eqNullSafe(old))
    change = F.when(old.isNull(), "added").when(F.col("_new").isNull(), "deleted").otherwise("modified")
    roots = rows.where(F.col("_root") & F.col("_new").isNotNull()).select(*COMMIT, F.substring_index("path", "/", 1).alias("path")).distinct()
    return differ.select(*COMMIT, "path", change.alias("change")).unionByName(roots.withColumn("change", F.lit("root")))


def changed_files(manifests: DataFrame, commits: DataFrame) -> DataFrame:
    """Paths that differ from the first parent; a root commit lists its top-level entries.

    ``manifests`` holds (repo, commit_hash, path, content_hash) for whole snapshots.
    """
    manifests = keyed(manifests, COMMIT)
    parents = commits.select(*COMMIT, F.get("parents", F.lit(0)).alias("_parent"))
    children = parents.where(F.col("_parent").isNotNull()).select(
        "repo", F.col("_parent").alias("commit_hash"), F.col("commit_hash").alias("_child")
    )
    # a commit with several children hands its files to each of them
    inherited = attach(manifests, children, COMMIT).select(
        "repo", F.col("_child").alias("commit_hash"), "path", F.col("content_hash").alias("_old")
    )
    own = attach(manifests, parents, COMMIT)
    later = own.where(F.col("_parent").isNotNull()).select(*COMMIT, "path", F.col("content_hash").alias("_new"))
    differ = later.join(inherited, [*COMMIT, "path"], "full_outer").where(
        ~F.col("_old").eqNullSafe(F.col("_new"))
    )
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").otherwise("modified")
    roots = (
        own.where(F.col("_parent").isNull())
        .select(*COMMIT, F.substring_index("path", "/", 1).alias("path"))
        .distinct()
        .withColumn("change", F.lit("root"))
    )
    return differ.select(*COMMIT, "path", change.alias("change")).unionByName(roots)
