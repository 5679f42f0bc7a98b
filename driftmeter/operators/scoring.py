"""Badness of files within their commit, entropy of commits, refactoring and diffusion scores.

A commit is scored in two passes: the range of every feature, then the scores.
Ranges are one mergeable aggregation; they come back to the files by a skew-safe
join (``skew.attach``), never by a window over all files of a commit.  The entropy
needs no third pass: with T = sum b and X = sum b log2 b over active files,
H = log2 T - X / T.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, measures
from . import skew
from .skew import attach
from .rollup import COMMIT

# feature -> SQL over the file columns
_FEATURES = {
    "sloc": "cast(sloc as double)",
    "cc": "cc",
    "smells": f"({measures.WEIGHTED_SMELLS})",
    "coupling": "cast(coupling as double)",
    "mi": "mi",
}


def feature_ranges(files: DataFrame, keys: Sequence[str] = COMMIT) -> DataFrame:
    """Minimum and maximum of every raw feature and the file count, per commit."""
    bounds = [
        F.expr(f"{function}({value}) as _{name}_{end}")
        for name, value in _FEATURES.items()
        for function, end in (("min", "low"), ("max", "high"))
    ]
    return files.groupBy(*keys).agg(F.expr("count(1) as _files"), *bounds)


def _scaled(name: str, shape: str = "{}") -> str:
    value, low, high = (shape.format(x) for x in (_FEATURES[name], f"_{name}_low", f"_{name}_high"))
    return measures.scaled(value, low, high)


_BADNESS = " + ".join(
    [
        _scaled("sloc", "ln(1d + {})"),
        _scaled("cc"),
        _scaled("smells"),
        _scaled("coupling"),
        f"(1d - {_scaled('mi')})",
    ]
)


def focus_score(focus: str = "overall") -> str:
    """Mean of the chosen scaled features; the badness for 'overall', nothing or nothing known."""
    words = {w.strip().lower() for w in focus.split(",") if w.strip()}
    parts = [
        f"(1d - {_scaled(name)})" if name == "mi" else _scaled(name)
        for name in ("sloc", "cc", "mi", "smells", "coupling")
        if name in words
    ]
    if "overall" in words or not parts:
        return _BADNESS
    return f"({' + '.join(parts)}) / {len(parts)}d"


def _with_ranges(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    known = skew.keyed(files, keys)
    return skew.attach(known, feature_ranges(known, keys), keys)


def badness_by_file(
    files: DataFrame, keys: Sequence[str] = COMMIT, commits: DataFrame | None = None
) -> DataFrame:
    """Add ``badness``, and the columns of ``commits`` (one row per commit; others drop out) if given.

    Commit columns travel with the ranges of their commit, at no further join of files.
    """
    if commits is None:
        return _with_ranges(files, keys).selectExpr(*files.columns, f"{_BADNESS} as badness")
    known = skew.keyed(files, keys)
    stats = feature_ranges(known, keys).join(commits, list(keys))
    rows = skew.attach(known, stats, keys)
    extra = [c for c in commits.columns if c not in keys]
    return rows.selectExpr(*files.columns, *extra, f"{_BADNESS} as badness")


def refactor_scores(
    files: DataFrame, focus: str | dict[str, str] = "overall", keys: Sequence[str] = COMMIT
) -> DataFrame:
    """Add ``score`` for one focus list, or one column per entry of a {column: focus} mapping."""
    wanted = {"score": focus} if isinstance(focus, str) else focus
    return _with_ranges(files, keys).selectExpr(
        *files.columns, *[f"{focus_score(words)} as {name}" for name, words in wanted.items()]
    )


_ACTIVE = f"badness > {fixed.EPSILON}d"

# from n active files, t = sum b and x = sum b log2 b: spread of the badness over
# the files, 0..1, times the mean badness, clamped at 0; 0 below two active files
_ENTROPY = f"""
    case when n <= 1 or coalesce(t, 0d) <= {fixed.EPSILON}d then 0d
         else greatest(0d, (log2(t) - x / t) / log2(cast(n as double)) * t / n) end
"""


def entropy_from_scored(scored: DataFrame, keys: Sequence[str] = COMMIT) -> DataFrame:
    """Commit metrics out of files that already carry ``badness``."""
    sums = scored.groupBy(*keys).agg(
        F.expr("count(1) as total_files"),
        F.expr("cast(sum(sloc) as bigint) as total_sloc"),
        F.expr(f"count_if({_ACTIVE}) as n"),
        F.expr(f"sum(if({_ACTIVE}, badness, null)) as t"),
        F.expr(f"sum(if({_ACTIVE}, badness * log2(badness), null)) as x"),
    )
    return sums.selectExpr(*keys, "total_files", "total_sloc", f"{_ENTROPY} as entropy")


def entropy_by_commit(
    files: DataFrame, keys: Sequence[str] = COMMIT, commits: DataFrame | None = None
) -> DataFrame:
    """(keys, total_files, total_sloc, entropy).  With ``commits``, empty commits appear with zeros."""
    scores = entropy_from_scored(badness_by_file(files, keys), keys)
    if commits is None:
        return scores
    listed = commits.select(*keys).join(scores, list(keys), "left")
    return listed.fillna(0, ["total_files", "total_sloc"]).fillna(0.0, ["entropy"])


# --- the score of a commit as a state that files can join and leave -------------------------

_BOUNDS = [f"_{name}_{end}" for name in _FEATURES for end in ("low", "high")]
_TERMS = ["total_files", "total_sloc", "n", "t", "x"]


def state_schema() -> T.StructType:
    """(repo, commit_hash), the files and lines, the active files n with T and X, and the range of every feature."""
    kinds = [T.StringType()] * len(COMMIT) + [T.LongType()] * 3 + [T.DoubleType()] * (2 + len(_BOUNDS))
    return T.StructType([T.StructField(c, k) for c, k in zip([*COMMIT, *_TERMS, *_BOUNDS], kinds, strict=True)])


def _terms(sign: str = "1") -> list[Column]:
    """The sums over scored files, each counted ``sign`` times (-1: taken out)."""
    return [
        F.expr(f"cast(sum({sign}) as bigint) as total_files"),
        F.expr(f"cast(sum({sign} * sloc) as bigint) as total_sloc"),
        F.expr(f"cast(sum(if({_ACTIVE}, {sign}, 0)) as bigint) as n"),
        F.expr(f"sum(if({_ACTIVE}, {sign} * badness, 0d)) as t"),
        F.expr(f"sum(if({_ACTIVE}, {sign} * badness * log2(badness), 0d)) as x"),
    ]


def state_of(files: DataFrame) -> DataFrame:
    """The state of every commit out of all its files."""
    ranged = _with_ranges(files, COMMIT).selectExpr("*", f"{_BADNESS} as badness")
    bounds = [F.first(c).alias(c) for c in _BOUNDS]
    return ranged.groupBy(*COMMIT).agg(*_terms(), *bounds).select(*[f.name for f in state_schema()])


def state_judged(states: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The states of the commits that files ``old`` leave and files ``new`` join, with ``rescored``.

    Where a new value lies outside a range, or an old one lies on its edge and
    is not there any more, only all files of the commit can tell: such commits,
    and those without a state, are ``rescored``.
    """
    sides = {}
    for side, files in (("l", old), ("j", new)):
        sides[side] = feature_ranges(files).select(*COMMIT, *[F.col(c).alias(f"{side}{c}") for c in _BOUNDS])
    beside = sides["j"].join(sides["l"], list(COMMIT), "left").join(states, list(COMMIT), "left")
    lows, highs = [c for c in _BOUNDS if c.endswith("low")], [c for c in _BOUNDS if c.endswith("high")]
    out_of = [f"j{c} < {c} or (l{c} <= {c} and j{c} > {c})" for c in lows] + [f"j{c} > {c} or (l{c} >= {c} and j{c} < {c})" for c in highs]
    moved = " or ".join(f"coalesce({c}, false)" for c in out_of)
    return beside.withColumn("rescored", F.expr(f"total_files is null or {moved}")).select(*state_schema().fieldNames(), "rescored")


def state_moved(judged: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The states of the commits that are not ``rescored`` once files ``old`` have left and ``new`` have joined."""
    still = judged.where("not rescored").drop("rescored")
    parts = [(new, 1), (old, -1)]
    files = [f.select("sloc", *COMMIT, "cc", "smells_high", "smells_medium", "smells_low", "coupling", "mi", F.lit(sign).alias("_sign")) for f, sign in parts]
    scored = attach(files[0].unionByName(files[1]), still.select(*COMMIT, *_BOUNDS), COMMIT).selectExpr("*", f"{_BADNESS} as badness")
    changes = scored.groupBy(*COMMIT).agg(*_terms("_sign"))
    return changes.unionByName(still.select(*COMMIT, *_TERMS)).groupBy(*COMMIT).agg(*[F.sum(c).alias(c) for c in _TERMS]).join(
        still.drop(*_TERMS), list(COMMIT)
    ).select(*state_schema().fieldNames())


def entropy_of_state(states: DataFrame) -> DataFrame:
    return states.selectExpr(*COMMIT, "total_files", "total_sloc", f"{_ENTROPY} as entropy")


def entropy_by_commit_kind(files: DataFrame) -> DataFrame:
    """Every kind scored on its own files only: ranges are taken inside the kind."""
    return entropy_by_commit(files, (*COMMIT, "kind"))


def _second_pass(files: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Scored files with statistics of their commit's scores; reuses the partitioning of the first pass."""
    ranged = _with_ranges(files, keys)
    scored = ranged.selectExpr(*files.columns, f"{_BADNESS} as badness")
    # the statistics look at the path only so that both readers of the shuffled rows want
    # the same columns of them; else Spark would shuffle the rows once for each reader
    touched = F.expr("bit_xor(xxhash64(path)) as _paths")
    stats = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_files"), *aggregates, touched)
    stats = stats.where("_paths is not null").drop("_paths")
    return skew.attach(scored, stats, keys)


def diffusion_contributions(files: DataFrame, keys: Sequence[str] = COMMIT) -> DataFrame:
    """Add ``badness`` and ``diffusion`` = -p log2 p over active files; they sum to H."""
    rows = _second_pass(files, keys, F.expr(f"sum(if({_ACTIVE}, badness, null)) as _t"))
    spread = f"if({_ACTIVE} and _t > {fixed.EPSILON}d, -(badness / _t) * log2(badness / _t), 0d) as diffusion"
    return rows.selectExpr(*files.columns, "badness", spread)


def heat_rank(files: DataFrame, keys: Sequence[str] = COMMIT) -> DataFrame:
    """Files hottest first with heat relative to the hottest and the length of a heat bar.

    The order is one range sort over all commits on a unique key, so a commit of
    any size spreads over many tasks.
    """
    rows = _second_pass(files, keys, F.expr("max(badness) as _hottest"))
    heat = "badness / if(_hottest = 0d, 1d, _hottest)"
    bar = f"cast(bround({heat} * {fixed.HEAT_BAR_STEPS}) as int) as bar"
    return rows.selectExpr(*files.columns, "badness", f"{heat} as heat", bar).orderBy(
        *keys, F.desc("badness"), "path"
    )
