"""Declared schemas of the tables and of the exchange document."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()

COMMITS = _struct(repo=_S, commit_hash=_S, ts=T.TimestampType(), parents=T.ArrayType(_S))
SOURCE_FILES = _struct(repo=_S, commit_hash=_S, path=_S, content=_S)
FUNCTION_METRICS = _struct(repo=_S, commit_hash=_S, path=_S, ccn=_D, nloc=_L)
FILE_METRICS = _struct(
    repo=_S, commit_hash=_S, path=_S, language=_S, sloc=_L, cc=_D, mi=_D,
    smells_high=_L, smells_medium=_L, smells_low=_L, coupling=_L, kind=_S,
)
COMMIT_METRICS = _struct(repo=_S, commit_hash=_S, total_files=_L, total_sloc=_L, entropy=_D)
REPOS = _struct(repo=_S, remote_url=_S)

# fixed values: property names of the snapshot document
SNAPSHOT_SUMMARY = _struct(entropy=_D, files=_L, sloc=_L)
SNAPSHOT_HISTORY = _struct(hash=_S, date=_S, entropy=_D, files=_L, sloc=_L)
SNAPSHOT_FILE = _struct(
    path=_S, language=_S, sloc=_L, cyclomaticComplexity=_D, maintainabilityIndex=_D,
    smellsHigh=_L, smellsMedium=_L, smellsLow=_L, couplingProxy=_D, badness=_D, kind=_S,
)
SNAPSHOT = _struct(
    generated=_S, commitCount=_L, summary=SNAPSHOT_SUMMARY,
    history=T.ArrayType(SNAPSHOT_HISTORY), latestFiles=T.ArrayType(SNAPSHOT_FILE),
)

# fixed values: columns of the function metrics CSV, in file order
FUNCTION_CSV = _struct(
    nloc=_S, ccn=_S, tokens=_S, params=_S, length=_S, location=_S, file_path=_S,
)
