from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("work")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


FILE_SCHEMA = (
    "repo string, commit_hash string, path string, language string, sloc long, cc double, mi double, "
    "smells_high long, smells_medium long, smells_low long, coupling long, kind string"
)


@pytest.fixture(scope="session")
def make_files(spark):
    def make(*rows, repo="r", commit_hash="c1"):
        full = []
        for i, row in enumerate(rows):
            given = {
                "repo": repo, "commit_hash": commit_hash, "path": f"f{i}.cs", "language": "CSharp", "sloc": 0,
                "cc": 0.0, "mi": 0.0, "smells_high": 0, "smells_medium": 0, "smells_low": 0, "coupling": 0,
                "kind": "Production",
            } | row
            full.append(tuple(given.values()))
        return spark.createDataFrame(full, FILE_SCHEMA)

    return make


@pytest.fixture(scope="session")
def make_history(spark):
    def make(*scores, repo="r", sloc=None, files=None, step="interval 1 day"):
        rows = [
            (repo, f"h{i:03d}", float(e), (sloc or [100] * len(scores))[i], (files or [10] * len(scores))[i], i)
            for i, e in enumerate(scores)
        ]
        frame = spark.createDataFrame(
            rows, "repo string, commit_hash string, entropy double, total_sloc long, total_files long, i int"
        )
        return frame.selectExpr(
            "repo", "commit_hash", f"timestamp'2020-01-30 00:00:00' + i * {step} as ts", "entropy", "total_sloc", "total_files"
        )

    return make
