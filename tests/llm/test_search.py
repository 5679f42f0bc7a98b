from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftmeter.llm import projected_search


def brute(vectors: dict[int, np.ndarray], queries: list[int], count: int = 5) -> dict[int, list[tuple[int, float]]]:
    out = {}
    for q in queries:
        scores = [(-float(v @ vectors[q]) / float(np.linalg.norm(v) * np.linalg.norm(vectors[q])), i) for i, v in vectors.items() if i != q]
        out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in scores)[:count]]
    return out


def test_query_recall(result, sf):
    frame = pd.read_parquet(f"{sf}/embeddings.parquet")
    vectors = {int(i): np.array(v, float) for i, v in zip(frame.vec_id, frame.embedding, strict=True)}
    expected = brute(vectors, [i for i in vectors if i % 50 == 0])
    found = result("op4_projected_search")
    hits = 0
    for q, rows in found.groupby("query_id"):
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == [1, 2, 3, 4, 5] and rows.score.is_monotonic_decreasing
        for i, s in zip(rows.vec_id, rows.score, strict=True):
            assert s == pytest.approx(vectors[i] @ vectors[q] / np.linalg.norm(vectors[i]) / np.linalg.norm(vectors[q]), abs=1e-12)
        hits += len({i for i, _ in expected[q]} & set(rows.vec_id))
    assert found.query_id.nunique() == len(expected) and hits >= 0.9 * 5 * len(expected)


def test_many_cells_and_blocks_and_one_common_vector(spark):
    rng = np.random.default_rng(8)
    data = rng.standard_normal((1500, 16)).astype(np.float32)
    data[::3] = data[0]
    vectors = {i: v.astype(float) for i, v in enumerate(data)}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    queries = [i for i in vectors if i % 50 == 0]
    found = projected_search.nearest(frame, F.col("vec_id") % 50 == 0, block=100).toPandas()
    expected = brute(vectors, queries)
    hits = sum(len({i for i, _ in expected[q]} & set(found[found.query_id == q].vec_id)) for q in queries)
    assert hits >= 0.9 * 5 * len(queries)
    common = [q for q in queries if q % 3 == 0]
    assert all(found[found.query_id == q].sort_values("rank").vec_id.tolist() == [i for i, _ in expected[q]] for q in common)


def test_stopping_ratio():
    ratio = projected_search.stopping_ratio(0.95, 8)
    assert ratio == pytest.approx(15.507, abs=1e-3)
    gaps = np.random.default_rng(1).standard_normal((20_000, 8)) ** 2
    assert (gaps.sum(axis=1) <= ratio).mean() == pytest.approx(0.95, abs=0.01)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (150, [nan, 1.0]), (200, [1.0, inf]), (250, [1.0, None]), (300, []), (350, [1.0, 2.0, 3.0]),
            (None, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [-1e30, 0.0]), (400, [1e-30, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    found = projected_search.nearest(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    half = pytest.approx(0.5**0.5)
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [
        (0, 1, 1, 1.0), (0, 2, 400, 1.0), (0, 3, 2, half), (0, 4, 3, half), (0, 5, 4, -1.0),
        (400, 1, 0, 1.0), (400, 2, 1, 1.0), (400, 3, 2, half), (400, 4, 3, half), (400, 5, 4, -1.0),
    ]
    assert projected_search.nearest(frame.filter("vec_id = 0"), F.lit(True)).count() == 0
    assert projected_search.nearest(frame.filter("false"), F.lit(True)).count() == 0
