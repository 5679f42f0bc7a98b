"""Approximate nearest neighbours by few stable projections and kd-trees.

Vectors are scaled to length 1, so the largest cosine is the smallest distance, and projected on DIMENSIONS random
directions with normal components (2-stable). The squared projected distance of two vectors divided by their squared
distance then is chi-square distributed with DIMENSIONS degrees of freedom, whatever the vectors. A query takes its
neighbours in the order of projected distance from a kd-tree and verifies each by its true cosine, until a vector as
near as the worst of the best so far would, with probability CONFIDENCE, have had a smaller projected distance than the
last one taken.

A kd-tree over a bounded sample cuts the projected space into cells, and all vectors are indexed in blocks of a cell: a
cell with many vectors, even equal ones, has many blocks. A query first searches the blocks of its own cell; with what it
found there it goes to the cells that the stopping test does not rule out. Each block has a kd-tree of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmeter.llm.common import ship, stored

DIMENSIONS = 8
CONFIDENCE = 0.97
NEIGHBOURS = 5
#: Vectors that the cells are fitted on at most, those of the smallest hash of their id; all are indexed.
SAMPLE = 20_000
BLOCK = 8192
LEAF = 64
SEED = 5


def chi_square(x: float, freedom: int) -> float:
    """Distribution function for even degrees of freedom."""
    term, total = 1.0, 1.0
    for k in range(1, freedom // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def stopping_ratio(confidence: float, freedom: int) -> float:
    """The squared projected distance, in squared distances, that is not exceeded with this probability."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, freedom) < confidence else (lo, mid)
    return hi


def directions(size: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, dimensions))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square is lost or too large."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


class Tree:
    """A kd-tree: boxes (low, high) of its leaves and the rows in each."""

    def __init__(self, points: np.ndarray, leaf: int, tight: bool = True):
        self.rows: list[np.ndarray] = []
        low, high = [], []
        size = points.shape[1]
        todo = [(np.arange(len(points)), np.full(size, -np.inf), np.full(size, np.inf))]
        while todo:
            rows, a, b = todo.pop()
            own = points[rows]
            spread = own.max(axis=0) - own.min(axis=0) if len(rows) else np.zeros(size)
            axis = int(spread.argmax())
            if len(rows) > leaf and spread[axis] > 0:
                cut = np.median(own[:, axis])
                left = own[:, axis] <= cut
                if left.all():
                    cut = own[own[:, axis] < cut, axis].max()
                    left = own[:, axis] <= cut
                b_left, a_right = b.copy(), a.copy()
                b_left[axis], a_right[axis] = cut, cut
                todo += [(rows[~left], a_right, b), (rows[left], a, b_left)]
                continue
            self.rows.append(rows)
            low.append(own.min(axis=0) if tight and len(rows) else a)
            high.append(own.max(axis=0) if tight and len(rows) else b)
        self.low, self.high = np.array(low), np.array(high)

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point to each box."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(axis=1)


def search(tree: Tree, points: np.ndarray, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, place: np.ndarray, own: int, worst: float, ratio: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines of the best of a block. worst: cosine that is to be bettered or equalled, -2 if none is known.

    Vectors are verified in the order of projected distance, some leaves' worth at a time.
    """
    boxes = tree.distances(place)
    order = np.argsort(boxes)
    bounds = np.append(boxes[order], np.inf)
    best_ids, best = np.zeros(0, np.int64), np.zeros(0)
    waiting_rows, waiting = np.zeros(0, np.int64), np.zeros(0)
    at = 0
    while at < len(order) or len(waiting):
        upto = min(at + 8, len(order))
        rows = np.concatenate([waiting_rows, *[tree.rows[k] for k in order[at:upto]]])
        gaps = points[rows[len(waiting) :]] - place
        near = np.concatenate([waiting, (gaps * gaps).sum(axis=1)])
        at = upto
        reached = bounds[at]  # all vectors of a smaller projected distance are at hand
        out = near <= reached
        waiting_rows, waiting = rows[~out], near[~out]
        rows = rows[out]
        rows = rows[ids[rows] != own]
        cosines = (vectors[rows] * query).sum(axis=1)
        best_ids, best = np.concatenate([best_ids, ids[rows]]), np.concatenate([best, cosines])
        keep = np.lexsort((best_ids, -best))[:count]
        best_ids, best = best_ids[keep], best[keep]
        least = max(worst, best[count - 1]) if len(best) == count else worst
        if least > -2 and reached > ratio * max(0.0, 2 - 2 * least) + 1e-9:
            break
    return best_ids, best


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _best(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector: str = "embedding", count: int = NEIGHBOURS, block: int = BLOCK, sample: int = SAMPLE, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine): the ``count`` nearest found of each row where queries holds.

    Ties go to the smaller id. Rows with a null id, or a vector that is null, zero or has null or non-finite components,
    take no part, nor do vectors of another length than most have (of equally frequent lengths the smallest counts). A
    row is no neighbour of a query with its id; of several rows with one id, the one with the smallest vector counts.
    Queries without any candidate give no rows. Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = "query_id long, vec_id long, score double"
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector))).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("is_query"))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query"))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, total = sizes["size"], sizes["count"]
    rows = rows.filter(F.size("v") == size)
    axes = directions(size, dimensions)
    fit = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]
    fit = _unit(np.array(fit.tolist(), np.float64)) @ axes
    cells = min(max(1, total // block), max(1, len(fit) // 16))
    tree = Tree(fit, -(-len(fit) // cells), tight=False)
    low, high = tree.low, tree.high
    ratio = stopping_ratio(confidence, dimensions)

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        places = _unit(np.array(v.tolist(), np.float64)) @ axes if len(v) else np.zeros((0, dimensions))
        out = np.full(len(places), -1)
        for k in range(len(low)):
            out[(out < 0) & (places > low[k]).all(axis=1) & (places <= high[k]).all(axis=1)] = k
        return pd.Series(out, dtype="int32")

    @F.pandas_udf("array<int>")
    def cells_of(v: pd.Series, home: pd.Series, score: pd.Series) -> pd.Series:
        places, out = _unit(np.array(v.tolist(), np.float64)) @ axes if len(v) else [], []
        for place, own, least in zip(places, home, score, strict=True):
            gap = np.maximum(np.maximum(low - place, place - high), 0)
            near = (gap * gap).sum(axis=1) <= (np.inf if least < -1.5 else ratio * max(0.0, 2 - 2 * least) + 1e-9)
            near[own] = False
            out.append(np.flatnonzero(near).tolist())
        return pd.Series(out)

    placed = stored(rows.withColumn("cell", cell_of("v")), "placed")
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    index = placed.join(blocks, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    asked = placed.filter("is_query").select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("cell").alias("home"))

    def searched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        known = _unit(np.array(left["v"].tolist(), np.float64))
        ids, points = left["id"].to_numpy(), known @ axes
        inner, out = Tree(points, LEAF), []
        wanted = _unit(np.array(right["q"].tolist(), np.float64))
        for own, query, place, worst in zip(right["query_id"], wanted, wanted @ axes, right["worst"], strict=True):
            found, scores = search(inner, points, known, ids, query, place, own, worst, ratio, count)
            out.append(pd.DataFrame({"query_id": own, "vec_id": found, "score": scores}))
        return pd.concat(out)

    def visit(to: DataFrame) -> DataFrame:
        """to: query_id, q, worst, cell."""
        at = to.join(blocks, "cell").select("query_id", "q", "worst", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        return index.groupBy("cell", "block").cogroup(at.groupBy("cell", "block")).applyInPandas(searched, kind)

    first = visit(asked.select("query_id", "q", F.lit(-2.0).alias("worst"), F.col("home").alias("cell")))
    first = stored(_best(first, count).select("query_id", "vec_id", "score"), "own-cells")
    least = first.groupBy("query_id").agg(F.when(F.count("*") == count, F.min("score")).otherwise(-2.0).alias("worst"))
    further = asked.join(least, "query_id", "left").select("query_id", "q", "home", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    further = further.withColumn("cell", F.explode(cells_of("q", "home", "worst"))).select("query_id", "q", "worst", "cell")
    return _best(first.union(visit(further)), count).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
