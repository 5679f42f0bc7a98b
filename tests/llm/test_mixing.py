from __future__ import annotations

import re

import numpy as np
import pytest

from driftmeter.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Shared by weight, the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), float(sum(sizes.values()))
    while left > 1e-9:
        live = [s for s in names if target[s] < most * sizes[s] - 1e-9]
        if not live:
            break
        total = sum(weight[s] for s in live)
        for s in live:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in live:
            left += max(0.0, target[s] - most * sizes[s])
            target[s] = min(target[s], most * sizes[s])
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 50, None: 7, "c": 900}, {"x": 5}, {"a": 0, "b": 10}, {"é": 3, "z": 4, "Z": 100, None: 1}])
def test_targets(spark, sizes):
    found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    expected = shares(sizes)
    assert {r["source"]: r["target"] for r in found} == pytest.approx(expected)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_permutations(n):
    at = [mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64)).tolist() for key in (1, 2)]
    assert all(sorted(x) == list(range(n)) for x in at) and (n < 5 or at[0] != at[1])


def test_query(result, documents, spark, sf):
    found = result("op3_source_mixing").merge(documents, on="doc_id")
    assert len(found) == len(documents)
    assert found["size"].tolist() == [len(WORD.findall(t)) for t in found.text]
    sizes = found.groupby("source")["size"].sum().to_dict()
    assert (found.source_size == found.source.map(sizes)).all()
    assert found.target.tolist() == pytest.approx(found.source.map(shares(sizes)).tolist())
    assert (found.taken <= 3 * found["size"]).all()
    taken = found.groupby("source").taken.sum()
    for source, target in shares(sizes).items():
        assert abs(taken[source] - target) <= max(0.05 * target, 4 * mixing.BLOCK)
    again = mixing.taken_words(spark.read.parquet(f"{sf}/documents.parquet").repartition(3)).toPandas().set_index("doc_id").taken
    assert (again[found.doc_id].to_numpy() == found.taken.to_numpy()).all()


def test_mixed_documents_hold_the_taken_words(spark, sf, result):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = mixing.mixed_documents(docs).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert list(mixed.columns) == docs.columns
    for r in mixed.itertuples():
        assert r.n_chars == len(r.text) and all(w in texts[r.doc_id] for w in r.text.split())
    words = mixed.text.map(lambda t: len(WORD.findall(t))).groupby(mixed.doc_id).sum()
    taken = result("op3_source_mixing").set_index("doc_id").taken
    assert words.to_dict() == taken[taken > 0].to_dict()


def test_cut_words():
    text = " a b\n\nc  d "
    assert mixing.cut_words(text, [(0, 4)]) == text and mixing.cut_words(text, [(2, 2), (0, 2)]) == text
    assert mixing.cut_words(text, [(1, 2)]) == "b\n\nc" and mixing.cut_words(text, [(3, 1), (0, 1)]) == "a d"


def test_odd_rows(odd, empty):
    rows = mixing.taken_words(odd.withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "row"), block=16).collect()
    assert len(rows) == 13
    assert {r["taken"] for r in rows if r["size"] == 0} == {0} and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) == pytest.approx(sum(r["size"] for r in rows), rel=0.02)
    assert {r["source_size"] for r in rows if r["doc_id"] is None} == {36}  # with the empty text of row 4: the null source
    assert mixing.mixed_documents(odd).count() > 0
    assert mixing.taken_words(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.taken_words(odd.filter("text is null")).count() == 2
