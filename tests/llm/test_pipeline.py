from __future__ import annotations

import brute
import pytest

import corpus_pipeline
from driftmeter.llm import queries
from driftmeter.llm.common import stored


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "step")
        out.append(docs.toPandas())
    return out


def test_quality_rules_keep_what_the_query_keeps(steps, result):
    judged = result("op6_quality_rules")
    assert set(steps[1].doc_id) == set(judged[judged.kept].doc_id)
    assert steps[1].merge(steps[0]).shape == steps[1].shape


def test_one_of_each_group_stays(steps):
    before, after = steps[1], steps[2]
    prints = [brute.fingerprint(t) for t in before.text]
    groups = brute.components(before.doc_id.tolist(), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert sorted(after.doc_id) == sorted(set(groups)) and after.merge(before).shape == after.shape


def test_repeats_are_cut(steps):
    before, after = steps[2], steps[3].set_index("doc_id")
    assert set(before.doc_id) == set(after.index)
    for doc_id, text, (n, removed, _, _) in zip(before.doc_id, before.text, brute.repeats(before.text), strict=True):
        kept = after.loc[doc_id]
        assert n - removed - 6 <= len(kept.text.encode()) <= n - removed and kept.n_chars == len(kept.text)
        assert removed or kept.text == text


def test_mix_and_tokens(steps):
    before, mixed, coded = steps[3], steps[4], steps[5]
    assert list(mixed.columns) == list(before.columns) and set(mixed.doc_id) <= set(before.doc_id)
    assert mixed.doc_id.value_counts().max() <= 3
    assert len(coded) == len(mixed) and coded.round_trip.all()
    assert (coded.n_tokens == coded.ids.map(lambda x: len(x.split(",")) if x else 0)).all()


def test_registered_as_a_whole(steps, result):
    found = result("pipeline")
    assert len(found) == len(steps[5]) and sorted(found.n_tokens) == sorted(steps[5].n_tokens)
    assert [f for f in queries.QUERIES if f.startswith("op")] == sorted((f for f in queries.QUERIES if f.startswith("op")), key=lambda f: int(f[2:].split("_")[0]))


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_odd_rows(spark, sf, request, rows):
    docs = request.getfixturevalue(rows)
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stored(stage(spark, docs, sf), "step")
    assert docs.count() == 0 or rows == "odd"
    assert corpus_pipeline.quality(spark, request.getfixturevalue(rows), sf).columns == request.getfixturevalue(rows).columns
