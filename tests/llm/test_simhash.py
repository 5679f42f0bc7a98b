from __future__ import annotations

import random

import brute
import pytest

from driftmeter.llm import common, simhash


def test_query_equals_brute_force(result, documents):
    found = result("op1_simhash_near_dedup").set_index("doc_id")
    prints = [brute.fingerprint(t) for t in documents.text]
    assert [format(p, "016x") for p in prints] == found.loc[documents.doc_id].fingerprint.tolist()
    classes = brute.components(documents.doc_id.tolist(), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert classes == found.loc[documents.doc_id].component_id.tolist()


def test_links_of_close_fingerprints(spark):
    rng = random.Random(3)
    words = [rng.getrandbits(64) for _ in range(150)]
    for w in list(words):
        for _ in range(3):
            near = w
            for b in rng.sample(range(64), rng.randrange(4)):
                near ^= 1 << b
            words.append(near)
    words = sorted({w - (1 << 64) if w >> 63 else w for w in words} | {0, -1, 1, 3, -2})
    links = simhash.links(spark.createDataFrame([(w,) for w in words], "fp long"))
    roots = {r["node"]: r["root"] for r in common.components(links).collect()}
    expected = brute.components(words, lambda i, j: ((words[i] ^ words[j]) & (1 << 64) - 1).bit_count() <= 2)
    assert [roots.get(w, w) for w in words] == expected


def test_many_near_copies_give_few_links(spark):
    centre = 0x0123456789ABCDEF
    near = {centre ^ (1 << a) ^ (1 << b) for a in range(63) for b in range(63)}
    assert len(near) > 1900
    links = simhash.links(spark.createDataFrame([(w,) for w in near], "fp long"))
    assert links.count() < 70 * len(near)
    assert {r["root"] for r in common.components(links).collect()} == {min(near)}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 200)]
    found = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("text", [None, "", " \n\x0b", "A", "a b", "a b c", "A B c d " * 300, "Ä ä é x y z"])
def test_fingerprint(text):
    expected = brute.fingerprint(text)
    assert simhash.fingerprint(text.encode() if text is not None else None) % (1 << 64) == expected


def test_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd.withColumnRenamed("lang", "fp").withColumnRenamed("source", "component_id")).collect()
    assert len(rows) == 13
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in rows}
    assert {by[k] for k in by if k[1] == 0} == {3}  # null, empty and white texts, with and without id
    same = next(k[1] for k in by if k[0] == 1)
    assert {by[k] for k in by if k[1] == same} == {1}
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    prints = [brute.fingerprint(t) for _, t in texts]
    groups = set(brute.components([d for d, _ in texts], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2))
    kept = simhash.keep_one(odd)
    assert {r["doc_id"] for r in kept.collect()} == groups and kept.count() == len(groups) and kept.columns == odd.columns
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    lone = odd.filter("doc_id is null and text is null")
    assert simhash.near_duplicates(lone).first()["component_id"] is None and simhash.keep_one(lone.union(lone)).count() == 1
