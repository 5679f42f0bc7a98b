from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from driftmeter.llm import toxicity


def _vector(word):
    """Weighted subsequences of three characters of the edged word within a span of SPAN."""
    w, out = f"\1{word}\1", defaultdict(float)
    for a in range(len(w)):
        for c in range(a + 2, min(len(w), a + toxicity.SPAN)):
            for b in range(a + 1, c):
                out[w[a] + w[b] + w[c]] += toxicity.DECAY ** (c - a + 1 - 3)
    return out


def _kernel(a, b):
    x, y = _vector(a), _vector(b)
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[k] for k, v in x.items() if k in y) / norm


@pytest.mark.parametrize(("a", "b"), [("idiot", "idiot"), ("idiot", "idixot"), ("banana", "bananas"), ("aaaa", "aaa"), ("réeux", "réeuxment"), ("abc", "xyz")])
def test_kernel_equals_definition(a, b):
    machine = toxicity.Machine(toxicity._table([b]), np.zeros(1), 0.0, np.zeros(0), 0.0)
    assert machine.kernel([a])[0, 0] == pytest.approx(_kernel(a, b) ** toxicity.POWER, abs=1e-4)


def test_long_words_are_compared_in_pieces():
    machine = toxicity.Machine(toxicity._table(["idiot"]), np.zeros(1), 0.0, np.zeros(0), 0.0)
    long, other = machine.kernel(["x" * 40 + "idiot" + "x" * 40, "x" * 85])[:, 0]
    assert long > other == 0 and machine.kernel(["idiot"])[0, 0] == pytest.approx(1, abs=1e-4)


def test_words():
    assert toxicity.words("you i-d.i*o*t*** 42 a".split()) == ["you", "idiot", "a"]
    assert toxicity.sentences("So i d i\to t you a b, I") == [["so", "idiot", "you", "a", "b,", "i"]]
    assert toxicity.sentences(None) == toxicity.sentences("") == toxicity.sentences(" \n") == []
    assert toxicity.sentences("A b. C\nd!") == [["a", "b."], ["c"], ["d!"]]
    assert list(map(len, toxicity.sentences("xy " * 40))) == [16, 16, 8]


@pytest.fixture(scope="module")
def machine():
    rng = np.random.default_rng(0)
    usual = [f"{a}{b}" for a in ("re", "ta", "mo", "li", "su", "ne") for b in ("ran", "dol", "mit", "ser", "pok")]
    texts, toxic = [], []
    for k in range(240):
        words = rng.choice(usual, 40).tolist()
        if k % 4 == 0:
            words[10] = rng.choice(["idiot", "stupid"])
            words[30] = rng.choice(["idiot", "moron"])
        texts.append(" ".join(words[:20]) + ". " + " ".join(words[20:]) + ".")
        toxic.append(k % 4 == 0)
    return toxicity.train(texts, np.array(toxic)), usual


@pytest.mark.parametrize("word", ["idiot", "IDIOT!!", "i.d.i.o.t", "id*iot", "idioot", "i d i o t", "stuppid", "moron,"])
def test_insults_with_gaps_and_insertions(machine, word):
    model, usual = machine
    clean = " ".join(usual[:12])
    high, low = toxicity._Scorer(model).scores([f"{clean}. {clean} {word} {clean}.", f"{clean}. {clean} {usual[20]} {clean}."])
    assert high > 0.5 > low


def test_query_on_held_out_rows(result, sf):
    found = result("op10_toxicity").set_index("doc_id")
    assert found.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.index]
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.5)).all()


def test_accuracy_on_held_out_rows(spark, result):
    from driftmeter.llm import queries

    sf = "/root/testdata/sf0.01"
    found = queries.op10_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = found[found.held_out & found.toxic.notna()]
    assert (held.predicted == held.toxic).mean() > 0.93
    clean = held[held.toxic == 0]
    assert (clean.predicted == 1).mean() < 0.05


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1)], [(None, 1), (99, 1), (2, None)]])
def test_odd_rows(spark, odd, empty, labels):
    model = toxicity.fitted(odd, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = toxicity.scored(odd.withColumnRenamed("lang", "score"), model).collect()
    assert len(rows) == 13 and {r["score"] for r in rows} == {1.0 if labels == [(1, 1)] else 0.0}
    assert toxicity.scored(empty, model).count() == 0


def test_empty_texts_have_a_score(spark, odd, machine):
    scores = {r["text"]: r["score"] for r in toxicity.scored(odd, machine[0]).collect()}
    assert scores[None] == scores[""] == scores[" \n\t "] < 0.5
