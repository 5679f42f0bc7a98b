from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmeter.llm import personal as P


@pytest.fixture(scope="module")
def tagger(spark):
    return P.Tagger(P.train(P.labelled_sentences(spark)))


def brute(text):
    """The patterns as they are stated, one after the other."""
    out = []
    for kind, pattern in enumerate([
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    ]):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == 1 and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == 2:
                doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1])]
                if not 14 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def _text(spans):
    return ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, b, k in spans)


def test_query(result, documents):
    found = result("op12_personal_data").merge(documents, on="doc_id")
    assert len(found) == len(documents)
    for _, r in found.iterrows():
        spans = brute(r.text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, _, k in spans) for kind in range(4)]
        assert r.base_sha256 == hashlib.sha256(_text(spans).encode()).hexdigest()
        assert set(filter(None, _text(spans).split(","))) <= set(r.spans.split(","))


def test_patterns_on_random_texts():
    draw = random.Random(1)
    for letters in ("0123.", "a1.@-", "+1 (2)-.", "4 -1", "a@.b+1 2.", "19. -+@aé"):
        for n in (5, 20, 60, 200):
            for _ in range(150):
                text = "".join(draw.choices(letters, k=n))
                assert P.base_spans(text) == brute(text), text
    cards = "4532015112830366 4532-0151-1283-0366, 4532015112830367 1.2.3.4:80 0255.1.1.1 1.2.3.4.5 256.1.1.1 a@b@c.d a@b.c@d.e +1 (017) 555-7713"
    assert P.base_spans(cards) == brute(cards)


def test_long_runs_take_linear_time(tagger):
    start = time.time()
    for text in ("1" * 400_000, "a" * 400_000, "1." * 200_000, "a@" * 200_000, "+1 " * 100_000, "1 " * 100_000, "(at) " * 50_000):
        P.found_spans([text], tagger)
    assert time.time() - start < 60


def test_held_out_sentences(tagger):
    rows = P.sentences(1000, seed=77)
    right = wrong = missed = 0
    for (_, spans), got in zip(rows, tagger.added([t for t, _ in rows]), strict=True):
        gold = {(a, b, P.KINDS.index(k)) for k, a, b in spans}
        right, wrong, missed = right + len(gold & set(got)), wrong + len(set(got) - gold), missed + len(gold - set(got))
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.93, (right, wrong, missed)


def test_leaving_words_out_changes_no_path(tagger, documents):
    """Viterbi over whole texts, every word in it, gives the tags that the runs of open words give."""
    texts = [t for t in documents.text if t][:60] + [t for t, _ in P.sentences(200, 8)]
    for text in texts:
        words = text.split()
        if not words:
            continue
        rows = np.array([tagger._edge, *(tagger._number(w) for w in words), tagger._edge])
        kinds, scores = tagger._kinds[rows], tagger._scores[rows].copy()
        scores[1:] += tagger.model.before[kinds[:-1]]
        scores[:-1] += tagger.model.after[kinds[1:]]
        tags = tagger.model.viterbi(scores[None, 1:-1], np.array([len(words)]))[0].tolist()
        assert P._spans(text, tags) == tagger.added([text])[0]


def test_what_the_patterns_miss(tagger):
    text = "write to anna (at) example (dot) org or call (017) 555-7713 today, card 4432507379035541!! and 4432 5073 7903 5541 thanks"
    found = [(text[a:b], P.KINDS[k], base) for a, b, k, base in P.found_spans([text], tagger)[0]]
    assert ("(017) 555-7713", "phone", False) in found and ("4432507379035541", "card", False) in found
    assert ("anna (at) example (dot) org", "email", False) in found
    clean = ["The heron of the wood. | a | b | c |\nLicensed under CC BY-NC 4.0, version 3.", "the*** thing!! of### 12 things in 2024, at 10:30 $5.00", ""]
    assert P.found_spans(clean, tagger) == [[], [], []]


def test_base_spans_stay_alone(tagger):
    text = "mail li@example.org 10.0.0.1 +1 (017) 555-7713 4532015112830366 4532015112830367"
    found = P.found_spans([text], tagger)[0]
    assert [s[:3] for s in found if s[3]] == P.base_spans(text)
    taken = sorted(s[:2] for s in found)
    added = [s for s in found if not s[3]]
    assert all(not (a < e and s < b) for a, b, *_ in added for s, e in taken if (s, e) != (a, b))


def test_odd_rows(spark, odd, empty, tagger):
    named = odd.withColumnRenamed("lang", "spans").withColumnRenamed("source", "start")
    rows = P.find(named, tagger.model).collect()
    assert len(rows) == odd.count() and set(rows[0].asDict()) == {"doc_id", "text", "start", "n_chars", "spans"}
    assert all(r["spans"] == [] for r in rows)
    assert P.find(empty, tagger.model).count() == 0


def test_labels_with_nothing(spark):
    none = spark.createDataFrame([], "text string, spans array<struct<kind string, start int, end int>>")
    for table in (none, spark.createDataFrame([("a b", []), (None, None), ("c", None)], none.schema)):
        model = P.train(table)
        assert P.Tagger(model).added(["call +1 23", ""]) == [[], []]
    kinds = P.labelled_sentences(spark, 50).withColumn("x", F.lit(1))
    assert P.train(kinds, max_labelled=20).own.any()
