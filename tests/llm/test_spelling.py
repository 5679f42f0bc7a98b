from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from driftmeter.llm import spelling


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts(rows, thinned=199):
    seen = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if thinned and key is not None and h % thinned == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return seen


def brute(rows, least_chars=6, least_count=5, ratio=5, thinned=199):
    n = {w: k for w, k in counts(rows, thinned).items() if k >= least_count and len(w) >= least_chars}
    # words that are near share all characters but at most one on each side
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, []) if _near(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def _rows(found):
    return sorted((tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_query(spark, sf, documents):
    found = spelling.variants(spark.read.parquet(f"{sf}/documents.parquet"))
    assert _rows(found) == brute(list(zip(documents.doc_id, documents.text, strict=True)))


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghijklmnop"])
def test_neighbours_of_random_words(spark, letters):
    draw = random.Random(len(letters))
    words = sorted({"".join(draw.choices(letters, k=draw.randrange(1, 10))) for _ in range(250)} | {"a" * k for k in range(1, 30)})
    table = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    found = {(words[a], words[b]) for a, b in spelling.neighbours(table).collect()}
    assert found == {(a, b) for a in words for b in words if _near(a, b)}


def test_chains_of_forms(spark):
    """Counts of 1, 5, 25, ... along a chain; the root is its end. Ties go to the smaller word."""
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb"]
    rows = [(None, f"{w} " * 5**i) for i, w in enumerate(chain)] + [(None, "zzzzzz " * 2 + "zzzzzy " * 10 + "zzzzzx " * 10)]
    found = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), least_count=1)
    assert _rows(found) == brute(rows, least_count=1)
    by = {r["word"]: r for r in found.collect()}
    assert by["aaaaaa"]["root"] == "abbbbb" and by["zzzzzz"]["form"] == "zzzzzx"


def test_thinned_runs(spark):
    rows = [(i, "Straße überall Mañana thunderstorm ÀÁÂÃÄÅ " * 3) for i in range(400)]
    found = spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string"), thinned=7)
    assert {r["word"]: r["n"] for r in found.collect()} == dict(counts(rows, 7))


def test_odd_rows(odd, empty):
    named = odd.withColumnRenamed("lang", "word").withColumnRenamed("source", "n").withColumnRenamed("n_chars", "id")
    rows = [(r[0], r[1]) for r in odd.collect()]
    for least in (1, 5):
        found = _rows(spelling.variants(named, least_chars=1, least_count=least))
        assert found == brute(rows, 1, least)
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(odd.filter("text is null or doc_id in (4, 5)")).count() == 0
