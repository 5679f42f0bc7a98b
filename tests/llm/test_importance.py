from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmeter.llm import importance


def _features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, longest=1, buckets=10_000, percent=10, least=20, seed="2024"):
    """(id, n_features, weight, score, rank) in the order of rows (id, text)."""
    held = [(i, *_features(t, longest)) for i, t in rows]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, _, fs in held for f in fs)
    t = Counter(bucket(f) for x in target for f in _features(x, longest)[1])
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all)))
    out = []
    for i, n_words, fs in held:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(fs), weight, score, None, n_words])
    drawn = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    for place, x in enumerate(drawn[: percent * len(drawn) // 100], 1):
        x[4] = place
    return [tuple(x[:5]) for x in out]


def _rows(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_query(result, documents, spark, sf):
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    found = result("op11_importance_resampling")
    ours = {(r.doc_id, r.n_features, r.weight, r.score, None if np.isnan(r["rank"]) else int(r["rank"])) for _, r in found.iterrows()}
    assert ours == set(brute(list(zip(documents.doc_id, documents.text, strict=True)), target))
    assert len(found) == len(documents) and found["rank"].notna().sum() == sum(found.n_features >= 20) // 10


@pytest.mark.parametrize(("longest", "head"), [(1, 3), (2, 0), (2, 50), (3, 50)])
def test_longer_runs_and_any_head(spark, sf, documents, longest, head):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60")
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = importance.resampled(docs, target, percent=50, longest=longest, buckets=97, head_words=head, head_pairs=head)
    rows = documents[documents.doc_id < 60]
    expected = brute(list(zip(rows.doc_id, rows.text, strict=True)), [r["text"] for r in target.collect()], longest, 97, 50)
    assert _rows(found) == sorted(expected, key=str)


def test_odd_rows(odd, empty):
    named = odd.withColumnRenamed("lang", "n_words").withColumnRenamed("source", "found").withColumnRenamed("n_chars", "score")
    target = odd.filter("doc_id < 3").withColumnRenamed("lang", "_f")
    found = importance.resampled(named, target, percent=60, buckets=1 << 17)
    rows = odd.collect()
    assert _rows(found) == sorted(brute([(r[0], r[1]) for r in rows], [r["text"] for r in target.collect()], buckets=1 << 17, percent=60), key=str)
    assert importance.resampled(empty, target).count() == 0
    none = importance.resampled(odd, empty.withColumn("score", F.lit(1)), percent=60).collect()
    assert len(none) == len(rows) and sum(r["rank"] is not None for r in none) == 6 * sum(r["n_features"] >= 20 for r in none) // 10


def test_one_row_repeated(spark):
    """All rows tie in everything: each place is given once."""
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", "repeat('word other ', 15) as text")
    found = importance.resampled(docs, docs.limit(1), percent=50).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 1501))


def test_head_and_tail_agree():
    words = [f"w{i % 7}é".encode() for i in range(50)]
    plain = importance.Vocabulary(longest=2).features(words)
    head = importance.Vocabulary.of(words[:3], [(words[0], words[1])], longest=2).features(words)
    assert (plain == head).all() and len(plain) == 99
