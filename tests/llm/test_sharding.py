from __future__ import annotations

import zlib
from collections import Counter

import pytest

from driftmeter.llm import sharding


def _lawful(rows, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))


def test_query(result, documents):
    found = result("op5_external_shuffle")
    _lawful(found.to_dict("records"), 40)
    merged = found.merge(documents, on="doc_id")
    assert len(merged) == len(documents) == len(found)
    assert merged.text_crc32.tolist() == [zlib.crc32(t.encode()) for t in merged.text]
    assert merged["size"].tolist() == [len(t.encode()) + 16 for t in merged.text]


def test_fisher_yates_is_uniform_and_repeatable():
    seen = Counter(tuple(sharding.fisher_yates(3, 1, b)) for b in range(6000))
    assert len(seen) == 6 and max(seen.values()) < 1200 and min(seen.values()) > 800
    assert (sharding.fisher_yates(100, 1, 2) == sharding.fisher_yates(100, 1, 2)).all() and len(sharding.fisher_yates(0, 1, 0)) == 0


@pytest.mark.parametrize("bucket_bytes", [2000, 1 << 25])
def test_odd_rows(odd, empty, bucket_bytes):
    named = odd.withColumnRenamed("lang", "slot").withColumnRenamed("source", "_base_")
    rows = sharding.sharded(named, shards=4, bucket_bytes=bucket_bytes).collect()
    _lawful([r.asDict() for r in rows], 4)
    key = lambda r: (r["doc_id"], r["text"], r["n_chars"])
    assert Counter(map(key, rows)) == Counter(map(key, odd.collect()))
    assert sharding.sharded(empty).count() == 0


def test_one_id_spreads_over_buckets(spark):
    docs = spark.range(3000).selectExpr("cast(7 as long) as doc_id", "repeat(concat('text ', id, ' '), 5) as text")
    rows, _ = sharding._scattered(docs, "text", "doc_id", 20_000, sharding.SEED)
    counts = [r["count"] for r in rows.groupBy("_bucket").count().collect()]
    assert len(counts) > 8 and max(counts) < 1.5 * 3000 / len(counts)
    found = sharding.sharded(docs, shards=7, bucket_bytes=20_000).collect()
    _lawful(found, 7)
    assert {r["text"] for r in found} == {r["text"] for r in docs.collect()} and len(found) == 3000


def test_many_rows_without_id(spark):
    docs = spark.range(2000).selectExpr("cast(null as long) as doc_id", "'same' as text")
    rows = sharding.sharded(docs, shards=7, bucket_bytes=1000).collect()
    assert len(rows) == 2000
    _lawful(rows, 7)
