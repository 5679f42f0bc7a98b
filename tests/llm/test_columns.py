"""Extra columns may have any name: every name that the modules use for themselves is given to one."""

from __future__ import annotations

import re
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from driftmeter.llm import byte_bpe, common, mixing, page_diff, personal, quality_rules, sharding, simhash, suffix_dedup

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Results, which replace columns of their names.
REPLACED = {"n_chars", "text", "doc_id", "source", "spans", "kept", "rule", "base_failed", "n_bytes", "n_removed", "n_spans", "shard", "slot", "n_tokens", "ids", "decoded"}


def _names(module):
    """All names in quotes after alias, withColumn, select and the like, and column names in general."""
    source = Path(module.__file__).read_text()
    found = set(re.findall(r'"(_?[a-z][a-z0-9_]{0,14})"', source))
    return sorted((found | {f"{n}_" for n in found if n.startswith("_")}) - REPLACED)


@pytest.mark.parametrize(
    ("module", "apply"),
    [
        (quality_rules, lambda spark, docs: quality_rules.judged(docs, spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, quality int"))),
        (simhash, lambda spark, docs: simhash.keep_one(docs)),
        (suffix_dedup, lambda spark, docs: suffix_dedup.remove_repeats(docs)),
        (mixing, lambda spark, docs: mixing.mixed_documents(docs)),
        (byte_bpe, lambda spark, docs: byte_bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN)),
        (sharding, lambda spark, docs: sharding.sharded(docs, shards=3)),
        (personal, lambda spark, docs: personal.find(docs, personal.Field({"any": 0}, personal.np.eye(1, len(personal.TAGS))))),
    ],
    ids=lambda x: getattr(x, "__name__", "").rpartition(".")[2],
)
def test_documents(spark, odd, module, apply):
    if not hasattr(module, "__file__"):
        return
    measures = {c for c in quality_rules.measured(odd.select("text"), "text").columns} if module is quality_rules else set()
    extra = [n for n in _names(module) if n not in measures and n not in odd.columns]
    docs = odd.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in extra])
    rows = apply(spark, docs).collect()
    plain = apply(spark, odd).collect()
    assert len(rows) == len(plain)
    for r in rows:
        assert all(r[n] == (None if r["doc_id"] is None else f"{n}:{r['doc_id']}") for n in extra)


def test_pages(spark):
    extra = [n for n in _names(page_diff) if n not in ("html", "url", "text")]
    pages = spark.createDataFrame([(i, f"http://h/{i % 3}", f"<p>a{i % 2}<p>b{i}") for i in range(7)], "page_id long, url string, html string")
    docs = pages.select("*", *[F.concat(F.lit(f"{n}:"), F.col("page_id").cast("string")).alias(n) for n in extra if n != "page_id"])
    found = {r["page_id"]: r for r in page_diff.extract(docs).collect()}
    plain = {r["page_id"]: r["text"] for r in page_diff.extract(pages).collect()}
    assert {k: r["text"] for k, r in found.items()} == plain
    assert all(r[n] == f"{n}:{k}" for k, r in found.items() for n in extra if n != "page_id")


def test_unused():
    assert common.unused(["a", "_ROW", "_row_"], "_row") == "_row__"
