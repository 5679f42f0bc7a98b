"""Byte-level BPE by prefixes, and token files."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftmeter.llm import byte_bpe, token_files

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
coder = byte_bpe.encoder(RANKS, public_tokenizers.PATTERN)
library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks.ranks, special_tokens={})
tokenizer = Tokenizer.from_file(WORDS)
tokenizer.encode_special_tokens = True
words = token_files.Words(WORDS)


@given(st.text(max_size=80))
@settings(max_examples=400, deadline=None)
def test_bpe_equals_library(text):
    n, ids = coder.encode(text)
    expected = library.encode_ordinary(text)
    assert (n, ids) == (len(expected), ",".join(map(str, expected)))
    assert coder.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["x" * 5000, " " * 3000 + "a", "!?" * 2000, "the" * 2000, "日本" * 800])
def test_bpe_of_long_pieces(text):
    assert coder.encode(text)[1] == ",".join(map(str, library.encode_ordinary(text)))


def test_prefixes_append_and_replace():
    rng = random.Random(4)
    some = lambda n: bytes(rng.choice(b"thein gaor") for _ in range(rng.randrange(n)))
    for _ in range(200):
        raw, more = some(150), some(20)
        held = byte_bpe.Prefixes(coder.ranks, raw)
        held.append(more)
        raw += more
        assert held.last == byte_bpe.Prefixes(coder.ranks, raw).last
        lo = rng.randrange(len(raw) + 1)
        hi, new = min(len(raw), lo + rng.randrange(6)), some(6)
        held.replace(lo, hi, new)
        raw = raw[:lo] + new + raw[hi:]
        assert held.raw == raw and held.last == byte_bpe.Prefixes(coder.ranks, raw).last and held.ids() == coder.ranks.merge(raw)


def test_bpe_query(result, documents):
    found = result("op7_byte_bpe").set_index("doc_id")
    for doc_id, text in zip(documents.doc_id, documents.text, strict=True):
        ids = library.encode_ordinary(text)
        assert tuple(found.loc[doc_id]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_of_odd_rows(odd, empty):
    rows = byte_bpe.encode_decode(odd.withColumnRenamed("lang", "ids"), RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == 13 and all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows)
    assert {(r["n_tokens"], r["ids"]) for r in rows if not r["text"]} == {(0, "")}
    assert byte_bpe.digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


@given(st.lists(st.lists(st.integers(0, 70) | st.integers(0, 60_000) | st.integers(0, (1 << 64) - 1), max_size=300), max_size=6))
@settings(max_examples=150, deadline=None)
def test_segments_come_back(documents_):
    arrays = [np.array(d, np.uint64) for d in documents_]
    raw = b"".join(s + b"\n" for s in token_files.segments([(k, a) for k, a in enumerate(arrays)]))
    found = list(token_files.read_segments(raw))
    assert [(k, last, ids.tolist()) for k, last, ids in found] == [(k, True, a.tolist()) for k, a in enumerate(arrays)]


def test_long_documents_take_several_segments(monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 1000)
    monkeypatch.setattr(token_files, "TOGETHER", 1500)
    ids = np.arange(4321, dtype=np.uint64)
    found = list(token_files.read_segments(b"".join(s + b"\n" for s in token_files.segments([(None, ids), (5, ids[:1000])]))))
    assert [(k, last, len(x)) for k, last, x in found] == [(None, False, 1000)] * 4 + [(None, True, 321), (5, True, 1000)]
    assert np.concatenate([x for _, _, x in found[:5]]).tolist() == ids.tolist()


def test_selectors_pack_small_ids_densely():
    offsets, words, escapes = next(token_files.pack([np.ones(token_files.BLOCK, np.uint64)]))
    assert len(words) == 3 and len(escapes) == 0 and offsets.tolist() == [0]


@given(st.text(max_size=60) | st.text("aA|'ts.1é ÄİǅΣ́\x1c\xa0 <>", max_size=30))
@settings(max_examples=400, deadline=None)
def test_words_equal_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids, empty = words.encode(pa.array([text.encode(), None]))
    assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and not len(empty)


def test_special_tokens_are_text():
    text = "a <|endoftext|> b<|startoftext|>"
    assert words.encode(pa.array([text.encode()]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_lower_case_is_all_that_latin_letters_need():
    letters = [c for c in map(chr, range(0x250)) if token_files._LATIN(c)]
    assert len(letters) == 524
    text = "".join(a + b for a in letters for b in letters)
    assert words.tokenizer.normalizer.normalize_str(text) == text.lower()


def test_one_id_spreads_over_files(spark, tmp_path, monkeypatch):
    rows = [(7, f"word{i} " * (i % 9)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(token_files, "FILE_BYTES", 1000)  # asks for more files than there are shuffle partitions
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, path, WORDS, end=2)
    sizes = [r[0] for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert len([n for n in sizes if n]) > 20 and max(sizes) < sum(sizes) / 8
    found = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert len(found) == 900 and {r["id"] for r in found} == {7}
    assert sorted(r["n_tokens"] for r in found) == sorted(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)


def test_full_cache(monkeypatch, documents):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 50)
    held = token_files.Words(WORDS)
    for text in documents.text[:20]:
        assert held.encode(pa.array([text.encode()]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(held.known) < 3000


def _expected(rows: pd.DataFrame) -> list[tuple]:
    out, start = [], 0
    for doc_id, text in zip(rows.doc_id, rows.text, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_query(result, documents):
    found = result("op2_token_files").sort_values("doc_id")
    assert list(found.itertuples(index=False, name=None)) == _expected(documents.sort_values("doc_id"))


def test_files_of_odd_rows(odd, empty):
    rows = token_files.round_trip(odd.withColumnRenamed("lang", "id").withColumnRenamed("source", "value"), WORDS, end=2).collect()
    frame = odd.toPandas()
    expected = {(None if pd.isna(d) else int(d), n, c) for d, _, n, c in _expected(frame)}
    assert len(rows) == 13 and {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows} == expected
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [sum(r["n_tokens"] for r in ordered[:k]) for k in range(13)]
    assert [r["doc_id"] for r in ordered] == [None, None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert token_files.round_trip(empty, WORDS, end=2).count() == 0
