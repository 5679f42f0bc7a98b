from __future__ import annotations

import hashlib
import os
import random
import string

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftmeter.llm import suffix_dedup


@given(st.binary(max_size=60) | st.text("ab", max_size=80).map(str.encode) | st.text("a", max_size=40).map(str.encode))
@settings(max_examples=300, deadline=None)
def test_suffix_array(text):
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_query_equals_brute_force(result, documents):
    found = result("op9_suffix_array_dedup").set_index("doc_id")
    for doc_id, expected in zip(documents.doc_id, brute.repeats(documents.text), strict=True):
        assert tuple(found.loc[doc_id]) == expected


def _texts(seed: int) -> list[str]:
    """Texts of shared passages in many surroundings, edited copies, periodic runs, and some that are too short."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randrange(20, 60)) for _ in range(4)]
    out = [prose(rng.randrange(60)) + rng.choice(passages) + prose(rng.randrange(60)) for _ in range(25)]
    out += [out[k][:150] + "#" + out[k][151:] for k in range(5)] + ["la " * rng.randrange(60, 200) for _ in range(4)] + ["", "x" * 199, "x" * 200, "x" * 201, out[0]]
    return out


@pytest.mark.parametrize(("length", "gram", "block_bytes", "group_bytes"), [(200, 64, 1 << 17, 1 << 23), (40, 16, 300, 1 << 23), (40, 16, 1 << 10, 200)])
def test_small_blocks_and_spread_groups(spark, length, gram, block_bytes, group_bytes):
    texts = _texts(length + group_bytes)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, length=length, gram=gram, block_bytes=block_bytes, group_bytes=group_bytes).collect()}
    for i, expected in enumerate(brute.repeats(texts, length)):
        r = found[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) == expected, i


@pytest.mark.parametrize("spread", [True, False])
def test_blocks_and_batches_are_bounded(monkeypatch, spread):
    rng = random.Random(3)
    edge = lambda: rng.randbytes(2) + b"edge" * 10
    segs = sorted({edge()[::-1] + b"passage " * 27 + edge() for _ in range(700)})
    rows = [{"a": 1, "salt": 0, "spread": spread, "copies": 1, "u": u, "lo": 0, "o": 42, "seg": s} for u, s in enumerate(segs)]
    sizes, sort = [], suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text: sizes.append(len(text)) or sort(text))
    monkeypatch.setattr(suffix_dedup, "_BATCH", 1000, raising=False)
    found = list(suffix_dedup._sort_blocks(200, 1 << 14)(iter([suffix_dedup.pa.RecordBatch.from_pylist(rows)])))
    assert len(sizes) > 3 and max(sizes) < (1 << 14) + 400 and max(b.num_rows for b in found) <= 1000


def test_one_anchor_beyond_a_group_at_the_default_parameters(spark):
    rng = random.Random(4)
    passage = "".join(rng.choices(string.ascii_letters, k=300))
    edge = lambda: "".join(rng.choices(string.ascii_letters, k=140))
    edges = [(edge(), edge()) for _ in range(31_000)]
    docs = spark.createDataFrame([(i, a + passage + b) for i, (a, b) in enumerate(edges)], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"]).decode()) for r in suffix_dedup.remove_repeats(docs).collect()}

    def reach(parts):
        """For each string the longest beginning that another one has too."""
        order = sorted(range(len(parts)), key=parts.__getitem__)
        out = [0] * len(parts)
        for x, y in zip(order, order[1:], strict=False):
            k = len(os.path.commonprefix([parts[x], parts[y]]))
            out[x], out[y] = max(out[x], k), max(out[y], k)
        return out

    left, right = reach([a[::-1] for a, _ in edges]), reach([b for _, b in edges])
    for i, ((a, b), x, y) in enumerate(zip(edges, left, right, strict=True)):
        assert found[i] == (300 + x + y, 1, a[: 140 - x] + b[y:])


def test_pieces_of_a_long_text_agree(monkeypatch):
    raw = " ".join(_texts(1)).encode()
    whole = suffix_dedup.anchors(raw)
    monkeypatch.setattr(suffix_dedup, "_PIECE", 500)
    windows = lambda found: {
        (int(p) >> 24) + k: (int(a), (int(p) >> 24) + (int(p) & 4095)) for a, _, p in zip(*found, strict=True) for k in range(int(p) >> 12 & 4095)
    }
    assert windows(whole) == windows(suffix_dedup.anchors(raw))


def test_odd_rows(odd, empty):
    named = odd.withColumnRenamed("lang", "kept").withColumnRenamed("source", "u")
    rows = suffix_dedup.remove_repeats(named).collect()
    assert len(rows) == 13 and "u" in rows[0].asDict()
    by = {r["doc_id"]: r for r in rows}
    assert (by[8]["n_removed"], by[8]["kept"]) == (108_000, b"") and (by[9]["n_removed"], by[9]["n_spans"]) == (30_000, 1)
    assert by[3]["n_bytes"] == by[4]["n_bytes"] == 0 and by[5]["kept"] == b" \n\t "
    assert suffix_dedup.remove_repeats(empty).count() == 0
