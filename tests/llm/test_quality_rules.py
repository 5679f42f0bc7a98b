from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftmeter.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_query(result, documents):
    found = result("op6_quality_rules").set_index("doc_id").loc[documents.doc_id]
    assert list(found[BASE].itertuples(index=False, name=None)) == [counts(t) for t in documents.text]
    failed = (found.n_words < 20) | (100 * found.n_repeat_words > 30 * found.n_words)
    assert (found.base_failed == failed).all() and not (found.kept & failed).any()
    assert (found.kept == ~failed & (found.rule == 0)).all()


def test_verdicts_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = quality_rules.judged(spark.read.parquet(f"{sf}/documents.parquet"), labels).filter("not base_failed").join(labels.filter("quality is not null"), "doc_id").toPandas()
    assert found[found.quality == 1].kept.mean() > 0.98
    assert found[found.quality == 0].kept.mean() < 0.1


@pytest.mark.parametrize("text", ["a b c d e f g h", "a b c d e f g h " * 2, "x " * 40, "a b c d e f g h i a b c d e f g h z a b c d e f g h", "\n\n a\na\n \na", None, " "])
def test_counts(spark, text):
    row = quality_rules.measured(spark.createDataFrame([(text,)], "text string")).first()
    assert tuple(row[c] for c in BASE) == counts(text)


def _rows(n):
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        rows.append({"hash": i * 7919, "bad": bad, "symbols": 0.3 if bad and i % 8 else 0.01 * (i % 5), "upper": 0.9 if bad and not i % 8 else 0.1, "noise": (i * 37) % 11})
    return rows


def test_covering_finds_both_reasons():
    rules = quality_rules.learn(_rows(400), ["symbols", "upper", "noise"])
    assert {c.feature for r in rules for c in r} == {"symbols", "upper"} and len(rules) == 2
    assert all(any(all(c.holds(r) for c in rule) for rule in rules) == r["bad"] for r in _rows(400))


def test_pruning_drops_what_does_not_help():
    by = lambda *cs: tuple(quality_rules.Condition(*c) for c in cs)
    rule = quality_rules._prune(by(("symbols", True, 0.1), ("noise", True, 5.0)), _rows(100))
    assert rule == by(("symbols", True, 0.1))


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None)], [(None, 0)]])
def test_without_examples_there_are_no_rules(spark, odd, labels):
    assert quality_rules.learned(odd, spark.createDataFrame(labels, "doc_id long, quality int")) == []


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (8, 0), (8, 1), (9, 0)], "doc_id long, quality int")
    named = odd.withColumnRenamed("lang", "n_words").withColumnRenamed("source", "_at")
    found = quality_rules.judged(named, labels).collect()
    assert len(found) == 13 and all(isinstance(r["n_words"], int) for r in found)
    assert {r["kept"] for r in found if not (r["text"] or "").strip()} == {False}
    assert quality_rules.judged(empty, labels).count() == 0


def test_main_path_has_no_python(spark, sf):
    plan = quality_rules.judged(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).filter("kept")
    text = plan.select(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
