from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from driftmeter.operators import ranking, rollup, scoring


def badness(files, **limits):
    return {r.path: r.badness for r in scoring.badness_by_file(files, **limits).collect()}


def entropy(files, **limits):
    rows = scoring.entropy_by_commit(files, **limits).collect()
    return rows[0].entropy if rows else 0.0


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([{"sloc": 100, "cc": 5.0}], [1]),
        ([{"cc": 10.0}, {"cc": 2.0}], [2, 1]),
        ([{"mi": 80.0}, {"mi": 20.0}], [0, 1]),
        ([{"sloc": 0}, {"sloc": 1}], [1, 2]),
        ([{"smells_high": 1, "smells_medium": 1, "smells_low": 1}, {"smells_low": 1}], [2, 1]),
        ([{"coupling": 5}, {"coupling": 0}], [2, 1]),
    ],
)
def test_badness_cases(make_files, rows, expected):
    found = badness(make_files(*rows))
    assert [found[f"f{i}.cs"] for i in range(len(rows))] == pytest.approx(expected, abs=1e-12)


def test_entropy_cases(make_files, spark):
    same = {"sloc": 50, "cc": 3.0, "mi": 70.0}
    assert entropy(make_files(same)) == 0
    assert entropy(make_files(same, same)) == pytest.approx(1.0, abs=1e-10)
    assert entropy(make_files(same, same, same, same)) == pytest.approx(1.0, abs=1e-10)
    assert entropy(make_files({"mi": 100.0}, {"mi": 0.0})) == 0
    assert entropy(make_files({"sloc": 1}, {"sloc": 0})) == pytest.approx((math.log2(3) - 2 / 3) * 1.5, abs=1e-10)


def test_commit_without_files_scores_zero(make_files, spark):
    commits = spark.createDataFrame([("r", "c1"), ("r", "empty")], "repo string, commit_hash string")
    rows = {r.commit_hash: r for r in scoring.entropy_by_commit(make_files({}, {}), commits=commits).collect()}
    assert (rows["empty"].entropy, rows["empty"].total_files, rows["empty"].total_sloc) == (0.0, 0, 0)
    assert rows["c1"].total_files == 2


def refactor(files, focus):
    return [r.score for r in scoring.refactor_scores(files, focus).orderBy("path").collect()]


def test_refactor_focus(make_files):
    files = make_files({"sloc": 500, "cc": 20.0}, {"sloc": 10, "cc": 1.0})
    assert refactor(files, "sloc,cc") == [1.0, 0.0]
    overall = list(badness(files).values())
    assert sorted(refactor(files, "speed")) == sorted(overall) == sorted(refactor(files, "")) == sorted(refactor(files, "CC, Overall"))
    assert refactor(make_files({"sloc": 5, "cc": 9.0}, {"sloc": 5}), "sloc") == [0.0, 0.0]
    assert refactor(make_files({"mi": 90.0}, {"mi": 10.0}), "mi") == [0.0, 1.0]


def random_files(make_files, seed, n=60, commit_hash="c1"):
    rng = random.Random(seed)
    return make_files(
        *[
            {
                "sloc": rng.randint(0, 900), "cc": rng.uniform(0, 40), "mi": rng.uniform(0, 100),
                "smells_high": rng.randint(0, 3), "smells_medium": rng.randint(0, 3),
                "smells_low": rng.randint(0, 3), "coupling": rng.randint(0, 20),
                "kind": rng.choice(["Production", "Utility"]),
            }
            for _ in range(n)
        ],
        commit_hash=commit_hash,
    )


def brute_force(rows):
    """Sequential scoring of one commit."""
    feature = [
        [math.log(1 + r.sloc) for r in rows], [r.cc for r in rows],
        [3 * r.smells_high + 2 * r.smells_medium + r.smells_low for r in rows],
        [r.coupling for r in rows], [r.mi for r in rows],
    ]

    def scale(v):
        low, high = min(v), max(v)
        return [0.0] * len(v) if low == high else [(x - low) / (high - low) for x in v]

    l, c, s, u, m = map(scale, feature)
    b = [a + d + e + f + 1 - g for a, d, e, f, g in zip(l, c, s, u, m)]
    active = [x for x in b if x > 1e-9]
    total = sum(active)
    h = -sum(x / total * math.log2(x / total) for x in active)
    return b, h, max(0.0, h / math.log2(len(active)) * total / len(active))


def test_against_brute_force(make_files):
    files = random_files(make_files, 1)
    rows = files.collect()
    expected, h, score = brute_force(rows)
    found = badness(files)
    assert [found[r.path] for r in rows] == pytest.approx(expected, abs=1e-10)
    assert entropy(files) == pytest.approx(score, abs=1e-10)
    assert entropy(files.repartition(7).orderBy("sloc")) == pytest.approx(score, abs=1e-10)
    spread = scoring.diffusion_contributions(files).collect()
    assert sum(r.diffusion for r in spread) == pytest.approx(h, abs=1e-10)
    assert 0 <= score / (sum(expected) / len(expected)) <= 1 + 1e-9


SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    "spark.sql.shuffle.partitions": "40",
}


@pytest.mark.parametrize("score", [scoring.badness_by_file, scoring.diffusion_contributions])
def test_hot_commits_take_more_than_one_task(spark, score):
    """95 % of all files in three commits; the planner splits each of them."""
    commits = "case when id % 20 = 0 then concat('c', id % 200) else concat('hot', id % 3) end"
    files = spark.range(0, 60_000, 1, 12).selectExpr(
        "'r' as repo", f"{commits} as commit_hash", "concat('f', id) as path", "'C' as language", "id % 97 as sloc", "cast(id % 13 as double) as cc",
        "cast(id % 100 as double) as mi", "id % 3 as smells_high", "id % 5 as smells_medium", "id % 7 as smells_low", "id % 11 as coupling", "'Production' as kind",
    )
    kept = {k: spark.conf.get(k) for k in SPLIT}
    plain = {(r.commit_hash, r.path): r.badness for r in score(files).collect()}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    try:
        rows = score(files).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    tasks = {}
    for r in rows:
        tasks.setdefault(r.commit_hash, set()).add(r.task)
    assert all(len(tasks[f"hot{k}"]) > 1 for k in range(3))
    assert {(r.commit_hash, r.path): pytest.approx(r.badness, abs=1e-12) for r in rows} == plain


def test_kinds_are_scored_apart(make_files):
    files = random_files(make_files, 5)
    by_kind = {r.kind: r.entropy for r in scoring.entropy_by_commit_kind(files).collect()}
    for kind in ("Production", "Utility"):
        assert by_kind[kind] == pytest.approx(entropy(files.where(f"kind = '{kind}'")), abs=1e-12)


def test_heat_and_top_lists(make_files):
    files = make_files({"mi": 100.0}, {"cc": 4.0}, {"cc": 8.0, "smells_high": 1})
    heat = scoring.heat_rank(files).collect()
    assert [r.path for r in heat] == ["f2.cs", "f1.cs", "f0.cs"]
    assert heat[0].heat == 1.0 and heat[0].bar == 10
    assert [r.path for r in ranking.top_complex_files(files, 1).collect()] == ["f2.cs"]
    assert ranking.top_smelly_files(files).count() == 1
    assert ranking.top_coupled_files(files).count() == 0
    flat = make_files({"mi": 100.0}, {"mi": 0.0})
    assert [r.bar for r in scoring.heat_rank(flat).collect()] == [10, 0]


def test_scan_chart_measure(make_files):
    by_cc = ranking.top_scan_chart(make_files({"sloc": 900}, {"cc": 1.25})).collect()
    assert [(r.path, r.measure, r.value) for r in by_cc] == [("f1.cs", "cc", 1.2)]
    by_sloc = ranking.top_scan_chart(make_files({"sloc": 9}, {"sloc": 70}, {})).orderBy("rank").collect()
    assert [(r.path, r.measure, r.value) for r in by_sloc] == [("f1.cs", "sloc", 70.0), ("f0.cs", "sloc", 9.0)]


def test_function_rollup(spark):
    rows = [("r", "c", "a.c", v) for v in (3.0, 7.0)] + [("r", "c", p, v) for p, v in zip("hmln", (21.0, 18.0, 12.0, 5.0))]
    functions = spark.createDataFrame(rows, "repo string, commit_hash string, path string, ccn double")
    found = {r.path_key: r for r in rollup.function_rollup(functions).collect()}
    assert found["a.c"].cc == 5.0
    bands = {k: (found[k].smells_high, found[k].smells_medium, found[k].smells_low) for k in "hmln"}
    assert bands == {"h": (1, 0, 0), "m": (0, 1, 0), "l": (0, 0, 1), "n": (0, 0, 0)}


def test_attached_rollup_ignores_case(spark):
    files = spark.createDataFrame([("r", "c", "src/Main.cs"), ("r", "c", "b")], "repo string, commit_hash string, path string")
    functions = spark.createDataFrame([("r", "c", "SRC/main.cs", 11.0), ("r", "c", "src/Main.cs", 4.0)], "repo string, commit_hash string, path string, ccn double")
    found = {r.path: r for r in rollup.attach_function_metrics(files, rollup.function_rollup(functions)).collect()}
    assert (found["src/Main.cs"].cc, found["src/Main.cs"].smells_low) == (7.5, 1)
    assert (found["b"].cc, found["b"].smells_low) == (0.0, 0)


def test_languages_share(make_files):
    files = make_files({"sloc": 30}, {"sloc": 10, "language": "C"}, {"sloc": 99, "language": ""}, commit_hash="x")
    assert [(r.language, r.share) for r in rollup.sloc_by_language(files).collect()] == [("CSharp", 75.0), ("C", 25.0)]
