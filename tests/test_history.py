from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from driftmeter.operators import diff, history
from driftmeter.plans import compare


def test_deltas(make_history):
    assert [r.delta for r in history.commit_deltas(make_history(1.0)).collect()] == [0.0]
    rows = history.commit_deltas(make_history(1.0, 1.5, sloc=[10, 30], files=[4, 1])).orderBy("commit_seq").collect()
    assert (rows[1].delta, rows[1].relative_delta, rows[1].sloc_delta, rows[1].files_delta) == (0.5, 0.5, 20, -3)
    assert history.commit_deltas(make_history(2.0, 1.0)).orderBy("commit_seq").collect()[1].delta == -1.0
    assert history.commit_deltas(make_history(0.0, 1.0)).orderBy("commit_seq").collect()[1].relative_delta == 0.0


@pytest.mark.parametrize("unit", ["day", "month", "year"])
def test_numbering_and_previous_do_not_depend_on_chunks(make_history, unit):
    scores = [random.Random(3).uniform(0, 3) for _ in range(60)]
    past = make_history(*scores, step="interval 17 hour")
    rows = history.with_previous(past, ["entropy"], unit).orderBy("commit_seq").collect()
    assert [r.commit_seq for r in rows] == list(range(1, 61))
    assert [r.prev_entropy for r in rows] == [None, *[r.entropy for r in rows[:-1]]]
    assert {r.commit_count for r in history.number_commits(past, unit).collect()} == {60}


def test_equal_times_order_by_hash(make_history):
    past = make_history(3.0, 1.0, 2.0, step="interval 0 day")
    rows = history.commit_deltas(past).orderBy("commit_seq").collect()
    assert [r.commit_hash for r in rows] == ["h000", "h001", "h002"]
    assert [r.delta for r in rows] == [0.0, -2.0, 1.0]


def test_outliers(make_history):
    rise = history.troubled_commits(make_history(0.1, 0.1, 0.1, 0.1, 0.1, 5.0, 5.0)).collect()
    assert [r.commit_hash for r in rise] == ["h005"]
    fall = history.heroic_commits(make_history(5.0, 5.0, 5.0, 5.0, 5.0, 0.1, 0.1)).collect()
    assert [r.commit_hash for r in fall] == ["h005"]
    assert history.outlier_commits(make_history(1.0, 1.0, 1.0)).count() == 0
    assert history.outlier_commits(make_history(1.0)).count() == 0


def test_trend(make_history):
    def trend(*scores):
        return history.entropy_trend(make_history(*scores)).collect()[0].trend

    assert trend(1.0, 1.5, 2.0) == pytest.approx(0.5)
    assert trend(2.0, 1.5, 1.0) == pytest.approx(-0.5)
    assert trend(1.0) == 0
    assert history.entropy_trend(make_history().limit(0)).count() == 0


VERDICTS = [
    ([0.5, 0.5, 0.5, 0.5, 2.5], 0.5, "HeatSpike"),
    ([0.4, 0.4, 1.5, 1.6, 1.5], 0.4, "HeatWave"),
    ([2.0, 1.7, 1.4, 1.1, 0.8], 2.0, "ColdFront"),
    ([1.2345, 1.15, 1.05, 0.98, 0.9876], 1.2345, "Cooling"),
    ([1.0, 1.02, 1.04, 1.06, 1.08], 1.0, "Warming"),
    ([1.0, 1.0], 1.0, "Stable"),
    ([1.0], 0.2, "Stable"),
]


@pytest.mark.parametrize("scores, baseline, expected", VERDICTS)
def test_verdicts(spark, make_history, scores, baseline, expected):
    past = make_history(*scores)
    before = spark.createDataFrame([("r", baseline)], "repo string, entropy double")
    assert [r.verdict for r in diff.drift_verdict(before, history.forecast_signals(past)).collect()] == [expected]


def signals(scores, window=3):
    """The detectors on one list."""
    n = len(scores)
    steps = [b - a for a, b in zip(scores, scores[1:])]
    spike = n >= 3 and max(steps) > statistics.fmean(steps) + 1.5 * statistics.pstdev(steps) and max(steps) > 0.05
    wave = cold = False
    if n >= window + 2:
        reference, tail = scores[-window - 1], scores[-window:]
        jump = tail[0] - reference
        wave = all(x > reference + 0.05 for x in tail) and jump > 0.05 and abs(tail[-1] - tail[0]) < jump
    if n >= window + 1:
        cold = sum(s < 0 for s in steps[-window:]) >= 3
    return spike, wave, cold


def test_signals_against_lists(make_history):
    rng = random.Random(11)
    frames, lists = None, {}
    for i in range(12):
        level, scores = 1.0, []
        for _ in range(rng.randint(1, 14)):
            level = max(0.0, level + rng.choice([-0.3, -0.1, 0.0, 0.02, 0.1, 0.6]))
            scores.append(level)
        lists[f"r{i}"] = scores
        frame = make_history(*scores, repo=f"r{i}", step="interval 9 day")
        frames = frame if frames is None else frames.unionByName(frame)
    whole = {r.repo: (r.heat_spike, r.heat_wave, r.cold_front) for r in history.forecast_signals(frames).collect()}
    assert whole == {repo: signals(scores) for repo, scores in lists.items()}
    as_of = {
        (r.repo, r.commit_seq): (r.heat_spike, r.heat_wave, r.cold_front)
        for r in history.forecast_signals_as_of(frames).collect()
    }
    assert as_of == {
        (repo, k): signals(scores[:k]) for repo, scores in lists.items() for k in range(1, len(scores) + 1)
    }


def test_percentile(spark, make_history):
    past = make_history(0.88, 1.00, 1.54)
    now = spark.createDataFrame([("r", "new", 1.20)], "repo string, commit_hash string, entropy double")
    row = history.percentile_position(past, now).collect()[0]
    assert row.percentile == pytest.approx(200 / 3)
    stored = {r.entropy: r.percentile for r in history.percentile_position(make_history(0.88, 1.0, 1.2, 1.54)).collect()}
    assert stored[1.2] == 75.0
    assert (row.entropy_min, row.entropy_max, row.history_count) == (0.88, 1.54, 3)
    assert row.position == "above its historical average"
    assert history.percentile_position(make_history(1.0, 2.0)).count() == 0


def test_percentile_with_many_equal_scores(make_history):
    scores = [0.0] * 30 + [0.5] * 10 + [random.Random(5).uniform(0, 3) for _ in range(20)]
    rows = history.percentile_position(make_history(*scores)).collect()
    assert len(rows) == 60
    for row in rows:
        assert row.percentile == pytest.approx(sum(s <= row.entropy for s in scores) * 100 / 60)


@pytest.mark.parametrize("n, points", [(1, 5), (5, 5), (6, 5), (37, 10), (101, 7), (120, 119), (50, 2)])
def test_downsample(make_history, n, points):
    kept = [r.commit_seq - 1 for r in history.downsample(make_history(*[1.0] * n), points).orderBy("commit_seq").collect()]
    if n <= points:
        assert kept == list(range(n))
    else:
        step = (n - 1) / (points - 1)
        assert kept == [round(i * step) for i in range(points)]


def test_history_join_falls_back_to_the_beginning_of_time(spark):
    metrics = spark.createDataFrame([("a", "1", 1.0), ("a", "2", 2.0), ("b", "3", 3.0)], "repo string, commit_hash string, entropy double")
    commits = spark.sql("select 'a' repo, '1' commit_hash, timestamp'2020-01-01' ts, array('0') parents")
    joined = history.history_join(metrics, commits)
    rows = {r.commit_hash: r.ts.year for r in joined.collect()}
    assert rows == {"1": 2020, "3": 1}
    order = [r.commit_hash for r in history.metrics_chronological(metrics.where("repo = 'a'"), commits).collect()]
    assert order == ["1", "2"]


def test_range_and_levels(make_history):
    row = history.history_range(make_history(1.0, 3.0)).collect()[0]
    assert (row.entropy_min, row.entropy_mean, row.entropy_max) == (1.0, 2.0, 3.0)
    grades = [r.grade for r in history.drift_level(make_history(0.29, 0.3, 0.7, 1.2, 2.0)).orderBy("ts").collect()]
    assert grades == ["Excellent", "Good", "Fair", "Poor", "Critical"]
    bands = [r.band for r in history.entropy_badge(make_history(0.4, 0.5, 1.5)).orderBy("ts").collect()]
    assert bands == ["green", "yellow", "red"]
    trends = [r.trend for r in history.trend_vs_previous(make_history(1.0, 1.01, 1.5, 1.0)).orderBy("ts").collect()]
    assert trends == [None, "stable", "worsening", "improving"]


def test_until_follows_time_not_hashes(spark):
    rows = [("r", h, e, i) for i, (h, e) in enumerate([("f3", 1.0), ("0a", 2.0), ("9c", 3.0), ("1b", 4.0)])]
    past = spark.createDataFrame(rows, "repo string, commit_hash string, entropy double, i int").selectExpr(
        "*", "timestamp'2020-01-01' + i * interval 1 day as ts", "10L as total_files", "100L as total_sloc"
    )
    other = past.where("i < 2").withColumn("repo", F.lit("s"))
    assert [r.commit_hash for r in compare.until(past.unionByName(other), "9c").orderBy("ts").collect()] == ["f3", "0a", "9c"]
    assert [tuple(r) for r in compare.summary_at(past, "9c").collect()] == [("r", 3.0, 10, 100, 3)]


def test_first_commits_have_no_verdict(spark, make_history):
    past = make_history(0.5, 0.5, 0.5, 0.9)
    rows = diff.drift_verdict_as_of(history.forecast_signals_as_of(past), lag=2).orderBy("commit_seq").collect()
    assert [r.baseline_entropy for r in rows] == [None, None, 0.5, 0.5]
    assert [r.verdict is None for r in rows] == [True, True, False, False]
