"""The stream's tables against scores of the whole, whatever way the rows arrive."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from driftmeter.operators import rollup, scoring
from driftmeter.streaming import incremental, runs

RAW = "repo string, commit_hash string, path string, ccn double, nloc int"


def to_files(rows):
    """Functions to files; lines are summed, so a function that is lost or counted twice shows."""
    rolled = rows.groupBy("repo", "commit_hash", "path").agg(
        F.avg("ccn").alias("cc"), F.sum("nloc").cast("long").alias("sloc"), F.count_if(F.col("ccn") > 20).alias("smells_high")
    )
    zero = F.lit(0).cast("long")
    full = rolled.withColumn("smells_medium", zero).withColumn("smells_low", zero).withColumn("coupling", F.col("sloc") % 7).withColumn("language", F.lit("C"))
    return rollup.add_maintainability(full).withColumn("kind", F.lit("Production"))


def _scores(metrics):
    return {(r.repo, r.commit_hash, r.total_files, r.total_sloc, round(r.entropy, 9)) for r in metrics.collect()}


def _rows(seed, n=240):
    draw = random.Random(seed)
    return [(draw.choice("ab"), draw.choice(["c1", "c2", "c3"]), f"f{draw.randrange(12)}", float(draw.randrange(30)), draw.randrange(5)) for _ in range(n)]


def test_cover():
    for n in range(600):
        found = runs.cover(n, 4)
        held = [b for level, run in found for b in range(run * 4**level, (run + 1) * 4**level)]
        assert held == list(range(n)) and len(found) <= 3 * 5


def test_equal_rows_count_each_and_redelivered_files_do_not(spark, tmp_path):
    """Two equal functions in one file, two in two files; then the first file is delivered again."""
    rows = [("r", "c", "a", 5.0, 3), ("r", "c", "a", 5.0, 3), ("r", "c", "b", 9.0, 40)]
    table = spark.createDataFrame(rows, RAW)
    (tmp_path / "in").mkdir()
    table.coalesce(1).write.parquet(str(tmp_path / "in" / "one"))
    table.where("path = 'a'").limit(1).coalesce(1).write.parquet(str(tmp_path / "in" / "two"))
    sink = incremental.IncrementalScan(str(tmp_path / "out"), to_files, identity=incremental.IDENTITY)
    read = lambda name: spark.read.parquet(str(tmp_path / "in" / name)).select("*", F.col("_metadata.file_path").alias(incremental.ORIGIN), F.col("_metadata.row_index").alias(incremental.PLACE))
    for k, name in enumerate(("one", "two", "one")):
        sink.process(read(name), k)
    expected = _scores(scoring.entropy_by_commit(to_files(table.unionByName(table.where("path = 'a'").limit(1)))))
    assert _scores(sink.commit_metrics(spark)) == expected
    assert {r.path: r.sloc for r in sink.file_metrics(spark).collect()} == {"a": 9, "b": 40}


@pytest.mark.parametrize("seed", [1])
def test_any_order_of_any_pieces(spark, tmp_path, seed):
    """Five batches with runs merged by twos; each commit is split over them, and after each batch the stream equals
    the whole of what has arrived."""
    rows = [(*r, i) for i, r in enumerate(_rows(seed))]
    random.Random(seed).shuffle(rows)
    schema = RAW + ", id int"
    sink = incremental.IncrementalScan(str(tmp_path / "out"), to_files, identity=["id"], fan=2, buckets=4)
    for k in range(5):
        part = rows[k * 40 : (k + 1) * 40] if k < 4 else rows[:15]
        sink.process(spark.createDataFrame(part, schema), k)
        if k in (0, 3, 4):
            arrived = spark.createDataFrame(rows[: min(k + 1, 4) * 40], schema).drop("id")
            assert _scores(sink.commit_metrics(spark)) == _scores(scoring.entropy_by_commit(to_files(arrived)))
    # a batch that is replayed replaces itself
    sink.process(spark.createDataFrame(rows[:15], schema), 4)
    assert _scores(sink.commit_metrics(spark)) == _scores(scoring.entropy_by_commit(to_files(arrived)))


def test_only_moved_ranges_score_a_commit_again(spark, tmp_path):
    """A file within all ranges adds its terms; one beyond them, and one that leaves the edge, rescore."""
    def file(path, sloc, cc=1.0):
        return ("r", "c", path, "C", sloc, cc, 50.0, 0, 0, 0, sloc, "Production")

    schema = "repo string, commit_hash string, path string, language string, sloc long, cc double, mi double, smells_high long, smells_medium long, smells_low long, coupling long, kind string"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    first = frame(file("a", 1), file("b", 9, 3.0), file("m", 5))
    state = scoring.state_of(first)
    none = frame(file("x", 1)).limit(0)
    judged = lambda old, new: scoring.state_judged(state, old, new).first().rescored
    assert not judged(none, frame(file("n", 4, 2.0))) and judged(none, frame(file("n", 10)))
    assert not judged(frame(file("m", 5)), frame(file("m", 6))) and judged(frame(file("b", 9, 3.0)), frame(file("b", 8, 3.0)))
    moved = scoring.state_moved(scoring.state_judged(state, frame(file("m", 5)), frame(file("m", 6))), frame(file("m", 5)), frame(file("m", 6)))
    whole = scoring.entropy_by_commit(frame(file("a", 1), file("b", 9, 3.0), file("m", 6)))
    assert _scores(scoring.entropy_of_state(moved)) == _scores(whole)


def test_files_through_the_stream(spark, tmp_path):
    table = spark.createDataFrame(_rows(5, 90), RAW)
    table.repartition(2).write.parquet(str(tmp_path / "in"))
    sink = incremental.IncrementalScan(str(tmp_path / "out"), to_files, identity=incremental.IDENTITY, buckets=4)
    for _ in range(2):  # the second run finds nothing new
        sink.start(incremental.read_rows(spark, str(tmp_path / "in"), table.schema, 1), str(tmp_path / "checkpoint")).awaitTermination()
    assert _scores(sink.commit_metrics(spark)) == _scores(scoring.entropy_by_commit(to_files(table)))
