"""What one task holds does not grow with the tables."""

from __future__ import annotations

import pyarrow as pa
import pytest

from driftmeter.operators import snapshots
from driftmeter.testbed import trees, views


def test_partitions_follow_the_splits_of_a_scan(spark, tmp_path):
    spark.range(1000).repartition(40).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        scan = spark.read.parquet(str(tmp_path / "t"))
        assert views.parts_of(scan) == 8 * scan.rdd.getNumPartitions() > 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_arriving_files_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "FILE_ROWS", 100)
    assert trees.write_in_files(spark.range(900), str(tmp_path / "many"), 2) == 5
    assert len(spark.read.parquet(str(tmp_path / "many")).inputFiles()) == 10
    assert trees.write_in_files(spark.range(200), str(tmp_path / "two"), 2) == 1


def test_versions_of_short_lines_move_once(spark):
    rows = spark.createDataFrame([("r", "l", p, "p", "v", False) for p in (1, 2)], "repo string, line string, place long, path string, content_hash string, is_deleted boolean")
    ends = spark.createDataFrame([("r", "l", 2)], "repo string, line string, _length long")
    found = snapshots._placed_versions(rows, ends)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted((r.first_place, r.last_place, r.old_hash) for r in found.collect()) == [(1, 1, None), (2, 2, "v")]


def test_coded_texts_are_sent_on_some_at_a_time(monkeypatch):
    byte_bpe = pytest.importorskip("driftmeter.llm.byte_bpe")
    coder = byte_bpe.Encoder({bytes([b]): b for b in range(256)}, ".")
    monkeypatch.setattr(byte_bpe, "encoder", lambda *_: coder)
    monkeypatch.setattr(byte_bpe, "TOGETHER", 2)
    parts = list(byte_bpe._coded(iter([pa.array(["a", None, "bc", "", "d"])]), "", "", lambda c, n, ids: (n, ids), ["n", "ids"], [pa.int64(), pa.string()]))
    assert [len(p) for p in parts] == [2, 2, 1]
    assert pa.concat_arrays(parts).field("n").to_pylist() == [1, 0, 2, 0, 1]
