from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from driftmeter.operators import history, rollup, scoring
from driftmeter.plans import compare, report, scan
from driftmeter.sources import function_csv, snapshot_json, source_tree, tables
from driftmeter.streaming.incremental import IncrementalScan


def write(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as stream:
        stream.write(text)


def test_function_csv(spark, tmp_path):
    write(tmp_path, "f.csv", '10,3,1,0,10,"f@1, x",/root/a/src/A.cs,f,"f(int a, int b)",1,10\n'
          '9,7,1,0,9,loc,/root/a/src/A.cs,g\nbroken line\n5,x,1,0,5,loc,/root/a/b.cs\n1,2,3,4,5,6\n\n4,21,1,1,1,l,/else/c.cs\n')
    rows = function_csv.read_functions(spark, str(tmp_path / "f.csv"), "/root/a/").orderBy("ccn").collect()
    assert [(r.path, r.ccn, r.nloc) for r in rows] == [("src/A.cs", 3.0, 10), ("src/A.cs", 7.0, 9), ("/else/c.cs", 21.0, 4)]


def test_scan_tree(spark, tmp_path):
    root = str(tmp_path / "some repo+1")
    write(root, "src/Main.cs", "using A;\r\n// c\r\nclass B {}\r\n")
    write(root, "src/deep/er/x.py", "import os\n# c\nx = 1\n")
    write(root, "tools/run me.sh", "echo\n\n")
    write(root, "bin/skip.cs", "class C {}")
    write(root, "gen/skip.cs", "class D {}")
    functions = spark.createDataFrame([("SRC/main.cs", 12.0)], "path string, ccn double")
    kinds = {"exclude": ["gen"], "utility": ["tools"], "functions": functions}
    rows = {r.path: r for r in source_tree.scan_tree(spark, root, **kinds).collect()}
    assert set(rows) == {"src/Main.cs", "src/deep/er/x.py"}
    main = rows["src/Main.cs"]
    assert (main.sloc, main.coupling, main.cc, main.smells_low, main.language) == (2, 1, 12.0, 1, "CSharp")
    everything = {r.path: r.kind for r in source_tree.scan_tree(spark, root, recognised=False, **kinds).collect()}
    assert everything["tools/run me.sh"] == "Utility" and len(everything) == 3
    assert [r.path for r in source_tree.scan_tree(spark, root, include=["*.SH"], **kinds).collect()] == ["tools/run me.sh"]


def test_manifests_equal_plain_scan(spark):
    rows = [("r", f"c{i % 4}", f"d{i}/{'bin/' if i == 3 else ''}f.{e}", t)
            for i, (e, t) in enumerate([("cs", "using A;\nx"), ("py", "# a\nb"), ("c", ""), ("cs", "x"), ("md", "# a\nb"), ("cs", "using A;\nx")] * 3)]
    files = spark.createDataFrame(rows, "repo string, commit_hash string, path string, content string")
    keyed = files.withColumn("content_hash", F.sha2("content", 256))
    blobs = keyed.select("content_hash", "content").distinct()
    plain = {tuple(r) for r in source_tree.scan_commits(files).collect()}
    assert plain == {tuple(r) for r in source_tree.scan_manifests(keyed.drop("content"), blobs).collect()}
    assert len(plain) == 17


DOCUMENT = {
    "generated": "2024-01-01T00:00:00Z",
    "commitCount": 2,
    "summary": {"entropy": 1.5, "files": 2, "sloc": 30},
    "history": [{"hash": "a", "date": "2024-01-01", "entropy": 1.0, "files": 1, "sloc": 10}, {"hash": "b", "entropy": 1.5}],
    "latestFiles": [
        {"path": "x.cs", "language": "CSharp", "sloc": 10, "cyclomaticComplexity": 2.0, "badness": 0.5, "couplingProxy": 3},
        {"path": "y.cs", "kind": "Utility", "badness": 2},
    ],
}


def test_snapshot_reading(spark, tmp_path):
    write(tmp_path, "a.json", json.dumps(DOCUMENT, indent=2))
    write(tmp_path, "b.json", json.dumps({"commitCount": 1, "summary": None}))
    snapshots = snapshot_json.read_snapshots(spark, str(tmp_path))
    summary = {r.document[-6:]: r for r in snapshot_json.snapshot_summary(snapshots).collect()}
    assert (summary["a.json"].entropy, summary["a.json"].commits, summary["a.json"].has_summary) == (1.5, 2, True)
    assert (summary["b.json"].entropy, summary["b.json"].files, summary["b.json"].has_summary) == (0.0, 0, False)
    past = snapshot_json.snapshot_history(snapshots).orderBy("position").collect()
    assert [(r.commit_hash, r.date, r.total_sloc) for r in past] == [("a", "2024-01-01", 10), ("b", "", 0)]
    files = {r.path: r for r in snapshot_json.snapshot_files(snapshots).collect()}
    assert (files["x.cs"].kind, files["x.cs"].coupling, files["x.cs"].mi) == ("Production", 3.0, 0.0)
    assert (files["y.cs"].kind, files["y.cs"].coupling, files["y.cs"].badness) == ("Utility", 0.0, 2.0)


def test_written_document_is_valid_and_complete(spark, make_files, make_history, tmp_path):
    past = make_history(1.0, 2.0, 1.5).unionByName(make_history(0.5, repo="s"))
    files = make_files({"mi": 10.0, "path": 'a "quoted".cs'}, {"mi": 90.0}, commit_hash="h002").unionByName(
        make_files({"mi": 1.0}, repo="s", commit_hash="h000")
    )
    lines = snapshot_json.snapshot_lines(past, files)
    out = str(tmp_path / "out")
    snapshot_json.write_snapshots(lines, out)
    documents = {}
    for repo in ("r", "s"):
        folder = os.path.join(out, f"repo={repo}")
        parts = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
        documents[repo] = json.loads("".join(open(os.path.join(folder, n)).read() for n in parts))
    r = documents["r"]
    assert (r["commitCount"], [h["hash"] for h in r["history"]]) == (3, ["h000", "h001", "h002"])
    assert r["summary"] == {"entropy": 1.5, "files": 10, "sloc": 100}
    assert {f["path"]: f["badness"] for f in r["latestFiles"]} == {'a "quoted".cs': 1.0, "f1.cs": 0.0}
    assert len(documents["s"]["latestFiles"]) == 1
    entries, listed = snapshot_json.parse_snapshot_lines(lines)
    assert (entries.count(), listed.count()) == (4, 3)
    # the folder reads back line by line, from however many part files
    again = snapshot_json.read_written(spark, out)
    rest = lambda rows: sorted(map(tuple, rows.where("section > 0").select("repo", "section", "line").collect()))
    assert rest(again) == rest(lines)  # the heads carry the time of writing
    heads = {r.repo: (r.commits, r.entropy, r.files, r.sloc) for r in snapshot_json.parse_snapshot_heads(again).collect()}
    assert heads == {"r": (3, 1.5, 10, 100), "s": (1, 0.5, 10, 100)}
    # what was written reads back as snapshots
    text = spark.createDataFrame([(k, json.dumps(v)) for k, v in documents.items()], "repo string, json string")
    parsed = snapshot_json.parse_snapshots(text, "json")
    assert snapshot_json.snapshot_files(parsed).count() == 3


def test_ad_hoc_snapshot(make_files):
    files = make_files({"sloc": 1}, {"sloc": 0})
    lines = snapshot_json.snapshot_of_files(files, "now", F.current_timestamp()).orderBy("section", "position", "name").collect()
    document = json.loads("".join(r.line for r in lines))
    assert document["history"][0]["hash"] == "now" and document["summary"]["files"] == 2


def test_compare_documents(spark):
    def documents(scores, files, sloc):
        content = {
            "commitCount": len(scores),
            "summary": {"entropy": scores[-1], "files": len(files), "sloc": sloc},
            "history": [{"hash": str(i), "entropy": s} for i, s in enumerate(scores)],
            "latestFiles": [{"path": p, "badness": b} for p, b in files.items()],
        }
        return snapshot_json.parse_snapshots(
            spark.createDataFrame([("r", json.dumps(content))], "repo string, json string"), "json"
        )

    old = documents([0.4], {"a": 1.0, "b": 2.0, "gone": 1.0}, 100)
    new = documents([0.4, 0.4, 1.5, 1.6, 1.5], {"a": 1.5, "b": 1.0, "fresh": 3.0}, 150)
    found = compare.compare_documents(old, new)
    assert found["verdict"].collect()[0].verdict == "HeatWave"
    assert {r.path: r.status for r in found["files"].collect()} == {"a": "worsened", "b": "improved", "gone": "removed", "fresh": "new"}
    facts = {r.code: r for r in found["observations"].collect()}
    assert set(facts) == {"entropy_rose", "inner_warming", "grew_and_rose", "files_hotter", "files_cooler"}
    assert (facts["files_hotter"].amount, facts["files_hotter"].example) == (1.0, "a")
    summary = {r.metric: (r.delta, r.direction) for r in found["summary"].collect()}
    assert summary["sloc"] == (50.0, "better") and summary["entropy"][1] == "worse" and summary["files"][1] == "unchanged"
    assert found["current_series"].count() == 5


def test_store(spark, make_files, tmp_path):
    store = tables.MetricsStore(spark, str(tmp_path / "store"))
    files = make_files({"sloc": 3}, {"sloc": 4}).unionByName(make_files({"sloc": 9}, repo="s"))
    commits = spark.sql("select repo, 'c1' commit_hash, timestamp'2020-01-01' ts, array('0') parents from values ('r'),('s') t(repo)")
    metrics = scoring.entropy_by_commit(files)
    for _ in range(2):
        store.add_scan(commits, files, metrics)
    assert [store.read(t).count() for t in ("commits", "file_metrics", "commit_metrics")] == [2, 3, 2]
    store.register(spark.createDataFrame([("r", "u1"), ("r", "u2")], "repo string, remote_url string"))
    store.register(spark.createDataFrame([("r", "u0"), ("s", "u3")], "repo string, remote_url string"))
    assert {tuple(r) for r in store.read("repos").collect()} == {("r", "u1"), ("s", "u3")}
    left = store.clear("r", str(tmp_path / "store2"))
    assert {r.repo for r in left.read("file_metrics").collect()} == {"s"}
    assert left.read("repos").count() == 2 and store.read("file_metrics").count() == 3


def test_report_and_drill_down(spark, make_files, make_history):
    past = make_history(1.0, 2.0)
    files = make_files({"mi": 5.0}, {"kind": "Utility"}, commit_hash="h000").unionByName(
        make_files({"mi": 9.0}, {"cc": 3.0}, {"kind": "Utility", "cc": 9.0}, commit_hash="h001"))
    commits = past.selectExpr("repo", "commit_hash", "ts", "array('0') as parents")
    found = report.report(files, commits, kind="production", prefix="H00")
    counts = {name: frame.count() for name, frame in found.items()}
    assert counts["commits"] == 2 and counts["large"] == 2 and counts["complex"] == 1 and counts["gauges"] == 1
    assert counts["series"] == 10 and counts["files"] == 2
    head = files.where("commit_hash = 'h001'")
    assert {name: frame.count() for name, frame in report.drill_down(head, past).items()}["assessment"] == 1


def test_stream_equals_batch_and_replays(spark, make_files, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    files = [make_files({"sloc": i, "path": "a"}, {"sloc": 5, "path": "b", "cc": 2.0}, commit_hash=f"c{i}") for i in range(4)]
    sink = IncrementalScan(root, lambda batch: batch)

    def run():
        raw = spark.readStream.schema(files[0].schema).parquet(source)
        sink.start(raw, str(tmp_path / "checkpoint")).awaitTermination()

    files[0].unionByName(files[1]).write.parquet(source)
    run()
    # the second delivery repeats a commit that is stored already
    files[1].unionByName(files[2]).write.mode("append").parquet(source)
    run()
    run()
    batch = files[0].unionByName(files[1]).unionByName(files[2])
    expected = {tuple(r) for r in scoring.entropy_by_commit(batch).collect()}
    assert [tuple(r) for r in sink.commit_metrics(spark).collect()].__len__() == 3
    assert {tuple(r) for r in sink.commit_metrics(spark).collect()} == expected
    # a batch that is replayed after a crash replaces itself
    sink.process(files[1].unionByName(files[2]), 1)
    assert {tuple(r) for r in sink.commit_metrics(spark).collect()} == expected
    assert sink.file_metrics(spark).count() == 6


@pytest.mark.parametrize("cuts", [(1, 2), (3,), (1, 4, 7)])
def test_commits_split_over_batches_equal_the_whole(spark, make_files, tmp_path, cuts):
    """10 files of two commits, delivered in pieces that split both; every delivery is repeated once."""
    rows = [{"path": f"f{i}", "sloc": i, "cc": float(i % 4)} for i in range(10)]
    files = make_files(*rows, commit_hash="c1").unionByName(make_files(*rows[:5], commit_hash="c2"))
    everything = sorted(files.collect(), key=lambda r: r.path)
    ends = [0, *(c * len(everything) // 10 for c in cuts), len(everything)]
    sink = IncrementalScan(str(tmp_path / "out"), lambda batch: batch)
    deliveries = [everything[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    for k, part in enumerate([d for d in deliveries for _ in range(2)]):
        sink.process(spark.createDataFrame(part, files.schema), k)
    expected = {tuple(r) for r in scoring.entropy_by_commit(files).withColumn("entropy", F.round("entropy", 9)).collect()}
    assert {tuple(r) for r in sink.commit_metrics(spark).withColumn("entropy", F.round("entropy", 9)).collect()} == expected
    assert sorted(map(tuple, sink.file_metrics(spark).select(*files.columns).collect())) == sorted(map(tuple, everything))
    sink.process(spark.createDataFrame(deliveries[-1], files.schema), 2 * len(deliveries) - 1)
    assert {tuple(r) for r in sink.commit_metrics(spark).withColumn("entropy", F.round("entropy", 9)).collect()} == expected


def test_document_of_many_parts_reads_back(spark, make_files, make_history, tmp_path):
    files = make_files(*[{"path": f"f{i:04d}", "sloc": i} for i in range(1500)], commit_hash="h002")
    lines = snapshot_json.snapshot_lines(make_history(1.0, 2.0, 1.5), files)
    out = str(tmp_path / "many")
    lines.repartition(9).select("repo", "line").write.partitionBy("repo").text(out)
    assert len([n for n in os.listdir(os.path.join(out, "repo=r")) if n.startswith("part-")]) > 1
    entries, listed = snapshot_json.parse_snapshot_lines(snapshot_json.read_written(spark, out))
    assert (entries.count(), listed.count(), listed.selectExpr("sum(sloc)").first()[0]) == (3, 1500, sum(range(1500)))


def test_tree_in_any_encoding(spark, tmp_path):
    (tmp_path / "latin.cs").write_bytes("using A;\nint größe;\n".encode("latin-1"))
    (tmp_path / "binary.py").write_bytes(bytes(range(256)) + b"\nx = 1\n")
    found = {r.path: r for r in source_tree.scan_tree(spark, str(tmp_path)).collect()}
    assert set(found) == {"latin.cs", "binary.py"}
    assert (found["latin.cs"].sloc, found["latin.cs"].coupling) == (2, 1) and found["binary.py"].sloc >= 2


def test_manifest_entries_without_blob_stay(spark):
    manifests = spark.createDataFrame(
        [("r", "c", "a.cs", "h1"), ("r", "c", "b.cs", "gone"), ("r", "c", "c.cs", None)], "repo string, commit_hash string, path string, content_hash string"
    )
    blobs = spark.createDataFrame([("h1", "using A;\nx"), ("other", "y")], "content_hash string, content string")
    found = {r.path: (r.sloc, r.coupling) for r in source_tree.scan_manifests(manifests, blobs).collect()}
    assert found == {"a.cs": (2, 1), "b.cs": (0, 0), "c.cs": (0, 0)}


def test_appends_open_only_their_buckets(spark, make_files, tmp_path):
    store = tables.MetricsStore(spark, str(tmp_path / "store"))
    for repo in ("r", "s"):
        store.append("file_metrics", make_files({}, {}, repo=repo))
    plan = store.stored_beside("file_metrics", make_files({}, repo="r"))
    assert {r.repo for r in plan.collect()} == {"r"}
    assert "repo_bucket" in plan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    store.append("file_metrics", make_files({}, {"path": "new"}, repo="r"))
    assert store.read("file_metrics").count() == 5


def test_a_broken_store_is_an_error(spark, tmp_path):
    (tmp_path / "commits").mkdir()
    (tmp_path / "commits" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        tables.MetricsStore(spark, str(tmp_path)).read("commits").count()


def test_scan_history_adds_only_new_commits(spark, tmp_path):
    rows = [("r", c, p, t) for c in ("c1", "c2") for p, t in (("a.cs", "using A;\nx"), ("b.py", "# c\ny\nz"), ("obj/c.cs", "q"))]
    texts = spark.createDataFrame(rows, "repo string, commit_hash string, path string, content string")
    commits = spark.sql(
        "select 'r' repo, c commit_hash, timestamp'2020-01-01' ts, array('0') parents from values ('c1'),('c2'),('empty') t(c)"
    )
    store = tables.MetricsStore(spark, str(tmp_path / "store"))
    for extent in ("commit_hash = 'c1'", "true", "true"):
        scan.scan_history(store, commits.where(extent), texts)
    metrics = {r.commit_hash: r for r in store.read("commit_metrics").collect()}
    assert set(metrics) == {"c1", "c2", "empty"}
    assert (metrics["c2"].total_files, metrics["c2"].total_sloc, metrics["empty"].entropy) == (2, 4, 0.0)
    assert store.read("file_metrics").count() == 4 and store.read("commits").count() == 3
    overview = scan.scan_overview(store.read("file_metrics"))
    assert {name: frame.count() for name, frame in overview.items()}["languages"] == 4
