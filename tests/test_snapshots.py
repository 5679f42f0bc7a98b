from __future__ import annotations

import random

import pytest

from driftmeter.operators import diff, history, maintenance, skew, snapshots


@pytest.fixture
def log(spark):
    """Two linear histories with random changes and deletions."""
    rng = random.Random(9)
    changes, commits = [], []
    for repo, n in (("a", 40), ("b", 7)):
        for i in range(n):
            commits.append((repo, f"{repo}{i:02d}", i, [f"{repo}{i - 1:02d}"] if i else []))
            for path in rng.sample(["x", "y", "d/z", "d/w", "hot"], rng.randint(0, 3)) + (["busy"] if i % 2 else []):
                changes.append((repo, f"{repo}{i:02d}", path, f"v{rng.randint(0, 2)}", rng.random() < 0.25))
    change_frame = spark.createDataFrame(
        changes, "repo string, commit_hash string, path string, content_hash string, is_deleted boolean"
    )
    commit_frame = spark.createDataFrame(commits, "repo string, commit_hash string, i int, parents array<string>").selectExpr(
        "repo", "commit_hash", "timestamp'2021-01-01' + i * interval 5 day as ts", "parents"
    )
    return changes, commits, change_frame, commit_frame


def replay(changes, commits):
    found = set()
    for repo in ("a", "b"):
        tree = {}
        for _, commit, _, _ in (c for c in commits if c[0] == repo):
            for _, _, path, version, gone in (c for c in changes if c[1] == commit):
                tree.pop(path, None)
                if not gone:
                    tree[path] = version
            found |= {(repo, commit, path, version) for path, version in tree.items()}
    return found


@pytest.mark.parametrize("block", [3, 1024])
def test_snapshots_match_a_replay(log, monkeypatch, block):
    changes, commits, change_frame, commit_frame = log
    monkeypatch.setattr(snapshots, "BLOCK", block)
    rows = [tuple(r) for r in snapshots.snapshot_at_commit(change_frame, commit_frame).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == replay(changes, commits)


def test_changed_files(spark, log):
    changes, commits, _, commit_frame = log
    trees = replay(changes, commits)
    manifests = spark.createDataFrame(sorted(trees), "repo string, commit_hash string, path string, content_hash string")
    # a second child of the same parent, with the tree of an unrelated commit
    extra = spark.createDataFrame([("a", "a05x", ["a05"])], "repo string, commit_hash string, parents array<string>")
    moved = manifests.where("commit_hash = 'a20'").selectExpr("repo", "'a05x' as commit_hash", "path", "content_hash")
    links = commit_frame.select("repo", "commit_hash", "parents").unionByName(extra)
    found = {tuple(r) for r in snapshots.changed_files(manifests.unionByName(moved), links).collect()}

    by_commit = {}
    for repo, commit, path, version in trees:
        by_commit.setdefault((repo, commit), {})[path] = version
    by_commit["a", "a05x"] = by_commit.get(("a", "a20"), {})
    expected = set()
    for repo, commit, parents in [(c[0], c[1], c[3]) for c in commits] + [("a", "a05x", ["a05"])]:
        new = by_commit.get((repo, commit), {})
        if not parents:
            expected |= {(repo, commit, path.split("/")[0], "root") for path in new}
            continue
        old = by_commit.get((repo, parents[0]), {})
        for path in old.keys() | new.keys():
            if path not in old:
                expected.add((repo, commit, path, "added"))
            elif path not in new:
                expected.add((repo, commit, path, "deleted"))
            elif old[path] != new[path]:
                expected.add((repo, commit, path, "modified"))
    assert found == expected


def test_attach(spark):
    rows = [("h", i) for i in range(50)] + [(k, i) for k in "abc" for i in range(3)] + [("unmatched", 0), (None, 0)]
    frame = spark.createDataFrame(rows, "k string, i int")
    stats = spark.createDataFrame([("h", None), ("a", 1.5), ("b", 2.5), ("c", 3.5), ("idle", 9.0), (None, 1.0)], "k string, v double")
    expected = sorted((k, i, dict(h=None, a=1.5, b=2.5, c=3.5)[k]) for k, i in rows if k not in ("unmatched", None))
    found = skew.attach(frame, stats, ["k"])
    assert found.columns == ["k", "i", "v"]
    assert sorted(map(tuple, found.collect()), key=lambda t: t[:2]) == sorted(expected, key=lambda t: t[:2])


def test_delta_contributors(make_files, make_history):
    before = make_files({"mi": 100.0, "path": "a"}, {"mi": 0.0, "path": "b"}, commit_hash="h000")
    after = make_files({"mi": 0.0, "path": "a"}, {"mi": 100.0, "path": "b"}, {"mi": 50.0, "path": "n"}, commit_hash="h001")
    numbered = history.number_commits(make_history(1.0, 1.0))
    rows = diff.delta_contributors(before.unionByName(after), numbered).orderBy("rank").collect()
    assert [(r.commit_hash, r.path, r.old_badness, r.delta) for r in rows] == [("h001", "a", 0.0, 1.0), ("h001", "n", 0.0, 0.5)]


def test_maintenance(spark):
    remotes = spark.createDataFrame(
        [("https://h/o/r.git",), ("git@h:o/r",), ("https://h/p/q",)], "remote_url string"
    )
    named = maintenance.name_repos(remotes)
    stored = maintenance.register_repos(named)
    assert [tuple(r) for r in stored.orderBy("repo").collect()] == [("o/r", "git@h:o/r"), ("p/q", "https://h/p/q")]
    assert maintenance.register_repos(named, stored).count() == 0
    listed = maintenance.repo_list(stored, named.where("repo = 'o/r'")).collect()
    assert [(r.repo, r.commit_count) for r in listed] == [("o/r", 2), ("p/q", 0)]
    table = spark.createDataFrame([("a", "1"), ("b", "1")], "repo string, commit_hash string")
    assert [r.repo for r in maintenance.clear_history(table, "a").collect()] == ["b"]
    assert maintenance.new_commits(table, table.where("repo = 'a'")).collect()[0].repo == "b"
    differing = spark.createDataFrame([("a", "1", 5), ("a", "1", 3)], "repo string, commit_hash string, v int")
    assert maintenance.insert_if_absent(differing, table.where("repo = 'b'"), ["repo", "commit_hash"]).first().v == 3
    doubled = table.unionByName(table)
    assert maintenance.insert_if_absent(doubled, table.where("repo = 'a'"), ["repo", "commit_hash"]).count() == 1
