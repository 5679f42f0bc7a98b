"""Orders, lines and snapshots on random commit graphs with merges, against walks over the graph."""

from __future__ import annotations

import random

import pytest

from driftmeter.operators import ancestry, history, scope, snapshots


def graph(seed, n=45, skew=True):
    """Commits of two repositories: (repo, hash, seconds, parents); branches, merges, roots and unknown parents."""
    draw = random.Random(seed)
    commits = []
    for repo, count in (("a", n), ("b", 6)):
        names = []
        for i in range(count):
            name = f"{draw.randrange(16**4):04x}{i}"
            parents = [] if not names or draw.random() < 0.04 else [draw.choice(names[-4:])]
            if parents and draw.random() < 0.25:
                parents += [p for p in draw.sample(names, min(2, len(names))) if p not in parents]
            if draw.random() < 0.05:
                parents = [*parents, "missing"]
            commits.append((repo, name, i * 100 + (draw.choice([0, 0, 0, 5000, -2500]) if skew else 0), parents))
            names.append(name)
    return commits


def frame(spark, commits):
    rows = spark.createDataFrame(commits, "repo string, commit_hash string, s int, parents array<string>")
    return rows.selectExpr("repo", "commit_hash", "timestamp'2021-01-01' + make_interval(0, 0, 0, 0, 0, 0, s) as ts", "parents")


def settled(commits):
    at = {}
    for repo, name, s, parents in commits:  # parents come first
        at[repo, name] = max([s * 10**6, *(at[repo, p] + 1 for p in parents if (repo, p) in at)])
    return at


@pytest.mark.parametrize("seed", [1, 2])
def test_no_commit_before_its_parent(spark, seed):
    commits = graph(seed)
    shuffled = random.Random(seed).sample(commits, len(commits))
    table = frame(spark, shuffled)
    at = settled(commits)
    found = ancestry.settle(table).selectExpr("repo", "commit_hash", "unix_micros(settled) - unix_micros(timestamp'2021-01-01') as m").collect()
    assert {(r.repo, r.commit_hash): r.m for r in found} == at
    order = {(r.repo, r.commit_hash): r.commit_seq for r in history.commits_chronological(table).collect()}
    expected = {}
    for repo in ("a", "b"):
        for i, key in enumerate(sorted((k for k in at if k[0] == repo), key=lambda k: (at[k], k[1])), 1):
            expected[key] = i
    assert order == expected
    assert all(order[repo, p] < order[repo, name] for repo, name, _, parents in commits for p in parents if (repo, p) in order)
    assert {(r.repo, r.commit_hash) for r in history.head_commit(table).collect()} == {k for k in at if order[k] == sum(x[0] == k[0] for x in at)}
    start = commits[20][1]
    since = {r.commit_hash for r in scope.commits_since(table, start).collect()}
    assert since == {k[1] for k in at if k[0] == "a" and order[k] >= order["a", start]}


def test_lines_nest_by_logarithm(spark):
    commits = graph(4, 60)
    rows = {(r.repo, r.commit_hash): r for r in ancestry.lines(frame(spark, commits)).collect()}
    assert len(rows) == len(commits)
    first = {(repo, name): parents[0] if parents and (repo, parents[0]) in rows else None for repo, name, _, parents in commits}
    for (repo, name), r in rows.items():
        parent = first[repo, name]
        if r.place == 1:
            assert r.line == name and r.fork == parent and r.depth == (rows[repo, parent].depth + 1 if parent else 0)
        else:
            above = rows[repo, parent]
            assert (above.line, above.place, above.fork) == (r.line, r.place - 1, r.fork)
        assert 2**r.depth <= len(commits)


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (3, 2)])
def test_snapshots_and_changes_on_branches(spark, monkeypatch, seed, block):
    monkeypatch.setattr(snapshots, "BLOCK", block)
    draw, commits = random.Random(seed), graph(seed, 40)
    changes, trees, differ = [], {}, set()
    for repo, name, _, parents in commits:
        old = trees.get((repo, parents[0]), {}) if parents else {}
        tree = dict(old)
        for path in draw.sample(["x", "y", "d/z", "d/e/w", "hot"], draw.randint(0, 3)):
            version, gone = f"v{draw.randint(0, 2)}", draw.random() < 0.25
            changes.append((repo, name, path, version, gone))
            tree.pop(path, None)
            if not gone:
                tree[path] = version
        trees[repo, name] = tree
        if not parents or (repo, parents[0]) not in trees:
            differ |= {(repo, name, p.split("/")[0], "root") for p in tree}
        else:
            for p in old.keys() | tree.keys():
                if old.get(p) != tree.get(p):
                    differ.add((repo, name, p, "added" if p not in old else "deleted" if p not in tree else "modified"))
    log = spark.createDataFrame(changes, "repo string, commit_hash string, path string, content_hash string, is_deleted boolean")
    table = frame(spark, commits)
    found = [tuple(r) for r in snapshots.snapshot_at_commit(log, table).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(*key, p, v) for key, tree in trees.items() for p, v in tree.items()}
    rows = [tuple(r) for r in snapshots.changed_in_log(log, table).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == differ


def test_empty(spark):
    none = frame(spark, graph(1)).limit(0)
    assert ancestry.settle(none).count() == 0 and ancestry.lines(none).count() == 0
