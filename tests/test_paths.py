from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from driftmeter.functions import fixed, paths
from driftmeter.operators import scope
from driftmeter.sources import patterns


def evaluate(spark, values, column):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, path string")
    return [r.v for r in frame.select("i", column(F.col("path")).alias("v")).orderBy("i").collect()]


def test_ignored_directories(spark):
    inside = ["node_modules/a.js", "src/BIN/a.cs", ".git/config", "a/obj/b/c.cs", "x/.nyc_output/y", "pods/a", "/out/x"]
    outside = ["binaries/a.cs", "builder/x.cs", "bin", "src/bin", "src/build.cs", "agit/x", "x.git/y", "bin.d/e"]
    assert evaluate(spark, inside, paths.in_ignored_directory) == [True] * len(inside)
    assert evaluate(spark, outside, paths.in_ignored_directory) == [False] * len(outside)


GLOBS = [
    ("*", "any/thing.x", True),
    ("*.log", "a/b.LOG", True),
    ("*.log", "a.log/b.txt", True),
    ("*.log", "a.logs", False),
    ("generated", "src/Generated/a.cs", True),
    ("generated", "src/generated2/a.cs", False),
    ("*.min.js", "a/x.min.js", True),
    (".ico", "icon.ico", True),
    ("third_party", "third_party/x", True),
    (".gitignore", ".gitignore", True),
    ("Test*", "src/testfile.cs", True),
    ("Test*", "src/mytest.cs", False),
    ("a*b", "axb", False),
    ("a*b", "x/a*b", True),
    ("**", "x", False),
    ("*a*", "bab", False),
    ("a+b", "A+B/c", True),
    ("a.b", "axb", False),
    ("src/x", "src/x", False),
]


@pytest.mark.parametrize("pattern, path, expected", GLOBS)
def test_globs(spark, pattern, path, expected):
    assert evaluate(spark, [path], lambda p: paths.matches_any_segment(p, [pattern])) == [expected]


def test_globs_from_a_table_agree(spark):
    rows = [(str(i), pattern, path) for i, (pattern, path, _) in enumerate(GLOBS)]
    lists = spark.createDataFrame([(r, p) for r, p, _ in rows], "repo string, content string")
    files = spark.createDataFrame([(r, path) for r, _, path in rows], "repo string, path string")
    for limits in ({},):
        kept = {r.repo for r in scope.drop_excluded_by_repo(files, patterns.regex_by_repo(lists)).collect()}
        assert kept == {str(i) for i, (_, _, hit) in enumerate(GLOBS) if not hit}


def test_include_looks_at_the_name_only(spark):
    names = ["src/A.cs", "a.cs/readme", "TEST1", "x/Main.java"]
    assert evaluate(spark, names, lambda p: paths.matches_file_name(p, ["*.cs", "main.java"])) == [True, False, False, True]
    assert evaluate(spark, names, lambda p: paths.matches_file_name(p, [])) == [True] * 4
    assert paths.parse_patterns(" *.cs, ,a ") == ["*.cs", "a"]


def test_languages(spark):
    known = {f"d.x/file{e.upper()}": name for name, es in fixed.LANGUAGE_EXTENSIONS.items() for e in es}
    assert evaluate(spark, list(known), paths.language_of) == list(known.values())
    others = ["a.md", "Makefile", "a.cs/b", "x.", "y.cs.bak"]
    assert evaluate(spark, others, paths.language_of) == [""] * len(others)
    assert evaluate(spark, [".cs", "dir/.py"], paths.language_of) == ["CSharp", "Python"]


def test_kinds(spark):
    column = lambda p: paths.kind_of(p, ["*.sh", "tools", "scripts"])
    assert evaluate(spark, ["run.sh", "a/Tools/b.cs", "scripts/x.py", "src/a.cs"], column) == ["Utility"] * 3 + ["Production"]
    frame = spark.createDataFrame([("a", "Utility"), ("b", "Production")], "path string, kind string")
    assert [scope.filter_kind(frame, k).count() for k in ("utility", "PRODUCTION", "all", "odd")] == [1, 1, 2, 2]


@pytest.mark.parametrize(
    "url, name",
    [
        ("https://github.com/owner/myrepo.git", "owner/myrepo"),
        ("https://github.com/owner/myrepo", "owner/myrepo"),
        ("git@github.com:owner/myrepo.git", "owner/myrepo"),
        ("http://host:8080/owner/x.GIT", "8080/owner/x"),
        ("local", "local"),
    ],
)
def test_repo_names(spark, url, name):
    assert evaluate(spark, [url], paths.repo_name) == [name]


def test_checkpoints_and_since(spark):
    commits = spark.sql(
        "select * from values ('r','a',timestamp'2020-01-01',array('')),('r','b',timestamp'2020-01-01',array('a','x')),"
        "('r','c',timestamp'2020-03-01',array('b')),('s','d',timestamp'2020-03-01',array('b'))"
        " as t(repo, commit_hash, ts, parents)"
    )
    tags = spark.sql("select 'r' repo, 'C' commit_hash")
    assert {r.commit_hash for r in scope.checkpoint_commits(commits, tags).collect()} == {"b", "c"}
    assert {r.commit_hash for r in scope.commits_since(commits, "b").collect()} == {"b", "c"}
    assert scope.commits_since(commits, "zz").count() == 0
    assert [r.commit_hash for r in scope.commits_with_prefix(commits, "A").collect()] == ["a"]
