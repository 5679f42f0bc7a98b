from __future__ import annotations

import random

import pytest

from driftmeter.operators import rollup
from driftmeter.sources import patterns

C_STYLE = {"C", "Cpp", "Java", "CSharp", "TypeScript", "JavaScript", "Rust"}


def count_lines(text, language):
    """Line-by-line automaton."""
    inside, count = False, 0
    for raw in text.split("\n"):
        line = raw.strip(" \t\r\x0b\x0c\x85\xa0 　")
        if inside:
            inside = "*/" not in line
        elif not line:
            pass
        elif language in C_STYLE and line.startswith("/*"):
            inside = "*/" not in line
        elif language in C_STYLE and line.startswith("//") or language == "Python" and line.startswith("#"):
            pass
        else:
            count += 1
    return count


def count_imports(text, language):
    def using(line):
        if not (line.startswith("using ") and line.endswith(";")):
            return False
        inner = line[6:-1].strip()
        if inner.startswith(("(", "var ")):
            return False
        inner = inner.removeprefix("static ")
        head, space, tail = inner.partition(" ")
        return not space or tail.startswith("=")

    rules = {
        "CSharp": using,
        "Java": lambda s: s.startswith("import ") and s.endswith(";"),
        "TypeScript": lambda s: s.startswith("import ") or "require('" in s or 'require("' in s,
        "Python": lambda s: s.startswith(("import ", "from ")),
        "C": lambda s: s.startswith("#include"),
        "Rust": lambda s: s.startswith(("use ", "extern crate ")),
    }
    rules |= {"JavaScript": rules["TypeScript"], "Cpp": rules["C"]}
    rule = rules.get(language, lambda s: False)
    return sum(rule(line) for line in (raw.strip(" \t\r\x0b\x0c\x85\xa0　") for raw in text.split("\n")) if line)


def measure(spark, rows):
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "id int, language string, content string")
    return [(r.sloc, r.coupling) for r in rollup.measure_text(frame).orderBy("id").collect()]


@pytest.mark.parametrize(
    "language, text, sloc",
    [
        ("CSharp", "/*\n * a\n */\nint x = 5;", 1),
        ("CSharp", "// a\n\nint x;\n/* one line */\n/* open\nint y;\nclose */ int z;\n  int w;\n\tint v;\r\n", 3),
        ("CSharp", "/* never closed\nint x;\nint y;", 0),
        ("CSharp", "int a; /* trailing\nint b;", 2),
        ("CSharp", "/*/\nint x;", 1),
        ("CSharp", " */ stray\n/* a\n/* b\n*/\nx", 2),
        ("Python", "# c\nx = 1\n/* not a comment\n  # d\n", 2),
        ("", "# c\n// d\n\n  \n/* e", 3),
        ("Java", "", 0),
        ("Java", "﻿// with a byte order mark\nclass A {}", 1),
    ],
)
def test_source_lines(spark, language, text, sloc):
    assert measure(spark, [(language, text)])[0][0] == sloc


@pytest.mark.parametrize(
    "language, text, imports",
    [
        ("CSharp", "using A;\nusing B.C;\n  using static D.E;\nusing F = G.H;", 4),
        ("CSharp", "using var x = y();\nusing (var z = w())\nusing (a);\nusing Stream s = open();\nusing A", 0),
        ("CSharp", "using ;\nusing var ;\nusing A ;\nusing A  = B;", 3),
        ("Java", "import a.b;\nimport a.b\n// import c;", 1),
        ("JavaScript", "import x from 'y'\nconst a = require('b'), c = require(\"d\")\nrequire(e)\nimport ", 2),
        ("Python", "import a\nfrom b import c\nimportant = 1\nfrom", 2),
        ("Cpp", "#include <a>\n  #include \"b\"\n# include <c>", 2),
        ("Rust", "use a::b;\nextern crate c;\nused", 2),
        ("", "import a", 0),
    ],
)
def test_import_lines(spark, language, text, imports):
    assert measure(spark, [(language, text)])[0][1] == imports == count_imports(text, language)


def test_random_texts_match_the_automaton(spark):
    rng = random.Random(7)
    pieces = [
        "/*", "*/", "//", "#", " ", "\t", "x = 1;", "/* a */", "\r", "", "using A;", "using var b = c;", "import d;",
        "from e", "require('f')", "#include <g>", "use h;", "extern crate i;", "using J = K;", "　", "*", "/", "static ",
        "using static L;", "using M N;", ";",
    ]
    rows = []
    for _ in range(600):
        lines = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 14))]
        language = rng.choice(["C", "Cpp", "Java", "CSharp", "TypeScript", "JavaScript", "Rust", "Python", ""])
        rows.append((language, "\n".join(lines)))
    found = measure(spark, rows)
    for (language, text), got in zip(rows, found):
        assert got == (count_lines(text, language), count_imports(text, language)), (language, text)


def test_huge_file(spark):
    """Long blocks and long lines: linear time, no deep recursion."""
    block = "/* start\n" + "words and more words\n" * 200_000 + "end */\n"
    text = block + "code();\n" * 1000 + "y" * 2_000_000 + "\n/* unclosed\n" + "tail\n" * 100_000
    assert measure(spark, [("C", text)])[0][0] == 1001


def test_patterns(spark):
    files = spark.createDataFrame([("r", "# a\n\n  *.log \r\ngenerated\n#b"), ("s", "\n# only\n")], "repo string, content string")
    assert [r.pattern for r in patterns.pattern_rows(files).collect()] == ["*.log", "generated"]
    assert [r.repo for r in patterns.regex_by_repo(files).collect()] == ["r"]
    assert patterns.read_patterns(spark, "/nowhere/at/all") == []
