from __future__ import annotations

import html
import random
import re
import tracemalloc

import pandas as pd
import pytest

from driftmeter.llm import page_diff


def test_common_lines():
    rng = random.Random(5)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        found = sorted(page_diff.common_lines(a, b))
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(any(a[i] == y for y in rest) for i in found)


def test_common_lines_of_long_pages_take_little_memory(monkeypatch):
    a, b = list(range(12_000)), list(range(0, 24_000, 2))
    random.Random(1).shuffle(b)
    b[3000:9000] = a[3000:9000]
    tracemalloc.start()
    found = sorted(page_diff.common_lines(a, b))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 << 20 and set(found) >= set(range(3000, 9000))
    monkeypatch.setattr(page_diff, "ROW_BITS", 6)
    test_common_lines()


def test_query(result, sf):
    pages = pd.read_parquet(f"{sf}/pages.parquet")
    found = result("op8_page_diff").set_index("page_id")
    assert len(found) == len(pages)
    for page in pages.itertuples():
        body = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        lines = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", body))
        expected = "\n".join(x for x in lines if x)
        assert (found.loc[page.page_id].text, found.loc[page.page_id].n_chars) == (expected, len(expected))


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (None, []),
        ("", []),
        ("plain &amp;lt; text", [("rest", "plain &lt; text")]),
        ("<p>a<p>b<br>c", [("rest", "a"), ("rest", "b"), ("rest", "c")]),
        ("<article><p>a <b>b\n c</b></p><div class='ad-box'>x</div>d</article>e", [("main", "a b c"), ("off", "x"), ("main", "d"), ("rest", "e")]),
        ("<nav><ul><li>x</ul></nav><p>y", [("off", "x"), ("rest", "y")]),
        ("<script>if (a<b) '</p>'</script><style>p{}</style>z<!-- <p>no</p> -->", [("rest", "z")]),
        ("<title>t &amp; u</title><p title='a>b'>v</p></div></p>w", [("off", "t & u"), ("rest", "v"), ("rest", "w")]),
        ("<div role=navigation>x</div><div class=\"user-comments\">y</div><form>z</form>k", [("off", "x"), ("off", "y"), ("off", "z"), ("rest", "k")]),
        ("<article>a<script>never ends", [("main", "a")]),
        ("<p>1 < 2 and 3 > 2</p>", [("rest", "1 < 2 and 3 > 2")]),
    ],
)
def test_blocks(page, expected):
    assert page_diff.blocks(page) == expected


def _site(*lines):
    return "<html><body><div>Menu A</div><div>Menu B</div>" + "".join(f"<div>{x}</div>" for x in lines) + "<div>Imprint</div></body></html>"


def test_shared_lines_go(spark):
    rows = [
        (1, "http://a.com/x/1", _site("one", "two")),
        (2, "https://u@A.com:80/x/2?q=1#f", _site("three", "Menu A now")),
        (3, "http://a.com/y", _site("four", "one")),
        (4, "http://b.com/z", _site("alone")),
        (5, "http://c.com/1", _site("same")),
        (6, "http://c.com/2", _site("same")),
        (7, None, None),
        (8, "", ""),
    ]
    frame = spark.createDataFrame(rows, "text long, url string, html string")
    found = page_diff.extract(frame.withColumnRenamed("text", "page_id").withColumn("text", page_diff.F.lit("old"))).collect()
    texts = {r["page_id"]: r["text"] for r in found}
    whole = "Menu A\nMenu B\n{}\nImprint"
    assert texts == {1: "one\ntwo", 2: "three\nMenu A now", 3: "four\none", 4: whole.format("alone"), 5: whole.format("same"), 6: whole.format("same"), 7: "", 8: ""}
    assert page_diff.extract(frame.filter("false")).count() == 0
    twice = page_diff.extract(frame.union(frame)).collect()
    assert len(twice) == 16 and {r["text"] for r in twice if r["url"] == "http://b.com/z"} == {whole.format("alone")}


def test_text_outside_articles_is_judged_by_the_neighbour(spark):
    teaser, quoted = "<article>teaser</article>", "<article>quoted</article>"
    rows = [
        (1, "http://a.com/1", _site("body one", teaser)),
        (2, "http://a.com/2", _site("body two", teaser)),
        (3, "http://b.com/1", _site("<article>first</article>")),  # the same outside the article
        (4, "http://b.com/2", _site("<article>second</article>")),
        (5, "http://c.com/1", _site("own", quoted)),
        (6, "http://c.com/2", _site("quoted", "<nav>Home</nav>")),
    ]
    found = page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r["page_id"]: r["text"] for r in found}
    assert texts == {1: "body one\nteaser", 2: "body two\nteaser", 3: "first", 4: "second", 5: "own\nquoted", 6: "quoted"}


def test_neighbours_do_not_depend_on_the_parts(spark):
    rows = [(k, "h" if k % 3 else "g", f"/{k % 4}/{k % 7}/{k}") for k in range(120)]
    frame = spark.createDataFrame(rows, "row long, host string, path string")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for parts in ("1", "4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append({r["row"]: r["other"] for r in page_diff.neighbours(frame).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))

    def alike(a, b):
        if a is None or b is None or a[1] != b[1]:
            return -1
        same = 0
        for x, y in zip(a[2].split("/"), b[2].split("/"), strict=False):
            if x != y:
                break
            same += 1
        return same

    for at, row in enumerate(order):
        before, after = order[at - 1] if at else None, order[at + 1] if at + 1 < len(order) else None
        x, y = alike(row, before), alike(row, after)
        expected = None if max(x, y) < 0 else before[0] if x >= y else after[0]
        assert all(f[row[0]] == expected for f in found)
