"""Quality rules as a learned decision list, in DataFrame operations only.

A sequential covering loop grows one rule at a time on labelled statistics: the conjunction of threshold conditions with
the best gain for the class to reject, grown on one part of the labelled rows and pruned on the other, until no rule is
precise enough. What it emits is an ordered chain of ``when`` expressions over the measures of a text, which Spark
evaluates for all rows without any Python.

Learning uses at most ``MAX_LABELLED`` labelled rows, those with the smallest hash of their id; measures are computed on
whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmeter.llm.common import stored, unused

#: White space that parts words.
SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_digits", "n_ends", "n_lines",
    "n_letters",
)
MAX_LABELLED = 4000
MAX_RULES = 8
MAX_CONDITIONS = 3
THRESHOLDS = 24
#: A rule stays if at least this share of what it covers on the pruning rows is to be rejected, counting one more
#: covered row that is not.
MIN_PRECISION = 0.9
MIN_COVERED = 3


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often use names it (lambda bodies compute anew per element)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Number of words that lie in a window of WINDOW words which occurs twice or more in the text."""
    n = F.size(words)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))
    hash_at = lambda placed, k: F.get(placed, k)["h"]

    def places(placed: Column) -> Column:
        """Places of windows whose hash a neighbour in the sorted array has too."""
        same = lambda x, k: (x["h"] == hash_at(placed, k - 1)) | (x["h"] == hash_at(placed, k + 1))
        return F.transform(F.filter(placed, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"])

    def covered(all_: Column) -> Column:
        placed = F.array_sort(F.transform(all_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(F.array_sort(_let(placed, places)), start, step, lambda acc: acc["n"].cast("long"))

    none = F.lit(0).cast("long")
    return F.coalesce(_let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(none)), none)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the COUNTS (long) of their texts and a row number, _at, that means nothing.

    A null text counts as empty. Columns of docs with these names are replaced. Windows are told apart by a 64-bit hash
    of their words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (*COUNTS, "_at")]
    count = lambda chars: (F.length(body) - F.length(F.translate(body, chars, ""))).cast("long")

    def counts(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            count(SYMBOLS).alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
            count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
            count("0123456789").alias("n_digits"),
            count("!?").alias("n_ends"),
            F.size(lines).cast("long").alias("n_lines"),
            count("abcdefghijklmnopqrstuvwxyz").alias("n_letters"),
        )

    words = F.filter(F.split(body, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda line: F.regexp_like(line, F.lit(f"[^{SPACE[1:]}")))
    found = _let(words, lambda w: _let(lines, lambda at: counts(w, at)))
    # the optimizer leaves filters above a row number, so that they read the counts and don't count once more
    held, at = unused(docs.columns, "_m"), unused(docs.columns, "_at")
    return docs.select(*rest, found.alias(held), F.monotonically_increasing_id().alias(at)).select(*rest, f"`{held}`.*", f"`{at}`")


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def features() -> dict[str, Column]:
    """What conditions may be on: shares of the counts, and two sizes."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _ratio("word_chars", "n_words"),
        "symbols": _ratio("n_symbols", "word_chars"),
        "dup_lines": _ratio("n_dup_lines", "n_lines"),
        "repeated": _ratio("n_repeat_words", "n_words"),
        "distinct": _ratio("n_distinct_words", "n_words"),
        "upper": _ratio("n_upper", "word_chars"),
        "digits": _ratio("n_digits", "word_chars"),
        "ends": _ratio("n_ends", "n_words"),
        "letters": _ratio("n_letters", "word_chars"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, columns: dict[str, Column]) -> Column:
        value = columns[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _covered(rule: Rule, rows: list[dict]) -> tuple[int, int]:
    """Rows to reject and rows to keep that the rule covers."""
    hit = [r["bad"] for r in rows if all(c.holds(r) for c in rule)]
    return sum(hit), len(hit) - sum(hit)


def _grow(rows: list[dict], names: list[str]) -> Rule:
    """Adds the condition of the largest information gain while rows to keep are covered."""
    rule: Rule = ()
    p, n = sum(r["bad"] for r in rows), sum(not r["bad"] for r in rows)
    while n and p and len(rule) < MAX_CONDITIONS:
        best: tuple[float, Condition, int, int] | None = None
        now = math.log2(p / (p + n))
        for name in names:
            values = sorted(r[name] for r in rows)
            cuts = sorted({values[len(values) * k // (THRESHOLDS + 1)] for k in range(1, THRESHOLDS + 1)})
            ranked = sorted(rows, key=lambda r: r[name])
            at, bad, good = 0, 0, 0
            for cut in cuts:
                while at < len(ranked) and ranked[at][name] <= cut:
                    bad, good, at = bad + ranked[at]["bad"], good + (not ranked[at]["bad"]), at + 1
                for above, x, y in ((False, bad, good), (True, p - bad, n - good)):
                    if x and (gain := x * (math.log2(x / (x + y)) - now)) > 1e-9 and (best is None or gain > best[0]):
                        best = gain, Condition(name, above, cut), x, y
        if best is None:
            break
        rule, p, n = (*rule, best[1]), best[2], best[3]
        rows = [r for r in rows if best[1].holds(r)]
    return rule


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    """Drops last conditions while that doesn't lower the precision on rows not used for growing."""
    worth = lambda r: (lambda p, n: (p + 0.0) / (p + n + 1))(*_covered(r, rows))
    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(rows: list[dict], names: list[str]) -> list[Rule]:
    """Ordered rules to reject. rows: features by name, bad (bool) and hash (to deal rows to growing and pruning)."""
    grow, prune = [r for r in rows if r["hash"] % 3], [r for r in rows if not r["hash"] % 3]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and any(r["bad"] for r in grow):
        rule = _prune(_grow(grow, names), prune)
        p, n = _covered(rule, prune) if rule else (0, 0)
        q, m = _covered(rule, grow) if rule else (0, 0)
        if not rule or p + q < MIN_COVERED or p / (p + n + 1) < MIN_PRECISION and (p + q) / (p + q + n + m + 1) < MIN_PRECISION:
            break
        rules.append(rule)
        grow = [r for r in grow if not all(c.holds(r) for c in rule)]
        prune = [r for r in prune if not all(c.holds(r) for c in rule)]
    return rules


def learned(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from the labelled rows (labels: id, quality 0 or 1; others are left out) of docs.

    At most max_labelled ids are taken, those of the smallest hash; where an id has both labels, or several rows, the
    smaller label and the row of the smallest text count. No labels, or none of quality 0: no rules.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("quality"))
    known = known.withColumn("hash", F.pmod(F.xxhash64("_id"), F.lit(1 << 40))).orderBy("hash", "_id").limit(max_labelled)
    # at most max_labelled rows of three numbers are sent to all executors
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")
    chosen = chosen.groupBy("_id", "quality", "hash").agg(F.min("_text").alias("_text"))
    named = features()
    counts = stored(measured(chosen, "_text").drop("_text"), "labelled")
    rows = counts.filter(~base_failed()).select("quality", "hash", *[c.alias(k) for k, c in named.items()]).collect()
    return learn([r.asDict() | {"bad": r["quality"] == 0} for r in sorted(rows, key=lambda r: r["hash"])], list(named))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    named, out = features(), None
    for k, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column(named)
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with their counts, base_failed, rule (the first learned rule that rejects; 0: none) and kept.

    Rows without id or text are judged like any other (no text: no words, so base_failed). Repeated rows get the same
    verdict. Columns of docs that have the name of one of the added ones are replaced.
    """
    rules = learned(docs, labels, text, id_col)
    docs = docs.drop(*({"base_failed", "rule", "kept"} - {text}))
    at = unused(docs.columns, "_at")
    found = measured(docs, text)
    found = found.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0) & (F.col(f"`{at}`") >= 0)).drop(at)
