"""Toxicity by a subsequence string kernel: a support vector machine over Nyström landmarks.

Words are compared by the subsequences of three characters that they share, within a span of SPAN characters, each
weighted by DECAY to the power of its span; the kernel is the cosine of these weights, to the power POWER. A word with
characters put in between still shares most of its subsequences. Of every chunk of text between white space only letters
are kept, so an insult with signs in it is the insult; runs of single letters are joined.

Landmarks are words of the labelled texts, those that toxic texts hold most unlike the others, none too like another,
and frequent words for contrast. A word's features are its kernel values with the landmarks, whitened (Nyström); a
sentence has the sum of its words'. A linear machine with squared hinge loss is trained on sentences: those of texts
that are not toxic, and of toxic texts the ones that look toxic so far, at first by their words' frequencies, then by
the machine. Four measures of a text's sentence values go to a logistic function, fitted on texts, which gives the score.

All is learnt on at most MAX_LABELLED labelled texts, those with the smallest hash of their id.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmeter.llm.common import ship

MAX_LABELLED = 3000
LANDMARKS = 96
SPAN = 5
DECAY = 0.7
POWER = 3
#: Words that may become landmarks for what is toxic.
CANDIDATES = 600
#: Cosine of words that stand for each other when landmarks are chosen.
ALIKE = 0.7
#: Features of a kernel are told apart by a hash of this many bits.
BITS = 16
#: Words of a sentence at most: sums over longer ones would grow with their length.
SENTENCE = 16
#: Characters of a word that are compared; longer words are compared in pieces of this length, at each half.
WORD = 16
CACHED_WORDS = 400_000
#: Texts scored together.
TOGETHER = 256
#: Subsequences by the places of their characters after the first.
_GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
_WEIGHTS = np.array([DECAY ** (j + 1 - 3) for _, j in _GAPS], np.float32)
_LETTERS = re.compile(r"[\W\d_]+")
#: Three single letters or more in a row, as chunks of their own.
_RUN = re.compile(r"(?<!\S)[^\W\d_](?:[ \t][^\W\d_]){2,}(?!\S)")
_ENDS = re.compile(r"(?<=[.!?])\s+|\n+")


def sentences(text: str | None) -> list[list[str]]:
    """Chunks between white space, lowered, of each sentence; long sentences are cut after SENTENCE chunks. Runs of three
    single letters or more are one chunk."""
    out = []
    text = _RUN.sub(lambda m: m[0].replace(" ", "").replace("\t", ""), text.lower()) if text else ""
    for s in _ENDS.split(text):
        chunks = s.split()
        if len(chunks) <= SENTENCE:
            out += [chunks] if chunks else []
        else:
            out += [chunks[i : i + SENTENCE] for i in range(0, len(chunks), SENTENCE)]
    return out


def words(chunks: list[str]) -> list[str]:
    """Letters only; chunks without letters are left out."""
    return [w for c in chunks if (w := _LETTERS.sub("", c))]


def features(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subsequences of each word (0: none) and their weights, scaled to unit length of the word's vector.

    Words are edged by a mark. A subsequence that a word has twice counts with both weights.
    """
    codes = np.zeros((len(some), WORD + 2 + SPAN), np.int64)
    for k, w in enumerate(some):
        codes[k, : len(w) + 2] = [1, *map(ord, w), 1]
    parts = []
    for (i, j), weight in zip(_GAPS, _WEIGHTS, strict=True):
        a, b, c = codes[:, : WORD + 2], codes[:, i : i + WORD + 2], codes[:, j : j + WORD + 2]
        h = ((a * 1_000_003 + b) * 1_000_003 + c) * 0x9E3779B1
        parts.append((np.where(c > 0, (h >> 20 & ((1 << BITS) - 2)) + 1, 0), weight))
    ids = np.concatenate([p for p, _ in parts], axis=1)
    weights = np.concatenate([np.where(p > 0, w, 0).astype(np.float32) for p, w in parts], axis=1)
    # length of the vector: equal subsequences of a word add up first
    order = np.argsort(ids, axis=1, kind="stable")
    ranked, held = np.take_along_axis(ids, order, 1), np.take_along_axis(weights, order, 1)
    sums = np.cumsum(held, axis=1, dtype=np.float64)
    last = np.ones(ids.shape, bool)
    last[:, :-1] = ranked[:, 1:] != ranked[:, :-1]
    ends = np.where(last, sums, 0)
    before = np.maximum.accumulate(np.concatenate([np.zeros((len(some), 1)), ends[:, :-1]], axis=1), axis=1)
    length = np.sqrt((np.where(last, sums - before, 0) ** 2).sum(axis=1))
    return ids, weights / np.maximum(length, 1e-9)[:, None].astype(np.float32)


def _pieces(word: str) -> list[str]:
    if len(word) <= WORD:
        return [word]
    return [word[i : i + WORD] for i in range(0, len(word) - WORD // 2, WORD // 2)]


@dataclass
class Machine:
    """table: features to landmarks' vectors; beta: the machine's weight of each kernel value; offset of a sentence;
    logit: weights of a text's measures. prior: score where nothing could be learnt."""

    table: np.ndarray
    beta: np.ndarray
    offset: float
    logit: np.ndarray
    prior: float

    def kernel(self, some: list[str]) -> np.ndarray:
        """Kernel values of each word with each landmark; of a long word the largest of its pieces'."""
        pieces = [_pieces(w) for w in some]
        flat = [p for ps in pieces for p in ps]
        out = np.zeros((len(flat), self.table.shape[1]), np.float32)
        by_length = sorted(range(len(flat)), key=lambda k: len(flat[k]))  # short words have few subsequences
        for at in range(0, len(flat), 1024):
            some = by_length[at : at + 1024]
            out[some] = _cosines(*features([flat[k] for k in some]), self.table)
        starts = np.cumsum([0, *map(len, pieces)])[:-1]
        return (np.maximum.reduceat(out, starts, axis=0) if len(flat) else out) ** POWER

    def values(self, some: list[str]) -> list[float]:
        return (self.kernel(some).astype(np.float64) @ self.beta).tolist()

    def measures(self, found: list[tuple[float, int]]) -> list[float]:
        """found: value and number of words of each sentence of a text."""
        if not found:
            return [0.0, 0.0, 0.0, 0.0]
        above = [v + 1 for v, _ in found if v > -1]
        n = sum(k for _, k in found)
        return [max(v for v, _ in found), np.log1p(sum(above)), sum(above) / len(found), 10 * sum(v > 0 for v, _ in found) / np.sqrt(max(n, 1))]

    def score(self, measures: list[list[float]]) -> np.ndarray:
        if not len(self.logit):
            return np.full(len(measures), self.prior)
        x = np.column_stack([np.array(measures, np.float64).reshape(-1, 4), np.ones(len(measures))])
        return 1 / (1 + np.exp(-np.clip(x @ self.logit, -40, 40)))


def _newton(x: np.ndarray, gradient_hessian, start: np.ndarray, steps: int = 40) -> np.ndarray:
    w = start
    for _ in range(steps):
        g, h = gradient_hessian(w)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """Linear machine, squared hinge loss, L2: Newton steps on the rows inside the margin. The last column of x is of
    ones, its weight the offset; rows of weight 0 are left out."""
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3

    def both(w):
        gradient, hessian = ridge @ w, ridge.copy()
        for at in range(0, len(x), 8192):
            part = x[at : at + 8192]
            inside = (weight[at : at + 8192] > 0) & (y[at : at + 8192] * (part @ w) < 1)
            xi = part[inside].astype(np.float64)
            scaled = 2 * cost * (xi * weight[at : at + 8192][inside, None]).T
            gradient += scaled @ (xi @ w - y[at : at + 8192][inside])
            hessian += scaled @ xi
        return gradient, hessian

    return _newton(x, both, np.zeros(x.shape[1]))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])

    def both(w):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        return 1e-2 * w + x.T @ (p - y), 1e-2 * np.eye(x.shape[1]) + (x * (p * (1 - p) + 1e-9)[:, None]).T @ x

    return _newton(x, both, np.zeros(x.shape[1]), 60)


def _table(some: list[str]) -> np.ndarray:
    """Features to the words' vectors."""
    ids, weights = features(some)
    table = np.zeros((1 << BITS, len(some)), np.float32)
    for k in range(len(some)):
        table[:, k] = np.bincount(ids[k], weights[k], 1 << BITS)
    table[0] = 0
    return table


def _cosines(ids: np.ndarray, weights: np.ndarray, table: np.ndarray) -> np.ndarray:
    total = np.zeros((len(ids), table.shape[1]), np.float32)
    for column in np.flatnonzero(ids.any(axis=0)):
        total += weights[:, column, None] * table[ids[:, column]]
    return total


def _landmarks(held: list[set[int]], distinct: list[str], toxic: np.ndarray, count: int) -> tuple[list[str], dict[int, float]]:
    """Landmarks, and the log odds of words by number. held: the words of each text; distinct: words by number."""
    bad, good = Counter(), Counter()
    for s, t in zip(held, toxic, strict=True):
        (bad if t else good).update(s)
    n, m = int(toxic.sum()), int((~toxic).sum())
    fit = [2 < len(w) <= WORD for w in distinct]
    odds = {w: float(np.log((k + 0.5) / (n + 1)) - np.log((good[w] + 0.5) / (m + 1))) for w, k in bad.items() if k > 1 and fit[w]}
    ranked = sorted(odds, key=lambda w: (-bad[w] * odds[w], distinct[w]))
    usual = sorted((w for w in good if fit[w]), key=lambda w: (-good[w], distinct[w]))
    some = ranked[:CANDIDATES]
    chosen: list[int] = []
    if some:
        spelt = [distinct[w] for w in some]
        alike = _cosines(*features(spelt), _table(spelt)) > ALIKE
        where = {w: k for k, w in enumerate(some)}
        holds = np.zeros((n, len(some)), bool)
        for d, s in enumerate(s for s, t in zip(held, toxic, strict=True) if t):
            holds[d, [where[w] for w in s if w in where]] = True
        # a text counts less the more landmarks it has words like
        left, gain = np.ones(n), np.array([odds[w] for w in some])
        for _ in range(min(len(some), count * 2 // 3)):
            k = int(np.argmax((left @ holds) * gain))
            chosen.append(some[k])
            gain[k] = -1
            left[holds[:, alike[k]].any(axis=1)] *= 0.5
    chosen += [w for w in usual if w not in chosen][: count - len(chosen)]
    return [distinct[w] for w in chosen], odds


def train(texts: list[str | None], toxic: np.ndarray, landmarks: int = LANDMARKS) -> Machine:
    """A machine from labelled texts; without both labels, one that gives the share of toxic texts."""
    prior = float(toxic.mean()) if len(toxic) else 0.0
    number: dict[str, int] = {}
    parts = [[[number.setdefault(w, len(number)) for w in ws] for s in sentences(t) if (ws := words(s))] for t in texts]
    distinct = list(number)
    held = [{w for s in p for w in s} for p in parts]
    chosen, odds = _landmarks(held, distinct, toxic, landmarks) if 0 < prior < 1 else ([], {})
    nothing = Machine(np.zeros((1 << BITS, 1), np.float32), np.zeros(1), 0.0, np.zeros(0), prior)
    if not chosen:
        return nothing
    machine = Machine(_table(chosen), np.zeros(len(chosen)), 0.0, np.zeros(0), prior)
    square = machine.kernel(chosen).astype(np.float64)
    root, axes = np.linalg.eigh((square + square.T) / 2)
    white = axes @ np.diag(1 / np.sqrt(np.maximum(root, 1e-3))) @ axes.T
    values = machine.kernel(distinct)
    flat = [ws for p in parts for ws in p]
    of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    x, bad = np.ones((len(flat), len(chosen) + 1), np.float32), toxic[of]
    for lo in range(0, len(flat), 4096):
        some = flat[lo : lo + 4096]
        at = np.cumsum([0, *map(len, some)])[:-1]
        x[lo : lo + 4096, :-1] = np.add.reduceat(values[list(itertools.chain.from_iterable(some))], at, axis=0) @ white
    look = np.array([max((odds.get(w, 0.0) for w in ws), default=0.0) for ws in flat])
    for _ in range(3):
        best = np.full(len(parts), -np.inf)
        np.maximum.at(best, of, look)
        positive = bad & ((look >= np.minimum(best[of], 2.0)) if _ == 0 else (look > 0) | (look == best[of]))
        use = positive | ~bad
        weight = np.where(positive, (use.sum() / max(positive.sum(), 1)) ** 0.5, use)
        w = _hinge(x, np.where(positive, 1.0, -1.0), weight, 1.0)
        look = x @ w
    machine.beta, machine.offset = white @ w[:-1], float(w[-1])
    found: list[list[tuple[float, int]]] = [[] for _ in parts]
    for o, v, ws in zip(of.tolist(), look.tolist(), flat, strict=True):
        found[o].append((v, len(ws)))
    machine.logit = _logistic(np.array([machine.measures(f) for f in found]), toxic.astype(np.float64))
    return machine


def fitted(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", max_labelled: int = MAX_LABELLED) -> Machine:
    """A machine from labels (id, toxic 0 or 1; other rows are left out) and the texts of these ids.

    At most max_labelled ids, those of the smallest hash; an id with both labels is toxic, of several texts the smallest
    counts. Only these texts come to the driver.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("_toxic"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    # at most max_labelled rows of two numbers are sent to all executors
    found = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")
    rows = found.groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")).orderBy("_id").collect()
    return train([r["_text"] for r in rows], np.array([r["_toxic"] == 1 for r in rows], bool))


class _Scorer:
    """A machine with the values of frequent chunks of text."""

    def __init__(self, machine: Machine):
        self.machine, self.known = machine, {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        parts = [sentences(t) for t in texts]
        here = set(itertools.chain.from_iterable(itertools.chain.from_iterable(parts)))
        new = [w for w in here if w not in self.known]
        letters = [_LETTERS.sub("", w) for w in new]
        fresh = {w: v if u else 0.0 for w, u, v in zip(new, letters, self.machine.values(letters), strict=True)}
        known = self.known
        for w in here:
            if w not in fresh:
                fresh[w] = known[w]
        if len(known) < CACHED_WORDS:
            known.update((w, fresh[w]) for w in new[: CACHED_WORDS - len(known)])
        offset, out = self.machine.offset, []
        for p in parts:
            found = []
            for s in p:
                got = [fresh[w] for w in s]
                found.append((sum(got) + offset, len(got)))
            out.append(self.machine.measures(found))
        return self.machine.score(out)


def scored(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """docs with score, from 0 to 1. Null and empty texts get the score of a text without sentences. The score depends
    on the text alone; a column of docs named score is replaced."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # 2 ** BITS x LANDMARKS numbers, whatever the input

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            texts = batch.tolist()  # split into words some at a time
            found = [scorer.scores(texts[at : at + TOGETHER]) for at in range(0, len(texts), TOGETHER)]
            yield pd.Series(np.concatenate([np.zeros(0), *found]), dtype="float64")

    return docs.drop("score").withColumn("score", score(F.col(text)))
