"""Personal data in texts: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns find e-mail addresses, IP addresses, card numbers that pass Luhn's test and phone numbers with a plus sign.
The field tags words: features are the word's shape (letters, digits and signs, runs folded), its number of digits, the
word itself if the labelled table holds it often, and the kind of the words beside it. It is trained on a small table
of labelled sentences (:func:`labelled_sentences` makes one by rule; any other of that form will do) and adds numbers in
other groupings, numbers that fail the test, and addresses spelt with (at) and (dot).

Words are decoded in numpy batches. A word whose score for "nothing" is above that of each other tag by more than the
transitions could ever make up is "nothing" on every best path; so texts fall into runs of other words between those,
and Viterbi's recursion runs over these runs alone, exactly, many at a time.
"""

from __future__ import annotations

import itertools
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmeter.llm.common import ship

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{e}-{k}" for k in KINDS for e in "BI"))
#: Labelled sentences that training takes at most, those of the smallest hash, and characters of each.
MAX_LABELLED = 2000
MAX_CHARS = 2000
#: A word must be in so many labelled sentences to be a feature itself.
LEAST_SENTENCES = 3
RIDGE = 0.02
#: Transitions are held small, so that words beside each other decide through their own features; see Field.slack.
RIDGE_MOVES = 5.0
STEPS = 150
#: Words of which a Python worker keeps the features at most.
CACHED_WORDS = 200_000
#: Characters of texts decoded together, about.
TOGETHER = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")
_RUNS = re.compile(r"a+|A+|9+")
_EDGES = re.compile(r"^[^\w+(\[]+|[^\w)\]]+$")

Span = tuple[int, int, int]
"""start, end, number of the kind"""


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by start and kind; leftmost first, without overlaps within a kind, in code points.

    Time is linear in the text: an address is looked for around each @, and no run of digits is entered twice.
    """
    out: list[Span] = []
    after = 0
    for host in _HOST.finditer(text) if "@" in text else ():
        start = host.start()
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        if start < host.start():
            out.append((start, after := host.end(), 0))
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


# --- features ----------------------------------------------------------------------------

#: How many digits a word has, by upper bounds.
_DIGITS = (0, 1, 2, 3, 4, 5, 7, 9, 13, 19)
#: Kinds of a neighbouring word: (name, pattern of its shape without signs at its edges), the first that fits.
_CLASSES = (
    ("edge", r"(?!)"), ("signs", r""), ("letters", r"[aA]+(-[aA]+)*"), ("plus", r"\+9.*"), ("round", r"\(9\)?"), ("at", r"[(\[][aA]+[)\]]"), ("number", r"9"), ("parts", r"9([-./ ]9)+"),
    ("mail", r".*@.*"), ("mixed", r".*9.*"), ("other", r".*"),
)
_CLASS_OF = [re.compile(p, re.DOTALL) for _, p in _CLASSES]


def core(word: str) -> str:
    """The word without signs at its edges."""
    return _EDGES.sub("", word)


def shape(word: str) -> str:
    """Letters as a or A, digits as 9, runs of each folded; cut after 24 characters."""
    kinds = "".join("9" if c in "0123456789" else "A" if c.isupper() else "a" if c.isalpha() else c for c in word[:200])
    return _RUNS.sub(lambda m: m[0][0], kinds)[:24]


def word_features(word: str) -> tuple[list[str], int]:
    """The features of a word by itself, and its kind as a neighbour."""
    bare = core(word)
    form = shape(bare)
    digits = sum(c in "0123456789" for c in bare)
    of = bisect_right(_DIGITS, digits - 1)
    found = ["any", f"shape {form}", f"digits {of}", f"word {bare.lower()[:24]}", f"start {form[:1]}", f"end {form[-1:]}"]
    if digits:
        found.append(f"digits {of} of {form}" if len(form) <= 8 else "long")
    return found, next(k for k, p in enumerate(_CLASS_OF) if p.fullmatch(form))


_EDGE = ("edge",), 0


@dataclass
class Field:
    """number: of each feature; own: its score for each tag; before, after: scores by the kind of the word there;
    moves: from a tag to the next."""

    number: dict[str, int] = field(default_factory=dict)
    own: np.ndarray = field(default_factory=lambda: np.zeros((0, len(TAGS))))
    before: np.ndarray = field(default_factory=lambda: np.zeros((len(_CLASSES), len(TAGS))))
    after: np.ndarray = field(default_factory=lambda: np.zeros((len(_CLASSES), len(TAGS))))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((len(TAGS), len(TAGS))))

    def score(self, features) -> np.ndarray:
        known = [self.number[f] for f in features if f in self.number]
        return self.own[known].sum(axis=0) if known else np.zeros(len(TAGS))

    def slack(self) -> np.ndarray:
        """For each tag, what its transitions may at most be better than those of "nothing" in its place."""
        into = (self.moves - self.moves[:, :1]).max(axis=0)
        out = (self.moves - self.moves[:1]).max(axis=1)
        return into + out

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags of runs (number, longest, tags) that stand between words of no kind; 0 behind a run's end."""
        n, longest, _ = scores.shape
        best, back = scores[:, 0] + self.moves[0], np.zeros((n, longest, len(TAGS)), np.int8)
        for t in range(1, longest):
            ways = best[:, :, None] + self.moves[None]
            back[:, t] = ways.argmax(axis=1)
            step = ways.max(axis=1) + scores[:, t]
            best = np.where((t < lengths)[:, None], step, best)
        tags = np.zeros((n, longest), np.int8)
        now = (best + self.moves[:, 0]).argmax(axis=1)
        rows = np.arange(n)
        for t in range(longest - 1, -1, -1):
            tags[:, t] = np.where(t < lengths, now, 0)
            if t:
                now = np.where(t < lengths, back[rows, t, now], now)
        return tags


# --- training ----------------------------------------------------------------------------

def labelled_sentences(spark: SparkSession, count: int = 600, seed: int = 5) -> DataFrame:
    """A small labelled table (text, spans: array of (kind, start, end)), made by rule from invented sentences."""
    return spark.createDataFrame(sentences(count, seed), "text string, spans array<struct<kind string, start int, end int>>")


# fixed values: words around personal data, and words like them around other numbers
_LEADS = ("write to", "mail", "contact", "reach us at", "call", "phone", "tel.", "from", "card", "paid with", "host", "the", "of", "and", "que", "der", "les", "ist", "por")
_TAILS = ("today", "or later", "for details", "thanks", "and", "the", "de", "und", "in", "", "")
_NAMES = ("anna", "jo.berg", "li", "m_ortiz", "petra.k", "sam", "tdv.31", "x.y", "info", "office", "ines")
_HOSTS = ("example", "mail5.example", "post", "uni-x", "firma", "correo")
_ENDS = ("com", "org", "net", "de", "fr", "es")
_PROSE = ("the", "heron", "of", "eating", "nicht", "wald", "que", "maison", "los", "rojo", "and", "things", "for", "licensed", "version", "im", "era", "mot", "Then", "Ist", "La", "Éa", "it", "at", "dot", "plus", "CC", "BY-NC")


def sentences(count: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    draw = random.Random(seed)
    one, digits = draw.choice, lambda n: "".join(draw.choices("0123456789", k=n))

    def number(n: int) -> str:
        return draw.choice("123456789") + digits(n - 1)

    def card() -> str:
        n = draw.choice((14, 15, 16, 16, 16, 16, 19))
        whole, sign = number(n), one(("", "", "", " ", "-"))
        return sign.join(whole[i : i + 4] for i in range(0, n, 4)) if sign else whole

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return one((f"({a}) {b}-{c}", f"+{one('1234')} ({a}) {b}-{c}", f"{a}-{b}-{c}", f"0{number(2)} {b} {c}{digits(2)}", f"+{number(2)} {a} {b} {c}", f"{a}.{b}.{c}"))

    def email() -> str:
        a, b, c = one(_NAMES), one(_HOSTS), one(_ENDS)
        return one((f"{a}@{b}.{c}", f"{a}@{b}.{c}", f"{a} (at) {b} (dot) {c}", f"{a}[at]{b}.{c}", f"{a} [at] {b} [dot] {c}", f"{a}(at){b}.{c}", f"{a} @ {b}.{c}"))

    def ip() -> str:
        return ".".join(str(draw.randrange(256)) for _ in range(4)) + one(("", "", "", f":{number(4)}"))

    def other() -> str:
        return one((
            f"{number(1)}.0", f"{number(1)}.{digits(1)}.{digits(2)}", f"{number(4)}", f"{number(2)}/{number(2)}/20{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{number(2)}:{digits(2)}",
            f"${number(2)}.{digits(2)}", f"{number(3)},{digits(3)}", f"#{number(6)}", f"{number(1)}", f"{number(7)}", f"no. {number(8)}", f"{number(24)}", f'token = "{draw.randbytes(20).hex()}"', f"password={draw.randbytes(9).hex()}",
            f"AKIA{''.join(draw.choices('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', k=16))}", f"v{number(1)}.{digits(1)}", f"@{one(_NAMES)}", f"{number(1)}+{number(1)}", f"({number(1)})", f"({one(_PROSE)})", f"[{number(2)}]", f"{number(2)}%", f"x{number(2)}", f"{draw.randbytes(8).hex()}", "C++", "+", "@", "(c)", "at", "dot",
        ))

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(count):
        text, spans = "", []
        signs = one(("", "", "", "!!", "***", "%%%", ",", ".", "###", " |"))
        for part in range(draw.randrange(1, 4)):
            between = " | " if signs == " |" else signs + " " if draw.random() < 0.3 else " "
            text += between.join(draw.choices(_PROSE, k=draw.randrange(0, 6)) + [one(_LEADS)]) + between
            kind = one((*KINDS, "other", "other", "other"))
            if kind == "other":
                text += other()
            else:
                for again in range(1 + (draw.random() < 0.2)):
                    made = makers[kind]()
                    text += " " * again
                    spans.append((kind, len(text), len(text) + len(made)))
                    text += made
            text += signs + " " + one(_TAILS) + " "
        out.append((text, spans))
    return out


def _tagged(text: str, spans) -> tuple[list[str], list[int]]:
    """Words and the numbers of their tags."""
    words, tags = [], []
    for m in _WORD.finditer(text):
        words.append(m[0])
        within = [s for s in spans if s["start"] < m.end() and m.start() < s["end"]]
        tags.append(1 + 2 * KINDS.index(within[0]["kind"]) + (m.start() > within[0]["start"]) if within else 0)
    return words, tags


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> Field:
    """A field from labelled (text, spans); of more than max_labelled rows those of the smallest hash, and of longer
    sentences the first MAX_CHARS characters. Rows without text are left out; an empty table gives a field that finds
    nothing. The sentences come to the driver, where the likelihood is climbed by Adam from zero."""
    rows = labelled.filter("text is not null").select(F.substring("text", 1, MAX_CHARS).alias("text"), "spans")
    rows = rows.orderBy(F.xxhash64("text"), "text").limit(max_labelled).collect()
    parts = [t for t in (_tagged(r["text"], [s for s in r["spans"] or () if s["kind"] in KINDS]) for r in rows) if t[0]]
    if not any(any(tags) for _, tags in parts):
        # without an example nothing is learnt; "nothing" wins by its margin
        none = Field({"any": 0}, np.zeros((1, len(TAGS))))
        none.own[0, 0] = 1.0
        return none
    seen = [[word_features(w) for w in words] for words, _ in parts]
    often = Counter(f for line in seen for f in {f for fs, _ in line for f in fs if f.startswith("word ")})
    held = dict.fromkeys(f for line in seen for fs, _ in line for f in fs if not f.startswith("word ") or often[f] >= LEAST_SENTENCES)
    number = {f: i for i, f in enumerate(held)}
    n, longest, k, c = len(parts), max(len(w) for w, _ in parts), len(TAGS), len(_CLASSES)
    most = max(len(fs) for line in seen for fs, _ in line)
    ids = np.full((n, longest, most), len(number))  # the last row of own stays 0
    prev, nxt = np.zeros((n, longest), np.int64), np.zeros((n, longest), np.int64)
    gold, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (line, (_, tags)) in enumerate(zip(seen, parts, strict=True)):
        for t, (fs, _) in enumerate(line):
            known = [number[f] for f in fs if f in number]
            ids[i, t, : len(known)] = known
        kinds = [0, *(kind for _, kind in line), 0]
        prev[i, : len(line)], nxt[i, : len(line)] = kinds[:-2], kinds[2:]
        gold[i, : len(line)], mask[i, : len(line)] = tags, True
    one = np.eye(k)[gold] * mask[..., None]
    sizes = [(len(number) + 1) * k, c * k, c * k, k * k]
    ridge = np.repeat([RIDGE, RIDGE, RIDGE, RIDGE_MOVES], sizes)
    theta, m1, m2 = np.zeros(sum(sizes)), np.zeros(sum(sizes)), np.zeros(sum(sizes))
    ends = mask.sum(axis=1) - 1
    rows_ = np.arange(n)
    inner = mask[:, 1:]
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (gold[:, :-1][inner], gold[:, 1:][inner]), 1)
    np.add.at(gold_moves, (0, gold[:, 0]), 1)
    np.add.at(gold_moves, (gold[rows_, ends], 0), 1)

    def sums(at: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(at, of[:, j], size) for j in range(k)], axis=1)

    flat, words_at = ids[mask], np.flatnonzero(mask.ravel())
    for step in range(1, STEPS + 1):
        own, bef, aft, moves = (p.reshape(-1, k) for p in np.split(theta, np.cumsum(sizes)[:-1]))
        e = np.zeros((n, longest, k))
        e[mask] = own[flat].sum(axis=1) + bef[prev[mask]] + aft[nxt[mask]]
        way, e = np.exp(moves), np.exp(e - e.max(axis=2, keepdims=True))
        # forward and backward, each place scaled to sum 1; behind a sentence's end nothing changes
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = e[:, 0] * way[0]
        alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, longest):
            a = (alpha[:, t - 1] @ way) * e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], a / a.sum(axis=1, keepdims=True), alpha[:, t - 1])
        beta[:, -1] = way[:, 0]
        for t in range(longest - 2, -1, -1):
            b = (e[:, t + 1] * beta[:, t + 1]) @ way.T
            beta[:, t] = np.where(mask[:, t + 1, None], b / b.sum(axis=1, keepdims=True), way[:, 0])
        p = alpha * beta
        p *= mask[..., None] / p.sum(axis=2, keepdims=True)
        ahead = e[:, 1:] * beta[:, 1:]
        scale = ((alpha[:, :-1] @ way) * ahead).sum(axis=2)
        expected = way * (alpha[:, :-1][inner].T @ (ahead[inner] / scale[inner][:, None]))
        expected[0] += p[:, 0].sum(axis=0)
        expected[:, 0] += p[rows_, ends].sum(axis=0)
        diff = (p - one).reshape(-1, k)[words_at]
        g_own = sums(flat.ravel(), np.repeat(diff, most, axis=0), len(number) + 1)
        g_own[-1] = 0
        g_bef, g_aft = sums(prev[mask], diff, c), sums(nxt[mask], diff, c)
        g = np.concatenate([x.ravel() for x in (g_own, g_bef, g_aft, expected - gold_moves)]) + ridge * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta - 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    own, bef, aft, moves = (p.reshape(-1, k) for p in np.split(theta, np.cumsum(sizes)[:-1]))
    return Field(number, own[:-1], bef, aft, moves)


# --- decoding ----------------------------------------------------------------------------

class Tagger:
    """A field with the scores of frequent words."""

    def __init__(self, model: Field):
        self.model, self.slack = model, model.slack()
        self._keys: dict[tuple, int] = {}
        self._words: dict[str, int] = {}
        self._plain: dict[tuple, int] = {}
        self._scores = np.zeros((1024, len(TAGS)))
        self._kinds = np.zeros(1024, np.int64)
        self._edge = self._row(*_EDGE)
        self._scores[self._edge, 0] = 1e9

    def _row(self, features, kind: int) -> int:
        """Words with the same known features share one row of scores."""
        key = (kind, *sorted(self.model.number[f] for f in features if f in self.model.number))
        row = self._keys.get(key)
        if row is None:
            row = self._keys[key] = len(self._keys)
            if row == len(self._scores):
                self._scores, self._kinds = np.concatenate([self._scores, np.zeros_like(self._scores)]), np.concatenate([self._kinds, np.zeros_like(self._kinds)])
            self._scores[row], self._kinds[row] = self.model.score(features), kind
        return row

    def _letters(self, word: str) -> int | None:
        """The row of a word of letters, small but for the first, before usual signs; these are most words."""
        bare = word.rstrip(".,!?;:")
        if not bare.isalpha() or not (bare[1:].islower() or len(bare) == 1) or len(bare) > 200:
            return None
        lower = bare.lower()[:24]
        key = (bare[0].isupper(), lower if f"word {lower}" in self.model.number else "")
        row = self._plain.get(key)
        if row is None:
            row = self._plain[key] = self._row(*word_features(bare))
        return row

    def _number(self, word: str) -> int:
        row = self._letters(word)
        if row is None:
            row = self._row(*word_features(word))
        if len(self._words) >= CACHED_WORDS:
            self._words.clear()  # frequent words come back at once
        if len(word) <= 64:
            self._words[word] = row
        return row

    def added(self, texts: list[str]) -> list[list[Span]]:
        """What the field finds in each text, overlaps with the patterns' spans included."""
        split = [t.split() for t in texts]
        known, number = self._words.get, self._number
        rows = [self._edge]
        for ws in split:
            rows += [r if (r := known(w)) is not None else number(w) for w in ws]
            rows.append(self._edge)
        at = np.array(rows)
        kinds = self._kinds[at]
        scores = self._scores[at]
        scores[1:] += self.model.before[kinds[:-1]]
        scores[:-1] += self.model.after[kinds[1:]]
        open_ = ~((scores[:, :1] - scores)[:, 1:] > self.slack[1:]).all(axis=1)
        open_[0] = open_[-1] = False
        out: list[list[Span]] = [[] for _ in texts]
        edges = np.flatnonzero(np.diff(open_.astype(np.int8)))
        starts, stops = edges[::2] + 1, edges[1::2] + 1
        if not len(starts):
            return out
        tags = np.zeros(len(at), np.int8)
        lengths = stops - starts
        order = np.argsort(lengths, kind="stable")
        while len(order):
            # runs of like length together, some 100,000 places at a time
            few = order[: max(1, int(100_000 // max(lengths[order[0]], 1)))]
            few = few[lengths[few] <= 2 * lengths[few[0]]]
            order = order[len(few) :]
            place = starts[few, None] + np.arange(lengths[few].max())
            found = self.model.viterbi(scores[np.minimum(place, len(at) - 1)], lengths[few])
            within = place < stops[few, None]
            tags[place[within]] = found[within]
        first = np.cumsum([1, *(len(ws) + 1 for ws in split)])
        tagged = np.flatnonzero(tags)
        for i in np.unique(np.searchsorted(first, tagged, "right") - 1).tolist():
            out[i] = _spans(texts[i], tags[first[i] : first[i + 1] - 1].tolist())
        return out


def _spans(text: str, tags: list[int]) -> list[Span]:
    # the words of str.split and of \S+ are the same but for U+001C to U+001F, which both count as white space
    out: list[list[int]] = []
    last = 0
    for m, tag in zip(_WORD.finditer(text), tags, strict=True):
        if tag:
            kind = (tag - 1) // 2
            bare = core(m[0])
            start = m.start() + m[0].find(bare)
            if tag % 2 == 0 and last and (last - 1) // 2 == kind:
                out[-1][1] = start + len(bare)
            elif bare:
                out.append([start, start + len(bare), kind])
            else:
                tag = 0
        last = tag
    return [(a, b, k) for a, b, k in out]


def found_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int, bool]]]:
    """(start, end, kind, base) of each text: the patterns' spans, and the field's that overlap none of them."""
    out = []
    for text, more in zip(texts, tagger.added(texts), strict=True):
        base = base_spans(text)
        if more and base:
            ends = list(itertools.accumulate((e for _, e, _ in base), max))
            begins = [s for s, _, _ in base]
            # the spans that begin before this one's end must all end before its start
            more = [s for s in more if not (n := bisect_right(begins, s[1] - 1)) or ends[n - 1] <= s[0]]
        out.append(sorted([(*s, True) for s in base] + [(*s, False) for s in more], key=lambda s: (s[0], s[2], s[1])))
    return out


SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"


def find(docs: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """docs with spans (kind, start, end, base) by start and kind, in code points, in place of an earlier column spans.

    base tells the patterns' spans from the field's; those of the field overlap none of the patterns'. Null and empty
    texts have none. Rows are independent and texts are read whole; nothing is shuffled.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sentences

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(shared.value)
        for batch in batches:
            out: list = []
            some: list[str] = []
            held = 0
            for i, text in enumerate(batch):
                some.append(text or "")
                held += len(some[-1])
                if held > TOGETHER or i + 1 == len(batch):
                    out += [[{"kind": KINDS[k], "start": a, "end": b, "base": of} for a, b, k, of in found] for found in found_spans(some, tagger)]
                    some, held = [], 0
            yield pd.Series(out, dtype=object)

    return docs.drop("spans").withColumn("spans", spans(F.col(text)))
