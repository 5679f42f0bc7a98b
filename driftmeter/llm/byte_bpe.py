"""Byte-level BPE by ranks, encoded through prefixes: each byte prefix of a piece has one valid last token.

A sequence of tokens is what the merges give exactly if each pair of neighbours is, for two tokens alone, what the
merges give for their bytes (a valid pair). So the encoding of a prefix is known by its last token: the token t ending
there for which the prefix before it ends in a token that makes a valid pair with t. :class:`Prefixes` stores that token
for each prefix. Appending bytes only adds prefixes; after an edit only the prefixes behind it are computed again, up to
where the stored tokens meet the old ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmeter.llm.common import ship, unused

#: Pieces of a generation, of which a worker keeps two, and pairs that it keeps at most; a full table of pairs is emptied.
CACHED_PIECES = 250_000
CACHED_PAIRS = 400_000
#: Texts encoded together: their Python objects are gone before the next ones come.
TOGETHER = 512


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Ranks:
    """A vocabulary of byte strings by rank; a smaller rank is merged first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        # how long the tokens are that end in three given bytes, the longest first; shorter tokens may end anywhere
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                lengths.setdefault(token[-3:], set()).add(len(token))
        self.lengths = {tail: (*sorted(of, reverse=True), 2, 1) for tail, of in lengths.items()}
        self._pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int]] = {}

    def merge(self, raw: bytes, upto: int = 1 << 60) -> list[int]:
        """The definition: of all neighbouring parts, the pair whose joint rank is smallest is joined, the first of ties.
        Only ranks below upto are joined."""
        parts, ranks = [raw[i : i + 1] for i in range(len(raw))], self.ranks.get
        while len(parts) > 1:
            joint = [ranks(a + b, upto) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(joint)
            if least >= upto:
                break
            at = joint.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def reached(self, token: int) -> bool:
        """Do the merges make this token of its own bytes?"""
        known = self._pairs.get(-1 - token)
        if known is None:
            known = self._pairs[-1 - token] = self.merge(self.tokens[token]) == [token]
        return known

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose joining makes the token; the token twice where there are none."""
        known = self._halves.get(token)
        if known is None:
            parts = self.merge(self.tokens[token], token)
            known = self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else (token, token)
        return known

    def valid_pair(self, a: int, b: int) -> bool:
        """Would the merges of a's and b's bytes leave exactly a and b? Not if, at some moment before both are whole,
        the parts at their border join first; the parts there are found by taking the later made one apart."""
        key = a << 24 | b
        known = self._pairs.get(key)
        if known is not None:
            return known
        left, right, before, valid = a, b, 1 << 60, True
        while True:
            joint = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joint is not None and joint < before and self.halves(joint) == (left, right):
                valid = False
                break
            l_half, r_half = self.halves(left)[1], self.halves(right)[0]
            if l_half == left and r_half == right:
                break
            if r_half == right or (left > right and l_half != left):
                before, left = left, l_half
            else:
                before, right = right + 1, r_half
        if len(self._pairs) >= CACHED_PAIRS:
            self._pairs.clear()
        self._pairs[key] = valid
        return valid


class Prefixes:
    """The unique valid last token of each byte prefix of a piece."""

    def __init__(self, ranks: Ranks, raw: bytes = b""):
        self.ranks, self.raw, self.last = ranks, b"", [-1]
        self.append(raw)

    def _extend(self, raw: bytes, start: int, stop: int) -> Iterator[int]:
        """The tokens of the prefixes that are longer than start, up to stop bytes; last is read as they are added."""
        ranks, last, pairs, valid = self.ranks.ranks.get, self.last, self.ranks._pairs.get, self.ranks.valid_pair
        lengths, reached = self.ranks.lengths.get, self.ranks.reached
        for end in range(start + 1, stop + 1):
            for length in lengths(raw[end - 3 : end] if end > 2 else b"", (2, 1)):  # the longest first
                at = end - length
                if at > 0:
                    token = ranks(raw[at:end])
                    if token is not None and ((known := pairs(last[at] << 24 | token)) or known is None and valid(last[at], token)):
                        yield token
                        break
                elif not at:
                    token = ranks(raw[:end])
                    # a token of the vocabulary that the merges never make is not valid by itself
                    if token is not None and reached(token):
                        yield token
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        raw = self.raw + more
        add = self.last.append
        for token in self._extend(raw, len(self.raw), len(raw)):
            add(token)
        self.raw = raw

    def become(self, raw: bytes) -> None:
        """Another piece: the prefixes that it has in common with this one keep their tokens."""
        old, same = self.raw, 0
        for a, b in zip(old, raw, strict=False):
            if a != b:
                break
            same += 1
        del self.last[same + 1 :]
        self.raw = old[:same]
        self.append(raw[same:])

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Bytes start to stop become new. Behind them, prefixes are computed again only until as many in a row as the
        longest token has bytes keep the token they had: from there on, all keep it."""
        raw = self.raw[:start] + new + self.raw[stop:]
        old, shift, same = self.last, len(new) - (stop - start), 0
        self.last = old[: start + 1]
        for end, token in enumerate(self._extend(raw, start, len(raw)), start + 1):
            self.last.append(token)
            before = end - shift
            same = same + 1 if end > start + len(new) and old[before] == self.last[end] else 0
            if same >= self.ranks.longest:
                self.last += old[before + 1 :]
                break
        self.raw = raw

    def ids(self) -> list[int]:
        out, end = [], len(self.raw)
        while end:
            out.append(self.last[end])
            end -= len(self.ranks.tokens[self.last[end]])
        return out[::-1]


class Encoder:
    """Texts to ids and back; the pattern's matches are encoded each for itself.

    The pieces of some texts that are not known yet are encoded in order, so that each goes on from the prefix that it
    shares with the one before. Pieces are kept in two generations: a full one becomes the older, and the one before that
    goes; pieces that are asked for again move on.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = Ranks(ranks), regex.compile(pattern).findall
        self._pieces: dict[str, str] = {}
        self._older: dict[str, str] = {}
        self._bytes = {str(rank): token for token, rank in ranks.items()}

    def _learn(self, pieces: set[str]) -> dict[str, str]:
        """The ids of each piece in decimal, joined by commas."""
        known, older, ranks = self._pieces, self._older, self.ranks.ranks.get
        found, new = {}, []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                if (ids := older.get(piece)) is None:
                    raw = piece.encode()
                    whole = ranks(raw)  # a match that is a token is that token, whatever the merges would do
                    if whole is None:
                        new.append((raw, piece))
                        continue
                    ids = str(whole)
                if len(piece) <= 64:
                    known[piece] = ids
            found[piece] = ids
        prefixes = Prefixes(self.ranks)
        for raw, piece in sorted(new):
            prefixes.become(raw)
            found[piece] = ids = ",".join(map(str, prefixes.ids()))
            if len(piece) <= 64:
                known[piece] = ids
        if len(known) >= CACHED_PIECES:
            self._older, self._pieces = known, {}
        return found

    def encode_all(self, texts: list[str]) -> list[tuple[int, str]]:
        """For each text the number of ids, and the ids in decimal, joined by commas."""
        split = list(map(self.split, texts))
        of = self._learn(set().union(*split)).__getitem__
        joined = [",".join(map(of, pieces)) for pieces in split]
        return [(ids.count(",") + 1 if ids else 0, ids) for ids in joined]

    def encode(self, text: str) -> tuple[int, str]:
        return self.encode_all([text])[0]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids.split(","))) if ids else b""


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One for each worker process: what it has learnt of frequent pieces serves all its tasks."""
    key = (ranks_path, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(read_ranks(ranks_path), pattern)
    return _encoders[key]


def _coded(batches: Iterator[pa.Array], ranks_path: str, pattern: str, of, names: list[str], types: list) -> Iterator[pa.Array]:
    """A struct array for each TOGETHER texts of a batch: of(coder, n, ids) gives the values of a row."""
    coder = encoder(ranks_path, pattern)
    for batch in batches:
        for at in range(0, len(batch), TOGETHER):  # sent on at once: no batch is held whole in its coded form
            rows = [of(coder, *found) for found in coder.encode_all([t or "" for t in batch.slice(at, TOGETHER).to_pylist()])]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            del rows
    pa.default_memory_pool().release_unused()  # the worker stays, and so would what its batches took


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids (decimal, joined by commas; kept as text, which Arrow and Parquet pack well) and the
    bytes decoded from those ids (decoded), in place of earlier columns of these names.

    Null texts count as empty and give no ids. Rows are independent: nothing is shuffled, long texts are encoded whole.
    The file of ranks is read by each worker from ranks_path, which must exist on every executor.
    """
    ship(docs.sparkSession)

    def row(coder: Encoder, n: int, ids: str) -> tuple:
        return n, ids, coder.decode(ids)

    @F.arrow_udf("n_tokens long, ids string, decoded binary")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _coded(batches, ranks_path, pattern, row, ["n_tokens", "ids", "decoded"], [pa.int64(), pa.string(), pa.binary()])

    return _with(docs, tokens(F.col(text)), ["n_tokens", "ids", "decoded"])


def digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens and the lowercase hex SHA-256 of its ids (ids_sha256) and of the decoded bytes."""
    ship(docs.sparkSession)

    def row(coder: Encoder, n: int, ids: str) -> tuple:
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _coded(batches, ranks_path, pattern, row, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()])

    return _with(docs, hashed(F.col(text)), ["n_tokens", "ids_sha256", "decoded_sha256"])


def _with(docs: DataFrame, coded, names: list[str]) -> DataFrame:
    rest = [c for c in docs.columns if c not in names]
    held = unused(docs.columns, "coded")
    fields = [F.col(f"`{held}`.{n}").alias(n) for n in names]
    return docs.select(*[F.col(f"`{c}`") for c in rest], coded.alias(held)).select(*[F.col(f"`{c}`") for c in rest], *fields)
