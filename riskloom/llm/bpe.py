"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Bytes form a doubly linked list.  Each adjacent pair that is in the vocabulary is put into the bucket
of its merge rank (list positions), and the rank's bit is set in a bitmap of three levels of 64-bit
words.  Find-first-set on the levels gives the lowest non-empty rank in constant time; its bucket is
emptied from left to right, and entries are skipped when the list has changed under them (the node is
gone, or its pair no longer has that rank).  A pre-token of n bytes takes O(n) queue entries whatever
its length; nothing is rescanned for the best pair.

Merges never cross pre-tokens, so one queue serves all new distinct pre-tokens of a batch laid end to
end: a popped bucket then holds many positions, which are merged together with numpy.  Two events make
the order inside a bucket matter: overlapping pairs, which are resolved left to right, and a merge
that creates a pair of a *lower* rank, upon which that one pre-token is encoded again alone, strictly
one leftmost lowest merge after the other.

The ids of distinct pre-tokens are remembered inside a task up to a bound; forgetting only costs time.  The
vocabulary (a public file, its path a parameter) is read by the driver and sent to the executors as
one broadcast variable of about 1 MB, a size fixed by the file.

Rows: a null text is empty; an empty text has no ids.  Batches are cut by text size, so very long
texts meet few others.  Repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.llm.common import give_back, record_batch, text_or_empty, tidy

MEMO_PIECES = 100_000
BATCH_CHARS = 250_000
_WORD = 64

# Fixed value: the splitting pattern of the public byte-level vocabularies.
BYTE_LEVEL_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class RankQueue:
    """Buckets by rank below ``size``, with the lowest non-empty rank at hand."""

    def __init__(self, size: int):
        self.levels = []
        while True:
            words = -(-size // _WORD)
            self.levels.append([0] * words)
            if words == 1:
                break
            size = words
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, entry) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(entry)
            return
        self.buckets[rank] = [entry]
        for level in self.levels:
            word = rank // _WORD
            before = level[word]
            level[word] = before | (1 << (rank % _WORD))
            if before:
                return
            rank = word

    def pop(self) -> tuple[int, list] | None:
        """The lowest rank and its entries, which leave the queue."""
        if not self.buckets:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank * _WORD + (word & -word).bit_length() - 1
        at = rank
        for level in self.levels:
            word = at // _WORD
            level[word] &= ~(1 << (at % _WORD))
            if level[word]:
                break
            at = word
        return rank, self.buckets.pop(rank)


class Vocabulary:
    """Token bytes by id and the ranks of pairs of ids, from {token bytes: rank}."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if self.single.min() < 0:
            raise ValueError("the rank file has no token for some bytes")
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_ranks = np.array(values, np.int64)[order]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that the ids a and b make together, -1 if there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token, by single merges in strict order of (rank, position)."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n = len(piece)
        ranks, tokens, queue = self.ranks, self.tokens, RankQueue(len(self.tokens))
        ids = [int(self.single[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n

        def renew(i: int, right: int) -> int:
            r = pair[i] = ranks.get(tokens[ids[i]] + tokens[ids[right]], -1) if right < n else -1
            if r >= 0:
                queue.push(r, i)
            return r

        for i in range(n - 1):
            renew(i, i + 1)
        while (top := queue.pop()) is not None:
            rank, positions = top
            positions.sort()
            for done, i in enumerate(positions):
                if pair[i] != rank:
                    continue
                gone = after[i]
                nxt = after[gone]
                ids[i], ids[gone], pair[gone], after[i] = rank, -1, -1, nxt
                if nxt < n:
                    before[nxt] = i
                new = [renew(i, nxt)]
                if before[i] >= 0:
                    new.append(renew(before[i], i))
                if any(0 <= r < rank for r in new):
                    for rest in positions[done + 1:]:
                        queue.push(rank, rest)
                    break
        return [i for i in ids if i >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[list[int], list[int]]:
        """(ids, cuts) of many non-empty pre-tokens in one rank queue: piece p has ids[cuts[p]:cuts[p + 1]]."""
        if not pieces:
            return [], [0]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(size)
        starts = ends - size
        n = int(ends[-1])
        ids = np.append(self.single[np.frombuffer(b"".join(pieces), np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[starts] = n, n  # node n stands for "none"
        pair = np.full(n + 1, -1, np.int64)
        pair[:n - 1] = self.pair_rank(ids[:n - 1], ids[1:n])
        pair[ends - 1] = -1
        queue, marked, seat, again = RankQueue(len(self.tokens)), np.zeros(n + 1, bool), np.zeros(n + 1, np.int64), []

        def push(at: np.ndarray) -> None:
            r = pair[at]
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            lows, highs = [0, *cuts.tolist()], [*cuts.tolist(), len(r)]
            for rank, lo, hi in zip(r[lows].tolist(), lows, highs, strict=True):
                queue.push(rank, at[lo:hi])

        push(np.arange(n))
        while (top := queue.pop()) is not None:
            rank, entries = top
            at = entries[0] if len(entries) == 1 else np.concatenate(entries)
            at = at[pair[at] == rank]
            if len(entries) > 1:  # a position may have been entered twice
                turn = np.arange(len(at))
                seat[at] = turn
                at = at[seat[at] == turn]
            if not len(at):
                continue
            marked[at] = True
            if marked[after[at]].any():  # overlapping pairs: from left to right
                chosen = []
                for i in sorted(at.tolist()):
                    if marked[i]:
                        marked[after[i]] = False
                        chosen.append(i)
                marked[at] = False
                at = np.array(chosen)
                marked[at] = True
            gone = after[at]
            nxt = after[gone]
            ids[at], ids[gone], pair[gone], after[at] = rank, -1, -1, nxt
            before[nxt] = at
            prev = before[at]
            prev = prev[~marked[prev] & (prev < n)]
            marked[at] = False
            touched = np.concatenate((at, prev))
            new = self.pair_rank(ids[touched], ids[after[touched]])
            pair[touched] = new
            lower = touched[(new >= 0) & (new < rank)]
            if len(lower):
                for p in np.unique(np.searchsorted(ends, lower, "right")).tolist():
                    again.append(p)
                    pair[starts[p]:ends[p]] = -1  # out of this queue
            push(touched)
        keep = ids[:n] >= 0
        flat = ids[:n][keep].tolist()
        cuts = np.concatenate(([0], np.cumsum(np.add.reduceat(keep.astype(np.int64), starts)))).tolist()
        # Merged to more than one token: those set aside, and whole tokens, which no merges need to give.
        alone = sorted({*again, *(p for p, x in enumerate(pieces) if x in self.ranks and cuts[p + 1] - cuts[p] > 1)})
        if alone:
            parts, last = [], 0
            grown = np.diff(cuts)
            for p in alone:
                own = self.encode_piece(pieces[p])
                parts += [flat[last:cuts[p]], own]
                last, grown[p] = cuts[p + 1], len(own)
            parts.append(flat[last:])
            flat = [i for part in parts for i in part]
            cuts = [0, *np.cumsum(grown).tolist()]
        return flat, cuts

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def splitter(pattern: str):
    """The function from a text to its pre-tokens.

    For the usual pattern, texts of Latin-1 characters take the same classes spelt out for ``re``,
    which is several times faster; letters come first, as no other branch can match where they do.
    """
    split = regex.compile(pattern).findall
    if pattern != BYTE_LEVEL_PATTERN:
        return split
    latin = [chr(c) for c in range(256)]
    letters, numbers, spaces = ("".join(map(re.escape, filter(regex.compile(c).match, latin)))
                                for c in (r"\p{L}", r"\p{N}", r"\s"))
    fast = re.compile(f" ?[{letters}]+| ?[{numbers}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{spaces}{letters}{numbers}]+"
                      f"|[{spaces}]+(?![^{spaces}])|[{spaces}]+").findall

    def by_kind(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return split(text)
        return fast(text)

    return by_kind


class Encoder:
    """Pre-tokenisation around a vocabulary; the ids of distinct pre-tokens are kept end to end in one array."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, splitter(pattern)
        self.forget()

    def forget(self) -> None:
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.ids, self.cuts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids in self.arrays(texts)]

    def arrays(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; pre-tokens that are not known yet are encoded together first."""
        if len(self.index) > MEMO_PIECES:
            self.forget()
        known, number = len(self.index), self.index.__getitem__
        coded = [np.fromiter(map(number, pieces), np.int64, len(pieces)) for pieces in map(self.split, texts)]
        ids, cuts = self.vocabulary.encode_pieces(
            [p.encode("utf-8", "surrogatepass") for p in islice(self.index, known, None)])
        self.cuts = np.concatenate((self.cuts, np.array(cuts[1:], np.int64) + len(self.ids)))
        self.ids = np.concatenate((self.ids, np.array(ids, np.int32)))
        for codes in coded:
            start, size = self.cuts[codes], self.cuts[codes + 1] - self.cuts[codes]
            ends = np.cumsum(size)
            yield self.ids[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


_ENCODERS: dict = {}


@contextmanager
def _encoder(ranks, name: str, pattern: str) -> Iterator[Encoder]:
    """This Python worker's encoder for the vocabulary of that name; what it remembers ends with the task."""
    if (name, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name, pattern] = Encoder(Vocabulary(ranks.value), pattern)
    encoder = _ENCODERS[name, pattern]
    try:
        yield encoder
    finally:
        encoder.forget()
        give_back()


def _sent(spark, vocabulary_path: str):
    """(broadcast ranks, a name for them) of a vocabulary file."""
    ranks = read_ranks(vocabulary_path)
    return spark.sparkContext.broadcast(ranks), hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()


def _portions(texts: Iterable[str]) -> Iterator[list[str]]:
    """Consecutive texts of about BATCH_CHARS together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, vocabulary_path: str, pattern: str = BYTE_LEVEL_PATTERN) -> DataFrame:
    """``docs`` with ``ids`` (array of int): the tokens of each whole text."""
    ranks, name = _sent(docs.sparkSession, vocabulary_path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with _encoder(ranks, name, pattern) as encoder:
            for texts in batches:
                yield pd.Series([i for part in _portions(texts) for i in encoder.arrays(part)], dtype=object)

    return docs.withColumn("ids", ids(text_or_empty()))


def decode(rows: DataFrame, vocabulary_path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded`` (binary): the bytes of an array of token ids; null ids give null."""
    tokens = rows.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(vocabulary_path)).tokens)

    @F.pandas_udf("binary")
    def back(lists):
        return lists.map(lambda i: None if i is None else b"".join(tokens.value[x] for x in i))

    return rows.withColumn("decoded", back(ids))


def round_trip(docs: DataFrame, vocabulary_path: str, pattern: str = BYTE_LEVEL_PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip_ok for every row; the ids stay in the task."""
    ranks, name = _sent(docs.sparkSession, vocabulary_path)
    schema = T.StructType.fromDDL(
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip_ok boolean")
    target = to_arrow_schema(schema)

    @tidy
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _encoder(ranks, name, pattern) as encoder:
            decimal, vocabulary = encoder.vocabulary.decimal.__getitem__, encoder.vocabulary
            for batch in batches:
                out = []
                for part in _portions(t.as_py() for t in batch.column(1)):
                    for text, found in zip(part, encoder.arrays(part), strict=True):
                        ids = found.tolist()
                        decoded = vocabulary.decode(ids)
                        out.append((len(ids), hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest(),
                                    hashlib.sha256(decoded).hexdigest(), decoded == text.encode("utf-8", "surrogatepass")))
                yield record_batch(target, [batch.column(0), *(zip(*out, strict=True) if out else [[]] * 4)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(digest, schema)
