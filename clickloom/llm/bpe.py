"""Byte-level BPE: encoding to packed ids with offsets, and decoding.

Pre-token boundaries of a batch of texts come from one vectorised scan (`pretokens`); each distinct
pre-token is merged once per worker and then looked up. Ids are kept as packed little-endian
unsigned 32-bit integers, offsets likewise: the byte at which each token begins.

Ranks are read once on the driver (a vocabulary file has a fixed size) and broadcast.

Defined cases: a null text is empty and has no tokens; a null id array decodes to no bytes. Texts
of any length are scanned in chunks. Rows are treated each for itself, other columns are kept;
a column that already has an output's name is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from clickloom.llm.arrow import Step, mapped, with_columns
from clickloom.llm.pretokens import SEPARATOR, boundaries, code_points

# Distinct pre-tokens remembered by a worker; beyond it the memory is emptied, results are the same.
REMEMBERED = 200_000
# Characters of a batch that are scanned together.
TOGETHER = 1 << 18
# Longer pre-tokens are merged one by one.
LONG_PIECE = 512
NO_RANK = np.int64(1 << 62)


class Ranks(dict):
    """Token to rank; an object that can key a cache."""

    __hash__ = object.__hash__
    __eq__ = object.__eq__


def read_ranks(path: str) -> Ranks:
    """Ranks from lines of a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return Ranks((base64.b64decode(pair[0]), int(pair[1])) for pair in pairs if pair)


class Pairs(NamedTuple):
    """Mergeable pairs: sorted keys (left id, right id), their ranks, and the id that a rank makes."""

    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray

    @classmethod
    def of(cls, triples: list[tuple[int, int, int, int]]) -> Pairs:
        """From (left, right, rank, id)."""
        table = np.array(triples, np.int64).reshape(-1, 4)
        keys = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(keys)
        made = np.zeros(int(table[:, 2].max(initial=-1)) + 1, np.int64)
        made[table[:, 2]] = table[:, 3]
        return cls(keys[order], table[order, 2], made)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)


@lru_cache(maxsize=2)
def _pairs(ranks: Ranks) -> tuple[Pairs, np.ndarray]:
    """All pairs of tokens that make a token, and the id of each byte."""
    found = [
        (ranks[token[:at]], ranks[token[at:]], rank, rank)
        for token, rank in ranks.items()
        for at in range(1, len(token))
        if token[:at] in ranks and token[at:] in ranks
    ]
    single = np.array([ranks.get(bytes([byte]), 0) for byte in range(256)], np.int64)
    return Pairs.of(found), single


def merge(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """Packed ids of pre-tokens. Very long ones are merged one by one, by a heap."""
    ids: list[bytes] = [b""] * len(pieces)
    rest = []
    for at, piece in enumerate(pieces):
        whole = ranks.get(piece)
        if whole is not None:
            ids[at] = whole.to_bytes(4, "little")
        elif len(piece) > LONG_PIECE:
            ids[at] = np.array(_merge_long(piece, ranks), "<u4").tobytes()
        elif piece:
            rest.append(at)
    if rest:
        pairs, single = _pairs(ranks)
        symbols = single[np.frombuffer(b"".join([pieces[at] for at in rest]), np.uint8)]
        lengths = np.array([len(pieces[at]) for at in rest], np.int64)
        for at, packed in zip(rest, merge_symbols(symbols, lengths, pairs), strict=True):
            ids[at] = packed
    return ids


def merge_symbols(symbols: np.ndarray, lengths: np.ndarray, pairs: Pairs) -> list[bytes]:
    """Packed ids of sequences of symbols laid end to end, none of them empty. In each, again and
    again, the leftmost pair of the lowest rank becomes one; all take each such step together."""
    ids: list[bytes] = [b""] * len(lengths)
    owners = np.arange(len(lengths))
    pair = pairs.rank(symbols, np.append(symbols[1:], 0))
    pair[np.cumsum(lengths) - 1] = NO_RANK
    while True:
        starts = np.cumsum(lengths) - lengths
        least = np.minimum.reduceat(pair, starts)
        done = least == NO_RANK
        if done.any():
            packed = symbols.astype("<u4").tobytes()
            for owner, low, n in zip(owners[done].tolist(), starts[done].tolist(), lengths[done].tolist(), strict=True):
                ids[owner] = packed[4 * low : 4 * (low + n)]
            if done.all():
                return ids
            going = np.repeat(~done, lengths)
            symbols, pair = symbols[going], pair[going]
            lengths, owners, least = lengths[~done], owners[~done], least[~done]
        segment = np.repeat(np.arange(len(lengths)), lengths)
        lowest = np.flatnonzero(pair == least[segment])
        first = lowest[np.append(True, segment[lowest[1:]] != segment[lowest[:-1]])]
        symbols[first] = pairs.made[least]
        keep = np.ones(len(symbols), bool)
        keep[first + 1] = False
        symbols, pair, segment = symbols[keep], pair[keep], segment[keep]
        lengths = lengths - 1
        # Each sequence lost one symbol to the right of its merged pair.
        at = first - np.arange(len(first))
        for left in (at[at > 0] - 1, at):
            right = np.minimum(left + 1, len(symbols) - 1)
            inside = (left + 1 < len(symbols)) & (segment[left] == segment[right])
            pair[left] = np.where(inside, pairs.rank(symbols[left], symbols[right]), NO_RANK)


def _merge_long(piece: bytes, ranks: Ranks) -> list[int]:
    """One piece with a heap of pairs and linked parts, for pieces without a bound on their length."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here; 0: no part begins here
    previous = list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)

    def offer(start: int, stop: int) -> None:
        rank = ranks.get(piece[start:stop])
        if rank is not None:
            heappush(heap, (rank, start, stop))

    while heap:
        _, start, stop = heappop(heap)
        middle = end[start]
        if not middle or middle >= stop or end[middle] != stop:
            continue  # one of the two has changed meanwhile
        end[start], end[middle] = stop, 0
        if stop < n:
            previous[stop] = start
            offer(start, end[stop])
        if previous[start] >= 0:
            offer(previous[start], stop)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


class Merged(dict):
    """Pre-token to the packed ids of its tokens, filled as pre-tokens appear."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        return merge([piece.encode()], self.ranks)[0]

    def learn(self, texts: list[list[str]]) -> None:
        """Merge what is new in some texts' pre-tokens."""
        present = set().union(*texts)
        new = [piece for piece in present if piece not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(present)
        self.update(zip(new, merge([piece.encode() for piece in new], self.ranks), strict=True))


def packed_ids(texts: list[str], merged: Merged) -> Iterator[bytes]:
    """The packed ids of each text."""
    for group in together(texts):
        pieces = list(pieces_of(group))
        merged.learn(pieces)
        yield from (b"".join(map(merged.__getitem__, own)) for own in pieces)


def together(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts, so many that they make a scan worth while."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def pieces_of(texts: list[str]) -> Iterator[list[str]]:
    """The pre-tokens of each text, all texts in one scan."""
    points = [code_points(text) for text in texts]
    gap = np.array([SEPARATOR], np.uint32)
    begins = boundaries(np.concatenate([part for text in points for part in (text, gap)]))
    first = 0
    for text, own in zip(texts, points, strict=True):
        low, high = np.searchsorted(begins, (first, first + len(own)))
        starts = (begins[low:high] - first).tolist()
        yield [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=False)]
        first += len(own) + 1


class Vocabulary:
    """Ranks that reach the workers once, as a broadcast."""

    def __init__(self, spark, path: str):
        self.path = path
        self.broadcast = spark.sparkContext.broadcast(read_ranks(path))

    @property
    def value(self) -> Ranks:
        return self.broadcast.value

    def __eq__(self, other) -> bool:
        return isinstance(other, Vocabulary) and self.path == other.path

    def __hash__(self) -> int:
        return hash(self.path)


@lru_cache(maxsize=2)
def _tokens(ranks: Vocabulary) -> tuple[np.ndarray, list[bytes]]:
    tokens = [b""] * (max(ranks.value.values(), default=-1) + 1)
    for token, rank in ranks.value.items():
        tokens[rank] = token
    return np.array([len(token) for token in tokens], np.int64), tokens


@lru_cache(maxsize=2)
def _merged(ranks: Vocabulary) -> Merged:
    return Merged(ranks.value)


ENCODED = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("token_ids", T.BinaryType()),
    T.StructField("token_offsets", T.BinaryType()),
]
DECODED = [T.StructField("decoded", T.BinaryType())]


def encoder(vocabulary: Vocabulary, text_column: str = "text") -> Step:
    """Adds `n_tokens`, `token_ids` and `token_offsets`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _merged(vocabulary)
        lengths, _ = _tokens(vocabulary)
        for batch in batches:
            texts = [text or "" for text in batch.column(text_column).to_pylist()]
            ids = list(packed_ids(texts, merged))
            yield with_columns(
                batch,
                {
                    "n_tokens": pa.array([len(packed) >> 2 for packed in ids], pa.int64()),
                    "token_ids": pa.array(ids, pa.binary()),
                    "token_offsets": pa.array([_offsets(packed, lengths) for packed in ids], pa.binary()),
                },
            )

    return run


def _offsets(packed: bytes, lengths: np.ndarray) -> bytes:
    """Where each token begins in its text's bytes."""
    sizes = lengths[np.frombuffer(packed, "<u4")]
    return (np.cumsum(sizes) - sizes).astype("<u4").tobytes()


def decoder(vocabulary: Vocabulary, ids_column: str = "token_ids") -> Step:
    """Adds `decoded`, the bytes of packed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tokens = _tokens(vocabulary)
        for batch in batches:
            packed = batch.column(ids_column).to_pylist()
            texts = [
                b"".join(map(tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))
                for ids in packed
            ]
            yield with_columns(batch, {"decoded": pa.array(texts, pa.binary())})

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, text_column: str = "text") -> DataFrame:
    return mapped(docs, [encoder(vocabulary, text_column)], ENCODED)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_column: str = "token_ids") -> DataFrame:
    return mapped(encoded, [decoder(vocabulary, ids_column)], DECODED)
