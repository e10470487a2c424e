"""Token counts that follow edits.

Counting a document keeps a segment tree over its pre-tokens: how many characters and how many
tokens each holds, summed upwards. An edit finds its place by descending through the character
sums, re-encodes the pre-tokens it touches and the few whose boundaries could depend on it, stops
where old and new boundaries meet again, and updates the sums on the way up.

Trees travel as a column of packed lengths and counts, so counts can be kept with the documents
and brought up to date by later edits, without reading a whole text again.

Defined cases: a null text is empty, has no tokens and an empty tree. Edits are (start, stop,
replacement) in characters of the text as given; a null replacement deletes, places beyond the text
mean its end, a null edit or list does nothing, and an edit that begins inside an earlier one
is left out. Rows are treated each for itself; other columns are kept, outputs replace columns of
the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from clickloom.llm.arrow import Step, mapped, unused, with_columns
from clickloom.llm.bpe import Merged, Vocabulary, _merged, pieces_of, together
from clickloom.llm.pretokens import pre_tokens

# Pre-tokens of a block, the leaf of the tree; a block that outgrows it fourfold rebuilds the tree.
BLOCK = 64
# How many characters before an edit a pre-token may end and still depend on it, and how near
# to the end of a looked-at window a boundary may still change.
CONTEXT = 2
MARGIN = 4
# Characters looked at beyond an edit at first; doubled until boundaries meet.
REACH = 64

Edit = tuple[int, int, str]
COUNTED = [T.StructField("n_tokens", T.LongType()), T.StructField("token_tree", T.BinaryType())]
RECOUNTED = [T.StructField("n_edits", T.LongType()), T.StructField("n_reencoded", T.LongType())]
ARROW_EDITS = pa.list_(
    pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("replacement", pa.string())])
)


class PreTokenTree:
    """Characters and tokens per pre-token, in blocks under a binary tree of sums."""

    def __init__(self, lengths: list[int], counts: list[int]):
        self._build(lengths, counts)

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        self.blocks = [
            (lengths[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(lengths), BLOCK)
        ] or [([], [])]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars = np.zeros(2 * self.width, np.int64)
        self.tokens = np.zeros(2 * self.width, np.int64)
        for at, (own_lengths, own_counts) in enumerate(self.blocks, self.width):
            self.chars[at], self.tokens[at] = sum(own_lengths), sum(own_counts)
        level = self.width
        while level > 1:
            half = level // 2
            for sums in (self.chars, self.tokens):
                sums[half:level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level = half

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    def find(self, place: int) -> tuple[int, int, int]:
        """Block, index in it and first character of the pre-token that ends after `place`
        (past the last one, if none does)."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if begin + self.chars[node] <= place:
                begin += int(self.chars[node])
                node += 1
        block = min(node - self.width, len(self.blocks) - 1)
        if node - self.width > block:
            begin = self.n_chars - int(self.chars[self.width + block])
        lengths = self.blocks[block][0]
        for index, length in enumerate(lengths):
            if begin + length > place:
                return block, index, begin
            begin += length
        return block, len(lengths), begin

    def ends_from(self, block: int, index: int) -> Iterator[tuple[int, int, int]]:
        """Block, index after it and length of the pre-tokens from a place on."""
        while block < len(self.blocks):
            lengths = self.blocks[block][0]
            for at in range(index, len(lengths)):
                yield block, at + 1, lengths[at]
            block, index = block + 1, 0

    def replace(
        self, first: tuple[int, int], last: tuple[int, int], lengths: list[int], counts: list[int]
    ) -> None:
        """Put new pre-tokens for those from `first` up to `last` (block, index)."""
        (block, index), (end_block, end_index) = first, last
        kept = [
            self.blocks[block][k][:index] + new + self.blocks[end_block][k][end_index:]
            for k, new in ((0, lengths), (1, counts))
        ]
        self.blocks[block] = (kept[0], kept[1])
        for between in range(block + 1, end_block + 1):
            self.blocks[between] = ([], [])
        if len(kept[0]) > 4 * BLOCK:
            self._build(*self.flat())
            return
        for changed in range(block, end_block + 1):
            self._update(changed)

    def _update(self, block: int) -> None:
        node = self.width + block
        self.chars[node], self.tokens[node] = (sum(part) for part in self.blocks[block])
        while node > 1:
            node //= 2
            for sums in (self.chars, self.tokens):
                sums[node] = sums[2 * node] + sums[2 * node + 1]

    def flat(self) -> tuple[list[int], list[int]]:
        lengths = [n for block in self.blocks for n in block[0]]
        return lengths, [n for block in self.blocks for n in block[1]]

    def pack(self) -> bytes:
        return pack(*self.flat())

    @classmethod
    def unpack(cls, packed: bytes | None) -> PreTokenTree:
        if not packed:
            return cls([], [])
        lengths, counts = np.frombuffer(packed[1:], f"<u{packed[0]}").reshape(2, -1).tolist()
        return cls(lengths, counts)


def pack(lengths: list[int], counts: list[int]) -> bytes:
    """Width in bytes, then all lengths, then all counts."""
    if not lengths:
        return b""
    largest = max(max(lengths), max(counts))
    width = 1 if largest < 1 << 8 else 2 if largest < 1 << 16 else 4
    return bytes([width]) + np.array([lengths, counts], f"<u{width}").tobytes()


def apply_edit(text: str, tree: PreTokenTree, edit: Edit, count: Callable[[str], int]) -> tuple[str, int]:
    """The edited text, and how many characters were encoded anew; the tree is brought up to date."""
    start, stop, replacement = edit
    shift = len(replacement) - (stop - start)
    edited = text[:start] + replacement + text[stop:]
    block, index, begin = tree.find(max(start - CONTEXT, 0))
    reach = REACH
    while True:
        window_end = min(stop + shift + reach, len(edited))
        pieces = pre_tokens(edited[begin:window_end])
        certain = window_end if window_end == len(edited) else window_end - MARGIN
        met = _meeting(tree, (block, index), begin, pieces, stop + shift, shift, certain)
        if met is not None:
            used, last = met
            lengths = [len(piece) for piece in pieces[:used]]
            tree.replace((block, index), last, lengths, [count(piece) for piece in pieces[:used]])
            return edited, sum(lengths)
        if window_end == len(edited):
            lengths = [len(piece) for piece in pieces]
            end = len(tree.blocks) - 1
            last = (end, len(tree.blocks[end][0]))
            tree.replace((block, index), last, lengths, [count(piece) for piece in pieces])
            return edited, sum(lengths)
        reach *= 2


def _meeting(
    tree: PreTokenTree,
    first: tuple[int, int],
    begin: int,
    pieces: list[str],
    resumed: int,
    shift: int,
    certain: int,
) -> tuple[int, tuple[int, int]] | None:
    """How many new pre-tokens there are before old and new boundaries meet, and up to which old
    one they replace."""
    old = tree.ends_from(*first)
    old_end, last = begin, first
    new_end = begin
    for used, piece in enumerate(pieces, 1):
        new_end += len(piece)
        if new_end > certain:
            return None
        if new_end < resumed:
            continue
        while old_end + shift < new_end:
            step = next(old, None)
            if step is None:
                return None
            last, old_end = (step[0], step[1]), old_end + step[2]
        if old_end + shift == new_end and old_end >= resumed - shift:
            return used, last
    return None


def usable_edits(edits: list[dict] | None, n_chars: int) -> list[Edit]:
    """Edits inside the text, by place; one that begins inside an earlier one is left out. Of those
    with equal starts insertions come first, then the longest."""
    clipped = []
    for edit in edits or []:
        if edit is None or edit["start"] is None or edit["stop"] is None:
            continue
        start = min(max(edit["start"], 0), n_chars)
        clipped.append((start, min(max(edit["stop"], start), n_chars), edit["replacement"] or ""))
    kept: list[Edit] = []
    for edit in sorted(clipped, key=lambda edit: (edit[0], edit[0] < edit[1], -edit[1], edit[2])):
        if not kept or edit[0] >= kept[-1][1]:
            kept.append(edit)
    return kept


def joined_edits(text: str, edits: list[Edit]) -> list[Edit]:
    """Edits so near to each other that their regions would meet become one."""
    groups: list[list[Edit]] = []
    for edit in edits:
        if groups and edit[0] - groups[-1][-1][1] <= REACH:
            groups[-1].append(edit)
        else:
            groups.append([edit])
    joined = []
    for group in groups:
        parts, at = [], group[0][0]
        for start, stop, replacement in group:
            parts += [text[at:start], replacement]
            at = stop
        joined.append((group[0][0], at, "".join(parts)))
    return joined


def counter(vocabulary: Vocabulary, text_column: str = "text") -> Step:
    """Adds `n_tokens` and `token_tree`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _merged(vocabulary)
        for batch in batches:
            totals, trees = [], []
            for group in together([text or "" for text in batch.column(text_column).to_pylist()]):
                pieces = list(pieces_of(group))
                merged.learn(pieces)
                for own in pieces:
                    counts = [len(packed) >> 2 for packed in map(merged.__getitem__, own)]
                    totals.append(sum(counts))
                    trees.append(pack(list(map(len, own)), counts))
            new = {"n_tokens": pa.array(totals, pa.int64()), "token_tree": pa.array(trees, pa.binary())}
            yield with_columns(batch, new)

    return run


def recounter(vocabulary: Vocabulary, edits_column: str = "edits", text_column: str = "text") -> Step:
    """Makes the edits and brings text, `token_tree` and `n_tokens` up to date; adds `n_edits` and
    `n_reencoded`, the characters that were encoded anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _merged(vocabulary)
        for batch in batches:
            inputs = [batch.column(c).to_pylist() for c in (text_column, "token_tree", edits_column)]
            rows = [edited_row(merged, *row) for row in zip(*inputs, strict=True)]
            names = (text_column, "n_tokens", "token_tree", "n_edits", "n_reencoded")
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield with_columns(
                batch, {n: pa.array(v, k) for n, v, k in zip(names, columns, kinds, strict=True)}
            )

    return run


def edited_row(merged: Merged, text: str | None, packed: bytes | None, edits: list[dict] | None):
    """Text, tokens, tree, edits made and characters encoded anew. Later places come first, so
    that earlier ones stay where they are."""
    usable = usable_edits(edits, len(text or ""))
    if not usable:
        total = int(np.frombuffer(packed[1:], f"<u{packed[0]}").reshape(2, -1)[1].sum()) if packed else 0
        return text, total, packed or b"", 0, 0
    tree, encoded = PreTokenTree.unpack(packed), 0
    text = text or ""
    for edit in reversed(joined_edits(text, usable)):
        text, anew = apply_edit(text, tree, edit, lambda piece: len(merged[piece]) >> 2)
        encoded += anew
    return text, tree.n_tokens, tree.pack(), len(usable), encoded


def edit_finder(
    patterns: list[tuple[str, str]], text_column: str = "text", into: str = "edits"
) -> Step:
    """Adds the edits that replace every match of some patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = [(regex.compile(pattern), replacement) for pattern, replacement in patterns]
        for batch in batches:
            edits = [
                [
                    {"start": match.start(), "stop": match.end(), "replacement": replacement}
                    for pattern, replacement in compiled
                    for match in pattern.finditer(text or "")
                ]
                for text in batch.column(text_column).to_pylist()
            ]
            yield with_columns(batch, {into: pa.array(edits, ARROW_EDITS)})

    return run


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, text_column: str = "text") -> DataFrame:
    """`docs` with `n_tokens` and `token_tree`."""
    return mapped(docs, [counter(vocabulary, text_column)], COUNTED)


def recount(
    counted: DataFrame, vocabulary: Vocabulary, edits_column: str = "edits", text_column: str = "text"
) -> DataFrame:
    """`counted` after the edits in a column of (start, stop, replacement)."""
    fields = [T.StructField(text_column, T.StringType()), *COUNTED, *RECOUNTED]
    return mapped(counted, [recounter(vocabulary, edits_column, text_column)], fields)


def count_edited(
    docs: DataFrame,
    vocabulary: Vocabulary,
    patterns: list[tuple[str, str]],
    text_column: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Counts before and after the edits that replace all matches of `patterns`, in one pass:
    `docs` (edited) with `tokens_before`, `n_tokens`, `token_tree`, `n_edits`, `n_reencoded`."""

    def remember(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield with_columns(batch, {"tokens_before": batch.column("n_tokens")})

    edits = unused("edits", docs.columns)
    steps = [
        counter(vocabulary, text_column),
        remember,
        edit_finder(patterns, text_column, edits),
        recounter(vocabulary, edits, text_column),
    ]
    fields = [*COUNTED, T.StructField("tokens_before", T.LongType()), *RECOUNTED]
    return mapped(docs, steps, fields, keep)
