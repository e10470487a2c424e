"""Packing documents into training sequences as vector bin packing.

A piece takes tokens, one of the sequence's segments, and the tokens among its own that bear loss.
A sequence takes, again and again, the waiting piece with the largest dot product of its demands
and what is left of the three limits; if none fits whole, the largest is cut to fill the rest.

Sequences are `limit` tokens long. One that cannot be filled (the end of a partition, or too many
small segments) is cut back to a power of two, and what is over waits for the next; a sequence
of such a length needs no padding.

Each task packs its own partition as it streams by, with a bounded number of waiting pieces, so
there is no shuffle and nothing is gathered. Sequence ids hold the number of the partition, so a
task that is run again gives the same ones as long as its input comes in the same order, as it does
from files.

Defined cases: a null text is empty; its document is the end token alone. Repeated rows are packed
each for itself. Other columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.arrow import slices
from clickloom.llm.bpe import Pairs, merge_symbols
from clickloom.llm.pretokens import WHITE_SPACE

LIMIT = 2048
SEGMENTS = 64
END_TOKEN = 1
# Waiting pieces, each shorter than a sequence, among which the next one is chosen.
WAITING = 1024
# Distinct words remembered by a worker; beyond it the memory is emptied.
REMEMBERED = 600_000
LONGEST_REMEMBERED = 64
PARTITION_SHIFT = 33
# Signs that end a word stand apart from it in the tokenizer as well, if what is before them is
# surely a letter or digit after normalising: Latin ones, but for the dotted capital I. Special tokens
# end with another sign, so they are never cut.
SIGNS = "[!-/:;=?@\\[-`{|}~]"
BEFORE = "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]"
TRAILING = re.compile(f"{SIGNS}(?<={BEFORE}{SIGNS}){SIGNS}*(?=[ \n]|\\Z)")
# What every special token begins with.
SPECIAL = "<|"
# Signs that are white space to `str.split` alone; the tokenizer encodes them.
ENCODED_SEPARATORS = "\x1c\x1d\x1e\x1f"
WORD = re.compile(f"[^{''.join(map(chr, WHITE_SPACE))}]+")
PIECE = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class TokenizerFile:
    """A tokenizers file, read on the driver and broadcast as text (its size is fixed)."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            self.broadcast = spark.sparkContext.broadcast(file.read())
        self.path = path

    def __eq__(self, other) -> bool:
        return isinstance(other, TokenizerFile) and self.path == other.path

    def __hash__(self) -> int:
        return hash(self.path)


def byte_signs() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself where it is printable
    Latin-1, else the next one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(byte) if byte in printable else chr(next(others)) for byte in range(256)]


def words_of(text: str) -> list[str]:
    """What stands between the tokenizer's white space, and signs that end words by themselves."""
    text = TRAILING.sub(r" \g<0>", text)
    if any(sign in text for sign in ENCODED_SEPARATORS):
        return WORD.findall(text)
    return text.split()


def lowered(text: str) -> str:
    """The text in lower case where the tokenizer makes the same of both: its composed form is taken
    before its small letters, which depend on no context there. Special tokens are told by case."""
    if SPECIAL in text:
        return text
    small = text.lower()
    if text.isascii():
        return small
    alike = is_normalized("NFC", text) and "\u03a3" not in text and "\u0130" not in text
    return small if alike and is_normalized("NFC", small) else text


def plain_word(word: str) -> bytes | None:
    """The lower-case bytes of a word of letters, where that needs no context; else null."""
    if not word.isalpha() or "\u03a3" in word or not is_normalized("NFC", word):
        return None
    small = word.lower()
    return small.encode() if small.isalpha() else None


class WordIds(dict):
    """Word between white space to its packed ids. The tokenizer drops white space and nothing
    reaches across it, so a text's ids are those of its words."""

    def __init__(self, file: TokenizerFile):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file.broadcast.value)
        model = json.loads(file.broadcast.value)["model"]
        vocabulary = model["vocab"]
        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.pairs = Pairs.of(
            [(vocabulary[a], vocabulary[b], rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)]
        )
        signs = byte_signs()
        self.inner = np.array([vocabulary[sign] for sign in signs], np.int64)
        self.last = np.array([vocabulary[sign + model["end_of_word_suffix"]] for sign in signs], np.int64)

    def _encode(self, words: list[str]) -> list[bytes]:
        """Words of letters alone are merged together here; the library splits and merges the rest."""
        plain = [plain_word(word) for word in words]
        found = iter(self._merged([word for word in plain if word is not None]))
        split = iter(self._split([word for word, own in zip(words, plain, strict=True) if own is None]))
        return [next(split) if own is None else next(found) for own in plain]

    def _split(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(word.ids, "<u4").tobytes() for word in found]

    def _merged(self, words: list[bytes]) -> list[bytes]:
        if not words:
            return []
        symbols = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.array([len(word) for word in words], np.int64)
        ends = np.cumsum(lengths) - 1
        ids = self.inner[symbols]
        ids[ends] = self.last[symbols[ends]]
        return merge_symbols(ids, lengths, self.pairs)

    def __missing__(self, word: str) -> bytes:
        return self._encode([word])[0]

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        split = [words_of(lowered(text)) for text in texts]
        present = [word for word in set().union(*split) if len(word) <= LONGEST_REMEMBERED]
        new = list(filterfalse(self.__contains__, present))
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = present
        self.update(zip(new, self._encode(new), strict=True))
        for words in split:
            yield b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=1)
def _word_ids(file: TokenizerFile) -> WordIds:
    return WordIds(file)


class Packer:
    """Pieces wait as (document, first token, ids); the three demands are kept as arrays."""

    def __init__(self, limit: int, segments: int, loss: int, first_sequence: int):
        self.limits = np.array([limit, segments, loss], float)
        self.waiting: list[tuple[int, int, bytes, int, int]] = []
        self.demand = np.empty((0, 3))
        self.sequence = first_sequence
        self.done: list[tuple] = []

    def add(self, items: list[tuple[int, int, bytes, int, int]]) -> None:
        """Items: document, first token, packed ids, tokens of the document, its prompt's tokens."""
        self.waiting += items
        self.demand = np.concatenate([self.demand, self._demands(items)])

    def _demands(self, items) -> np.ndarray:
        rows = [(len(ids) >> 2, 1, _loss(start, ids, prompt)) for _, start, ids, _, prompt in items]
        return np.array(rows, float).reshape(-1, 3)

    def pack(self, until: int) -> None:
        """Fill sequences while more than `until` pieces wait."""
        while len(self.waiting) > until:
            gone = np.zeros(len(self.waiting), bool)
            back: list[tuple[int, int, bytes, int, int]] = []
            while (~gone).sum() + len(back) > until and not gone.all():
                back += self._sequence(gone)
                if len(back) > WAITING:
                    break
            left = [item for item, taken in zip(self.waiting, gone.tolist(), strict=True) if not taken]
            self.demand = self.demand[~gone]
            self.waiting = left
            self.add(back)

    def _sequence(self, gone: np.ndarray) -> list[tuple[int, int, bytes, int, int]]:
        """Fill one sequence; returns what was cut off."""
        rest, chosen, over = self.limits.copy(), [], []
        scaled = self.demand / self.limits
        while rest[0] > 0 and rest[1] > 0:
            fits = ~gone & (self.demand <= rest).all(1)
            if fits.any():
                value = np.where(fits, scaled @ (rest / self.limits), -1.0)
                at = int(np.argmax(value))
                chosen.append(self.waiting[at])
                gone[at] = True
                rest = rest - self.demand[at]
                continue
            # Nothing fits whole: cut the largest to what is left of tokens and loss.
            at = int(np.argmax(np.where(gone, -1.0, self.demand[:, 0])))
            if gone[at]:
                break
            document, start, ids, total, prompt = self.waiting[at]
            free = max(0, prompt - start)
            room = int(min(rest[0], free + rest[2], len(ids) >> 2))
            if room <= 0:
                break
            gone[at] = True
            chosen.append((document, start, ids[: 4 * room], total, prompt))
            if 4 * room < len(ids):
                over.append((document, start + room, ids[4 * room :], total, prompt))
            rest = rest - np.array([room, 1, _loss(start, ids[: 4 * room], prompt)])
        return over + self._close(chosen)

    def _close(self, chosen: list[tuple[int, int, bytes, int, int]]) -> list[tuple[int, int, bytes, int, int]]:
        """Write a sequence, cut back to a power of two if it is not full."""
        tokens = sum(len(piece[2]) >> 2 for piece in chosen)
        target = tokens if tokens == self.limits[0] else 1 << (tokens.bit_length() - 1)
        offset, back = 0, []
        for document, start, ids, total, prompt in chosen:
            room = min(len(ids) >> 2, target - offset)
            if room:
                self.done.append((document, start, room, total, self.sequence, offset, ids[: 4 * room]))
                offset += room
            if 4 * room < len(ids):
                back.append((document, start + room, ids[4 * room :], total, prompt))
        self.sequence += 1
        return back

    def whole(self, document: int, start: int, ids: bytes, total: int) -> None:
        """A full sequence of one document."""
        self.done.append((document, start, len(ids) >> 2, total, self.sequence, 0, ids))
        self.sequence += 1


def _loss(start: int, ids: bytes, prompt: int) -> int:
    stop = start + (len(ids) >> 2)
    return max(0, stop - max(start, prompt))


def pack(
    docs: DataFrame,
    file: TokenizerFile,
    limit: int = LIMIT,
    segments: int = SEGMENTS,
    loss: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    prompt_column: str | None = None,
    end_token: int = END_TOKEN,
) -> DataFrame:
    """(id, start, length, doc_tokens, sequence_id, offset, ids) per piece, its ids packed.

    `loss`: the limit of loss-bearing tokens (`limit`, if not given). `prompt_column` names the
    number of a document's first tokens that bear none.
    """
    loss = limit if loss is None else loss
    if min(limit, segments, loss) < 1 or limit & (limit - 1):
        raise ValueError("limits must be positive, the limit of tokens a power of two")
    prompt = F.lit(0) if prompt_column is None else F.coalesce(F.col(prompt_column), F.lit(0))
    rows = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), prompt.cast("long").alias("prompt")
    )
    id_type = rows.schema["id"].dataType.simpleString()
    end = np.array([end_token], "<u4").tobytes()
    fields = ["start", "length", "doc_tokens", "sequence_id", "offset"]

    def written(packer: Packer, keys: dict[int, object], id_arrow: pa.DataType) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(packer.done), 512):
            part = packer.done[low : low + 512]
            columns = [pa.array([keys[row[0]] for row in part], id_arrow)]
            columns += [pa.array([row[at] for row in part], pa.int64()) for at in range(1, 6)]
            columns.append(pa.array([row[6] for row in part], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", *fields, "ids"])
        packer.done = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(file)
        task = TaskContext.get()
        packer = Packer(limit, segments, loss, (task.partitionId() if task else 0) << PARTITION_SHIFT)
        keys: dict[int, object] = {}
        number, id_arrow = 0, None
        for batch in slices(batches):
            id_arrow = batch.schema.field("id").type
            texts = [text or "" for text in batch.column("text").to_pylist()]
            prompts = batch.column("prompt").to_pylist()
            tails = []
            for key, prompt_tokens, ids in zip(
                batch.column("id").to_pylist(), prompts, words.texts(texts), strict=True
            ):
                ids += end
                total, start = len(ids) >> 2, 0
                keys[number] = key
                # Whole sequences need no choice, if loss and segments allow them.
                while total - start >= limit and _loss(start, ids[4 * start : 4 * (start + limit)], prompt_tokens) <= loss:
                    packer.whole(number, start, ids[4 * start : 4 * (start + limit)], total)
                    start += limit
                if start < total:
                    tails.append((number, start, ids[4 * start :], total, prompt_tokens))
                number += 1
            packer.add(tails)
            if len(packer.waiting) > 2 * WAITING:
                packer.pack(WAITING)
            if len(packer.done) >= 512:
                yield from written(packer, keys, id_arrow)
                held = {item[0] for item in packer.waiting}
                keys = {at: key for at, key in keys.items() if at in held}
        packer.pack(0)
        if packer.done:
            yield from written(packer, keys, id_arrow)

    packed = rows.mapInArrow(run, f"id {id_type}, {PIECE}")
    return packed.withColumnRenamed("id", id_column)
