from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clickloom.llm import packing
from frames import rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_TOKEN]


def check(found, texts, library, limit, segments):
    pieces = [r.asDict() for r in found.collect()]
    for doc_id, text in enumerate(texts):
        own = sorted((p for p in pieces if p["doc_id"] == doc_id), key=lambda p: p["start"])
        joined = [i for p in own for i in np.frombuffer(bytes(p["ids"]), "<u4").tolist()]
        assert joined == library(text)
        assert [p["start"] for p in own] == np.cumsum([0, *[p["length"] for p in own]])[:-1].tolist()
        assert {p["doc_tokens"] for p in own} == {len(joined)}
    sequences: dict[int, list[dict]] = {}
    for piece in pieces:
        sequences.setdefault(piece["sequence_id"], []).append(piece)
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        lengths = [p["length"] for p in own]
        assert [p["offset"] for p in own] == np.cumsum([0, *lengths])[:-1].tolist()
        total = sum(lengths)
        assert total <= limit and len(own) <= segments and total & (total - 1) == 0
    return sequences


SIGNS = "aBc'sTre ÉéßΣσİıſǅﬁ中０９٣12.,!? \ń 　x²½"


@pytest.mark.parametrize(("limit", "segments"), [(2048, 64), (64, 3), (16, 16)])
def test_every_token_is_in_one_piece(spark, documents, library, limit, segments):
    rnd = random.Random(limit)
    texts = [None, "", "word " * 700, "Hello, world. It's <|endoftext|> fine!"]
    texts += ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    docs = documents(*texts).withColumnRenamed("lang", "ids").repartition(3, "doc_id")
    found = packing.pack(docs, packing.TokenizerFile(spark, PATH), limit, segments)
    sequences = check(found, texts, library, limit, segments)
    full = sum(sum(p["length"] for p in own) == limit for own in sequences.values())
    if segments * 20 > limit:
        assert full >= 0.8 * len(sequences)


def test_separators_that_only_python_takes_for_white_space_are_encoded(spark, documents, library):
    rnd = random.Random(7)
    signs = SIGNS + "\x1c\x1d\x1e\x1f\x85\u2028"
    texts = ["a\x1cb", "a\x1d\x1e b", "\x1f", "end.\x1c", " \x1e\n"]
    texts += ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    found = packing.pack(documents(*texts).withColumnRenamed("lang", "ids"), packing.TokenizerFile(spark, PATH))
    check(found, texts, library, packing.LIMIT, packing.SEGMENTS)


def test_loss_limit_and_prompts(spark):
    texts = [f"one two three four five six {i}" for i in range(40)]
    docs = spark.createDataFrame([(i, t, 4) for i, t in enumerate(texts)], "doc_id long, text string, prompt long")
    found = packing.pack(docs, packing.TokenizerFile(spark, PATH), 64, 64, loss=16, prompt_column="prompt")
    loss: dict[int, int] = {}
    for start, length, sequence in rows(found, "start", "length", "sequence_id"):
        loss[sequence] = loss.get(sequence, 0) + max(0, start + length - max(start, 4))
    assert max(loss.values()) <= 16
    assert sum(loss.values()) == sum(t - 4 for (t,) in rows(found.select("doc_id", "doc_tokens").distinct(), "doc_tokens"))


def test_empty_tables_and_repeated_rows(spark, documents):
    file = packing.TokenizerFile(spark, PATH)
    docs = documents("same", "same", ids=[1, 1])
    assert sum(n for (n,) in rows(packing.pack(docs, file), "length")) == 4
    assert packing.pack(docs.limit(0), file).count() == 0


ALPHABETS = [
    "aBzÉéW\u030aẘΣσİıſǅK\u1e9e", "'.,!?;:$%*-_()<>|@#&", "0９٣²½中한ア😀\u200d\u0301", " \n\t\x1c\u3000",
]


def test_ids_are_the_library_s_whatever_ends_a_word(library):
    class File:
        class broadcast:
            value = open(PATH, encoding="utf-8").read()

    words = packing.WordIds(File)
    rnd = random.Random(5)
    special = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "it's", "I'LL'"]
    texts = ["a <|endoftext|> b", "WORD<|endoftext|>...", "W\u030a.", "word's'", "A.B.", "x" * 5000 + "!!", "<|endoftext|>" * 3]
    for _ in range(1500):
        signs = rnd.choice([*ALPHABETS, "".join(ALPHABETS)]) + rnd.choice(ALPHABETS)
        parts = [rnd.choice([rnd.choice(signs), rnd.choice(signs), rnd.choice(special)]) for _ in range(rnd.randint(1, 14))]
        texts.append("".join(parts))
    end = [packing.END_TOKEN]
    for text, ids in zip(texts, words.texts(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() + end == library(text), text
    assert np.frombuffer(next(words.texts(["a <|endoftext|> b"])), "<u4").tolist() == [320, 49407, 321]
