from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T

from clickloom.llm import bpe, pretokens, token_counts
from clickloom.llm.arrow import mapped
from frames import rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SIGNS = "ab'strevlmdST 19 \n\t\u3000\x85éß!'.-中文🙂\u0301 "

EDITS_FIELD = T.StructField(
    "edits",
    T.ArrayType(
        T.StructType(
            [T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("replacement", T.StringType())]
        )
    ),
)


def random_texts(n, seed, signs=SIGNS, most=60):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def ids(texts):
    merged = bpe.Merged(RANKS)
    return [np.frombuffer(packed, "<u4").tolist() for packed in bpe.packed_ids(texts, merged)]


@pytest.mark.parametrize("chunk", [1 << 19, 97])
def test_ids_equal_the_library(monkeypatch, chunk):
    monkeypatch.setattr(pretokens, "CHUNK", chunk)
    texts = random_texts(1500, 1) + random_texts(1500, 2, "'rest ve\n", 30)
    assert ids(texts) == [LIBRARY.encode_ordinary(text) for text in texts]


def test_every_code_point_has_the_library_s_class():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(points), 50_000):
        texts = [f"a{chr(c)}a 1{chr(c)}1" for c in points[low : low + 50_000 : 7]]
        assert ids(texts) == [LIBRARY.encode_ordinary(text) for text in texts]


def test_long_pieces_and_a_forgetful_memory(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    texts = ["abc" * 3000 + "é" * 700, "x" * 5000, "one two three four five six seven", "", "eight nine ten " * 50]
    assert ids(texts) == [LIBRARY.encode_ordinary(text) for text in texts]


def test_encode_decode_round_trip(spark, documents):
    texts = ["Don't stop. 12 'll\n\n x", None, "", "中文 é", "Don't stop. 12 'll\n\n x"]
    vocabulary = bpe.Vocabulary(spark, PATH)
    docs = documents(*texts).withColumnRenamed("lang", "n_tokens")
    found = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).orderBy("doc_id").collect()
    for row, text in zip(found, texts, strict=True):
        expected = LIBRARY.encode_ordinary(text or "")
        assert np.frombuffer(bytes(row.token_ids), "<u4").tolist() == expected
        assert row.n_tokens == len(expected) and bytes(row.decoded) == (text or "").encode()
        begins = np.frombuffer(bytes(row.token_offsets), "<u4").tolist()
        ends = [*begins[1:], len((text or "").encode())][: len(begins)]
        assert [(text or "").encode()[a:b] for a, b in zip(begins, ends, strict=True)] == [
            LIBRARY.decode_single_token_bytes(i) for i in expected
        ]
    assert bpe.encode(docs.limit(0), vocabulary).count() == 0


def brute_edit(text, edits):
    for start, stop, new in reversed(token_counts.usable_edits(edits, len(text))):
        text = text[:start] + new + text[stop:]
    return text


def test_counts_follow_edits():
    rnd = random.Random(5)
    merged = bpe.Merged(RANKS)
    count = lambda piece: len(merged[piece]) >> 2
    for turn in range(600):
        text = random_texts(1, turn, most=rnd.choice([5, 60, 600]))[0]
        pieces = pretokens.pre_tokens(text)
        packed = token_counts.pack([len(p) for p in pieces], [count(p) for p in pieces])
        edits = [
            {"start": a, "stop": a + rnd.randint(0, 9), "replacement": rnd.choice([None, "", *random_texts(3, turn + 7)])}
            for a in (rnd.randint(0, len(text) + 2) for _ in range(rnd.randint(0, 5)))
        ]
        edited, total, tree, made, encoded = token_counts.edited_row(merged, text, packed, edits)
        assert edited == brute_edit(text, edits)
        after = pretokens.pre_tokens(edited)
        assert total == len(LIBRARY.encode_ordinary(edited))
        assert tree == token_counts.pack([len(p) for p in after], [count(p) for p in after])


def test_an_edit_encodes_only_its_surroundings():
    merged = bpe.Merged(RANKS)
    text = "word and other words " * 5000
    pieces = pretokens.pre_tokens(text)
    packed = token_counts.pack([len(p) for p in pieces], [len(merged[p]) >> 2 for p in pieces])
    edit = [{"start": 50_003, "stop": 50_004, "replacement": "X"}]
    edited, total, _, _, encoded = token_counts.edited_row(merged, text, packed, edit)
    assert total == len(LIBRARY.encode_ordinary(edited))
    assert 0 < encoded < 100


def test_counts_as_frames(spark, documents):
    vocabulary = bpe.Vocabulary(spark, PATH)
    docs = documents("mail a.b@c.org now!!! 123456", None, "", "plain", "plain")
    patterns = [(r"\S+@\S+", "<mail>"), (r"!{2,}", "!")]
    found = token_counts.count_edited(docs, vocabulary, patterns).orderBy("doc_id").collect()
    assert [r.n_edits for r in found] == [2, 0, 0, 0, 0]
    for row in found:
        assert row.n_tokens == len(LIBRARY.encode_ordinary(row.text or ""))
    assert found[0].text == "mail <mail> now! 123456"
    counted = token_counts.count_tokens(docs, vocabulary)
    edits = mapped(counted, [token_counts.edit_finder(patterns)], [EDITS_FIELD])
    again = token_counts.recount(edits, vocabulary).orderBy("doc_id")
    assert rows(again, "n_tokens") == [(r.n_tokens,) for r in found]
    assert token_counts.count_edited(docs.limit(0), vocabulary, patterns).count() == 0


def test_the_wider_of_two_edits_with_one_start_wins(spark, documents):
    from clickloom.llm.queries import CLEAN_UP

    vocabulary = bpe.Vocabulary(spark, PATH)
    found = token_counts.count_edited(documents("to 12345678@qq.com now"), vocabulary, CLEAN_UP).first()
    assert (found.text, found.n_edits) == ("to <mail> now", 1)
    assert found.n_tokens == len(LIBRARY.encode_ordinary(found.text))
    edits = [{"start": 3, "stop": stop, "replacement": new} for stop, new in ((5, "a"), (3, "b"), (9, "c"))]
    assert token_counts.usable_edits(edits, 20) == [(3, 3, "b"), (3, 9, "c")]


def test_an_edits_column_of_the_input_stays(spark):
    docs = spark.createDataFrame([(1, "a  b!!", "mine", 9)], "doc_id long, text string, edits string, N_TOKENS int")
    vocabulary = bpe.Vocabulary(spark, PATH)
    found = token_counts.count_edited(docs, vocabulary, [(r"!{2,}", "!")])
    assert found.columns.count("edits") == 1 and "N_TOKENS" not in found.columns
    row = found.first()
    assert (row.edits, row.text, row.n_edits) == ("mine", "a  b!", 1)
