from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clickloom.llm import spelling

ASCII = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(docs):
    words = counted(docs)
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, len(around[w]), form[w], words.get(form[w]), root))
    return out


def found(frame):
    rows = [tuple(r) for r in frame.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(rows) == len({r[0] for r in rows})
    return set(rows)


def corpus(seed, alphabet, n=40):
    random.seed(seed)
    stock = ["".join(random.choices(alphabet, k=random.randint(4, 8))) for _ in range(60)]
    texts = []
    for i in range(n):
        words = [random.choice(stock[: 3 + i]) for _ in range(random.randint(0, 120))]
        texts.append((i, random.choice([" ", ", ", "1"]).join(w.upper() if random.random() < 0.1 else w for w in words)))
    return texts


@pytest.mark.parametrize(("seed", "alphabet"), [(1, "ab"), (2, "abcdeé"), (3, "aàÿÀbz"), (4, "abcdefghijklmnopqrst")])
def test_equals_brute_force(spark, staging, documents, seed, alphabet):
    docs = corpus(seed, alphabet)
    frame = documents(*[t for _, t in docs], ids=[i for i, _ in docs])
    assert found(spelling.variants(frame, staging)) == brute(docs)


def test_nulls_repeats_long_runs_and_clashing_columns(spark, staging, documents):
    long_run = "qx" * 20_000
    texts = [None, "", "   ", "token tokem " * 4, "token " * 9, "token " * 9, f"{long_run} {long_run}a " * 3, "ÉTÉÉÉÉ étéÉÉÉ " * 3]
    ids = [None, 1, 2, 3, 3, 3, None, 5]
    frame = documents(*texts, ids=ids).withColumns({c: F.lit(1) for c in ("word", "n", "run", "h", "sig", "role", "form", "id")})
    docs = list(zip(ids, texts, strict=True))
    result = found(spelling.variants(frame, staging))
    assert result == brute(docs)
    assert ("tokem", 4, 1, "token", 22, "token") in result


def test_empty_table(spark, staging, documents):
    assert spelling.variants(documents(), staging).count() == 0
    assert spelling.variants(documents(None, "", "one two"), staging).count() == 0


def test_forms_are_followed_to_the_last(spark, staging):
    rows = [("w0", None), *[(f"w{i}", f"w{i - 1}") for i in range(1, 20)], ("alone", None)]
    formed = spark.createDataFrame(rows, "word string, form string")
    result = dict(map(tuple, spelling.roots(formed, staging).collect()))
    assert result == {**{f"w{i}": "w0" for i in range(20)}, "alone": "alone"}


def test_signatures_meet_for_every_near_pair():
    random.seed(5)
    words = {"".join(random.choices("abcé", k=random.randint(5, 9))) for _ in range(250)}
    counts = Counter(e for w in words for e in spelling.elements(w) if e[1] < spelling.OCCURRENCES)
    equal, unlike = spelling.signer(counts, spelling.PARTS, 2), spelling.signer(counts, spelling.PARTS_UNLIKE, 1)
    for a in words:
        for b in words:
            if near(a, b) and len(a) == len(b):
                assert set(equal(a, len(a))) & set(equal(b, len(b)))
            elif near(a, b) and len(a) < len(b):
                assert set(unlike(a, len(a))) & set(unlike(b, len(b) - 1))
