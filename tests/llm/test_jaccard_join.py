from __future__ import annotations

import random
import time

import numpy as np
import pytest

from clickloom.llm import jaccard_join as jj
from frames import rows

VOCABULARY = [f"w{i}" for i in range(60)]


def corpus(seed, n=60):
    rnd = random.Random(seed)
    passage = " ".join(rnd.choice(VOCABULARY) for _ in range(30))
    texts = [None, "", " \t\n", "one", "ONE", "one two", "two one", "one two three"]
    for _ in range(n):
        words = [rnd.choice(VOCABULARY) for _ in range(rnd.choice([4, 9, 10, 11, 40, 120]))]
        texts.append(" ".join(words) + rnd.choice(["", " " + passage]))
    for _ in range(n):
        words = rnd.choice(texts[8:]).split()
        for _ in range(rnd.choice([0, 1, 1, 2, 3])):
            words[rnd.randrange(len(words))] = rnd.choice(VOCABULARY)
        texts.append(rnd.choice([" ", "  ", "\n"]).join(words).upper() if rnd.random() < 0.3 else " ".join(words))
    return texts


def plain_set(text, n):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(texts, n, num, den):
    sets = [plain_set(text, n) for text in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                one, other = root(i), root(j)
                label[max(one, other)] = min(one, other)
    return [(i, len(sets[i]), root(i)) for i in range(len(texts))]


@pytest.mark.parametrize(("seed", "n", "num", "den", "block"), [(1, 3, 90, 100, 256), (2, 5, 80, 100, 3), (3, 2, 70, 100, 2)])
def test_components_equal_brute_force(documents, staging, seed, n, num, den, block):
    texts = corpus(seed)
    docs = documents(*texts).withColumnRenamed("lang", "node")
    found = jj.jaccard_components(docs, staging, n, num, den, block=block)
    assert sorted(rows(found)) == brute(texts, n, num, den)


def test_a_large_group_of_near_copies(documents, staging):
    rnd = random.Random(7)
    base = [f"v{i}" for i in range(80)]
    texts = []
    for _ in range(150):
        words = list(base)
        words[rnd.randrange(80)] = f"x{rnd.randrange(1000)}"
        texts.append(" ".join(words))
    found = jj.jaccard_components(documents(*texts), staging, 3, 90, 100, block=16)
    assert sorted(rows(found)) == brute(texts, 3, 90, 100)


def test_any_linked_sets_share_a_tile():
    rnd = np.random.default_rng(5)
    for num, den in ((90, 100), (80, 100)):
        bands = jj.Bands(num, den)
        for _ in range(400):
            size = int(rnd.integers(1, 200))
            one = np.unique(rnd.integers(0, 2**63, size).astype(np.uint64))
            drop = int(rnd.integers(0, len(one) // 5 + 1))
            other = np.unique(np.concatenate([one[drop:], rnd.integers(0, 2**63, int(rnd.integers(0, size // 5 + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(one, other))
            if not len(other) or both * den < num * (len(one) + len(other) - both):
                continue
            assert np.intersect1d(jj.tile_keys(one, bands), jj.tile_keys(other, bands)).size
            differ = jj.differing_bits(
                jj.bitmap(one, jj.bitmap_size(len(one))).tobytes(), jj.bitmap(other, jj.bitmap_size(len(other))).tobytes()
            )
            assert differ <= len(one) + len(other) - 2 * both


def test_unlike_sets_do_not_meet_in_empty_parts():
    rnd = np.random.default_rng(8)
    for num, den in ((90, 100), (80, 100)):
        bands = jj.Bands(num, den)
        sets = [np.unique(rnd.integers(0, 2**63, int(rnd.integers(40, 400))).astype(np.uint64) * np.uint64(2)) for _ in range(300)]
        keys = np.concatenate([np.unique(jj.tile_keys(one, bands)) for one in sets])
        assert len(np.unique(keys)) > 0.99 * len(keys)
        told = [sum(bands.told(len(one), band) for band in bands.of(len(one))) for one in sets]
        assert [len(jj.tile_keys(one, bands)) for one in sets] == told


def test_shuffle_files_go_as_soon_as_a_table_is_written(spark, documents, staging, monkeypatch):
    kept, put = {}, jj.Staging.put
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    def putting(self, frame, name):
        before = shuffled()
        out = put(self, frame, name)
        deadline = time.monotonic() + 10
        while (left := shuffled() - before) and time.monotonic() < deadline:
            time.sleep(0.05)
        kept[name] = kept.get(name, 0) + len(left)
        return out

    monkeypatch.setattr(jj.Staging, "put", putting)
    before = spark.conf.get(jj.CLEANUP)
    found = jj.jaccard_components(documents(*corpus(1)), staging)
    assert {"shared", "sets", "members", "pairs", "components", "labels"} <= set(kept)
    assert not any(kept.values())
    assert spark.conf.get(jj.CLEANUP) == before
    assert sorted(rows(found)) == brute(corpus(1), 3, 90, 100)


def test_chains_repeated_rows_null_ids_and_empty_tables(spark, documents, staging):
    docs = documents("a b c d", "a b c d", "a b c d", "x y z", None, ids=[7, 7, None, 9, 3])
    found = jj.jaccard_components(docs, staging)
    assert sorted(rows(found), key=str) == sorted([(7, 2, 7), (7, 2, 7), (None, 2, 7), (9, 1, 9), (3, 0, 3)], key=str)
    assert jj.jaccard_components(docs.limit(0), staging).count() == 0
    links = [(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(40)]
    labels = jj.components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in links], "a binary, b binary"), staging)
    assert {bytes(label) for _, label in rows(labels)} == {b"000"} and labels.count() == 41


def near_copies(n):
    """Texts that differ from one in a few words: many pairs link, none by a single hub."""
    rnd = random.Random(n)
    base = [f"v{i}" for i in range(200)]
    texts = []
    for i in range(n):
        words = list(base)
        for _ in range(rnd.choice([1, 2, 3])):
            words[rnd.randrange(200)] = f"x{rnd.randrange(10_000)}"
        texts.append(" ".join(words))
    return texts


def test_pairs_grow_with_the_nodes_of_a_group(documents, staging, monkeypatch):
    """Twice the near copies: about twice the pairs that are compared exactly, not four times."""
    seen = []
    verified = jj._verified

    def counting(pairs, *more):
        seen[-1] += pairs.count()
        return verified(pairs, *more)

    monkeypatch.setattr(jj, "_verified", counting)
    for n in (200, 400):
        seen.append(0)
        texts = near_copies(n)
        assert sorted(rows(jj.jaccard_components(documents(*texts), staging))) == brute(texts, 3, 90, 100)
    assert seen[1] < 3 * seen[0]


def test_shared_tiles_are_found_however_rows_are_packed(monkeypatch):
    rnd = np.random.default_rng(3)
    tiles = rnd.integers(0, 60, 500).astype(np.uint64)
    shorts = rnd.integers(0, 9, 500).astype(np.uint64)
    nodes = {}
    for tile, short in zip(tiles.tolist(), shorts.tolist(), strict=True):
        nodes.setdefault(tile, set()).add(short)
    expected = {(t, s) for t, found in nodes.items() if len(found) > 1 for s in found}
    for held in (1, 10, 10_000):
        monkeypatch.setattr(jj, "HELD_PAIRS", held)
        packed = []
        for bucket in range(3):
            mine = tiles % np.uint64(3) == bucket
            pairs = np.column_stack([tiles[mine], shorts[mine]])
            packed += [(bucket, pairs[low : low + 7].tobytes()) for low in range(0, len(pairs), 7)]
        batch = jj.pa.RecordBatch.from_arrays([jj.pa.array(c) for c in zip(*packed, strict=True)], names=["bucket", "pairs"])
        out = [row for b in jj._shared_pairs(iter([batch])) for row in zip(*b.to_pydict().values(), strict=True)]
        assert set(out) == expected


def test_one_of_each_loses_no_distinct_text(spark, documents, staging):
    long = [f"u{i}" for i in range(60)]
    other = " ".join(long[:59] + ["z"])
    texts = [" ".join(long), other, "a quite different text of six words", " ".join(long), "", "", None, "solo words here", "solo words here", "without id", "without id"]
    ids = [4, 9, 4, 2, 5, 5, 6, 8, 8, None, None]
    docs = documents(*texts, ids=ids).withColumnRenamed("lang", "digest").withColumnRenamed("source", "node")
    found = jj.one_of_each(docs, staging)
    assert found.columns == docs.columns
    assert sorted(rows(found.select("doc_id", "text")), key=str) == sorted(
        [(2, " ".join(long)), (4, texts[2]), (5, ""), (5, ""), (6, None), (8, "solo words here"), (None, "without id")], key=str
    )
    assert jj.one_of_each(docs.limit(0), staging).count() == 0
