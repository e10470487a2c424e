from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from clickloom.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The trie of the contract, prefix by prefix."""
    own: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            record = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(conv, []).append((turn is not None, turn or 0, record, role, text))
    turns = {c: [t[3:] for t in sorted(found)] for c, found in own.items()}
    nodes: dict[tuple, dict] = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seq = tuple(turns.get(base, [])[:h] + mine[h:])
        for d in range(len(seq) + 1):
            node = nodes.setdefault(seq[:d], {"members": [], "ends": []})
            node["members"].append(c)
            if d == len(seq):
                node["ends"].append(c)
    out = set()
    for prefix, node in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(q[:-1] == p for q in nodes if q)]
        saved = sum((len(nodes[p]["members"]) - 1) * len(p[-1][1]) for p in below if p)
        ends = hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest()
        out.add((
            min(node["members"]), len(prefix), min(nodes[prefix[:-1]]["members"]) if prefix else None,
            len(node["members"]), len(children), len(leaves), saved, ends,
        ))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def found(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def conversations(seed, n=160, texts=3):
    random.seed(seed)
    return [
        (c, t, random.choice(["user", "assistant", None]), random.choice(["", None, "é" * 3, "hello", "bye"][:texts + 2]))
        for c in random.sample(range(-150, 600), n)
        for t in range(random.choice([0, 1, 2, 3, 4, 9]))
    ]


@pytest.mark.parametrize("shard", [1, 7, 60, prefix_trie.SHARD_TURNS])
def test_equals_brute_force_however_shards_are_cut(spark, staging, shard):
    rows = conversations(shard)
    assert found(prefix_trie.trie(table(spark, rows), staging, shard)) == brute(rows)


def test_nulls_ties_repeats_and_turnless(spark, staging):
    rows = [
        (None, 0, "user", "lost"), (7, None, "user", "first"), (7, 0, None, None), (7, 0, None, None),
        (7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "assistant", "a"), (8, 0, "user", "x"), (300, 5, "a", "bc"),
        (301, 5, "ab", "c"),
    ]
    docs = table(spark, rows).withColumns({c: F.lit(9) for c in ("base", "record", "seq", "key", "n", "depth", "own")})
    assert found(prefix_trie.trie(docs, staging)) == brute(rows)
    # A conversation of one turn that its base does not give it has none.
    turnless = next(c for c in range(401, 499) if zlib.crc32(str(c).encode()) % 6)
    assert found(prefix_trie.trie(table(spark, [(turnless, 0, "user", "x")]), staging)) == {
        (turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())
    }


def test_empty_table(spark, staging):
    assert prefix_trie.trie(table(spark, []), staging).count() == 0


def test_many_copies_and_long_conversations(spark, staging, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 64)
    rows = [(c, t, "user", "same") for c in range(300) for t in range(8)]
    rows += [(c, t, "user", f"{t % 5}") for c in (1000, 1001, 2000) for t in range(3000)]
    nodes = {(r.conv_id, r.depth): r for r in prefix_trie.trie(table(spark, rows), staging, 100).collect()}
    root = nodes[0, 0]
    assert (root.n_convs, root.n_children, root.n_leaves) == (303, 2, 2)
    # Depth 8 of the copies, and every turn of the long ones that more than one of them shares.
    assert root.saved_tokens == 299 * 8 * 4 + 2 * 3000
    copies = ",".join(map(str, range(300))).encode()
    assert nodes[0, 8].ends_sha256 == hashlib.sha256(copies).hexdigest()
    assert nodes[1000, 3000].n_convs == 3 and len(nodes) == 1 + 8 + 3000


def test_trees_are_balanced():
    tree = prefix_trie.TernaryTree()
    for i in prefix_trie.medians(1023):
        tree.insert([i], i)

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.low[node]), height(tree.high[node]))

    assert height(tree.down[0]) == 10
    assert sorted(prefix_trie.medians(37)) == list(range(37))
    assert len(tree.traversed()) == 1024
