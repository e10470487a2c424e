"""Prefix trie of conversations by ternary search trees.

A turn becomes a record of 20 bytes: half a SHA-256 of its role and text, and the text's length. A
conversation is its records in order, and a node of the trie is a prefix of such a sequence. Equal
sequences are folded into one with a count; the distinct ones are range-partitioned and sorted, so
what shares a prefix lies together. A shard is a stretch of at most `SHARD_TURNS` turns of that order:
its records are numbered by a dictionary of its own and its sequences are inserted into a ternary
search tree, the median first, then the medians of both halves, so that siblings stay balanced. One
traversal without recursion then sums members, leaves and savings from the leaves up.

A node that reaches beyond its shard lies on the path of the shard's first or last sequence. Only
these nodes are merged by key. What two neighbours count twice lies on the path that the last sequence
of one shares with the first of the next, so each border sends one row of corrections per node of that
path, and the merge is a sum.

At scale: texts are read once and do not travel; a row is 20 bytes per turn. Copies of a sequence are
reduced before the shards are cut, so a group of copies is one row, and a common first turn is no key
of any shuffle but that of the parent's number, which is salted. The ids of copies are joined to
texts of `CHUNK_BYTES` in sorted stretches over all tasks; only these texts of one sequence meet in one
task, streamed through the digest, which is sequential by its nature. A conversation is the unit: its
records, 20 bytes a turn (72 while they are sorted), are held by one task, and so are at most a hundred
conversations that share a base while its first turns are handed on, spilled to disk where they do not
fit. One row per shard is ordered in one task.

Defined cases: rows without a conv_id are no conversation; turns of equal number are ordered by their
records, rows that repeat stay turns of their own; null role and text are empty; a conversation
without turns ends at the root; the remainder of a negative id is negative, as in SQL; an empty table
has no nodes, not even a root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.arrow import Step
from clickloom.sources.staging import Staging

RECORD = 20
# Turns that a shard's tree holds; a single longer sequence is a shard of its own.
SHARD_TURNS = 50_000
# Ids joined into one text before they meet the others of their sequence.
CHUNK_BYTES = 1 << 16
# Copies of the merged nodes, so that the children of a common one are spread.
SALTS = 16
# Rows of a batch that leaves a task.
OUT_ROWS = 1 << 14

# Turns that a conversation may take from its base.
HEAD = 5
BASE = 100

NO_MEMBERS = hashlib.sha256(b"").hexdigest()


# --- sequences -----------------------------------------------------------------------------


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and seq: the first h turns of the base conversation, then the conversation's own after
    its first h. h is the checksum of the id modulo six, the base is the id without its last two
    digits."""
    role, text = (F.coalesce(name, F.lit("")) for name in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    record = F.concat(digest, F.lpad(F.hex(F.length(text)), 8, "0"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        (F.col("conv_id") - F.col("conv_id") % BASE).alias("base"), "conv_id", "turn", record.alias("record")
    )
    # One shuffle serves the turns of a conversation and those of its base.
    listed = F.sort_array(F.collect_list(F.struct("turn", "record"))).getField("record")
    own = turns.repartition("base").groupBy("base", "conv_id").agg(listed.alias("own"))
    head = F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, HEAD))
    given = F.first(head, ignorenulls=True).over(Window.partitionBy("base"))
    kept = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)
    joined = own.select("conv_id", "own", F.coalesce(given, F.array().cast("array<string>")).alias("given"), kept.cast("int").alias("h"))
    records = F.concat(
        F.slice("given", F.lit(1), F.col("h")),
        F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))),
    )
    return joined.select("conv_id", F.unhex(F.array_join(records, "")).alias("seq"))


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """seq, its number of conversations, the smallest of them, and the digest of all their ids."""
    keyed = sequences.withColumn("key", F.unhex(F.sha2("seq", 256)))
    ordered = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = ordered.mapInArrow(_id_chunks, "key binary, seq binary, first long, n long, ids string")
    together = chunks.repartition("key").sortWithinPartitions("key", "first")
    return together.mapInArrow(_id_digests, "seq binary, n long, first long, ends string")


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "seq", "first", "n", "ids"]
    out: list[tuple] = []
    ids: list[str] = []
    at, seq, first, length = None, b"", 0, 0

    def close() -> None:
        if ids:
            out.append((at, seq, first, len(ids), ",".join(ids)))
            ids.clear()

    for batch in batches:
        for conv_id, text, key in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seq", "key")), strict=True):
            if key != at or length >= CHUNK_BYTES:
                close()
                at, seq, first, length = key, text, conv_id, 0
            ids.append(str(conv_id))
            length += len(ids[-1]) + 1
        if len(out) >= OUT_ROWS:
            yield _batch(out, names)
            out = []
    close()
    yield from _batches(out, names)


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["seq", "n", "first", "ends"]
    out: list[tuple] = []
    at, seq, n, first, digest = None, b"", 0, 0, hashlib.sha256()
    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != at:
                if at is not None:
                    out.append((seq, n, first, digest.hexdigest()))
                at, seq, n, first, digest = row["key"], row["seq"], 0, row["first"], hashlib.sha256()
            elif n:
                digest.update(b",")
            digest.update(row["ids"].encode())
            n += row["n"]
        if len(out) >= OUT_ROWS:
            yield _batch(out, names)
            out = []
    if at is not None:
        out.append((seq, n, first, digest.hexdigest()))
    yield from _batches(out, names)


_TYPES = {"key": pa.binary(), "seq": pa.binary(), "parent_key": pa.binary(), "first_seq": pa.binary(), "last_seq": pa.binary(), "ids": pa.string(), "ends": pa.string()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, _TYPES.get(name, pa.int64())) for c, name in zip(columns, names, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _batches(rows: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(rows), OUT_ROWS):
        yield _batch(rows[low : low + OUT_ROWS], names)


# --- a shard's tree ------------------------------------------------------------------------


@dataclass
class TernaryTree:
    """A ternary search tree as parallel lists; node 0 is the root, which stands for no turn. `low`
    and `high` lead to siblings with a smaller or larger turn, `down` to the first child found."""

    turn: list[int] = field(default_factory=lambda: [-1])
    low: list[int] = field(default_factory=lambda: [-1])
    high: list[int] = field(default_factory=lambda: [-1])
    down: list[int] = field(default_factory=lambda: [-1])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    end: list[int] = field(default_factory=lambda: [-1])

    def _new(self, turn: int, parent: int) -> int:
        for column, value in (
            (self.turn, turn), (self.low, -1), (self.high, -1), (self.down, -1),
            (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.end, -1),
        ):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, turns: Iterable[int], number: int) -> int:
        """Add a sequence, which is known by its number; returns the node at which it ends."""
        at = 0
        for turn in turns:
            links, place, node = self.down, at, self.down[at]
            while node >= 0 and self.turn[node] != turn:
                links = self.low if turn < self.turn[node] else self.high
                place, node = node, links[node]
            if node < 0:
                node = links[place] = self._new(turn, at)
            at = node
        self.end[at] = number
        return at

    def traversed(self) -> list[int]:
        """All nodes, each after its parent."""
        found, waiting = [], [0]
        while waiting:
            node = waiting.pop()
            found.append(node)
            waiting += [n for n in (self.low[node], self.high[node], self.down[node]) if n >= 0]
        return found


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle first, then the middles of what lies on its sides."""
    waiting = [(0, n)]
    while waiting:
        low, high = waiting.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            waiting += [(middle + 1, high), (low, middle)]


def path_keys(seq: bytes) -> Iterator[bytes]:
    """The keys of the nodes on a sequence's path, from the root's."""
    digest = hashlib.blake2b(digest_size=16)
    yield digest.digest()
    for low in range(0, len(seq), RECORD):
        digest.update(seq[low : low + RECORD])
        yield digest.copy().digest()


NODES = [
    "key", "parent_key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
    "saved_tokens", "ends", "first_seq", "last_seq",
]
NODE_SCHEMA = """key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long,
    n_children long, n_leaves long, saved_tokens long, ends string, first_seq binary, last_seq binary"""


def shard_nodes(shard: list[tuple[bytes, int, int, str]]) -> list[tuple]:
    """Rows of NODES for the sorted sequences (seq, n, first, ends) of a shard. Only nodes on its first
    and last path have a key, and only their children a parent_key; the root also names both sequences."""
    split = [[seq[i : i + RECORD] for i in range(0, len(seq), RECORD)] for seq, *_ in shard]
    records = sorted({record for records in split for record in records})
    number = {record: i for i, record in enumerate(records)}
    lengths = [int.from_bytes(record[-4:], "big") for record in records]

    tree = TernaryTree()
    ends = [0] * len(shard)
    for i in medians(len(shard)):
        ends[i] = tree.insert([number[record] for record in split[i]], i)

    keys: dict[int, bytes] = {}
    for i in (0, len(shard) - 1):
        path = [ends[i]]
        while path[-1]:
            path.append(tree.parent[path[-1]])
        keys |= zip(reversed(path), path_keys(shard[i][0]), strict=True)

    size = len(tree.turn)
    members, children, leaves, saved = ([0] * size for _ in range(4))
    smallest = [None] * size
    order = tree.traversed()
    for node in reversed(order):
        if tree.end[node] >= 0:
            _, n, first, _ = shard[tree.end[node]]
            members[node] += n
            smallest[node] = first if smallest[node] is None else min(first, smallest[node])
        leaves[node] += not children[node]
        if node:
            saved[node] += (members[node] - 1) * lengths[tree.turn[node]]
            above = tree.parent[node]
            members[above] += members[node]
            children[above] += 1
            leaves[above] += leaves[node]
            saved[above] += saved[node]
            known = smallest[above]
            smallest[above] = smallest[node] if known is None else min(known, smallest[node])

    bounds = shard[0][0], shard[-1][0]
    rows = []
    for node in order:
        above = tree.parent[node]
        closed = above >= 0 and above not in keys
        rows.append((
            keys.get(node), keys.get(above), tree.depth[node], smallest[node],
            smallest[above] if closed else None, members[node], children[node], leaves[node], saved[node],
            shard[tree.end[node]][3] if tree.end[node] >= 0 else None,
            *(bounds if node == 0 else (None, None)),
        ))
    return rows


def _sharded(limit: int) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        turns = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("seq", "n", "first", "ends")), strict=True):
                more = len(row[0]) // RECORD
                if shard and turns + more > limit:
                    yield from _batches(shard_nodes(shard), NODES)
                    shard, turns = [], 0
                shard.append(row)
                turns += more
        if shard:
            yield from _batches(shard_nodes(shard), NODES)

    return run


# --- the merged trie -----------------------------------------------------------------------


def border_rows(last: bytes, following: bytes) -> Iterator[tuple[bytes, int, int, int]]:
    """What the nodes common to a shard's last sequence and the next shard's first one have counted
    twice: key, children, leaves, and savings that were missed."""
    common = 0
    while common < min(len(last), len(following)) and last[common : common + RECORD] == following[common : common + RECORD]:
        common += RECORD
    lengths = [int.from_bytes(last[i + RECORD - 4 : i + RECORD], "big") for i in range(0, common, RECORD)]
    below = sum(lengths)
    # The last sequence had no child in its shard, but has one in the next.
    leaf = int(common == len(last))
    for depth, key in enumerate(path_keys(last[:common])):
        yield key, int(depth < len(lengths)), leaf, below
        # The root has no text; every other node counts its own.
        below -= lengths[depth - 1] if depth else 0


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rows = list(border_rows(row["last_seq"], row["next_seq"]))
            yield from _batches(rows, ["key", "n_children", "n_leaves", "saved_tokens"])


def trie(conversations: DataFrame, staging: Staging, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node: conv_id (the smallest member's), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Depth and conv_id name a node."""
    sequences = staging.put(rebuilt(conversations), "sequences")
    distinct = staging.put(distinct_sequences(sequences), "distinct")
    turns = distinct.agg(F.sum(F.octet_length("seq"))).first()[0] or 0
    parts = 1 + turns // (RECORD * shard_turns)
    ordered = distinct.repartitionByRange(parts, "seq").sortWithinPartitions("seq")
    nodes = staging.put(ordered.mapInArrow(_sharded(shard_turns), NODE_SCHEMA), "nodes")

    # One row per shard.
    bounds = nodes.filter("first_seq IS NOT NULL").select("first_seq", "last_seq")
    following = F.lead("first_seq").over(Window.orderBy("first_seq", "last_seq"))
    borders = bounds.select("last_seq", following.alias("next_seq")).filter("next_seq IS NOT NULL")
    twice = borders.mapInArrow(_borders, "key binary, n_children long, n_leaves long, saved_tokens long")
    corrections = twice.select(
        "key",
        (-F.col("n_children")).alias("n_children"),
        (-F.col("n_leaves")).alias("n_leaves"),
        "saved_tokens",
    )
    open_nodes = nodes.filter("key IS NOT NULL").unionByName(corrections, allowMissingColumns=True)
    merged = staging.put(
        open_nodes.groupBy("key").agg(
            *[F.max(c).alias(c) for c in ("parent_key", "depth", "ends")],
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        ),
        "merged",
    )
    inner = nodes.filter("key IS NULL")
    # Children of a common node are many; those of no open node need no join.
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")
    asking = inner.filter("parent_key IS NOT NULL").unionByName(merged, allowMissingColumns=True)
    above = merged.select(
        F.col("key").alias("parent_key"),
        F.col("conv_id").alias("above"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    answered = asking.withColumn("salt", salt).join(above, ["parent_key", "salt"], "left")
    answered = answered.withColumn("parent_conv_id", F.col("above")).select(nodes.columns)
    return (
        inner.filter("parent_key IS NULL").unionByName(answered)
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends", F.lit(NO_MEMBERS)).alias("ends_sha256"),
        )
    )
