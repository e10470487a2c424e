from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clickloom.llm import mixing
from clickloom.llm.running import numbered, with_running_total

ROWS = "doc_id long, text string, source string"


def frame(spark, *rows):
    return spark.createDataFrame([(d, "w " * n if n is not None else None, s) for d, n, s in rows], ROWS)


def wanted(sizes, share=1.5, repeats=2):
    """Targets by sharing again and again, source by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > repeats * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
        open_ -= full
    return target


def check(result):
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for row in result:
        assert 0 <= row.taken <= 2 * row.size
        sizes[row.source] += row.size
        taken[row.source] += row.taken
        targets[row.source] = row.target
    expected = wanted(dict(sizes))
    for source, target in targets.items():
        assert target == pytest.approx(expected[source])
        assert taken[source] == int(expected[source] + 0.5)
    for row in result:
        assert row.source_size == sizes[row.source]


@pytest.mark.parametrize("block", [1, 7, 64, 1024])
def test_sources_reach_their_targets(spark, staging, block):
    random.seed(block)
    rows = [(i, int(random.paretovariate(0.8)) % 900, f"s{min(i % 7, 3)}") for i in range(300)]
    mixed = mixing.mix(frame(spark, *rows), staging, block=block)
    check(mixed.taken().collect())


def test_nulls_blanks_repeats_and_clashing_columns(spark, staging):
    rows = [(1, 40, "b"), (1, 40, "b"), (None, 30, None), (2, 0, "b"), (3, None, "empty"), (4, 5000, ""), (4, 3, "")]
    docs = frame(spark, *rows).withColumns({c: F.lit("x") for c in ("size", "target", "slot", "bucket", "start", "_start")})
    result = mixing.mix(docs, staging, block=16).taken()
    assert result.columns == ["doc_id", "size", "source_size", "target", "taken", "source"]
    result = result.collect()
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in result if r.doc_id) == [
        (False, 1, 40), (False, 1, 40), (False, 2, 0), (False, 3, 0), (False, 4, 3), (False, 4, 5000),
    ]
    check(result)


def test_empty_and_wordless_tables(spark, staging):
    assert mixing.mix(frame(spark), staging).taken().count() == 0
    only = mixing.mix(frame(spark, (1, None, "a"), (2, 0, None)), staging).taken().collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in only) == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0)]


def test_pieces_cover_slots_without_gaps_and_documents_by_turns(spark, staging):
    rows = [(i, 1 + i * 37 % 211, "ab"[i % 2]) for i in range(60)]
    mixed = mixing.mix(frame(spark, *rows), staging, block=50)
    slots = {(s.slot, s.source): s.words for s in mixed.slots.collect()}
    pieces = defaultdict(list)
    for p in mixed.pieces().collect():
        pieces[p.slot, p.source].append((p.place, p.n_words))
    assert set(pieces) == set(slots)
    for key, parts in pieces.items():
        at = 0
        for place, n in sorted(parts):
            assert place == at
            at += n
        assert at == slots[key] <= 50


def test_every_stretch_of_the_mix_holds_the_shares(spark, staging):
    rows = [(i, 200, "abc"[i % 3]) for i in range(300)]
    mixed = mixing.mix(frame(spark, *rows), staging, block=10)
    order = [s.source for s in mixed.slots.orderBy("slot", "source").collect()]
    share = {s: order.count(s) / len(order) for s in "abc"}
    for low in range(0, len(order) - 500, 250):
        part = order[low : low + 500]
        assert all(abs(part.count(s) - 500 * share[s]) <= 12 for s in "abc")


def test_reruns_and_partitions_agree(spark, staging):
    rows = [(i % 50, 10 + i % 90, f"s{i % 4}") for i in range(200)]
    docs = frame(spark, *rows)
    one = sorted(mixing.mix(docs, staging).taken().collect())
    assert one == sorted(mixing.mix(docs.repartition(9), staging).taken().collect())


def test_a_source_is_placed_in_many_windows(spark, staging, monkeypatch):
    """Small buckets and cells give the same mix."""
    rows = [(i, 1 + i % 40, "hot" if i % 3 else f"s{i}") for i in range(400)]
    docs = frame(spark, *rows)
    once = sorted(mixing.mix(docs, staging, block=8).taken().collect())
    for name, value in (("BUCKET_ROWS", 16), ("CELL", 32)):
        monkeypatch.setattr(mixing, name, value)
    assert sorted(mixing.mix(docs, staging, block=8).taken().collect()) == once


def test_running_totals_and_numbers(spark, staging):
    rows = spark.range(200).select("id", (F.col("id") % 3).alias("g"), F.floor(F.col("id") / 16).alias("b"))
    found = with_running_total(rows, ["g"], "b", ["id"], F.col("id"), "before").collect()
    assert all(r.before == sum(i for i in range(r.id) if i % 3 == r.g) for r in found)
    placed = numbered(rows.repartition(5), [F.desc("id")], "place", staging).collect()
    assert all(r.place == 199 - r.id for r in placed)
