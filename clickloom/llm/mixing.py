"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled by a keyed hash and laid end to end; the stream is cut into
blocks of `block` words. The mix is a row of slots, each of which takes one block. Slot i is
van der Corput's point i, mapped through the sources' cumulative shares; its rank among the slots of
its source names the block, and ranks beyond the stream's end begin it again. So every stretch of the
mix, not only the whole, holds the sources in about their shares.

A source has exactly the slots that its target asks for: the schedule leaves out what it has too
many of (at most a logarithm of the slots), appends what it lacks, and the last block of a source is
cut, so that the words taken are the target rounded to a whole word.

Targets: sources in the order of their code points, null last, weigh 5, 2, 1 and so on; they share
`share` times all words, and one whose share exceeds `repeats` times its words stops there, its
excess being shared again by weight until none is above.

At scale: texts are read once and do not travel. Documents are placed by buckets of their hash, slots
are placed by cells of the points and ranked by stretches of the schedule, so a source with a third of
all rows, or of all slots, is spread over many tasks; slots meet documents block by block. The driver
sees two sums per round of sharing.

Defined cases: a null or blank text has no words and is never taken; a null source is a source of its
own; null ids are kept; rows that repeat stay rows of their own, each taken for itself; a document
longer than a block spans several; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.running import matched, numbered, with_running_total
from clickloom.sources.staging import Staging

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)

# Words of a block.
BLOCK = 1_024
# Documents of a bucket, on average, and slots of a cell or stretch: what one window holds.
BUCKET_ROWS = 4_096
CELL = 1 << 16

# Bits of the points. 2^48 slots of 1,024 words are beyond any corpus.
POINT_BITS = 48


@dataclass(frozen=True)
class Mix:
    """`documents`: doc_id, size, source, source_size, target and the start in the source's stream.
    `slots`: slot, source, rank, block and the words taken of it; in slot order, then source order,
    they are the mix."""

    documents: DataFrame
    slots: DataFrame
    block: int

    def pieces(self) -> DataFrame:
        """Stretches of documents in the mix: slot, source, place in the slot, the document and its
        start, first_word and n_words."""
        low = F.greatest("start", F.col("block") * self.block)
        high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * self.block)
        first, last = (F.floor(x / self.block) for x in (F.col("start"), F.col("start") + F.col("size") - 1))
        parts = (
            self.documents.filter("size > 0")
            .withColumn("block", F.explode(F.sequence(first, last)))
            .select(
                "doc_id", "source", "start", "block",
                (low - F.col("start")).alias("first_word"),
                (low - F.col("block") * self.block).alias("place"),
                (high - low).alias("length"),
            )
        )
        taken = F.least("length", F.col("words") - F.col("place")).alias("n_words")
        joined = matched(self.slots.select("slot", "source", "block", "words"), parts, ["source", "block"])
        return joined.select("slot", "source", "place", "doc_id", "start", "first_word", taken).filter("n_words > 0")

    def taken(self) -> DataFrame:
        """Per document the words that the mix takes of it."""
        sums = self.pieces().groupBy("source", "start").agg(F.sum("n_words").alias("taken"))
        # Documents without words share their start with the next one.
        empty, full = self.documents.filter("size = 0"), self.documents.filter("size > 0")
        counted = matched(full, sums, ["source", "start"], "left")
        both = counted.unionByName(empty.withColumn("taken", F.lit(None).cast("long")))
        taken = F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
        return both.select("doc_id", "size", "source_size", "target", taken, "source")


def mix(
    docs: DataFrame,
    staging: Staging,
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    repeats: int = 2,
    block: int = BLOCK,
    seed: str = "mix",
) -> Mix:
    sized = staging.put(_sized(docs, seed), "sized")
    buckets = max(1, sized.count() // BUCKET_ROWS)
    # The first 32 bits of the hash, so that buckets lie in its order.
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    sized = sized.withColumn("bucket", F.floor(head * buckets / (1 << 32)))

    sources = staging.put(_targets(_weighed(sized, weights, staging), share, repeats, block), "sources")
    placed = with_running_total(sized, ["source"], "bucket", ["key"], F.col("size"), "start")
    # A source's figures join its buckets, of which a large one has many, and not its documents.
    of_buckets = matched(
        sized.select("source", "bucket").distinct(), sources.select("source", "source_size", "target"), ["source"]
    )
    documents = matched(placed, of_buckets, ["source", "bucket"])
    wanted = documents.select("doc_id", "size", "source", "source_size", "target", "start")
    return Mix(staging.put(wanted, "placed"), staging.put(_slots(sources, block, staging), "slots"), block)


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.md5(named).alias("key"))


def _weighed(sized: DataFrame, weights: Sequence[int], staging: Staging) -> DataFrame:
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = numbered(sizes, [F.asc_nulls_last("source")], "number", staging)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    return staging.put(in_order.withColumn("weight", weight.cast("long")), "weighed")


def _targets(sources: DataFrame, share: float, repeats: int, block: int) -> DataFrame:
    """Each source's target, and from it the words, blocks and slots it gets."""
    cap = F.col("source_size") * repeats
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, stopped = (share * total / weight if weight else 0.0), None
    # Words that a unit of weight gets. It only rises, and so does the number of sources that stop.
    while True:
        above = cap < F.col("weight") * level
        capped, open_weight = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        if (capped, open_weight) == stopped or not open_weight:
            break
        stopped = capped, open_weight
        level = (share * total - capped) / open_weight
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(level).cast("double"))
    size = F.col("source_size")
    # A source without words has no blocks; the divisor is only there to be one.
    full = F.when(size > 0, F.expr("words DIV greatest(source_size, 1)")).otherwise(0)
    rest = F.when(size > 0, F.expr("words % greatest(source_size, 1)")).otherwise(0)
    blocks = F.ceil(size / block)
    return (
        sources.withColumn("target", target)
        .withColumn("words", F.floor(F.col("target") + 0.5))
        .withColumn("blocks", blocks)
        .withColumn("quota", full * blocks + F.ceil(rest / block))
    )


def _point(slot: Column) -> Column:
    """Van der Corput's point of a slot in [0, 1): its bits mirrored at the point."""
    mirrored = F.conv(F.reverse(F.lpad(F.bin(slot), POINT_BITS, "0")), 2, 10)
    return mirrored.cast("double") / float(1 << POINT_BITS)


def _slots(sources: DataFrame, block: int, staging: Staging) -> DataFrame:
    total = sources.agg(F.sum("quota")).first()[0] or 0
    facts = F.struct("source", "source_size", "words", "blocks", "quota", "number").alias("facts")
    kept = sources.filter("quota > 0").withColumn("stretch", F.floor(F.col("number") / CELL))
    starts = with_running_total(kept, [], "stretch", ["number"], F.col("quota"), "low")
    # Where a source's interval begins in each cell it reaches into.
    reached = F.sequence(F.floor(F.col("low") / CELL), F.floor((F.col("low") + F.col("quota") - 1) / CELL))
    marks = starts.select(F.explode(reached).alias("cell"), "low", facts).select(
        "cell",
        F.greatest(F.col("low"), F.col("cell") * CELL).cast("double").alias("point"),
        F.lit(None).cast("long").alias("slot"),
        "facts",
    )
    points = (
        sources.sparkSession.range(total)
        .select(F.col("id").alias("slot"), (_point(F.col("id")) * float(total)).alias("point"))
        .select(
            F.floor(F.col("point") / CELL).alias("cell"), "point", "slot", F.lit(None).cast(marks.schema["facts"].dataType).alias("facts")
        )
    )
    # A point belongs to the last interval that begins at or before it.
    so_far = Window.partitionBy("cell").orderBy("point", F.asc_nulls_first("slot"))
    owned = points.unionByName(marks).withColumn("owner", F.last("facts", ignorenulls=True).over(so_far))
    owned = owned.filter("slot IS NOT NULL").select("slot", "owner.*")
    owned = staging.put(owned.withColumn("stretch", F.floor(F.col("slot") / CELL)), "owned")
    ranked = with_running_total(owned, ["number"], "stretch", ["slot"], F.lit(1), "rank").drop("stretch")
    ranked = ranked.filter("rank < quota")

    have = owned.groupBy("number").agg(F.count(F.lit(1)).alias("have"))
    short = sources.filter("quota > 0").join(have, "number", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    short = short.filter("have < quota").withColumn("rank", F.explode(F.sequence(F.col("have"), F.col("quota") - 1)))
    appended = short.withColumn("slot", F.lit(total) + F.col("rank") - F.col("have"))
    slots = ranked.unionByName(appended.select(ranked.columns))

    place = F.expr("rank % blocks")
    before = F.expr("rank DIV blocks") * F.col("source_size") + place * block
    length = F.least(F.lit(block), F.col("source_size") - place * block)
    words = F.least(length, F.col("words") - before)
    return slots.select("slot", "source", "number", "rank", place.alias("block"), words.alias("words"))
