"""N-gram Jaccard join: components of documents whose shingle sets overlap enough.

Sets that are equal are one node. Sizes fall into bands; a band's hash space is cut into one part
more than two linked sets of the band can differ in elements, so that any two linked sets agree
in at least one part; of these each set tells only its fullest, as many as that needs. A tile holds
the nodes of a band that agree in a part. Passages that many
documents share do not fill a tile, since the rest of the part must agree as well.

Tile keys are not stored. A pass over the texts packs (tile, node) into one binary row per bucket of
tiles, 16 bytes a pair; the task that gets a bucket keeps the tiles in which nodes meet, and only
those, a small part, become rows.

Within a tile each node is first compared with one pivot, which settles large groups of near
copies in a step. Tiles that still hold several components, and many nodes, get further pivots, one
a round; what is left then is compared in full, split into blocks. A pair is compared by sizes and by bitmaps first: every bit in which two bitmaps
differ stands for an element that only one set has. Within a tile that is a short bitmap of fixed
length, then for each pair left one as long as its sets need. What both bounds let through is
intersected exactly, as sorted arrays of 64-bit hashes. Pairs within a component need no comparison.

Each round's tables are removed when the round is over, and shuffle files as soon as the table that
needed them is written, so that the executors' disks hold the shuffles of one table and not of all.

Tiles are found by the first 64 bits of a node's 128; equal ones only add comparisons.

Defined cases: a text without words, or null, has an empty set and is linked with nothing; its
component is its own id. Documents with equal sets are linked, whatever their ids; a null id is
never a component's name unless there is no other. Other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.arrow import Step, mapped, slices, unused, with_columns
from clickloom.sources.staging import Staging

# Longs of the bitmap of fixed length, and bits per element of the other one.
BITMAP = 16
DENSITY = 6
# Nodes of a block of a tile that is compared in full.
BLOCK = 256
# Nodes from which a tile gets further pivots, and how many of them, before it is compared in full.
CROWD = 16
# Tasks over which the rows of one key are dealt out.
SALTS = 16
PIVOTS = 6
# Pairs of tile and node in a bucket, on average, and in memory before they are packed or reduced.
BUCKET_PAIRS = 1 << 20
HELD_PAIRS = 1 << 21
BAND_GROWTH = 1.5
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64
SHORT_SEED = 77
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

BITS = [f"bits{i}" for i in range(BITMAP)]
SIGNED = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("node", T.BinaryType()),
    T.StructField("short", T.LongType()),
    T.StructField("n_tiles", T.LongType()),
]
SHINGLED = [
    T.StructField("node", T.BinaryType()),
    T.StructField("n", T.LongType()),
    *[T.StructField(name, T.LongType()) for name in BITS],
    T.StructField("bitmap", T.BinaryType()),
    T.StructField("shingles", T.BinaryType()),
]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the argument."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


@lru_cache(maxsize=1)
def _word_hashes() -> WordHashes:
    return WordHashes()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; of all words, if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), SHORT_SEED)], np.uint64)
    hashes = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    runs = len(words) - n + 1
    total = np.zeros(runs, np.uint64)
    for at in range(n):
        total = mixed(total + hashes[at : at + runs])
    return np.unique(total)


class Bands:
    """Bands of set sizes and their numbers of parts, for a similarity of num / den."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("a similarity above 0, of 1 at most")
        self.num, self.den = num, den
        self.growth = max(BAND_GROWTH, den / num)
        self.ends = [2]

    def end(self, band: int) -> int:
        while len(self.ends) <= band:
            self.ends.append(max(self.ends[-1] + 1, int(np.ceil(self.ends[-1] * self.growth))))
        return self.ends[band]

    def of(self, size: int) -> list[int]:
        """The size's own band, and the next one if a linked set may lie there."""
        band = 0
        while self.end(band) <= size:
            band += 1
        return [band, band + 1] if size * self.den >= self.num * self.end(band) else [band]

    def parts(self, band: int) -> int:
        """One more than linked sets, the larger of this band, can differ in."""
        return 2 * (self.end(band) - 1) * (self.den - self.num) // (self.den + self.num) + 1

    def told(self, size: int, band: int) -> int:
        """Parts by which a set is found in a band: one more than it can differ in from the largest
        linked set there."""
        largest = min(self.end(band) - 1, size * self.den // self.num)
        return (size + largest) * (self.den - self.num) // (self.den + self.num) + 1


@lru_cache(maxsize=256)
def _edges(parts: int) -> np.ndarray:
    return np.array([(at << 64) // parts for at in range(1, parts)], np.uint64)


def tile_keys(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """What the set holds of a part, as one number, for the parts of each band that hold most of it.
    Linked sets differ in fewer parts than either tells. Of the parts in which they agree, take the
    first in an order that both share, by number of elements and key: what comes before it in one set
    is no part of the other, so both tell it. Thus no key stands for a part that is empty as long as
    fuller ones suffice."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes), dtype=np.uint64)])
    keys = []
    for band in bands.of(len(hashes)):
        parts = bands.parts(band)
        cuts = np.concatenate([[0], np.searchsorted(hashes, _edges(parts)), [len(hashes)]])
        held = sums[cuts[1:]] - sums[cuts[:-1]]
        place = np.arange(parts, dtype=np.uint64) + np.uint64(band << 32) + np.uint64(1)
        held = mixed(held + mixed(place))
        told = bands.told(len(hashes), band)
        keys.append(held[np.lexsort((held, cuts[:-1] - cuts[1:]))[:told]] if told < parts else held)
    return np.concatenate(keys)


def bitmap(hashes: np.ndarray, size: int = 64 * BITMAP) -> np.ndarray:
    """A bit for every element; `size` is a power of two. Halves laid over each other make the
    bitmap of half the size."""
    bits = np.zeros(size, np.uint8)
    bits[(hashes & np.uint64(size - 1)).astype(np.intp)] = 1
    return np.packbits(bits)


def bitmap_size(n: int) -> int:
    return 1 << max(9, (DENSITY * n - 1).bit_length())


def differing_bits(one: bytes, other: bytes) -> int:
    """Bits that differ, the longer bitmap folded to the length of the shorter."""
    left, right = (np.frombuffer(part, np.uint64) for part in (one, other))
    while len(left) > len(right):
        left = left[: len(left) // 2] | left[len(left) // 2 :]
    while len(right) > len(left):
        right = right[: len(right) // 2] | right[len(right) // 2 :]
    return int(np.bitwise_count(left ^ right).sum())


def node_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def short_of(node: bytes) -> int:
    return int.from_bytes(node[:8], "little", signed=True)


def packer(n: int, bands: Bands, text_column: str, buckets: int) -> Step:
    """bucket and pairs: the tiles of each set with its node's short number, packed by bucket. Copies
    that a task has met shortly before are left out."""

    def packed(tiles: np.ndarray, shorts: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = (tiles % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        pairs = np.column_stack([tiles[order], shorts[order]])
        found, starts = np.unique(bucket[order], return_index=True)
        ends = [*starts[1:], len(pairs)]
        for low in range(0, len(found), 256):
            parts = [pairs[a:b].tobytes() for a, b in zip(starts[low : low + 256], ends[low : low + 256], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[low : low + 256]), pa.array(parts, pa.binary())], names=["bucket", "pairs"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()
        count = 0
        for batch in slices(batches):
            for text in batch.column(text_column).to_pylist():
                hashes = shingles(text, n)
                if not len(hashes):
                    continue
                short = short_of(node_of(hashes))
                if short in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(short)
                keys = tile_keys(hashes, bands)
                held.append((keys, np.full(len(keys), short, np.int64).view(np.uint64)))
                count += len(keys)
                if count >= HELD_PAIRS:
                    yield from packed(*(np.concatenate(part) for part in zip(*held, strict=True)))
                    held, count = [], 0
        if held:
            yield from packed(*(np.concatenate(part) for part in zip(*held, strict=True)))

    return run


def split_shared(tiles: np.ndarray, shorts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tiles and nodes, each pair once: of tiles with several nodes, then of those with one."""
    order = np.lexsort((shorts, tiles))
    tiles, shorts = tiles[order], shorts[order]
    new = np.ones(len(tiles), bool)
    new[1:] = (tiles[1:] != tiles[:-1]) | (shorts[1:] != shorts[:-1])
    tiles, shorts = tiles[new], shorts[new]
    starts = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(tiles)]]))
    shared = np.repeat(sizes > 1, sizes)
    return tiles[shared], shorts[shared], tiles[~shared], shorts[~shared]


def _shared_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tile and short of the tiles in which nodes meet, from packed rows that come bucket by bucket.
    What is found to be shared leaves at once, so a crowded tile is never held."""
    none = np.empty(0, np.uint64)
    at, count, held = None, 0, []
    met = none

    def out(tiles: np.ndarray, shorts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(tiles), 1 << 16):
            columns = [pa.array(part[low : low + (1 << 16)].view(np.int64)) for part in (tiles, shorts)]
            yield pa.RecordBatch.from_arrays(columns, names=["tile", "short"])

    def reduce_held() -> Iterator[pa.RecordBatch]:
        nonlocal held, count, met
        pairs = np.concatenate(held)
        tiles, shorts = pairs[:, 0], pairs[:, 1]
        known = np.isin(tiles, met)
        yield from out(np.ascontiguousarray(tiles[known]), np.ascontiguousarray(shorts[known]))
        shared_tiles, shared_shorts, tiles, shorts = split_shared(tiles[~known], shorts[~known])
        yield from out(shared_tiles, shared_shorts)
        met = np.union1d(met, shared_tiles)
        held, count = [np.column_stack([tiles, shorts])], len(tiles)

    for batch in batches:
        for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
            if bucket != at or count >= 4 * HELD_PAIRS:
                if held:
                    yield from reduce_held()
                if bucket != at:
                    at, count, held, met = bucket, 0, [], none
            held.append(np.frombuffer(packed, np.uint64).reshape(-1, 2))
            count += len(held[-1])
    if held:
        yield from reduce_held()


def signer(n: int, bands: Bands, text_column: str) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, n) for text in batch.column(text_column).to_pylist()]
            nodes = [node_of(s) if len(s) else None for s in sets]
            short = [None if node is None else short_of(node) for node in nodes]
            tiles = [sum(bands.told(len(s), band) for band in bands.of(len(s))) if len(s) else 0 for s in sets]
            yield with_columns(
                batch,
                {
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "node": pa.array(nodes, pa.binary()),
                    "short": pa.array(short, pa.int64()),
                    "n_tiles": pa.array(tiles, pa.int64()),
                },
            )

    return run


def shingler(n: int, text_column: str) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, n) for text in batch.column(text_column).to_pylist()]
            maps = np.array([bitmap(s).view(np.int64) for s in sets], np.int64).reshape(-1, BITMAP)
            own = [bitmap(s, bitmap_size(len(s))).tobytes() for s in sets]
            yield with_columns(
                batch,
                {
                    "node": pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    **{name: pa.array(maps[:, at]) for at, name in enumerate(BITS)},
                    "bitmap": pa.array(own, pa.binary()),
                    "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
                },
            )

    return run


def _named(frame: DataFrame, side: str) -> DataFrame:
    return frame.select(*[F.col(name).alias(f"{name}_{side}") for name in frame.columns])


def _bound(num: int, den: int) -> Column:
    """Whether two sets can be linked, by their sizes and bitmaps: the overlap is at most half of
    what remains of both sizes without the differing bits."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in BITS])
    both = F.col("n_a") + F.col("n_b")
    smaller, larger = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return (smaller * den >= larger * num) & ((both - differ) * (num + den) >= both * (2 * num))


def _filtered(pairs: DataFrame, sets: DataFrame, column: str, linked, staging: Staging) -> DataFrame:
    """The pairs (a, b) for which `linked` holds, given their sizes and one binary column."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    sets = sets.join(nodes.distinct(), "node", "left_semi")
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col(column).alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col(column).alias("right"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            inputs = [batch.column(name).to_pylist() for name in ("n_a", "n_b", "left", "right")]
            keep = [linked(*row) for row in zip(*inputs, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return staging.put(joined.mapInArrow(run, "a binary, b binary"), column)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, staging: Staging) -> DataFrame:
    """The pairs whose sets overlap enough: what the long bitmaps let through is intersected."""

    def possible(n_a: int, n_b: int, one: bytes, other: bytes) -> bool:
        both = n_a + n_b
        return (both - differing_bits(one, other)) * (num + den) >= both * 2 * num

    def overlapping(n_a: int, n_b: int, one: bytes, other: bytes) -> bool:
        x, y = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both * den >= num * (n_a + n_b - both)

    left = _filtered(pairs, sets, "bitmap", possible, staging)
    return _filtered(left, sets, "shingles", overlapping, staging)


@contextmanager
def _passing(staging: Staging) -> Iterator[Staging]:
    """Tables that are removed at the end. Meanwhile shuffle files go as soon as what needed them is
    written; those of jobs that nothing refers to go at the end."""
    conf = staging.spark.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        with Staging(staging.spark) as scratch:
            yield scratch
    finally:
        conf.set(CLEANUP, before)
    gc.collect()
    staging.spark.sparkContext._jvm.System.gc()


def components(links: DataFrame, staging: Staging) -> DataFrame:
    """(node, label): for every node with a link the smallest node of its component. Labels
    spread along links and are then followed once, so that chains shorten by half."""
    with _passing(staging) as scratch:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = scratch.put(both.distinct(), "both")
        labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("nearest"))
        labels = scratch.put(labels.select("node", F.least("node", "nearest").alias("label")), "labels")
        while True:
            of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("offered"))
            offers = both.join(of_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("offered").alias("offered"))
            spread = labels.join(offers, "node").select("node", "label", F.least("label", "offered").alias("next"))
            targets = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
            jumped = spread.join(targets, "next").select(
                "node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved")
            )
            stepped = scratch.put(jumped, "labels")
            labels = stepped.select("node", "label")
            if stepped.filter("moved").isEmpty():
                return staging.put(labels, "components")


def _signed(
    docs: DataFrame, staging: Staging, n: int, bands: Bands, id_column: str, text_column: str
) -> tuple[DataFrame, DataFrame]:
    """Rows of id and text, and of each its id, a digest of the text, and what its set is known by."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    digested = rows.withColumn("digest", F.xxhash64("text"))
    kept = [T.StructField("id", rows.schema["id"].dataType), T.StructField("digest", T.LongType())]
    return rows, staging.put(mapped(digested, [signer(n, bands, "text")], [*kept, *SIGNED], keep=[]), "signed")


def _spread_join(many: DataFrame, few: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """A join with a frame that has each key once, where one key may hold much of `many`: its rows are
    dealt out by another column."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(few.select("*", salts), [key, "_salt"], how).drop("_salt")


def jaccard_components(
    docs: DataFrame,
    staging: Staging,
    n: int = 3,
    num: int = 90,
    den: int = 100,
    id_column: str = "doc_id",
    text_column: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """(id, n_shingles, component_id) per document; sets link when den * overlap >= num * union."""
    bands = Bands(num, den)
    rows, signed = _signed(docs, staging, n, bands, id_column, text_column)
    full = signed.filter("node IS NOT NULL")
    labels = _labels(rows, full, staging, n, bands, block)

    first = full.groupBy("node").agg(F.min("id").alias("first"))
    named = labels.join(first, "node")
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    linked = named.join(smallest, "label").select("node", "component_id")
    classes = first.join(linked, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))
    settled = _spread_join(full.select("id", "n_shingles", "node"), classes, "node", "id")
    settled = settled.select("id", "n_shingles", "component_id")
    empty = signed.filter("node IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    return settled.unionByName(empty).withColumnRenamed("id", id_column)


def one_of_each(
    docs: DataFrame,
    staging: Staging,
    n: int = 5,
    num: int = 80,
    den: int = 100,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The rows of `docs`, one of each component: the one with the smallest id, rows without an id
    last. Rows are told apart by id and text, so of different texts with one id none is lost by that;
    rows equal in both count as copies. Rows whose text has no words all stay. Columns stay as they
    are, whatever their names."""
    bands = Bands(num, den)
    rows, signed = _signed(docs, staging, n, bands, id_column, text_column)
    full = signed.filter("node IS NOT NULL")
    labels = _labels(rows, full, staging, n, bands, BLOCK)
    counted = full.groupBy("id", "digest", "node").agg(F.count(F.lit(1)).alias("rows"))
    grouped = _spread_join(counted, labels, "node", "id", "left").select(
        "id", "digest", "rows", F.coalesce("label", "node").alias("group")
    )
    grouped = staging.put(grouped, "grouped")
    order = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "digest")).alias("first")
    groups = grouped.groupBy("group").agg(F.sum("rows").alias("n"), order).filter("n > 1")
    several = _spread_join(grouped.select("id", "digest", "group"), groups, "group", "id")

    id_, digest, stays = (unused(name, docs.columns) for name in ("id", "digest", "stays"))
    marks = several.select(
        F.col("id").alias(id_),
        F.col("digest").alias(digest),
        (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))).alias(stays),
    )
    marks = staging.put(marks, "marks")
    same = F.col(id_column).eqNullSafe(F.col(id_)) & (F.xxhash64(text_column) == F.col(digest))
    alone = docs.join(marks, same, "left_anti")
    first = docs.join(marks.filter(F.col(stays)), same).groupBy(id_, digest)
    chosen = first.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(stays))
    return alone.unionByName(chosen.select(f"{stays}.*"))


def _shared_tiles(rows: DataFrame, full: DataFrame, staging: Staging, n: int, bands: Bands) -> DataFrame:
    """(tile, short) of the tiles in which several nodes meet."""
    pairs = full.agg(F.sum("n_tiles")).first()[0] or 0
    buckets = 1 + pairs // BUCKET_PAIRS
    packed = rows.select("text").mapInArrow(packer(n, bands, "text", buckets), "bucket long, pairs binary")
    dealt = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return staging.put(dealt.mapInArrow(_shared_pairs, "tile long, short long"), "shared")


def _labels(
    rows: DataFrame, full: DataFrame, staging: Staging, n: int, bands: Bands, block: int
) -> DataFrame:
    """(node, label) of all nodes that are linked with another one."""
    with _passing(staging) as scratch:
        return staging.put(_linked(rows, full, scratch, n, bands, block), "labels")


def _linked(
    rows: DataFrame, full: DataFrame, staging: Staging, n: int, bands: Bands, block: int
) -> DataFrame:
    num, den = bands.num, bands.den
    with _passing(staging) as scratch:
        shared = _shared_tiles(rows, full, scratch, n, bands)
        leading = full.groupBy("node").agg(F.min("short").alias("short"), F.min("id").alias("id"))
        leading = leading.join(shared.select("short").distinct(), "short", "left_semi")
        leading = scratch.put(leading, "leading")
        chosen = leading.select(F.col("id").alias("chosen"))
        chosen = rows.join(chosen, F.col("id").eqNullSafe(F.col("chosen")), "left_semi")
        sets = mapped(chosen.select("text"), [shingler(n, "text")], SHINGLED, keep=[])
        sets = sets.join(leading.select("node"), "node", "left_semi").dropDuplicates(["node"])
        sets = staging.put(sets, "sets")
        members = shared.join(leading.select("short", "node"), "short").select("tile", "node").distinct()
        members = staging.put(members, "members")
    sized = sets.select("node", "n", *BITS)

    links, labels, crowded, pivots = None, None, members.withColumn("label", F.col("node")), 0
    while True:
        with _passing(staging) as scratch:
            pairs = _pivot_pairs(crowded, pivots).join(_named(sized, "a"), "node_a").join(_named(sized, "b"), "node_b")
            pairs = pairs.filter(_bound(num, den)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
            found = staging.put(_verified(scratch.put(pairs, "pairs"), sets, num, den, scratch), "links")
        links = found if links is None else links.unionByName(found)
        labels = components(links, staging)
        pivots += 1
        labelled = members.join(labels, "node", "left").select("tile", "node", F.coalesce("label", "node").alias("label"))
        open_tiles = labelled.groupBy("tile").agg(
            F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("size")
        )
        # A tile of two is settled by its pivot.
        open_tiles = staging.put(open_tiles.filter("least <> most AND size > 2").select("tile", "size"), "open")
        crowds = open_tiles.filter(F.col("size") > CROWD)
        if pivots > PIVOTS or crowds.isEmpty():
            break
        crowded = staging.put(labelled.join(crowds.select("tile"), "tile"), "crowded")

    with _passing(staging) as scratch:
        open_members = labelled.join(open_tiles, "tile")
        own_tiles = open_members.groupBy("node").agg(F.collect_list("tile").alias("tiles"))
        unsettled = scratch.put(open_members.join(sized, "node").join(own_tiles, "node"), "unsettled")
        if unsettled.isEmpty():
            return labels
        compared = scratch.put(_compared(unsettled, num, den, block), "more")
        more = staging.put(_verified(compared, sets, num, den, scratch), "links")
    return components(links.unionByName(more), staging)


def _pivot_pairs(members: DataFrame, number: int) -> DataFrame:
    """(node_a, node_b), once each: every tile's pivot of a round with the tile's nodes of other labels."""
    order = F.xxhash64("node", F.lit(number))
    pivot = members.groupBy("tile").agg(F.min(F.struct(order.alias("order"), "node", "label")).alias("pivot"))
    met = members.join(pivot, "tile").filter(F.col("label") != F.col("pivot.label"))
    return met.select(
        F.least("node", "pivot.node").alias("node_a"), F.greatest("node", "pivot.node").alias("node_b")
    ).distinct()


def _compared(unsettled: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Pairs (a, b) of different components in a tile that the bound lets through. A tile is cut
    into blocks, and each pair of blocks is compared by itself. A pair that shares several tiles is
    reported by the first of them."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    cut = unsettled.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = [*BITS, "node", "label", "n", "tiles"]
    left = cut.select(
        "tile", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"),
        *[F.col(name).alias(f"{name}_a") for name in own],
    )
    right = cut.select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"),
        *[F.col(name).alias(f"{name}_b") for name in own],
    )
    # Blocks of a pair are in order; within one block the nodes are.
    ordered = (F.col("i") < F.col("j")) | (F.col("node_a") < F.col("node_b"))
    found = left.join(right, ["tile", "i", "j"]).filter(
        ordered
        & (F.col("label_a") != F.col("label_b"))
        & _bound(num, den)
        & (F.array_min(F.array_intersect("tiles_a", "tiles_b")) == F.col("tile"))
    )
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
