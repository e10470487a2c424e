"""Spelling variants grouped by PartEnum signatures.

Words that differ by one inserted or deleted letter have letter multisets that differ by one element,
words that differ by one replaced letter by two; as binary vectors over (letter, occurrence) their
Hamming distance is at most two. PartEnum splits the elements into parts and enumerates choices of
parts. With `PARTS` parts, two vectors at distance two agree on all but two parts at most, so they
agree on one of the choices of `PARTS` - 2; words of unlike length differ in one element and agree on
all but one part. A signature is the hash of a word's projection on one choice together with the
length, so words of equal length meet through the one family of signatures and words whose lengths
differ by one through the other. Signatures are joined by equality, and every pair that meets is
verified on the words themselves, in the join. No word pair within distance one is lost; hashes can
only add pairs, which the verification removes.

The parts are balanced by how often each element occurs, counted over all words: at most 90 letters by
four occurrences; later occurrences follow the letter's code point.

At scale: occurrences are counted before the shuffle, and only distinct words with enough of them go
on. A signature's group is as large as the number of words with like letters on most parts, which
selects the more the more parts there are; groups are joined, never collected, and what leaves the join
is verified. Words are told their root from the roots down, where a word answers only its near ones.

Defined cases: a null text has no words; a null id counts as an empty one in the checksum; repeated
rows count each; an empty table gives no rows; very long runs are words like others; other columns are
not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.arrow import slices
from clickloom.sources.staging import Staging

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIN_LETTERS = 5
MIN_COUNT = 3
DELETED = 97

# Parts for words of equal length, where two may disagree, and of unlike length, where one may.
PARTS = 6
PARTS_UNLIKE = 4
# Occurrences of a letter that are counted to balance the parts.
OCCURRENCES = 4

# Roles of a signature's row.
EQUAL, SHORTER, LONGER = 0, 1, 2


def word_counts(docs: DataFrame, least: int = MIN_COUNT, letters: int = MIN_LETTERS) -> DataFrame:
    """word and n over all texts, for words that are long and frequent enough. One run in 97, by a
    checksum over document and run, loses a letter."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"),
    )
    # A run shorter than the least word can only become shorter.
    runs = runs.filter(F.length("run") >= letters)
    checked = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), cut), F.col("run").substr(cut + 2, F.length("run")))
    word = F.when(F.col("h") % DELETED == 0, shorter).otherwise(F.col("run"))
    counts = checked.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.col("n") >= least) & (F.length("word") >= letters))


def elements(word: str) -> Iterator[tuple[str, int]]:
    """The letters in order, each with the number of equal ones before it."""
    before, seen = "", 0
    for letter in sorted(word):
        seen = seen + 1 if letter == before else 0
        before = letter
        yield letter, seen


def _element_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[tuple[str, int]] = Counter()
    for batch in slices(batches):
        for word in batch.column("word").to_pylist():
            counts.update(e for e in elements(word) if e[1] < OCCURRENCES)
    names = ["letter", "occurrence", "n"]
    rows = [(*element, n) for element, n in sorted(counts.items())]
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    types = [pa.string(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def balanced_parts(counts: dict[tuple[str, int], int], parts: int) -> dict[tuple[str, int], int]:
    """A part for every counted element, the most frequent first, into the part with least so far."""
    load = [0] * parts
    chosen = {}
    for element, n in sorted(counts.items(), key=lambda item: (-item[1], item[0])):
        chosen[element] = load.index(min(load))
        load[chosen[element]] += n
    return chosen


def signer(counts: dict[tuple[str, int], int], parts: int, wrong: int) -> Callable[[str, int], list[int]]:
    """Signatures of a word for one family: a hash per choice of all but `wrong` parts."""
    part_of = balanced_parts(counts, parts)
    choices = list(combinations(range(parts), parts - wrong))

    def signatures(word: str, length: int) -> list[int]:
        projections = [""] * parts
        for letter, occurrence in elements(word):
            part = part_of.get((letter, occurrence))
            projections[(ord(letter) + occurrence) % parts if part is None else part] += letter
        return [
            xxhash.xxh64_intdigest("|".join([projections[p] for p in choice]).encode(), seed=(length << 12) + (wrong << 8) + i) - (1 << 63)
            for i, choice in enumerate(choices)
        ]

    return signatures


def signatures(words: DataFrame) -> DataFrame:
    """sig, role, word, n: a word's rows in both families; it is a longer and a shorter one in the second."""
    found = words.mapInArrow(_element_counts, "letter string, occurrence long, n long")
    # At most 90 letters by four occurrences.
    totals = found.groupBy("letter", "occurrence").agg(F.sum("n").alias("n")).collect()
    counts = {(row.letter, row.occurrence): row.n for row in totals}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        equal, unlike = signer(counts, PARTS, 2), signer(counts, PARTS_UNLIKE, 1)
        for batch in slices(batches):
            sigs, roles, rows = [], [], []
            for i, word in enumerate(batch.column("word").to_pylist()):
                length = len(word)
                for role, found in (
                    (EQUAL, equal(word, length)),
                    (SHORTER, unlike(word, length)),
                    (LONGER, unlike(word, length - 1)),
                ):
                    sigs += found
                    roles += [role] * len(found)
                    rows += [i] * len(found)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sigs, pa.int64()), pa.array(roles, pa.int8()), taken.column("word"), taken.column("n")],
                names=["sig", "role", "word", "n"],
            )

    return words.select("word", "n").mapInArrow(run, "sig long, role byte, word string, n long")


def near_pairs(words: DataFrame, staging: Staging) -> DataFrame:
    """Each pair of words one letter apart, once: word, n, other, other_n."""
    signed = staging.put(signatures(words), "signatures")
    left = signed.filter(F.col("role") != LONGER).select("sig", "role", "word", "n")
    right = signed.filter(F.col("role") != SHORTER).select(
        F.col("sig").alias("other_sig"), F.col("role").alias("other_role"),
        F.col("word").alias("other"), F.col("n").alias("other_n"),
    )
    apart = F.levenshtein("word", "other", 1) == 1
    once = ((F.col("role") == EQUAL) & (F.col("other_role") == EQUAL) & (F.col("word") < F.col("other"))) | (
        (F.col("role") == SHORTER) & (F.col("other_role") == LONGER)
    )
    met = left.join(right, (F.col("sig") == F.col("other_sig")) & once & apart)
    return met.select("word", "n", "other", "other_n").distinct()


def variants(docs: DataFrame, staging: Staging) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    words = staging.put(word_counts(docs), "words")
    pairs = staging.put(near_pairs(words, staging), "pairs")
    both = pairs.select("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")).unionByName(
        pairs.select(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left").withColumn("best_n", -F.col("best.less"))
    taken = F.col("best_n") >= 2 * F.col("n")
    formed = staging.put(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(taken, F.col("best.near")).alias("form"),
            F.when(taken, F.col("best_n")).alias("form_n"),
        ),
        "formed",
    )
    return formed.join(roots(formed.select("word", "form"), staging), "word")


def roots(formed: DataFrame, staging: Staging) -> DataFrame:
    """word and root: each word's forms followed to the last. Counts at least double at each step, so
    there are few rounds; a round's answers go only to the near words of those found before."""
    found = formed.filter("form IS NULL").select("word", F.col("word").alias("root"))
    waiting = staging.put(formed.filter("form IS NOT NULL"), "waiting")
    known = found
    while not waiting.isEmpty():
        last = found.select(F.col("word").alias("form"), F.col("root"))
        found = staging.put(waiting.join(last, "form").select("word", "root"), "rooted")
        waiting = staging.put(waiting.join(found, "word", "left_anti"), "waiting")
        known = known.unionByName(found)
    return known
