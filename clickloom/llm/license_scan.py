"""Licence scan: ordered signature rules over a document's words.

A cheap test for the literal words of the rules decides which texts are looked at; it follows from
the rules, so it leaves out no text that a rule would match. There, every word that
is some rule's keyword opens a window; one pattern per keyword, which joins those of its rules, tells
whether any of them matches, and only then are they tried one by one.
Detections that lie inside a detection of at least the same priority are suppressed.

Everything is DataFrame code within the row: no shuffle, no join, whole texts. Words are searched in
blocks with a margin as wide as the longest detection, so that time grows with a text's length.

Defined cases: a null text is empty. A document without detections has no labels (empty
strings), null first and last word and score 0. Repeated rows are scanned each for itself; other
columns are left alone by `detect` and not returned by `license_scan`.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.license_rules import Gate, Signature, signatures
from clickloom.llm.license_rules import gates as gates_of

# Words without ASCII signs; A-Z stand for their small letters.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIGN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
# Keywords so short that they often stand inside other words.
SHORT = 4
# Longest signature in words, with some room.
WINDOW = 32
# Words of a block.
BLOCK = 512
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
PHRASE_SCORE = 0.5
RULE_TYPE = "array<struct<keyword:string,pattern:string,label:string,priority:int,confidence:double>>"
DETECTION = "array<struct<start:int,stop:int,label:string,priority:int,confidence:double>>"


def _rules(rules: Sequence[Signature]) -> Column:
    """The rules as one constant; longer patterns of a keyword first, then by label."""
    rows = [rule._asdict() | {"pattern": f"^{rule.pattern}(?= |$)"} for rule in rules]
    return F.from_json(F.lit(json.dumps(rows)), RULE_TYPE)


def _gate(text: Column, gates: Sequence[Gate]) -> Column:
    small = F.lower(text)

    def holds(parts: frozenset[str]) -> Column:
        found = F.lit(True)
        for part in sorted(parts):
            found = found & F.contains(small, F.lit(part))
        return found

    opened = F.lit(False)
    for gate in gates:
        parts = F.lit(False)
        for one in gate.holds:
            parts = parts | holds(one)
        found = F.contains(small, F.lit(gate.keyword)) & parts
        if len(gate.keyword) <= SHORT:
            found = found & F.regexp_like(small, F.lit(f"(?:^|{SIGN}){gate.keyword}(?:$|{SIGN})"))
        opened = opened | found
    return opened


def _places(words: Column, phrase: str) -> Column:
    """Starts of a phrase's words standing consecutively."""
    wanted = phrase.split(" ")

    def stands(i: Column) -> Column:
        found = F.get(words, i) == wanted[0]
        for offset, word in enumerate(wanted[1:], 1):
            found = found & F.coalesce(F.get(words, i + offset) == word, F.lit(False))
        return found

    return F.filter(_positions(words), stands)


def _positions(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def _found(words: Column, first: Column, end: Column, rules: Sequence[Signature]) -> Column:
    """All detections that start in some words before `end`; the words begin at place `first`."""
    table = _rules(rules)
    keywords = sorted({rule.keyword for rule in rules})
    windows = F.transform(
        F.filter(
            _positions(words),
            lambda i: (first + i < end) & F.array_contains(F.array(*map(F.lit, keywords)), F.get(words, i)),
        ),
        lambda i: F.struct(
            (first + i).alias("at"),
            F.get(words, i).alias("keyword"),
            F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("text"),
        ),
    )

    def possible(window: Column) -> Column:
        chosen = F.when(F.lit(False), F.lit(False))
        for keyword in keywords:
            every = "|".join(rule.pattern for rule in rules if rule.keyword == keyword)
            matching = F.regexp_like(window["text"], F.lit(f"^(?:{every})(?= |$)"))
            chosen = chosen.when(window["keyword"] == keyword, matching)
        return F.coalesce(chosen, F.lit(False))

    def hits(window: Column) -> Column:
        matching = F.filter(
            table,
            lambda rule: (rule["keyword"] == window["keyword"])
            & F.regexp_like(window["text"], rule["pattern"]),
        )
        return F.transform(
            matching,
            lambda rule: F.struct(
                window["at"].alias("start"),
                (window["at"] + F.size(F.split(F.regexp_substr(window["text"], rule["pattern"]), " "))).alias("stop"),
                rule["label"].alias("label"),
                rule["priority"].alias("priority"),
                rule["confidence"].alias("confidence"),
            ),
        )

    return F.flatten(F.transform(F.filter(windows, possible), hits))


def _detections(words: Column, rules: Sequence[Signature]) -> Column:
    """Unsuppressed detections, block by block. What may hold a detection starts less than a window
    before it, and so within its block's margin."""
    count = F.size(words)
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1, F.lit(BLOCK)))
    priorities = sorted({rule.priority for rule in rules})

    def cut(low: Column) -> Column:
        first = F.greatest(low - WINDOW, F.lit(0))
        last = F.least(low + BLOCK + WINDOW, count) - 1
        own = F.transform(F.sequence(first, last), lambda i: F.get(words, i))
        return F.struct(low.alias("low"), first.alias("first"), own.alias("words"))

    def searched(block: Column) -> Column:
        found = _found(block["words"], block["first"], block["low"] + BLOCK, rules)
        return F.struct(block["low"].alias("low"), found.alias("found"))

    def resolved(block: Column) -> Column:
        several = F.when(F.size(block["found"]) > 1, _unsuppressed(block["found"], priorities))
        left = F.coalesce(several, block["found"])
        return F.filter(left, lambda d: d["start"] >= block["low"])

    blocks = F.coalesce(starts, F.array().cast("array<int>"))
    for step in (cut, searched, resolved):
        blocks = F.transform(blocks, step)
    return F.flatten(blocks).cast(DETECTION)


def _unsuppressed(found: Column, priorities: Sequence[int]) -> Column:
    """In order of start, longest first, a detection lies inside an earlier one exactly if that
    one ends no earlier. The furthest end so far is kept for each priority."""
    ordered = F.array_sort(
        F.transform(
            found,
            lambda d: F.struct(
                d["start"].alias("start"),
                (-d["stop"]).alias("back"),
                (-d["priority"]).alias("rank"),
                d["label"].alias("label"),
                d["confidence"].alias("confidence"),
            ),
        )
    )
    nothing = F.struct(
        F.array().cast(DETECTION).alias("kept"),
        F.array(*[F.lit(0) for _ in priorities]).alias("ends"),
    )
    levels = F.array(*[F.lit(p) for p in priorities])

    def step(state: Column, d: Column) -> Column:
        stop, priority = -d["back"], -d["rank"]
        inside = F.exists(
            F.zip_with(state["ends"], levels, lambda end, level: (level >= priority) & (end >= stop)),
            lambda e: e,
        )
        detection = F.struct(
            d["start"].alias("start"), stop.alias("stop"), d["label"].alias("label"),
            priority.alias("priority"), d["confidence"].alias("confidence"),
        )
        ends = F.zip_with(
            state["ends"], levels, lambda end, level: F.when(level == priority, F.greatest(end, stop)).otherwise(end)
        )
        kept = F.when(inside, state["kept"]).otherwise(F.array_append(state["kept"], detection))
        return F.struct(kept.cast(DETECTION).alias("kept"), ends.alias("ends"))

    return F.aggregate(ordered, nothing, step, lambda state: state["kept"])


def detect(
    docs: DataFrame,
    rules: Sequence[Signature] | None = None,
    gates: Sequence[Gate] | None = None,
    text_column: str = "text",
) -> DataFrame:
    """`docs` with `n_words`, `signature_words` (lower-case words where a gate is open, else
    empty) and `detections`: (start, stop, label, priority, confidence), by start. The gates are
    those of the rules, if not given; the words of every text are kept if there are none."""
    rules = signatures() if rules is None else rules
    gates = gates_of(rules) if gates is None else gates
    text = F.coalesce(F.col(text_column), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    nothing = F.array().cast("array<string>")
    small = F.transform(words, lambda word: F.translate(word, UPPER, LOWER))
    opened = docs.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "signature_words": F.when(_gate(text, gates), small).otherwise(nothing) if gates else small,
        }
    )
    return opened.withColumn("detections", _detections(F.col("signature_words"), rules))


def license_scan(
    docs: DataFrame,
    rules: Sequence[Signature] | None = None,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per document: words, places of the base phrases, labels of phrases and rules, a score
    (the best confidence; `PHRASE_SCORE` for a phrase alone) and the detections."""
    rules = signatures() if rules is None else rules
    words = [phrase.split(" ") for phrase, _ in phrases]
    gates = [*gates_of(rules), *[Gate(first, [frozenset(rest)]) for first, *rest in words]]
    found = detect(docs.select(id_column, text_column), rules, gates, text_column)
    places = F.array(
        *[
            F.struct(_places(F.col("signature_words"), phrase).alias("at"), F.lit(label).alias("label"))
            for phrase, label in phrases
        ]
    )
    found = found.withColumn("places", F.filter(places, lambda p: F.size(p["at"]) > 0))
    starts = F.flatten(F.transform("places", lambda p: p["at"]))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_union(base, F.transform("detections", lambda d: d["label"]))
    best = F.array_max(F.transform("detections", lambda d: d["confidence"]))
    phrase_score = F.when(F.size("places") > 0, F.lit(PHRASE_SCORE)).otherwise(F.lit(0.0))
    return found.select(
        id_column,
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), phrase_score).alias("score"),
        "detections",
    )
