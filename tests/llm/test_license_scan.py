from __future__ import annotations

import re

from clickloom.llm import license_rules, license_scan
from frames import rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "Released under the MIT License. mit-license, MIT\nLICENSE! émit license",
    "Licensed under the Apache License, Version 2.0.",
    "GNU General Public License v3; general public license; general public",
    "Licensed under CC BY-NC 4.0. All rights reserved.",
    "nothing here", "", None, "license", "mit mit license license", "K license \u212aelvin MIT license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "mit license " * 3000,
]


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    starts, labels = [], set()
    for phrase, label in license_scan.PHRASES:
        wanted = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_words_and_base_phrases_equal_brute_force(documents):
    found = license_scan.license_scan(documents(*TEXTS))
    for doc_id, *rest in rows(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"):
        assert tuple(rest) == brute(TEXTS[doc_id])


def test_labels_and_suppression(documents):
    found = license_scan.license_scan(documents(*TEXTS)).orderBy("doc_id")
    labels = [r.labels for r in found.collect()]
    assert labels[1] == "apache,apache-2.0"
    assert labels[2] == "gpl,gpl-3.0"
    assert labels[3] == "all-rights-reserved,cc-by-nc-4.0"
    assert labels[4:7] == ["", "", ""]
    assert labels[10] == "mit"
    # The version with its lead-in holds the shorter detections.
    kept = [(d.start, d.stop, d.label) for d in found.collect()[1].detections]
    assert kept == [(0, 8, "apache-2.0")]
    assert all(0 <= r.score <= 1 for r in found.collect())
    assert found.collect()[4].score == 0


def suppressed_by_brute_force(found):
    def inside(d, e):
        if e[0] <= d[0] and e[1] >= d[1] and e[3] >= d[3]:
            same = (e[0], e[1], e[3]) == (d[0], d[1], d[3])
            return not same or (e[2], e[4]) < (d[2], d[4])
        return False

    return [d for d in found if not any(inside(d, e) for e in found)]


def test_suppression_equals_brute_force(spark):
    import random

    rnd = random.Random(3)
    detections = [
        sorted({(s, s + rnd.randint(1, 6), rnd.choice("abc"), rnd.randint(1, 3), 0.5) for s in [rnd.randint(0, 9) for _ in range(8)]})
        for _ in range(60)
    ]
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(detections)], f"id int, found {license_scan.DETECTION}")
    kept = frame.select("id", license_scan._unsuppressed(frame["found"], [1, 2, 3]).alias("kept"))
    for i, left in rows(kept):
        assert sorted(map(tuple, left)) == sorted(suppressed_by_brute_force(detections[i]))


def test_there_are_hundreds_of_rules_and_all_begin_with_their_keyword():
    rules = license_rules.signatures()
    assert len(rules) >= 400
    assert all(rule.pattern.startswith(rule.keyword) for rule in rules)


def sample(pattern):
    """A text that a pattern matches: without what is optional, with the first of alternatives."""
    pattern, groups = re.sub(r"\.\{1,60\}", "x", pattern.replace("[cs]", "c").replace(" ?", " ")), 1
    while groups:
        pattern, groups = re.subn(r"\(\?:([^()]*)\)(\??)", lambda m: "" if m[2] else m[1].split("|")[0], pattern)
    return pattern


def test_the_gate_loses_no_detection_of_any_rule(documents):
    rules = license_rules.signatures()
    texts = [sample(rule.pattern) for rule in rules]
    assert all(re.match(rule.pattern + "( |$)", text) for rule, text in zip(rules, texts, strict=True))
    texts = [f"a,{text.upper().replace(' ', chr(10))}. z" for text in texts] + ["nothing", "replies, access", "", None]
    docs = documents(*texts)
    found, every = (
        dict(rows(license_scan.detect(docs, gates=gates), "doc_id", "detections")) for gates in (None, [])
    )
    assert found == every
    assert all(found[at] for at in range(len(rules)))
    shut = rows(license_scan.detect(docs).filter("size(signature_words) = 0"), "doc_id")
    assert len(shut) == 4


def test_names_without_the_word_license_are_labelled(documents):
    expected = {
        "Released under MIT.": "mit", "available under the EPL": "epl", "MPL 2.0": "mpl-2.0",
        "distributed under the Boost Software 1.0": "boost-1.0", "CC0 1.0": "cc0-1.0",
        "CC\nBY 4.0": "cc-by-4.0", "CC  BY 4.0": "cc-by-4.0",
    }
    found = rows(license_scan.license_scan(documents(*expected)), "doc_id", "labels", "score")
    for at, label in enumerate(expected.values()):
        assert label in dict((i, labels.split(",")) for i, labels, _ in found)[at]
    assert all(score > 0 for _, _, score in found)


def test_repeated_rows_extra_columns_and_empty_tables(documents):
    docs = documents("mit license", "mit license", ids=[4, 4]).withColumnRenamed("lang", "labels")
    assert rows(license_scan.license_scan(docs), "doc_id", "n_base") == [(4, 1), (4, 1)]
    assert license_scan.license_scan(docs.limit(0)).count() == 0


def test_blocks_find_what_the_whole_text_holds(spark, documents, monkeypatch):
    import random

    rnd = random.Random(8)
    parts = ["licensed under the apache license version 2.0", "mit license", "gnu general public license v3", "word", "under the", "all rights reserved"]
    texts = [" ".join(rnd.choice(parts) for _ in range(n)) for n in (0, 1, 5, 40, 150, 400)]
    whole = sorted(rows(license_scan.detect(documents(*texts)), "doc_id", "detections"))
    monkeypatch.setattr(license_scan, "BLOCK", 7)
    assert sorted(rows(license_scan.detect(documents(*texts)), "doc_id", "detections")) == whole
    assert sum(len(found) for _, found in whole) > 100


def test_a_very_long_text_and_clashing_columns(spark):
    n = 100_000
    text = "licensed under the mit license with words " * (n // 7)
    docs = spark.createDataFrame([(1, text, 5, "x")], "doc_id long, text string, detections int, signature_words string")
    (row,) = license_scan.license_scan(docs).collect()
    assert (row.n_words, row.n_base, row.labels, len(row.detections)) == (n // 7 * 7, n // 7, "mit", n // 7)
