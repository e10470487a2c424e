"""Signature rules of the licence scan, written over a text's lower-case words.

A rule reads words joined by single spaces and begins with one literal word, its keyword. Rules
come from hand-written name patterns and hand-written lead-ins, each combination being one rule,
and from the first sentences of well-known licence texts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple


class Signature(NamedTuple):
    keyword: str
    pattern: str
    label: str
    priority: int
    confidence: float


class Gate(NamedTuple):
    """A word that a text must have, and alternatives of strings one of which it must hold whole."""

    keyword: str
    holds: list[frozenset[str]]


class Family(NamedTuple):
    label: str
    first: str
    rest: str
    versions: tuple[str, ...] = ()


LICENSE = "licen[cs]e"
# Alternatives of a gate; where its rules have more, it asks for what they have in common.
ALTERNATIVES = 8

# Name patterns: label, first word, what follows it, known versions.
FAMILIES = [
    Family("mit", "mit", ""),
    Family("mit", "expat", ""),
    Family("apache", "apache", "(?: software)?", ("2.0", "1.1", "1.0")),
    Family("asl", "asl", "", ("2.0", "1.1")),
    Family("gpl", "gnu", " general public", ("3.0", "2.0", "1.0")),
    Family("gpl", "gnu", " gpl", ("3.0", "2.0")),
    Family("gpl", "gpl", "", ("3.0", "2.0")),
    Family("gpl", "general", " public", ("3.0", "2.0")),
    Family("lgpl", "gnu", " (?:lesser|library) general public", ("3.0", "2.1", "2.0")),
    Family("lgpl", "lesser", " general public", ("3.0", "2.1")),
    Family("lgpl", "lgpl", "", ("3.0", "2.1", "2.0")),
    Family("agpl", "gnu", " affero general public", ("3.0",)),
    Family("agpl", "affero", " general public", ("3.0",)),
    Family("agpl", "agpl", "", ("3.0",)),
    Family("gfdl", "gnu", " free documentation", ("1.3", "1.2", "1.1")),
    Family("bsd-3-clause", "bsd", " 3 clause"),
    Family("bsd-3-clause", "3", " clause bsd"),
    Family("bsd-3-clause", "new", " bsd"),
    Family("bsd-2-clause", "bsd", " 2 clause"),
    Family("bsd-2-clause", "2", " clause bsd"),
    Family("bsd-2-clause", "simplified", " bsd"),
    Family("0bsd", "0bsd", ""),
    Family("bsd", "bsd", ""),
    Family("isc", "isc", ""),
    Family("zlib", "zlib", "(?: libpng)?"),
    Family("mpl", "mozilla", " public", ("2.0", "1.1", "1.0")),
    Family("mpl", "mpl", "", ("2.0", "1.1")),
    Family("epl", "eclipse", " public", ("2.0", "1.0")),
    Family("epl", "epl", "", ("2.0", "1.0")),
    Family("cddl", "common", " development and distribution", ("1.1", "1.0")),
    Family("cpl", "common", " public", ("1.0",)),
    Family("eupl", "european", " union public", ("1.2", "1.1")),
    Family("boost", "boost", " software", ("1.0",)),
    Family("artistic", "artistic", "", ("2.0", "1.0")),
    Family("python", "python", " software foundation", ("2.0",)),
    Family("ofl", "sil", " open font", ("1.1",)),
    Family("odbl", "open", " database", ("1.0",)),
    Family("wtfpl", "wtfpl", "", ("2.0",)),
    Family("unlicense", "unlicense", ""),
    Family("ms-pl", "microsoft", " public"),
    Family("cc0", "cc0", "", ("1.0",)),
    Family("cc0", "creative", " commons zero", ("1.0",)),
    Family("cc-by-nc-nd", "cc", " by nc nd", ("4.0", "3.0")),
    Family("cc-by-nc-sa", "cc", " by nc sa", ("4.0", "3.0")),
    Family("cc-by-nc", "cc", " by nc", ("4.0", "3.0")),
    Family("cc-by-nd", "cc", " by nd", ("4.0", "3.0")),
    Family("cc-by-sa", "cc", " by sa", ("4.0", "3.0")),
    Family("cc-by", "cc", " by", ("4.0", "3.0")),
    Family("cc-by-nc", "creative", " commons attribution non ?commercial", ("4.0", "3.0")),
    Family("cc-by-sa", "creative", " commons attribution share ?alike", ("4.0", "3.0")),
    Family("cc-by", "creative", " commons attribution", ("4.0", "3.0")),
]

# Lead-ins: first word, what may follow it before the name.
LEADS = [
    ("licensed", " (?:under|by)(?: the)?(?: terms of)?(?: the| an?)?"),
    ("licenced", " (?:under|by)(?: the)?(?: terms of)?(?: the| an?)?"),
    ("released", " under(?: the)?(?: terms of)?(?: the| an?)?"),
    ("distributed", " under(?: the)?(?: terms of)?(?: the| an?)?"),
    ("available", " under(?: the)?(?: terms of)?(?: the| an?)?"),
    ("published", " under(?: the)?(?: terms of)?(?: the| an?)?"),
    ("spdx", " license identifier"),
]

# First sentences of licence texts and notices.
SENTENCES = [
    ("permission", " is hereby granted free of charge to any person obtaining a copy", "mit", 0.98),
    ("permission", " to use copy modify and or distribute this software for any purpose", "isc", 0.97),
    ("redistribution", " and use in source and binary forms with or without modification", "bsd", 0.95),
    ("neither", " the name of .{1,60} nor the names of its contributors", "bsd-3-clause", 0.9),
    ("this", " is free and unencumbered software released into the public domain", "unlicense", 0.98),
    ("this", " program is free software you can redistribute it and or modify it", "gpl", 0.95),
    ("this", " library is free software you can redistribute it and or modify it", "lgpl", 0.95),
    ("this", " software is provided as is without any express or implied warranty", "zlib", 0.8),
    ("this", " source code form is subject to the terms of the mozilla public", "mpl", 0.97),
    ("dedicated", " to the public domain", "public-domain", 0.8),
    ("public", " domain dedication", "public-domain", 0.7),
    ("no", " rights reserved", "public-domain", 0.6),
    ("all", " rights reserved", "all-rights-reserved", 0.6),
    ("some", " rights reserved", "some-rights-reserved", 0.5),
    ("proprietary", " and confidential", "proprietary", 0.7),
    ("unauthorized", " (?:copying|use|reproduction|distribution)", "proprietary", 0.6),
    ("unauthorised", " (?:copying|use|reproduction|distribution)", "proprietary", 0.6),
]

def _version(version: str) -> str:
    major, minor = version.split(".")
    optional = f"(?: {minor})?" if minor == "0" else f" {minor}"
    return f"(?: {LICENSE})?(?:(?: version| v)? {major}| v{major}){optional}"


def signatures() -> list[Signature]:
    """All rules. Versions rank above bare names, a lead-in above none, a sentence above both."""
    rules = [Signature(first, first + rest, label, 5, confidence) for first, rest, label, confidence in SENTENCES]
    for family in FAMILIES:
        name = family.first + family.rest
        rules.append(Signature(family.first, f"{name} {LICENSE}", family.label, 1, 0.6))
        for version in family.versions:
            exact = f"{family.label}-{version}"
            rules.append(Signature(family.first, name + _version(version), exact, 3, 0.8))
        for first, lead in LEADS:
            rules.append(Signature(first, f"{first}{lead} {name}(?: {LICENSE})?", family.label, 2, 0.9))
            for version in family.versions:
                exact = f"{family.label}-{version}"
                rules.append(Signature(first, f"{first}{lead} {name}{_version(version)}", exact, 4, 0.95))
    return rules


def literals(pattern: str) -> frozenset[str]:
    """Strings that every match of a pattern holds: its letters and digits outside groups, classes
    and repeats."""
    pattern, groups = pattern + "\n", 1
    while groups:
        pattern, groups = re.subn(r"\([^()]*\)\??", "\n", pattern)
    plain = re.sub(r"\[[^\]]*\]|\.|\{[^}]*\}| \?", "\n", pattern)
    return frozenset(re.findall("[a-z0-9]+", plain))


def gates(rules: Sequence[Signature]) -> list[Gate]:
    """What a text must have for any of the rules to match, by keyword."""
    needs: dict[str, set[frozenset[str]]] = {}
    for rule in rules:
        needs.setdefault(rule.keyword, set()).add(literals(rule.pattern) - {rule.keyword})
    found = []
    for keyword, every in sorted(needs.items()):
        least = [own for own in every if not any(other < own for other in every)]
        if len(least) > ALTERNATIVES:
            least = [frozenset.intersection(*least)]
        found.append(Gate(keyword, sorted(least, key=sorted)))
    return found
