"""PII: detected entities are replaced by keyed surrogates of the same kind and format.

Mail addresses, telephone numbers, IP addresses of both versions, card, bank account (IBAN) and social
security numbers are found, and persons after a form of address or with a known given name; bare
surnames of such a person in the same text are found too. Card numbers of the
2 series without separators, IBANs and IPv6 addresses count only if valid. A given name that is in no list (`GIVEN`,
`NAMES`), without a form of address before it, is not found. A
surrogate follows from a secret key, the entity and an attempt: the same entity gets the same
surrogate everywhere. Two entities whose surrogates are equal, or a surrogate that occurs as an
entity of the corpus, are told apart by joins over the distinct entities, and the loser takes its
next attempt, until all are distinct and new.

Given names keep gender and script, surnames the script (and a Slavic feminine ending), numbers their
digits' grouping, cards a valid check digit, addresses a reserved domain.

Defined cases: a null text stays null and has no entities. Rows are treated each for itself, other
columns stay; outputs replace columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from ipaddress import AddressValueError, IPv6Address

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.arrow import Step, mapped, unused, with_columns
from clickloom.sources.staging import Staging

ATTEMPTS = 40

MAIL = regex.compile(r"(?<![\w.+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,6}\p{L}{2,24}(?![\p{L}\p{N}-])")
ADDRESS = regex.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
PHONE = regex.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])")
CARD = regex.compile(r"(?<![\w.-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])")
# Without signs that set a number apart: trunk or country prefix, area code, and the rest.
PLAIN_PHONE = regex.compile(
    r"(?<![\w.+-])(?:"
    r"(?:1[ .-]?)?(?:\([2-9]\d{2}\)[ .-]?|[2-9]\d{2}[ .-])\d{3}[ .-]\d{4}"
    r"|1?[2-9]\d{9}"
    r"|(?<!\d )00[1-9]\d{0,2}(?:[ ./-]?\d{2,4}){2,4}"
    r"|(?<!\d )0[1-9]\d{1,3}[ /-]\d{3,4}[ -]?\d{3,5}"
    r"|(?<!\d )0[1-9](?:[ .]\d{2}){4}"
    r"|0[1-9]\d{8,9}"
    r")(?![\w-]|[.,]\d)"
)
OTHER_CARD = regex.compile(r"(?<![\w.-])(?:3[47]\d{2}[ -]?\d{6}[ -]?\d{5}|2[2-7]\d{2}(?:[ -]?\d{4}){3})(?![\w-])")
IPV6 = regex.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9A-Fa-f]{1,4})?(?!\w|:[0-9A-Fa-f:])")
IBAN = regex.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
SOCIAL = regex.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
# Forms of address and the gender they tell.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f",
    "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f",
    "Господин": "m", "Госпожа": "f", "г-н": "m", "г-жа": "f",
}
PERSON = regex.compile(
    r"(?<![\p{L}])(" + "|".join(sorted(map(regex.escape, TITLES), key=len, reverse=True)) + r")\.? "
    r"(\p{Lu}\p{Ll}{1,30})(?: (\p{Lu}\p{Ll}{1,30}))?(?![\p{L}])"
)
# A capitalised word and the one after it, which may be the next such pair's first.
PAIR = regex.compile(
    r"(?<![\p{L}])(\p{Lu}\p{Ll}{1,30})(?= (?:\p{Lu}\. )?(\p{Lu}(?:\p{Ll}|['’-]?\p{Lu}\p{Ll}){1,30})(?![\p{L}]))"
)
GIVEN = {
    ("f", "latin"): "Anna Clara Elena Emma Flora Greta Helena Irma Julia Laura Maria Nora Olivia Paula Rosa Vera".split(),
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Henry Ivan Jonas Leo Martin Oscar Paul Robert Victor".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Лидия Мария Нина Ольга София".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Денис Егор Иван Максим Олег Павел Роман".split(),
}
# Frequent given names that tell a person without a form of address, besides those of `GIVEN`.
# Names that are common words as well (Will, May, Grace) are left out.
NAMES = {
    "f": """Alexandra Alice Alicia Amanda Amelia Amy Ana Andrea Angela Anita Anne Annette Antonia Ashley Barbara
        Beatriz Betty Brenda Brigitte Camille Carla Carmen Carol Caroline Catherine Charlotte Christina Christine
        Cynthia Daniela Deborah Diana Donna Dorothy Edith Elisabeth Elizabeth Emily Emilia Esther Eva Franziska
        Gabriela Hannah Heather Heike Ines Ingrid Isabel Isabella Jane Janet Jennifer Jessica Joan Johanna Judith
        Karen Karin Katharina Katherine Kathleen Kimberly Lena Lina Linda Lisa Louise Lucia Lucy Margaret Marie
        Marta Martha Martina Mary Megan Melissa Mia Michelle Monica Monika Nancy Natalia Nicole Patricia Petra
        Pilar Rachel Rebecca Renate Ruth Sabine Samantha Sandra Sara Sarah Sharon Silvia Sofia Sophia Sophie
        Stephanie Susan Susanne Teresa Theresa Ursula Valentina Valeria Victoria Virginia Yvonne
        Александра Алина Алла Анастасия Валентина Галина Екатерина Жанна Зоя Ксения Людмила Маргарита Марина
        Надежда Наталья Оксана Полина Светлана Татьяна Юлия""".split(),
    "m": """Aaron Alan Albert Alejandro Alexander Alfred Andreas Andrew Anthony Antonio Arthur Benjamin Bernard
        Bernd Brandon Brian Carlos Charles Christian Christopher Daniel Dennis Diego Dieter Donald Douglas Edward
        Enrique Eric Ethan Fernando Francis Francisco François Franz Frederick Friedrich Gary George Gerald Gerhard
        Gregory Günter Hans Harold Heinrich Helmut Hugo Ian Jack Jacob Jacques James Jan Jason Javier Jean Jeffrey
        Jeremy Jesús Joachim Johannes John Jonathan Jorge Joseph José Joshua Juan Jürgen Karl Keith Kenneth Kevin
        Klaus Larry Lawrence Louis Luca Lucas Luis Lukas Manuel Marc Marco Markus Mathias Matthew Matthias Max
        Michael Michel Miguel Moritz Nathan Nicholas Nicolas Pablo Patrick Pedro Peter Philip Philippe Pierre
        Rafael Ralph Raymond Ricardo Richard Roger Roland Ronald Rudolf Ryan Samuel Scott Sebastian Sergio Simon
        Stefan Stephen Steven Thomas Timothy Tobias Tom Ulrich Uwe Vincent Walter Werner William Wolfgang
        Александр Алексей Анатолий Андрей Артём Василий Владимир Дмитрий Евгений Игорь Кирилл Константин Михаил
        Николай Пётр Сергей Степан Юрий""".split(),
}
GENDERS = {name: gender for gender, names in NAMES.items() for name in names}
GENDERS |= {name: gender for (gender, _), names in GIVEN.items() for name in names}
SYLLABLES = {
    "latin": "ba be bo da de di fa fe ga go ha ka ko la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se ta te ti to va ve".split(),
    "cyrillic": "ба бе бо ва ве го да де ди за ка ко ла ле ли ло ма ме ми мо на не но па пе ра ре ри ро са се та те".split(),
}


def script(word: str) -> str:
    return "cyrillic" if regex.match(r"\p{Cyrillic}", word) else "latin"


def luhn_valid(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if at % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def iban_valid(compact: str) -> bool:
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int, str, str]]:
    """A candidate may have swallowed words after the number; they are given back one by one."""
    for match in IBAN.finditer(text):
        written = match[0]
        while written and not iban_valid(written.replace(" ", "")):
            written = written.rpartition(" ")[0]
        if written:
            yield match.start(), match.start() + len(written), "iban", written.replace(" ", "")


def _long_addresses(text: str) -> Iterator[tuple[int, int, str, str]]:
    for match in IPV6.finditer(text):
        written = match[0]
        if written.endswith(":") and not written.endswith("::"):
            written = written[:-1]
        try:
            value = str(IPv6Address(written))
        except AddressValueError:
            continue
        # Colons between two short words are more likely a path of names.
        if any(c.isdigit() for c in written) or written.count(":") > 3:
            yield match.start(), match.start() + len(written), "ipv6", value


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, stop, kind, value), in order and without overlaps; earlier kinds come first."""
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    has_digit = regex.search(r"\d", text) is not None
    if "@" in text:
        found += [(m.start(), m.end(), "mail", m[0].lower()) for m in MAIL.finditer(text)]
    if has_digit:
        for kind, pattern in (
            ("ip", ADDRESS), ("card", CARD), ("card", OTHER_CARD), ("social", SOCIAL), ("phone", PHONE), ("phone", PLAIN_PHONE),
        ):
            for match in pattern.finditer(text):
                digits = regex.sub(r"\D", "", match[0])
                if pattern is OTHER_CARD and match[0] == digits and not luhn_valid(digits):
                    continue
                if kind == "card" and not 13 <= len(digits) <= 19 or kind == "phone" and not 7 <= len(digits) <= 15:
                    continue
                found.append((match.start(), match.end(), kind, match[0] if kind == "ip" else digits))
        found += _ibans(text)
    if "::" in text or text.count(":") >= 7:
        found += _long_addresses(text)
    surnames: set[str] = set()
    for match in PERSON.finditer(text):
        gender = TITLES[match[1]] or _gender(match[2])
        if match[3]:
            found.append((match.start(2), match.end(2), f"given-{gender or 'm'}-{script(match[2])}", match[2]))
        at = 3 if match[3] else 2
        found.append((match.start(at), match.end(at), f"surname-{script(match[at])}", match[at]))
        surnames.add(match[at])
    for match in PAIR.finditer(text):
        if match[1] in GENDERS and match[1] not in surnames:
            found.append((match.start(1), match.end(1), f"given-{GENDERS[match[1]]}-{script(match[1])}", match[1]))
            found.append((match.start(2), match.end(2), f"surname-{script(match[2])}", match[2]))
            surnames.add(match[2])
    if surnames:
        again = regex.compile(r"(?<![\p{L}])(?:" + "|".join(sorted(map(regex.escape, surnames))) + r")(?![\p{L}])")
        found += [(m.start(), m.end(), f"surname-{script(m[0])}", m[0]) for m in again.finditer(text)]
    order = {"mail": 0, "ip": 1, "ipv6": 1, "iban": 1, "card": 2, "social": 3, "phone": 4}
    kept, end = [], 0
    for entity in sorted(found, key=lambda e: (e[0], order.get(e[2], 5), -e[1])):
        if entity[0] >= end:
            kept.append(entity)
            end = entity[1]
    return kept


def _gender(given: str) -> str:
    if given in GENDERS:
        return GENDERS[given]
    return "f" if given[-1] in "aая" else "m"


class Stream:
    """Numbers that follow from the key, a label and a value."""

    def __init__(self, key: bytes, *parts: str):
        message = "\0".join(parts).encode("utf-8", "surrogatepass")
        self.number = int.from_bytes(blake2b(message, key=key, digest_size=64).digest(), "big")

    def below(self, n: int) -> int:
        self.number, rest = divmod(self.number, n)
        return rest


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """What stands for an entity at some attempt; digits alone for numbers."""
    stream = Stream(key, kind, value, str(attempt))
    if kind == "mail":
        return _mail(key, value, stream)
    if kind == "ip":
        first = 10 if attempt < 8 else 11 + stream.below(180)
        return ".".join(str(n) for n in (first, stream.below(256), stream.below(256), 1 + stream.below(254)))
    if kind == "ipv6":
        # The block that is reserved for documentation.
        return str(IPv6Address((0x20010DB8 << 96) + stream.below(1 << 96)))
    if kind == "iban":
        rest = "".join(
            str(stream.below(10)) if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[stream.below(26)] for c in value[4:]
        )
        number = int("".join(str(int(c, 36)) for c in rest + value[:2] + "00"))
        return f"{value[:2]}{98 - number % 97:02d}{rest}"
    if kind == "card":
        body = value[0] + "".join(str(stream.below(10)) for _ in value[1:-1])
        if not luhn_valid(value):
            return body + str(stream.below(10))
        return next(body + str(d) for d in range(10) if luhn_valid(body + str(d)))
    if kind == "social":
        return str(900 + stream.below(100)) + "".join(str(stream.below(10)) for _ in value[3:])
    if kind == "phone":
        return _phone(value, stream)
    if kind.startswith("given"):
        _, gender, letters = kind.split("-")
        names = GIVEN[gender, letters]
        if attempt < 4:
            return names[stream.below(len(names))]
        ending = ("а" if letters == "cyrillic" else "a") if gender == "f" else ("н" if letters == "cyrillic" else "n")
        return _syllables(stream, letters, 2 + attempt // 8) + ending
    letters = kind.partition("-")[2]
    if letters == "cyrillic":
        ending = "ова" if value.endswith(("ва", "на", "ая")) else "ов"
        return _syllables(stream, letters, 3 + attempt // 8) + ending
    return _syllables(stream, letters, 3 + attempt // 8) + "nrst"[stream.below(4)]


def _syllables(stream: Stream, letters: str, n: int) -> str:
    parts = SYLLABLES[letters]
    return "".join(parts[stream.below(len(parts))] for _ in range(n)).capitalize()


def _mail(key: bytes, value: str, stream: Stream) -> str:
    """Letters for letters and digits for digits; a domain keeps its end and becomes a reserved one."""
    name, _, domain = value.partition("@")
    shaped = "".join(
        str(stream.below(10)) if c.isdigit() else "abcdefghijklmnopqrstuvwxyz"[stream.below(26)] if c.isalpha() else c
        for c in name
    )
    if len(shaped) < 6:
        shaped += "".join("abcdefghijklmnopqrstuvwxyz"[stream.below(26)] for _ in range(6 - len(shaped)))
    own = Stream(key, "domain", domain)
    label = "".join("bcdfghjklmnpqrstvwxz"[own.below(20)] for _ in range(6))
    end = domain.rpartition(".")[2]
    return f"{shaped}@{label}.example" + (f".{end}" if end in ("com", "net", "org") else "")


def _phone(digits: str, stream: Stream) -> str:
    """The last ten digits change, but for an exchange of 555 and a trunk prefix."""
    head, tail = digits[:-10], digits[-10:]
    new = ["0" if tail[0] == "0" else str(2 + stream.below(8)), *[str(stream.below(10)) for _ in tail[1:]]]
    if len(tail) == 10 and tail[3:6] == "555":
        new[3:6] = "555"
    return head + "".join(new)


def shaped(original: str, kind: str, value: str) -> str:
    """A surrogate in the original's format: separators stay, capital letters too."""
    if kind in ("card", "social", "phone"):
        digits = iter(value)
        return "".join(next(digits, "0") if c.isdigit() else c for c in original)
    if kind == "iban":
        signs = iter(value)
        return "".join(c if c == " " else next(signs) for c in original)
    if kind in ("mail", "ipv6") and original.isupper():
        return value.upper()
    return value


def detector(text_column: str, into: str) -> Step:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "stop", "kind", "value")
        for batch in batches:
            found = [
                [dict(zip(names, entity, strict=True)) for entity in find(text)]
                for text in batch.column(text_column).to_pylist()
            ]
            yield with_columns(batch, {into: pa.array(found, kind)})

    return run


def replacer(text_column: str, entities: str, surrogates: str) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                replaced(*row)
                for row in zip(*[batch.column(c).to_pylist() for c in (text_column, entities, surrogates)], strict=True)
            ]
            yield with_columns(batch, {text_column: pa.array(texts, pa.string())})

    return run


def replaced(text: str, entities: list[dict], surrogates: list[dict]) -> str:
    chosen = {(s["kind"], s["value"]): s["surrogate"] for s in surrogates}
    parts, at = [], 0
    for entity in entities:
        original = text[entity["start"] : entity["stop"]]
        parts += [text[at : entity["start"]], shaped(original, entity["kind"], chosen[entity["kind"], entity["value"]])]
        at = entity["stop"]
    return "".join([*parts, text[at:]])


def proposer(key: bytes, attempt: int) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist(), strict=True)
            new = [surrogate(key, kind, value, attempt) for kind, value in rows]
            yield with_columns(
                batch,
                {"attempt": pa.array([attempt] * len(new), pa.int32()), "surrogate": pa.array(new, pa.string())},
            )

    return run


def assigned(units: DataFrame, key: bytes, staging: Staging) -> DataFrame:
    """(kind, value, attempt, surrogate) for distinct entities: all surrogates of a kind are distinct
    and none is an entity of that kind."""
    fields = [T.StructField("attempt", T.IntegerType()), T.StructField("surrogate", T.StringType())]
    taken = units.select("kind", F.col("value").alias("surrogate"))
    settled, open_units = None, units
    for attempt in range(ATTEMPTS):
        proposed = mapped(open_units, [proposer(key, attempt)], fields)
        # An entity's own value is no surrogate of anything.
        fresh = proposed.join(taken, ["kind", "surrogate"], "left_anti")
        every = fresh if settled is None else settled.unionByName(fresh)
        first = every.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("first"))
        now = first.select("kind", F.col("first.value").alias("value"), F.col("first.attempt").alias("attempt"), "surrogate")
        settled = staging.put(now, "settled")
        open_units = staging.put(units.join(settled.select("kind", "value"), ["kind", "value"], "left_anti"), "open")
        if open_units.isEmpty():
            return settled
    raise ValueError("too many distinct entities of one format to tell their surrogates apart")


def replace_pii(docs: DataFrame, key: bytes, staging: Staging, text_column: str = "text") -> DataFrame:
    """`docs` with surrogates in the text and `n_entities`, the entities replaced."""
    entity = T.StructType([T.StructField(n, T.IntegerType() if n in ("start", "stop") else T.StringType()) for n in ("start", "stop", "kind", "value")])
    columns = [c for c in docs.columns if c.lower() != "n_entities"]
    entities, row, chosen = (unused(name, columns) for name in ("pii_entities", "pii_row", "pii_surrogates"))
    detected = T.StructField(entities, T.ArrayType(entity))
    found = mapped(docs.select(*columns), [detector(text_column, entities)], [detected])
    clean = found.filter(F.size(entities) == 0).select(*columns, F.lit(0).cast("long").alias("n_entities"))
    touched = staging.put(found.filter(F.size(entities) > 0).withColumn(row, F.monotonically_increasing_id()), "touched")
    mentions = touched.select(F.col(row).alias("row"), F.explode(entities).alias("e"))
    mentions = mentions.select("row", "e.kind", "e.value").distinct()
    units = staging.put(mentions.select("kind", "value").distinct(), "units")
    known = mentions.join(assigned(units, key, staging), ["kind", "value"]).groupBy(F.col("row").alias(row))
    known = known.agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias(chosen))
    replace = replacer(text_column, entities, chosen)
    changed = mapped(touched.join(known, row), [replace], [docs.schema[text_column]], keep=[*columns, entities])
    changed = changed.select(*columns, F.size(entities).cast("long").alias("n_entities"))
    return changed.unionByName(clean)
