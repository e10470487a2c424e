from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from clickloom.llm import cotraining, surrogates
from frames import rows

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st")]


def page(rnd, good):
    words = [rnd.choice(WORDS) for _ in range(rnd.randint(20, 120))]
    return " ".join(words).capitalize() + "." if good else "!! ".join(words).upper() + "!!"


def labelled(spark, n=400, labelled_share=0.5):
    rnd = random.Random(11)
    good = [rnd.random() < 0.7 for _ in range(n)]
    docs = [(i, page(rnd, g), "en", f"src{i % 4}", None) for i, g in enumerate(good)]
    labels = [(i, int(g), 0) for i, g in enumerate(good) if rnd.random() < labelled_share]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return good, spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    good, docs, labels = labelled(spark)
    found = cotraining.score(docs, cotraining.train(docs, labels))
    unseen = found.join(labels, "doc_id", "left_anti")
    right = [keep == good[i] for i, keep in rows(unseen, "doc_id", "keep")]
    assert len(right) > 100 and sum(right) >= 0.95 * len(right)
    assert all(0 <= s <= 1 for (s,) in rows(found, "score"))


SOUNDS = {"en": ("bdfgk", "aeiou"), "xx": ("πρστλ", "αεηιο")}


def two_languages(spark):
    """Labels for English only; sites tell of quality in both languages, but for one that has either."""
    rnd, docs, good = random.Random(3), [], []
    for i in range(900):
        lang = "en" if i % 2 else "xx"
        good.append(rnd.random() < 0.5)
        first, then = SOUNDS[lang]
        ends = ("n", "r") if good[i] else ("m", "l")
        words = [rnd.choice(first) + rnd.choice(then) + rnd.choice(ends) for _ in range(40)]
        site = "mixed" if i % 3 == 0 else "fine" if good[i] else "poor"
        docs.append((i, " ".join(words), lang, site, None))
    labels = [(i, int(good[i])) for i in range(900) if i % 2]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return good, spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int")


def test_a_language_without_labels_is_learned_by_exchange(spark):
    good, docs, labels = two_languages(spark)
    unseen = docs.filter("lang = 'xx' and source = 'mixed'")

    def accuracy(rounds):
        found = rows(cotraining.score(unseen, cotraining.train(docs, labels, rounds=rounds)), "doc_id", "content_score")
        return sum((score > 0.5) == good[i] for i, score in found) / len(found)

    alone, taught = accuracy(0), accuracy(3)
    assert taught >= 0.95 and taught > alone + 0.2


def test_the_whole_table_may_teach_and_partitions_do_not_matter(spark, staging):
    _, docs, labels = two_languages(spark)
    one, many = (cotraining.train(docs.repartition(n), labels, rounds=1) for n in (1, 7))
    for view in ("content", "metadata"):
        first, second = getattr(one, view), getattr(many, view)
        assert (first.weights == second.weights).all() and (first.slope, first.shift) == (second.slope, second.shift)
    assert (one.cut, one.prior) == (many.cut, many.prior)
    names = [field.name for field in cotraining.FEATURES]
    pool = staging.put(cotraining.mapped(docs, [cotraining.featurer], cotraining.FEATURES, keep=["doc_id"]), "pool")
    models = [one.content, one.metadata]
    edges = cotraining.limits(pool, models, 1.0)
    taught = cotraining.mapped(pool, [cotraining.teacher(models, edges)], cotraining.TAUGHT, keep=names)
    # With a share of one, all that either view is sure of is taught; sites make it sure of two thirds.
    assert taught.count() >= 600


def test_gradients_of_the_table_equal_those_of_its_rows(spark):
    import numpy as np

    _, docs, _ = two_languages(spark)
    taught = cotraining.mapped(docs, [cotraining.featurer], cotraining.FEATURES, keep=["doc_id"])
    lessons = taught.selectExpr("*", "cast(doc_id % 3 - 1 as int) content_taught", "cast(doc_id % 2 as int) metadata_taught")
    rnd = np.random.default_rng(5)
    weights = [cotraining.rounded(rnd.normal(size=places)) for places in cotraining.PLACES]
    found = cotraining.gradients(lessons)(weights)
    local = lessons.toPandas()
    views = cotraining.views_of({f.name: list(local[f.name]) for f in cotraining.FEATURES})
    for view, name in enumerate(cotraining.VIEWS):
        target = local[f"{name}_taught"].to_numpy()
        dense = np.zeros((len(local), cotraining.PLACES[view]))
        lengths = np.diff(np.append(views[view].starts, len(views[view].at)))
        dense[np.repeat(np.arange(len(local)), lengths), views[view].at] = views[view].by / 255
        for label in (0, 1):
            own = dense[target == label]
            raw = own @ (weights[view] / cotraining.UNIT)
            n, loss, sums = found[view][label]
            assert n == len(own)
            assert abs(loss / cotraining.UNIT - np.logaddexp(0, raw if label == 0 else -raw).sum()) < 0.01
            slope = (cotraining.logistic(raw) - label) @ own
            assert np.abs(sums / (cotraining.UNIT * cotraining.ONE) - slope).max() < 0.01


def test_labels_are_drawn_by_class(spark):
    _, docs, labels = labelled(spark, 400, 1.0)
    rare = labels.withColumn("quality", F.when(F.col("doc_id") == 7, 0).otherwise(1))
    assert cotraining.train(docs, rare, labelled=20, rounds=1) is not None


def test_without_labels_everything_is_kept(spark):
    _, docs, labels = labelled(spark, 30)
    one_class = labels.withColumn("quality", F.lit(1))
    for known in (labels.limit(0), one_class):
        found = cotraining.score(docs, cotraining.train(docs, known))
        assert rows(found.select("keep", "score").distinct()) == [(True, None)]
    assert cotraining.score(docs.limit(0), None).count() == 0


def test_null_and_empty_documents_are_scored_alike(spark):
    _, docs, labels = labelled(spark)
    model = cotraining.train(docs, labels)
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", None, None, None), (3, "x " * 50_000, "de", "s", 5), (3, "x " * 50_000, "de", "s", 5)],
        docs.schema,
    )
    scores = dict(rows(cotraining.score(odd, model), "doc_id", "score"))
    assert scores[1] == scores[2] and len(scores) == 3


def test_odd_ids_and_clashing_columns(spark):
    _, docs, labels = labelled(spark, 120)
    odd = spark.createDataFrame([(None, "no id", "en", "s", 1), (0, "other text", None, None, None), (0, "x", "en", "s", 2)], docs.schema)
    every = docs.unionByName(odd)
    unknown = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (10**9, 0, 0)], labels.schema))
    first, again = (cotraining.train(every.repartition(n), unknown, rounds=1) for n in (1, 5))
    assert (first.content.weights == again.content.weights).all()
    clashing = every.selectExpr("*", "'k' Keep", "'s' score", "1 label", "2 content_at")
    found = cotraining.score(clashing, first)
    assert found.columns == [*docs.columns, "label", "content_at", "content_score", "metadata_score", "score", "keep"]
    assert found.count() == 123 and found.filter("keep is null or score is null").count() == 0
    assert cotraining.train(docs.limit(0), labels) is None


KEY = b"test"
PRIVATE = [
    "Mr. John Smith wrote to ab.42@mail8.example.com from 42.144.35.254. Smith agreed, SMITHY did not.",
    "call +1 (988) 555-2485 or 4337166598464399, ssn 123-45-6789; AB.42@mail8.example.com",
    "г-жа Анна Петрова и г-жа Петрова", "nothing 12 3.14 2024-01-01 v1.2.3", None, "",
    "Mrs. Jane Smith and Mr. John Smith",
]


def replaced(docs, staging):
    return dict(rows(surrogates.replace_pii(docs, KEY, staging), "doc_id", "text"))


def test_surrogates_keep_kind_format_and_identity(documents, staging):
    texts = replaced(documents(*PRIVATE), staging)
    assert (texts[3], texts[4], texts[5]) == (PRIVATE[3], None, "")
    first = texts[0]
    assert not re.search(r"John|Smith |ab\.42@|42\.144", first) and "SMITHY" in first
    name = re.match(r"Mr\. (\w+) (\w+) wrote", first)
    assert name[1] in surrogates.GIVEN["m", "latin"] and f"{name[2]} agreed" in first
    mail = re.search(r"\S+@\S+", first)[0]
    assert re.fullmatch(r"[a-z]{2}\.\d\d[a-z]*@[a-z]+\.example\.com", mail)
    assert mail.upper() in texts[1] or mail in texts[1].lower()
    phone = re.search(r"\+1 \((\d{3})\) 555-(\d{4})", texts[1])
    assert phone and phone[0] != "+1 (988) 555-2485"
    card = re.search(r"\b4\d{15}\b", texts[1])[0]
    assert card != "4337166598464399" and surrogates.luhn_valid(card) == surrogates.luhn_valid("4337166598464399")
    assert not re.search("Анна|Петрова", texts[2])
    family = re.match(r"г-жа (\w+) (\w+) и г-жа (\w+)", texts[2])
    assert family[2] == family[3] and family[1] in surrogates.GIVEN["f", "cyrillic"]
    assert texts[6].split()[2] == texts[6].split()[-1] == name[2] and texts[6].split()[5] == name[1]


FORMS = {
    "phone": ["1-800-555-1234", "555 123 4567", "5552234567", "030 1234567", "(212) 555-1234", "0049 30 1234567", "01 23 45 67 89"],
    "card": ["3782 822463 10005", "2221 0012 3412 3456", "378282246310005", "4111 1111 1111 1111"],
    "ipv6": ["2001:db8:85a3::8a2e:370:7334", "fe80::1", "2001:0DB8:0:0:0:0:0:1"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "AT61 1904 3002 3457 3201"],
}


def test_every_form_is_found_whole_and_replaced(documents, staging):
    forms = [(kind, form) for kind, own in FORMS.items() for form in own]
    for kind, form in forms:
        for text in (form, f"see {form}, then", f"({form}) WORD", f"at {form}: yes."):
            found = surrogates.find(text)
            assert [(k, text[a:b]) for a, b, k, _ in found] == [(kind, form)], text
    texts = replaced(documents(*[f"see {form}, then" for _, form in forms]), staging)
    for at, (kind, form) in enumerate(forms):
        new = texts[at].removeprefix("see ").removesuffix(", then")
        assert new != form
        if kind == "iban":
            assert surrogates.iban_valid(new.replace(" ", "")) and new[:2] == form[:2]
        if kind == "card":
            assert surrogates.luhn_valid(re.sub(r"\D", "", new)) == surrogates.luhn_valid(re.sub(r"\D", "", form))
            assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", form)


def test_numbers_that_are_no_personal_data_stay():
    for text in ("1700000000", "12:30:45", "std::sort", "2221001234123457", "DE88370400440532013000", "2024-01-01 1,000,000.25"):
        assert surrogates.find(text) == [], text


def test_names_without_a_form_of_address_are_found():
    text = "Yesterday John Smith met Maria O. Jones. Smith left, Jones stayed. Светлана Иванова"
    found = [(kind, text[a:b]) for a, b, kind, _ in surrogates.find(text)]
    assert found == [
        ("given-m-latin", "John"), ("surname-latin", "Smith"), ("given-f-latin", "Maria"), ("surname-latin", "Jones"),
        ("surname-latin", "Smith"), ("surname-latin", "Jones"), ("given-f-cyrillic", "Светлана"), ("surname-cyrillic", "Иванова"),
    ]


def test_surrogates_are_distinct_and_new(spark, documents, staging, monkeypatch):
    # Few surrogates, so that they collide at first.
    plain = surrogates.surrogate
    monkeypatch.setattr(surrogates, "ATTEMPTS", 60)
    values = [f"{i:03d}-45-6789" for i in range(100, 160)]
    units = spark.createDataFrame([("social", v.replace("-", "")) for v in values], "kind string, value string")
    found = surrogates.assigned(units, KEY, staging)
    chosen = rows(found, "value", "surrogate")
    assert len(chosen) == len({s for _, s in chosen}) == 60
    assert not {s for _, s in chosen} & {v for v, _ in chosen}
    names = spark.createDataFrame([("given-f-latin", f"Name{i}") for i in range(40)], "kind string, value string")
    given = rows(surrogates.assigned(names, KEY, staging), "value", "attempt", "surrogate")
    assert len({s for _, _, s in given}) == 40 and max(a for _, a, _ in given) > 0
    assert all(s == plain(KEY, "given-f-latin", v, a) for v, a, s in given)


def test_pii_repeated_rows_extra_columns_and_empty_tables(documents, staging):
    docs = documents("a.b@c.org", "a.b@c.org", ids=[1, 1]).withColumnRenamed("lang", "kind")
    found = surrogates.replace_pii(docs, KEY, staging)
    assert found.columns == [*docs.columns, "n_entities"]
    assert len(set(rows(found, "text"))) == 1 and found.count() == 2
    assert surrogates.replace_pii(docs.limit(0), KEY, staging).count() == 0


def test_the_pipeline_keeps_one_of_each_group_and_clean_documents(spark, staging, tmp_path):
    _, docs, labels = labelled(spark, 200, 0.6)
    clean = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi")
    copies = clean.limit(10).withColumn("doc_id", F.col("doc_id") + 1000)
    folder = str(tmp_path / "data")
    docs.unionByName(copies).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    pieces = corpus_pipeline.run(spark, folder)
    left = {i for (i,) in rows(pieces, "doc_id")}
    assert not any(i >= 1000 for i in left)
    assert len({i for (i,) in rows(clean, "doc_id")} - left) <= 3
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "packing"]
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_surrogates_leave_clashing_columns_alone(spark, staging):
    docs = spark.createDataFrame(
        [(1, "mail ab.42@mail8.example.com", 7, "mine", "kept", 3), (2, "none", 8, "own", "too", 4)],
        "doc_id long, text string, pii_row int, pii_entities string, kind string, N_Entities int",
    )
    found = surrogates.replace_pii(docs, KEY, staging)
    assert found.columns == ["doc_id", "text", "pii_row", "pii_entities", "kind", "n_entities"]
    got = sorted(rows(found, "doc_id", "pii_row", "pii_entities", "kind", "n_entities"))
    assert got == [(1, 7, "mine", "kept", 1), (2, 8, "own", "too", 0)]
