from __future__ import annotations

import math
from collections import defaultdict

import pytest

from clickloom.llm import url_filter
from clickloom.llm.queries import URL_RULES
from frames import rows

URLS = [
    "https://A.Example.ORG/en/1?x", "http://example.org/es/", "http://x.org/fr", "http://shop.com/fr/7",
    "http://shop.com/de/7", "http://com/de/", "no scheme", None, "", "http://notorg/x", "http://x.org",
    "ftp://u://v/w#z", "http://net/é中", "http://example.org/en/2", "http://b.example.org/en/12",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in host), tail[:end]


def ruled(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return (best.text, best.verdict) if best else (None, None)


def test_hosts_paths_and_rules(spark, staging):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    found = url_filter.url_filter(pages.withColumnRenamed("x", "score"), URL_RULES, staging)
    assert found.count() == len(URLS)
    for page_id, host, path, rule, verdict in rows(found, "page_id", "host", "path", "rule", "verdict"):
        assert (host, path) == parts(URLS[page_id])
        text, expected = ruled(host, path)
        assert rule == text
        assert verdict == expected if expected else verdict in ("allow", "block")


def grams(url):
    small = "".join("0" if c in "0123456789" else c if "!" <= c <= "~" else "\x7f" for c in (url or "").lower())
    padded = "\x02" * url_filter.ORDER + small + "\x03"
    return [padded[i : i + url_filter.ORDER + 1] for i in range(len(padded) - url_filter.ORDER)]


def brute_scores(accepted, rejected, urls, support):
    """The same model with dictionaries and recursion."""
    k = url_filter.ORDER
    counts = [defaultdict(int), defaultdict(int)]
    for table, group in zip(counts, (accepted, rejected), strict=True):
        for gram in (g for url in group for g in grams(url)):
            for n in range(1, k + 2):
                table[gram[-n:]] += 1
    total = sum(sum(v for s, v in table.items() if len(s) == 1) for table in counts)
    strings = set(counts[0]) | set(counts[1])
    kept = {s for s in strings if counts[0][s] + counts[1][s] >= total / support}
    context = [defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])]
    for s in strings:
        for c in (0, 1):
            if counts[c][s]:
                context[c][len(s), s[:-1]][0] += counts[c][s]
                context[c][len(s), s[:-1]][1] += 1

    def prob(c, s):
        lower = 1 / url_filter.ALPHABET if len(s) == 1 else prob(c, s[1:])
        n, t = context[c][len(s), s[:-1]]
        return (counts[c][s] + t * lower) / (n + t) if n else lower

    def weight(c, n, s):
        total_here, kinds = context[c][n, s]
        return kinds / (total_here + kinds) if total_here else 1.0

    known = {
        (n, s)
        for c in (0, 1)
        for n, s in context[c]
        if n > 1 and context[0][n, s][0] + context[1][n, s][0] >= total / support
    }
    result = []
    for url in urls:
        terms = []
        for gram in grams(url):
            backed = 0.0
            for n in range(k + 1, 0, -1):
                s = gram[-n:]
                if s in kept:
                    backed += math.log(prob(0, s) / prob(1, s))
                    break
                if n > 1 and (n, s[:-1]) in known:
                    backed += math.log(weight(0, n, s[:-1]) / weight(1, n, s[:-1]))
            terms.append(backed)
        result.append(sum(terms) / len(terms))
    return result


@pytest.mark.parametrize("support", [1 << 16, 40])
def test_scores_equal_a_plain_model(spark, staging, support):
    accepted = [f"http://good{i % 3}.org/news/{i}" for i in range(9)] + ["", "http://a.org/é"]
    rejected = [f"http://bad.com/win-{i}/cash" for i in range(7)]
    labelled = spark.createDataFrame(
        [(u, True, 1) for u in accepted] + [(u, False, 2) for u in rejected], "url string, accepted boolean, copies long"
    )
    learned = url_filter.model(url_filter.counted(labelled), support)
    urls = ["http://good1.org/news/5", "http://bad.com/cash", "zzz", "", "http://é"]
    found = url_filter.scored(spark.createDataFrame([(u,) for u in urls], "url string"), staging.put(learned, "m"))
    expected = dict(zip(urls, brute_scores(accepted, rejected * 2, urls, support), strict=True))
    for url, score in rows(found):
        assert score == pytest.approx(expected[url], abs=1e-9)


def test_held_out_urls_are_told_apart(spark, staging):
    urls = [f"http://site{i}.net/{'article' if i % 2 else 'casino-bonus'}/{i}" for i in range(400)]
    urls += [f"http://s{i}.org/article/{i}" for i in range(300)] + [f"http://s{i}.com/de/casino-bonus/{i}" for i in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = url_filter.url_filter(pages, URL_RULES, staging).filter("rule IS NULL")
    right = sum((verdict == "allow") == ("article" in urls[i]) for i, verdict in rows(found, "page_id", "verdict"))
    assert right >= 0.95 * 400


def test_the_model_keeps_every_string_of_a_large_corpus(spark):
    grams = spark.range(100_000).selectExpr("lpad(conv(id, 10, 36), 5, '!') AS gram", "2L AS n_a", "1L AS n_r")
    learned = url_filter.model(grams)
    assert learned.filter("length(s) = 5 AND ratio IS NOT NULL").count() == 100_000


def test_digits_and_letters_beyond_ascii_are_told_apart(spark, staging):
    urls = [f"http://example.org/en/{i % 2 + 1}" for i in range(2)]
    urls += [f"http://a{i}.example.org/en/{i % 2 + 1}{'жц'[i % 2]}" for i in range(400)]
    tested = ["http://x.net/en/1", "http://x.net/en/2", "http://x.net/ж", "http://x.net/ц", "http://x.net/\U0001f600"]
    pages = spark.createDataFrame(list(enumerate(tested + urls)), "page_id long, url string")
    scores = dict(rows(url_filter.url_filter(pages, URL_RULES, staging), "page_id", "score"))
    assert len(scores) == len(tested) + len(urls)
    assert scores[0] < scores[1] and scores[2] < scores[3]


def test_frequent_grams_are_dealt_over_tasks_alike(spark, staging, monkeypatch):
    labelled = spark.createDataFrame([("http://a.org/1", True, 1), ("http://b.com/2", False, 1)], "url string, accepted boolean, copies long")
    learned = staging.put(url_filter.model(url_filter.counted(labelled)), "m")
    urls = spark.createDataFrame([(f"http://a.org/{i}",) for i in range(30)], "url string")
    expected = dict(rows(url_filter.scored(urls, learned)))
    monkeypatch.setattr(url_filter, "HOT", 1)
    assert dict(rows(url_filter.scored(urls, learned))) == pytest.approx(expected)


def test_repeated_rows_and_empty_tables(spark, staging):
    pages = spark.createDataFrame([(1, "http://x.net/"), (1, "http://x.net/"), (None, None)], "page_id long, url string")
    assert url_filter.url_filter(pages, URL_RULES, staging).count() == 3
    assert url_filter.url_filter(pages.limit(0), URL_RULES, staging).count() == 0
