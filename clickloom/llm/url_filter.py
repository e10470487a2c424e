"""URL filter: site rules first, then a ratio of two character language models.

URLs that a rule allows and URLs that a rule blocks train one variable-order Markov model each.
A model's contexts reach back `ORDER` symbols where the corpus supports them; shorter contexts
stand in for the rest (Witten-Bell smoothing). A URL without a rule is judged by the mean
log-likelihood difference of its symbols against a threshold calibrated on held-out URLs.

Everything is DataFrame code. The model holds every string of the training URLs and grows with
them. The distinct grams of the URLs to be judged are joined with it, length by length, and each
gram's value goes back to the URLs by a join in which frequent grams are dealt over several tasks.

Defined cases: a null URL, or one without `://`, has an empty host and path, fits no rule and is
judged by the model as text. An empty path fits no rule with a path. Repeated rows come back as
often as they came. Where one of the two classes has no URL, the model cannot tell and allows.
Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.sources.staging import Staging

ORDER = 4
# A gram with more than 1/`HOT` of all positions is dealt over `SALTS` tasks; there are at most `HOT`.
HOT = 1024
SALTS = 64
ALPHABET = 96
BINS_PER_NAT = 50
LARGEST_SCORE = 8.0
START, END, OTHER = "\x02", "\x03", "\x7f"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_column(host: Column, path: Column, rules: Sequence[Rule], value) -> Column:
    """`value(rule)` of the longest rule that fits, else null."""
    choice = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda rule: len(rule.text)):
        at_host = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        choice = F.when(at_host & F.startswith(path, F.lit(rule.path)), F.lit(value(rule))).otherwise(choice)
    return choice


def symbols(url: Column, folded: bool = True) -> Column:
    """Small letters, digits, signs; controls and spaces are one symbol. `folded`: all digits are
    one symbol too, and whatever is not ASCII is the same as a control."""
    small = F.lower(F.coalesce(url, F.lit("")))
    if not folded:
        return F.regexp_replace(small, r"[\x00-\x20\x7f]", OTHER)
    return F.regexp_replace(F.regexp_replace(small, "[0-9]", "0"), r"[^\x21-\x7e]", OTHER)


def grams_of(url: Column, folded: bool = True) -> Column:
    """For every symbol and the end: the symbol after its `ORDER` predecessors."""
    padded = F.concat(F.lit(START * ORDER), symbols(url, folded), F.lit(END))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{ORDER + 1}}}))."), F.lit(1))


def _suffix(gram: Column, n: int) -> Column:
    return F.substring(gram, ORDER + 2 - n, n)


def counted(labelled: DataFrame, folded: bool = True) -> DataFrame:
    """From (url, accepted, copies): how often each gram of full length stands in each class."""
    exploded = labelled.select(
        F.explode(grams_of(F.col("url"), folded)).alias("gram"), "accepted", F.col("copies").alias("n")
    )
    return exploded.groupBy("gram").agg(
        F.coalesce(F.sum(F.when(F.col("accepted"), F.col("n"))), F.lit(0)).alias("n_a"),
        F.coalesce(F.sum(F.when(~F.col("accepted"), F.col("n"))), F.lit(0)).alias("n_r"),
    )


def model(counts: DataFrame, support: int | None = None) -> DataFrame:
    """(s, ratio, back): for a string read as context and symbol the log ratio of the classes'
    probabilities, and for a string read as context the log ratio of the weights with which the
    next shorter context is used. With `support`, strings that carry less than 1/`support` of all
    positions are left out."""
    total = 0 if support is None else counts.agg(F.sum(F.col("n_a") + F.col("n_r"))).first()[0] or 0
    least = total / support if support else 0
    tables, below = [], None
    for k in range(ORDER + 1):
        grams = counts.groupBy(_suffix(F.col("gram"), k + 1).alias("s")).agg(
            F.sum("n_a").alias("n_a"), F.sum("n_r").alias("n_r")
        )
        context = F.substring("s", 1, k) if k else F.lit("")
        contexts = grams.groupBy(context.alias("c")).agg(
            F.sum("n_a").alias("c_a"),
            F.sum("n_r").alias("c_r"),
            F.sum(F.expr("int(n_a > 0)")).alias("t_a"),
            F.sum(F.expr("int(n_r > 0)")).alias("t_r"),
        )
        frequent = grams.filter(F.col("n_a") + F.col("n_r") >= least).withColumn("c", context)
        kept = frequent.join(contexts, "c")
        if below is None:
            kept = kept.withColumns({"q_a": F.lit(1.0 / ALPHABET), "q_r": F.lit(1.0 / ALPHABET)})
        else:
            shorter = below.select(F.col("s").alias("tail"), F.col("p_a").alias("q_a"), F.col("p_r").alias("q_r"))
            kept = kept.withColumn("tail", F.substring("s", 2, k)).join(shorter, "tail")
        kept = kept.withColumns({f"p_{x}": _smoothed(x) for x in "ar"})
        below = kept.select("s", "p_a", "p_r")
        tables.append(kept.select("s", F.log(F.col("p_a") / F.col("p_r")).alias("ratio"), F.lit(None).cast("double").alias("back")))
        if k:
            back = F.log(_weight("a") / _weight("r"))
            known = contexts.filter(F.col("c_a") + F.col("c_r") >= least)
            tables.append(known.select(F.col("c").alias("s"), F.lit(None).cast("double").alias("ratio"), back.alias("back")))
    return reduce(DataFrame.unionByName, tables).groupBy("s").agg(
        F.max("ratio").alias("ratio"), F.max("back").alias("back")
    )


def _smoothed(x: str) -> Column:
    n, c, t, q = (F.col(f"{name}_{x}") for name in "nctq")
    return F.when(c == 0, q).otherwise((n + t * q) / (c + t))


def _weight(x: str) -> Column:
    c, t = F.col(f"c_{x}"), F.col(f"t_{x}")
    return F.when(c == 0, F.lit(1.0)).otherwise(t / (c + t))


def valued(grams: DataFrame, learned: DataFrame) -> DataFrame:
    """(gram, value) for distinct grams: the log ratio of the longest known string that ends them,
    and of the weights passed on the way to it. A string is joined with the model once, however
    many grams end in it, and has at most one extension per symbol, so no key is hot."""
    as_gram = learned.filter("ratio IS NOT NULL").select("s", "ratio")
    as_context = learned.filter("back IS NOT NULL").select(F.col("s").alias("c"), "back")
    strings = {ORDER + 1: grams.select(F.col("gram").alias("s"))}
    for n in range(ORDER, 0, -1):
        strings[n] = strings[n + 1].select(F.substring("s", 2, n).alias("s")).distinct()
    below = None
    for n in range(1, ORDER + 2):
        found = strings[n].join(as_gram, "s", "left")
        if below is None:
            below = found.select("s", F.coalesce("ratio", F.lit(0.0)).alias("value"))
            continue
        found = found.withColumns({"c": F.substring("s", 1, n - 1), "tail": F.substring("s", 2, n - 1)})
        shorter = below.select(F.col("s").alias("tail"), F.col("value").alias("next"))
        found = found.join(as_context, "c", "left").join(shorter, "tail")
        value = F.coalesce("ratio", F.coalesce("back", F.lit(0.0)) + F.col("next"))
        below = found.select("s", value.alias("value"))
    return below.withColumnRenamed("s", "gram")


def scored(urls: DataFrame, learned: DataFrame, folded: bool = True, staging: Staging | None = None) -> DataFrame:
    """One row per row of `urls` with `score`: the mean over its symbols of log P(accepted) -
    log P(rejected). Rows are known by their other columns, or by the URL if it is the only one."""
    put = staging.put if staging else lambda frame, name: frame
    keys = [c for c in urls.columns if c != "url"] or ["url"]
    rows = urls.select(*keys, F.explode(grams_of(F.col("url"), folded)).alias("gram"))
    counts = put(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") > total / HOT).select("gram", F.lit(SALTS).alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    values = put(valued(counts, learned), "values").join(F.broadcast(hot), "gram", "left")
    values = values.select("gram", "value", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    # At most `HOT` grams are broadcast, whatever the input.
    rows = rows.join(F.broadcast(hot), "gram", "left")
    rows = rows.select(*keys, "gram", F.pmod(F.xxhash64(*keys), salts).cast("int").alias("salt"))
    return rows.join(values, ["gram", "salt"]).groupBy(*keys).agg(F.avg("value").alias("score"))


def threshold(judged: DataFrame) -> float | None:
    """Where held-out accepted and rejected URLs are told apart best: the largest difference of
    the two shares, by a histogram of fixed size. None without both."""
    bounded = F.least(F.greatest(F.col("score"), F.lit(-LARGEST_SCORE)), F.lit(LARGEST_SCORE))
    bins = judged.groupBy(F.floor(bounded * BINS_PER_NAT).alias("bin")).agg(
        F.coalesce(F.sum(F.when(F.col("accepted"), F.col("copies"))), F.lit(0)).alias("n_a"),
        F.coalesce(F.sum(F.when(~F.col("accepted"), F.col("copies"))), F.lit(0)).alias("n_r"),
    )
    shares = bins.selectExpr(
        "bin",
        "sum(n_a) OVER (ORDER BY bin DESC) / sum(n_a) OVER () AS caught",
        "sum(n_r) OVER (ORDER BY bin DESC) / sum(n_r) OVER () AS wrong",
        "lead(bin) OVER (ORDER BY bin DESC) + 1 AS below",
        "sum(n_a) OVER () AS all_a",
        "sum(n_r) OVER () AS all_r",
    ).filter("all_a > 0 AND all_r > 0")
    # The middle of the gap to the next lower URL.
    middle = (F.col("bin") + F.coalesce("below", "bin")) / 2
    best = shares.agg(F.max_by(middle, F.struct(F.col("caught") - F.col("wrong"), "bin"))).first()[0]
    return None if best is None else best / BINS_PER_NAT


def url_filter(
    pages: DataFrame,
    rules: Sequence[Rule],
    staging: Staging,
    id_column: str = "page_id",
    support: int | None = None,
) -> DataFrame:
    """(id, host, path, rule, verdict, score, threshold) for every row of `pages`."""
    rows = pages.groupBy(F.col(id_column), F.col("url")).agg(F.count(F.lit(1)).alias("copies"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = rows.select(
        id_column,
        "url",
        "copies",
        rule_column(host, path, rules, lambda rule: rule.text).alias("rule"),
        rule_column(host, path, rules, lambda rule: rule.verdict).alias("ruled"),
    )
    rows = rows.withColumn("accepted", F.col("ruled") == "allow")
    # Equal URLs fall into the same half, so the second half has not been learned by heart.
    rows = rows.withColumn("learned", F.pmod(F.xxhash64("url"), F.lit(2)) == 0)
    rows = staging.put(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    labelled = rows.filter("accepted IS NOT NULL")
    learned = staging.put(model(staging.put(counted(labelled.filter("learned"), False), "counts"), support), "model")
    scores = scored(rows.select("row", "url"), learned, False, staging)
    judged = staging.put(rows.join(scores, "row"), "scored")
    cut = threshold(judged.filter("accepted IS NOT NULL AND NOT learned"))
    allowed = F.lit(True) if cut is None else F.col("score") >= cut
    return judged.select(
        id_column,
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        "rule",
        F.coalesce("ruled", F.when(allowed, "allow").otherwise("block")).alias("verdict"),
        "score",
        F.lit(cut).cast("double").alias("threshold"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
