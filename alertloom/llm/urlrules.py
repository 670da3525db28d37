"""URL filters: given rules, and association rules mined from URLs with known verdicts.  DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import written

# fixed values: (verdict, host and path)
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

# Mining: least share of the labelled URLs that hold a combination and its verdict, least share of a combination's URLs with the verdict.
SUPPORT, CONFIDENCE = 0.002, 0.9
DEFAULT = "allow"
_LABEL = "verdict="


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null and where there is no ``://``."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = url.substr(F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(known, lower).otherwise(""), F.when(known, path).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.  A rule fits its host and all hosts below it."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, _, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rule_path}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: labels of the host from its end, parts of the path, the ending, query keys and the scheme; runs of digits are ``#``."""
    parts = lambda text, sep: F.filter(F.split(text, sep), lambda p: p != "")
    named = lambda name, items: F.transform(items, lambda p: F.concat(F.lit(name), F.regexp_replace(p, "[0-9]+", "#")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    found = F.concat(
        named("host:", F.reverse(parts(host, r"\."))),
        named("path:", parts(path, "/")),
        named("ending:", F.filter(F.array(ending), lambda p: p != "")),
        named("key:", F.transform(parts(query, "&"), lambda p: F.substring_index(p, "=", 1))),
        named("scheme:", F.filter(F.array(F.regexp_extract(url, "^([^:/?#]*)://", 1)), lambda p: p != "")),
    )
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def rule_tokens(rules: tuple[tuple[str, str], ...]) -> list[list[str]]:
    """For each given rule the tokens that every URL it fits has."""
    split = [(host.split(".")[::-1], [p for p in path.split("/")[:-1] if p]) for host, _, path in (text.partition("/") for _, text in rules)]
    return [[*(f"host:{re.sub('[0-9]+', '#', p)}" for p in host), *(f"path:{re.sub('[0-9]+', '#', p)}" for p in path)] for host, path in split]


def telling(urls: DataFrame, support: float) -> list[str]:
    """Tokens of labelled ``urls`` (tokens, verdict) that mining needs, in order.

    A token of a rule is with the rule's verdict in a share of ``support`` of the URLs; the others are in no
    rule.  Of tokens that are in the same URLs the last by name stands for all.  That
    bounds the list: it holds at most the tokens of an average URL divided by ``support``.
    """
    baskets = urls.filter(F.size("tokens") > 0).select("tokens", "verdict", *(F.xxhash64(F.lit(k), F.array_sort("tokens"), "verdict").cast("decimal(20,0)").alias(f"h{k}") for k in (1, 2)))
    of = baskets.select(F.explode("tokens").alias("token"), "verdict", "h1", "h2")
    counts = of.groupBy("token").agg(F.count("*").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("allow", "block")))
    # A hair below, so that rounding keeps a token that FPGrowth would keep.
    least = F.lit(support * (1 - 1e-9) * baskets.count())
    return sorted(r.token for r in counts.filter(F.greatest("allow", "block") >= least).groupBy("n", "h1", "h2").agg(F.max("token").alias("token")).collect())


def mine(urls: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``antecedent, verdict, confidence, lift, support, anchor``: rules from the labelled ones of ``urls`` (tokens, verdict or null; every labelled row counts).

    A rule is left out where one with a token less has at least its confidence, where its verdict is no more frequent
    among its URLs than among all (a lift of 1 or less), and where it only says again what one of the
    given ``rules`` says, holding all of its tokens.  ``anchor`` is the antecedent's rarest token.
    """
    baskets = urls.filter("verdict IS NOT NULL").select(F.concat("tokens", F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = model.associationRules.filter(F.col("consequent")[0].startswith(_LABEL) & ~F.exists("antecedent", lambda t: t.startswith(_LABEL)))
    made = written(found.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], len(_LABEL) + 1, 100).alias("verdict"), "confidence", "lift", "support"), "rules")
    shorter = made.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("out")).withColumn("less", F.array_remove("antecedent", F.col("out")))
    weaker = made.select(F.col("antecedent").alias("less"), "verdict", F.col("confidence").alias("known"))
    needless = shorter.join(weaker, ["less", "verdict"]).filter("known >= confidence").select("antecedent", "verdict").distinct()
    again = F.lit(False)
    for own in rule_tokens(rules):
        again = again | (F.size(F.array_intersect("antecedent", F.array(*map(F.lit, own)))) == len(set(own)))
    kept = made.join(needless, ["antecedent", "verdict"], "left_anti").filter((F.col("lift") > 1) & ~again)
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    anchors = kept.select("antecedent", F.explode("antecedent").alias("token")).join(single, "token").groupBy("antecedent").agg(F.min(F.struct("freq", "token")).alias("rarest"))
    return written(kept.join(anchors, "antecedent").select("antecedent", "verdict", "confidence", "lift", "support", F.col("rarest.token").alias("anchor")), "anchored")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined`` for each row of ``pages`` (page_id, url; further columns are ignored).

    The longest given rule that fits decides.  Other URLs are looked up among the mined rules by an
    inverted index on the rules' rarest tokens; of those whose tokens the URL has, that
    with the highest confidence, then the most tokens, then ``block``, decides, and ``mined`` names its
    tokens.  Where none fits the verdict is ``allow``.  Null URLs and URLs without ``://`` have empty host and path
    and no token, so they are allowed.  Each row is judged by its URL alone: repeated rows and null page_ids change nothing.
    """
    urls = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    host, path = host_and_path(F.col("url"))
    split = urls.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    given = split.withColumn("rule", rule).withColumn("verdict", verdict)
    listed = F.when(F.col("host") != "", tokens(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>"))
    ready = given.withColumn("tokens", listed)
    # Mining and lookup need few of the tokens.
    labelled = ready.filter("verdict IS NOT NULL AND size(tokens) > 0").select("tokens", "verdict")
    told = telling(labelled, support)
    useful = F.array(*map(F.lit, told)) if told else F.array().cast("array<string>")
    model = mine(labelled.select(F.array_intersect("tokens", useful).alias("tokens"), "verdict"), support, confidence, rules)
    # Equal lists of useful tokens are looked up once; URLs that a given rule decides, or without such a token, take no part in the join.
    few = ready.withColumn("_key", F.when(F.col("rule").isNull(), F.array_sort(F.array_intersect("tokens", useful))).otherwise(F.array().cast("array<string>")))
    unknown = few.filter("size(_key) > 0")
    hits = unknown.select("_key").distinct().select("_key", F.explode("_key").alias("anchor")).join(model, "anchor").filter(F.size(F.array_except("antecedent", "_key")) == 0)
    best = hits.groupBy("_key").agg(F.max(F.struct("confidence", F.size("antecedent").alias("n"), F.col("verdict").alias("said"), "antecedent")).alias("b"))
    answer = best.select("_key", F.col("b.said").alias("said"), F.array_join("b.antecedent", " ").alias("mined"))
    none = F.lit(None).cast("string")
    others = few.filter("size(_key) = 0").select("page_id", "host", "path", "rule", "verdict", none.alias("said"), none.alias("mined"))
    judged = unknown.join(answer, "_key", "left").select(*others.columns).unionByName(others)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", "said", F.lit(DEFAULT)).alias("verdict"), "mined")
