"""URL filters: given rules first, then association rules mined from URLs that the given rules judge.

A URL becomes a set of tokens: every suffix of its host at a dot ("host=example.com"), its scheme, the names and kinds
(number, or file ending) of its path segments with their depth, the names of its query's parameters and whether it has
a fragment. FP-growth (Spark ML) finds the combinations of at most TOKENS tokens that are frequent among the labelled
URLs of a verdict; those that hold with CONFIDENCE, and in which every token raises the confidence of the others, are
rules. They are matched through an inverted index from token to rules: a rule fits when all its tokens are there. The
fitting rule of highest confidence, then support, then name decides; without one the verdict is DEFAULT.

Labels are the verdicts of the given rules, on all rows that they judge. A null URL, or one without "://", has empty
host and path. The whole URL is tokenised, however deep; what bounds the mining is that each token, and each rule, needs
a SUPPORT share of all labelled URLs. Repeated rows are judged alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import staged

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
SUPPORT, CONFIDENCE, TOKENS, DEFAULT = 0.01, 0.9, 3, "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest given rule that fits, as text; else null."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, start = rule[:rule.index("/")], rule[rule.index("/"):]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out if out is not None else F.lit(None).cast("string")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL."""
    labels = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda n: F.concat(F.lit("host="), F.array_join(F.slice(labels, -n, n), ".")))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    kinds = F.transform(segments, lambda s, i: F.concat(
        F.lit("path"), i.cast("string"), F.lit("="),
        F.when(s.rlike(r"^[0-9]+$"), "number").when(s.rlike(r"\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("."), F.substring_index(s, ".", -1))).otherwise(s)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""),
                        lambda s: F.concat(F.lit("query="), F.substring_index(s, "=", 1)))
    scheme = F.array(F.concat(F.lit("scheme="), F.translate(F.substring_index(F.coalesce(url, F.lit("")), "://", 1), _UPPER, _LOWER)))
    mark = F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(tails, kinds, names, scheme, mark)))


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, given (verdict of the rule) and tokens."""
    pages = (pages.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
             .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)))
    given = F.lit(None).cast("string")
    for rule, verdict in rules:
        given = F.when(F.col("rule") == rule, verdict).otherwise(given)
    return pages.withColumn("given", given).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))


@dataclass(frozen=True)
class Mined:
    tokens: frozenset[str]
    verdict: str
    confidence: float
    support: float


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[Mined]:
    """Rules from rows with tokens and given (a verdict); the best first."""
    labelled = labelled.select("tokens", "given")
    n = labelled.count()
    if not n:
        return []
    items = labelled.select(F.array_union("tokens", F.array(F.concat(F.lit("verdict="), F.col("given")))).alias("items"))
    # each item on its own first: only tokens that are frequent enough take part
    often = [r["item"] for r in items.select(F.explode("items").alias("item")).groupBy("item").count().where(F.col("count") >= support * n).collect()]
    items = items.select(F.array_intersect("items", F.array(*map(F.lit, often)) if often else F.array().cast("array<string>")).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=support).fit(items).freqItemsets
    freq = {frozenset(r["items"]): r["freq"] for r in sets.where(F.size("items") <= TOKENS + 1).toLocalIterator()}
    share: dict[tuple[frozenset, str], float] = {}
    for found, count in freq.items():
        for verdict in (t for t in found if t.startswith("verdict=")):
            rest = found - {verdict}
            share[rest, verdict] = count / (freq[rest] if rest else n)
    out = []
    for (rest, verdict), c in share.items():
        fewer = [share.get((rest - {t}, verdict), 0.0) for t in rest]
        if rest and c >= confidence and all(c > f for f in fewer):
            out.append(Mined(rest, verdict.removeprefix("verdict="), c, freq[rest | {verdict}] / n))
    return sorted(out, key=lambda m: (-m.confidence, -m.support, sorted(m.tokens)))


def matched(pages: DataFrame, mined: list[Mined], default: str = DEFAULT) -> DataFrame:
    """``pages`` with verdict: that of the given rule, else of the first mined rule whose tokens are all there."""
    index: dict[str, list[int]] = defaultdict(list)
    for k, rule in enumerate(mined):
        for token in rule.tokens:
            index[token].append(k)
    sizes, verdicts = [len(m.tokens) for m in mined], [m.verdict for m in mined]
    index = dict(index)

    @F.pandas_udf("string")
    def mined_verdict(tokens: pd.Series) -> pd.Series:
        out = []
        for row in tokens:
            hits: dict[int, int] = {}
            for token in row if row is not None else ():
                for k in index.get(token, ()):
                    hits[k] = hits.get(k, 0) + 1
            first = min((k for k, n in hits.items() if n == sizes[k]), default=None)
            out.append(default if first is None else verdicts[first])
        return pd.Series(out, dtype="str")

    return pages.withColumn("verdict", F.coalesce("given", mined_verdict("tokens")))


def judged_urls(pages: DataFrame) -> DataFrame:
    known = staged(parsed(pages.select("page_id", "url")), "urls")
    mined = mine(known.where(F.col("given").isNotNull()))
    return matched(known, mined).select("page_id", "host", "path", "rule", "verdict")
