"""URL filters by association rules (operator 5).

A list of (verdict, host, path) rules judges the URLs that it covers. These labels, and the tokens
of the URLs (host suffixes, path parts with their depth, extension, query keys), go to FP-growth: all
tokens of all labelled URLs take part. The rules ``tokens => verdict`` of at most ``MAX_TOKENS`` tokens
that are frequent and confident enough, and that no part of them says as well, judge the URLs that the
list doesn't cover. Of several the one with the highest lower bound of its confidence wins, so few URLs
never outrank many. They match through an inverted index: a join on tokens finds the rules that share one
with a URL, a count shows which are complete.

Each different URL is judged once, so hot hosts and repeated pages are joined once.

Defined results: null URLs, and those without ``://``, have an empty host and path and no tokens; a
URL that no rule fits gets the verdict that most labels have, allow if there are none or on a tie;
of listed rules that fit the longest wins, block before allow on a tie.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.llm.common import lower_ascii, stored, workers_import

#: Verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
#: A rule has at least so many URLs behind it, whatever its share.
MIN_COUNT = 5
#: The longest antecedent. It limits rules, as support and confidence do, never the tokens of a URL that take part.
MAX_TOKENS = 8
#: Rules rank by the lower end of this many standard deviations below their confidence.
DEVIATIONS = 1.96


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both are empty where the URL is null or has no ``://``."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))


def _tokens(url: Column, host: Column, path: Column) -> Column:
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0)), lambda x: x != "")
    at_depth = F.transform(segments, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), x))
    kind = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    return F.array_distinct(F.concat(F.transform(_suffixes(host), lambda x: F.concat(F.lit("h:"), x)), at_depth, F.transform(keys, lambda x: F.concat(F.lit("q:"), x)), F.when(kind != "", F.array(F.concat(F.lit("e:"), kind))).otherwise(F.array().cast("array<string>"))))


def listed(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(url, rule, listed): the longest rule of the list that fits; ``urls`` has url, host, path once each."""
    spark: SparkSession = urls.sparkSession
    table = spark.createDataFrame(rules, "listed string, rule_host string, rule_path string")
    near = urls.select("url", "path", F.explode(_suffixes(F.col("host"))).alias("rule_host")).join(table, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = near.groupBy("url").agg(F.max(F.struct(F.length(rule).alias("n"), "listed", rule.alias("rule"))).alias("b"))  # "block" sorts after "allow"
    return best.select("url", F.col("b.rule").alias("rule"), F.col("b.listed").alias("listed"))


def _lower_bound(hits: Column, n: Column) -> Column:
    """The lower end of the score interval of ``hits`` in ``n``."""
    z2 = DEVIATIONS**2
    p = hits / n
    return (p + z2 / (2 * n) - DEVIATIONS * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)


def _bases(labelled: DataFrame, least: int) -> DataFrame:
    """(token, before, blocked, allowed): the conditional pattern bases of FP-growth, over all tokens of all URLs.

    A URL's tokens are put in order, the most frequent first; URLs with equal tokens count together. ``before``
    has those that come before ``token``. Tokens that no verdict has ``least`` times are in no frequent combination.
    """
    each = labelled.select("url", "listed", F.explode("tokens").alias("token"))
    blocked, allowed = F.count_if(F.col("listed") == "block").alias("blocked"), F.count_if(F.col("listed") != "block").alias("allowed")
    known = each.groupBy("token").agg(blocked, allowed).filter(F.greatest("blocked", "allowed") >= least)
    place = F.struct((-F.col("blocked") - F.col("allowed")).alias("by"), "token")
    placed = each.join(known, "token").groupBy("url", "listed").agg(F.sort_array(F.collect_set(place)).alias("places"))
    patterns = placed.groupBy(F.transform("places", lambda x: x["token"]).alias("tokens")).agg(blocked, allowed)
    parts_of = patterns.select("tokens", "blocked", "allowed", F.posexplode("tokens").alias("at", "token"))
    before = F.slice("tokens", F.lit(1), F.col("at")).alias("before")
    return parts_of.groupBy("token", before).agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))


def _grown(base: pa.Table, least: int, min_confidence: float) -> pa.Table:
    """All combinations of a base's token with those before it that may be rules, and the URLs they have of each verdict.

    Left out are combinations that a part of them makes needless: where a further token is in all URLs that hold the
    others, or where the others have one verdict only, the others say the same with as much confidence.
    """
    before = base["before"].to_pylist()
    columns = sorted({x for b in before for x in b})
    place = {x: i for i, x in enumerate(columns)}
    holds = np.zeros((len(before), len(columns)), bool)
    for row, some in enumerate(before):
        holds[row, [place[x] for x in some]] = True
    votes = np.stack([base["blocked"].to_numpy(), base["allowed"].to_numpy()]).astype(float)
    found: list[tuple[list[str], float, float]] = []

    def grow(chosen: list[str], rows: np.ndarray, upto: int) -> None:
        own, held = votes[:, rows], holds[rows, :upto]
        counts = own @ held
        most, n = counts.max(axis=0), counts.sum(axis=0)
        further = (most >= least) & (n < own.sum())
        for c in np.flatnonzero(further & (most >= min_confidence * n * (1 - 1e-9))):
            found.append(([*chosen, columns[c]], counts[0, c], n[c]))
        if len(chosen) + 1 < MAX_TOKENS:
            for c in np.flatnonzero(further & (most < n)):
                if c:
                    grow([*chosen, columns[c]], rows[held[:, c]], c)

    token, totals = base["token"][0].as_py(), votes.sum(axis=1)
    found.append(([token], totals[0], totals.sum()))
    if totals.min() > 0 and MAX_TOKENS > 1:
        grow([token], np.arange(len(before)), len(columns))
    return pa.table({"tokens": pa.array([sorted(x) for x, _, _ in found], pa.list_(pa.string())),
                     "blocked": pa.array([int(x) for _, x, _ in found], pa.int64()), "all": pa.array([int(x) for _, _, x in found], pa.int64())})


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, said, confidence, support, bound), from ``labelled`` (url, tokens, listed).

    FP-growth over all tokens of each URL, one token's conditional base a task. Rules have at most MAX_TOKENS tokens.
    """
    workers_import(labelled.sparkSession)
    total = labelled.count()
    least = max(MIN_COUNT, math.ceil(min_support * total))
    grown = _bases(labelled, least).groupBy("token").applyInArrow(lambda base: _grown(base, least, min_confidence), "tokens array<string>, blocked long, all long")
    said = F.when(F.expr("2 * blocked >= all"), F.lit("block")).otherwise(F.lit("allow"))
    hits = F.when(F.col("said") == "block", F.col("blocked")).otherwise(F.col("all") - F.col("blocked"))
    rules = grown.withColumn("said", said).withColumn("hits", hits).filter(F.col("hits") >= least)
    rules = rules.select("tokens", "said", (F.col("hits") / F.col("all")).alias("confidence"), (F.col("hits") / total).alias("support"), _lower_bound(F.col("hits"), F.col("all")).alias("bound"))
    rules = stored(rules.filter(F.col("confidence") >= min_confidence), "rules")
    # a rule goes if a part of its tokens says the same with as much confidence: each rule's parts are looked up
    several = rules.filter(F.size("tokens") > 1)
    parts_of = several.select("tokens", "said", "confidence", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.pow(F.lit(2), F.size("tokens")).cast("int") - 2))).alias("chosen"))
    parts_of = parts_of.withColumn("less", F.filter("tokens", lambda _, i: F.getbit(F.col("chosen"), i) == 1))
    smaller = rules.select(F.col("tokens").alias("less"), "said", F.col("confidence").alias("c"))
    worse = parts_of.join(smaller, ["less", "said"]).filter("c >= confidence")
    return rules.join(worse.select("tokens", "said").distinct(), ["tokens", "said"], "left_anti").withColumn("rule_id", F.xxhash64("tokens", "said"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict (older columns of these names are replaced)."""
    host, path = parts(F.col("url"))
    urls = pages.select(F.col(url).alias("url")).filter(F.col("url").isNotNull()).distinct().withColumn("host", host).withColumn("path", path)
    urls = stored(urls.withColumn("tokens", _tokens(F.col("url"), F.col("host"), F.col("path"))), "urls")
    # a number for each URL, fixed once written: what is counted for URL and rule is shuffled by two numbers
    known = urls.join(listed(urls, rules), "url", "left").withColumn("url_id", F.monotonically_increasing_id())
    known = stored(known, "listed")
    labelled = known.filter("listed IS NOT NULL")
    votes = {r["listed"]: r["n"] for r in labelled.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    default = "block" if votes.get("block", 0) > votes.get("allow", 0) else "allow"
    verdicts = known.select("url", "host", "path", "rule", "listed", F.lit(None).cast("string").alias("said"))
    if votes:
        index = stored(mine(labelled.select(F.col("url_id").alias("url"), "tokens", "listed")), "index")
        open_ = known.filter("listed IS NULL").select("url_id", F.explode("tokens").alias("token"))
        entries = index.select("rule_id", F.explode("tokens").alias("token"))
        held = open_.join(entries, "token").groupBy("url_id", "rule_id").agg(F.count("*").alias("k"))
        whole = held.join(index.select("rule_id", F.size("tokens").alias("n"), "said", "bound", "support"), "rule_id").filter("k = n")
        best = whole.groupBy("url_id").agg(F.max(F.struct("bound", "support", "said")).alias("b")).select("url_id", F.col("b.said").alias("said"))
        verdicts = known.join(best, "url_id", "left").select("url", "host", "path", "rule", "listed", "said")
    verdicts = verdicts.select(F.col("url").alias("_url"), "host", "path", "rule", F.coalesce("listed", "said", F.lit(default)).alias("verdict"))
    kept = pages.drop("host", "path", "rule", "verdict")
    out = kept.join(verdicts, F.col(url) == F.col("_url"), "left").drop("_url")
    return out.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit("")), "verdict": F.coalesce("verdict", F.lit(default))})


def op5_urls(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
