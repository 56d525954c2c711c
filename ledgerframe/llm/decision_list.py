"""Quality rules: a learned decision list (operator 9).

Sequential covering on statistics of a bounded labelled sample: a rule against bad documents grows
condition by condition (by FOIL's gain, on the growing part of the sample), is pruned back on the
other part, and what it covers is left out for the next rule. The list becomes one ordered CASE
expression. All counts are DataFrame aggregates of one row a feature and bin; no Python runs on the
executors.

Defined results: null texts have no words; a text that fails the base rules isn't kept, whatever the
list says; without labels of both classes the list is empty and keeps what passes the base rules;
repeated rows are judged each; other columns stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import stored
from ledgerframe.llm.rule_ensemble import Condition, condition
from ledgerframe.llm.text_stats import FEATURES, count_of, features, labelled_sample, with_counts, without_counts

#: Labelled documents that the list is learnt from, at most.
MAX_SAMPLE = 20_000
BINS = 16
MAX_RULES, MAX_CONDITIONS = 8, 4
#: A rule is taken if so large a share of what it covers, in the pruning part, is bad.
MIN_PRECISION = 0.75


def base_failed() -> Column:
    n = count_of("n_words")
    return (n < 20) | (100 * count_of("n_repeat_words") > 30 * n)


def learn(sample: DataFrame) -> list[tuple[Condition, ...]]:
    """Rules against bad rows of ``sample`` (columns FEATURES, label and row, a number by which it is parted)."""
    names = [f"b_{f}" for f in FEATURES]
    steps = [i / BINS for i in range(1, BINS)]
    cuts_of = sample.agg(*[F.percentile_approx(f, steps, 2000).alias(f) for f in FEATURES]).first()
    if cuts_of[0] is None:
        return []
    cuts = {f: sorted(set(cuts_of[f])) for f in FEATURES}

    def bin_of(f: str) -> Column:
        """How many cuts the value is above."""
        out = F.lit(0)
        for c in cuts[f]:
            out = out + (F.col(f) > float(c)).cast("int")
        return out

    binned = stored(sample.select((F.col("label") <= 0).cast("int").alias("bad"), (F.pmod("row", F.lit(3)) == 0).alias("prune"), *[bin_of(f).alias(n) for f, n in zip(FEATURES, names, strict=True)]), "binned")

    def holds(rule: list[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for f, above, k in rule:
            out = out & ((F.col(names[f]) > k) if above else (F.col(names[f]) <= k))
        return out

    left, rules = binned, []
    while len(rules) < MAX_RULES:
        rule: list[tuple[int, bool, int]] = []
        while len(rule) < MAX_CONDITIONS:
            shown = left.filter(~F.col("prune")).filter(holds(rule)).select("bad", F.posexplode(F.array(*names)).alias("f", "bin"))
            counts = shown.groupBy("f", "bin").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect()  # FEATURES x BINS rows at most
            best = _best_condition([(r["f"], r["bin"], r["p"], r["n"]) for r in counts])
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        sums = [F.sum(F.when(holds(rule[: i + 1]), F.col("bad")).otherwise(0)) for i in range(len(rule))] + [F.sum(holds(rule[: i + 1]).cast("int")) for i in range(len(rule))]
        seen = [x or 0 for x in left.filter("prune").agg(*sums).first()]
        worth = [(2 * p - n) / n if n else -1.0 for p, n in zip(seen[: len(rule)], seen[len(rule) :], strict=True)]
        keep = max(range(len(rule)), key=lambda i: (round(worth[i], 3), -i))
        if worth[keep] < 2 * MIN_PRECISION - 1:
            break
        rule = rule[: keep + 1]
        rules.append(tuple((FEATURES[f], above, float(cuts[FEATURES[f]][k])) for f, above, k in rule))
        left = left.filter(~holds(rule))
    return rules


def _best_condition(counts: list[tuple[int, int, int, int]]) -> tuple[int, bool, int] | None:
    """The (feature, above, cut) with the greatest FOIL gain; None if none gains."""
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for f, b, p, n in counts:
        by.setdefault(f, {})[b] = (p, n)
    best, most = None, 1e-9
    for f, bins in sorted(by.items()):
        p_all, n_all = sum(p for p, _ in bins.values()), sum(n for _, n in bins.values())
        if not p_all or p_all == n_all:
            return None
        before, p_low, n_low = math.log2(p_all / n_all), 0, 0
        for k in range(max(bins)):
            p, n = bins.get(k, (0, 0))
            p_low, n_low = p_low + p, n_low + n
            for above, p1, n1 in ((False, p_low, n_low), (True, p_all - p_low, n_all - n_low)):
                gain = p1 * (math.log2(p1 / n1) - before) if p1 else 0.0
                if gain > most:
                    best, most = (f, above, k), gain
    return best


def verdict(rules: list[tuple[Condition, ...]], values: dict[str, Column]) -> Column:
    """The list as an ordered CASE: the first rule that holds drops the text, else it is kept."""
    if not rules:
        return F.lit(True)
    case = F.when(condition(rules[0], values), False)
    for rule in rules[1:]:
        case = case.when(condition(rule, values), False)
    return case.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = MAX_SAMPLE) -> list[tuple[Condition, ...]]:
    counted = with_counts(labelled_sample(docs.select("doc_id", text), labels, most), text, repeats=True)
    values = features()
    sample = counted.select("label", F.xxhash64(F.lit("part"), "doc_id").alias("row"), base_failed().alias("failed"), *[values[f].alias(f) for f in FEATURES])
    return learn(stored(sample, "sample").filter("NOT failed"))


def judge(docs: DataFrame, rules: list[tuple[Condition, ...]], text: str = "text") -> DataFrame:
    """``docs`` with the base counts, base_failed and kept (older columns of these names are replaced)."""
    counted = with_counts(docs, text, repeats=True)
    counts = {n: count_of(n).cast("long") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    out = counted.withColumns({"base_failed": base_failed(), "_listed": verdict(rules, features())}).withColumn("kept", ~F.col("base_failed") & F.col("_listed"))
    return without_counts(out.withColumns(counts)).drop("_listed")


def op9_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = fit(docs, labels)
    return judge(docs.select("doc_id", "text"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
