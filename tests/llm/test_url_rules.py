"""Rules mined for operator 5, over all tokens of a URL."""

import itertools
import random

from ledgerframe.llm import url_filters


def _mined(spark, rows):
    labelled = spark.createDataFrame([(f"u{i}", t, v) for i, (t, v) in enumerate(rows)], "url string, tokens array<string>, listed string")
    return {tuple(r["tokens"]): (r["said"], r["confidence"], r["support"]) for r in url_filters.mine(labelled).collect()}


def test_tokens_that_tell_nothing_alone_take_part(spark):
    """Two keys that decide only together, beside twelve that tell more each: all tokens of a URL are mined (F4)."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        a, b = i % 2, i // 2 % 2
        bad = a == b
        kept = [f"q:n{k}" for k in range(12) if rng.random() < (0.95 if bad else 0.75)]
        rows.append(([f"q:a{a}", f"q:b{b}", *kept], "block" if bad else "allow"))
    rules = _mined(spark, rows)
    for a, b in itertools.product((0, 1), repeat=2):
        assert rules[(f"q:a{a}", f"q:b{b}")] == ("block" if a == b else "allow", 1.0, 0.25)


def test_rules_are_those_of_brute_force(spark):
    """URLs of nine tokens and more: every combination is counted, and goes only if a part of it says as much."""
    rng = random.Random(5)
    names = [f"t{k:02}" for k in range(11)]
    rows = [(rng.sample(names, 11) if i % 9 == 0 else [x for x in names if rng.random() < 0.8], rng.choice(["block", "allow", "allow"])) for i in range(60)]
    rows += [([], "block"), (["t00", "few"], "block")]
    least, said = max(url_filters.MIN_COUNT, 1), {}
    for size in range(1, url_filters.MAX_TOKENS + 1):
        for some in itertools.combinations([*names, "few"], size):
            votes = [v for t, v in rows if set(some) <= set(t)]
            blocked = votes.count("block")
            verdict, hits = ("block", blocked) if 2 * blocked >= len(votes) else ("allow", len(votes) - blocked)
            if hits >= least and hits / len(votes) >= url_filters.MIN_CONFIDENCE:
                said[some] = (verdict, hits / len(votes), hits / len(rows))
    parts = lambda some: (p for n in range(1, len(some)) for p in itertools.combinations(some, n))
    want = {x: r for x, r in said.items() if not any(p in said and said[p][0] == r[0] and said[p][1] >= r[1] for p in parts(x))}
    assert _mined(spark, rows) == want and max(map(len, want)) > 3
