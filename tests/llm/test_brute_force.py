"""Base rules, learned lists and base spans against plain Python, over texts made to be awkward."""

import hashlib
import random
import re

from ledgerframe.llm import decision_list, pii
from ledgerframe.llm.text_stats import FEATURES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def share(part, whole):
    return part / whole if whole else 0.0


def counts_of(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the features of a text."""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at: dict = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    chars, dups = sum(map(len, words)), len(lines) - len(set(lines))
    symbols = sum(c in "#*$%&|<>" for c in text)
    values = {
        "n_words": float(len(words)),
        "word_length": share(chars, len(words)),
        "symbol_share": share(symbols, chars),
        "upper_share": share(sum("A" <= c <= "Z" for c in text), chars),
        "exclaim_share": share(text.count("!"), chars),
        "stop_share": share(sum(len(w) <= 3 for w in words), len(words)),
        "distinct_share": share(len(set(words)), len(words)),
        "dup_line_share": share(dups, len(lines)),
        "line_words": share(len(words), len(lines)),
        "digit_share": share(sum("0" <= c <= "9" for c in text), chars),
    }
    return (len(words), chars, symbols, dups, len(repeated)), values


def test_counts_and_learned_lists(spark):
    rng = random.Random(11)
    spaces = [" ", "  ", "\n", "\t", "\n\n", "\x0b", "\x0c", "\r\n", " \n"]
    stock = ["a", "the", "Word", "longer-word", "x1", "##", "wow!", "é", "日本語", "\u00a0", "\u2028", "<b>", "7", "end."]

    def text(bad):
        said = "".join(rng.choice(stock) + ("!" if bad and rng.random() < 0.5 else "") + rng.choice(spaces) for _ in range(rng.randrange(1, 90)))
        if rng.random() < 0.3:  # a passage that is there again, overlapping itself or not
            part = " ".join(rng.choices(stock, k=rng.choice([1, 3, 9])))
            said += " ".join([part] * rng.choice([2, 9])) + rng.choice(spaces) + said[: rng.randrange(200)]
        return said

    rows = [(i, text(i % 3 == 0), "kept") for i in range(300)] + [(None, text(True), "kept"), (500, None, "x"), (501, "", "x"), (501, "", "x"), (502, " \n ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int")
    rules = decision_list.fit(docs, labels)
    assert rules and all(f in FEATURES for rule in rules for f, _, _ in rule)
    got = decision_list.judge(docs, rules).collect()
    assert len(got) == len(rows)
    dropped = 0
    for r in got:
        counts, values = counts_of(r["text"] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        hit = any(all((values[f] > cut) == above for f, above, cut in rule) for rule in rules)
        assert (r["base_failed"], r["kept"]) == (failed, not failed and not hit)
        dropped += hit and not failed
    assert dropped > 10


def base_of(text):
    """The base spans as the contract words them, by Python's expressions."""

    def luhn(digits):
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, expression, valid) in enumerate(kinds) for m in re.finditer(expression, text) if valid(m[0])]
    return [(name, start, end) for start, _, name, end in sorted(found)]


def test_base_spans(spark):
    rng = random.Random(12)
    whole = ["4111 1111-1111 1111", "5500005555555559", "378282246310005 ", "10.0.0.255", "1.2.3.256", "a.b@c-d.org", "x@y.z@w.v.u", "+1 (672) 555-0196", "+44.20 7946 0958", "日本", "🎉", "é"]
    marks = list("0123456789.-+@() ab%_\n")
    texts = ["".join(rng.choice(whole) if rng.random() < 0.15 else rng.choice(marks) for _ in range(rng.randrange(120))) for _ in range(600)]
    texts += [None, "", "4111111111111111" * 2, "1.2.3.4.5.6.7.8.9", "0" * 2000, "a@b." + "c." * 500, "+1" + " " * 500 + "2"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_email long").repartition(4)
    n = dict.fromkeys(("email", "ip", "card", "phone"), 0)
    for r in pii.op4_pii(docs).collect():
        spans = base_of(texts[r["doc_id"]] or "")
        of = {k: sum(s[0] == k for s in spans) for k in n}
        n = {k: n[k] + of[k] for k in n}
        assert {k: r[f"n_{k}"] for k in n} == of
        listed = [":".join(map(str, s)) for s in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(",")) | {""}
    assert all(k >= 20 for k in n.values())


def test_contexts_of_many_matches_in_one_text(spark):
    # more matches than a run and longer than a block, with code points outside the basic plane
    words = [w for i in range(700) for w in (f"🎉{i}", f"u{i}@h{i}.org", "É" * (i % 50))]
    text = "  ".join(words)
    found = pii.base_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["email"]
    spans = [(m.start(), m.end()) for m in re.finditer(r"u[0-9]+@h[0-9]+\.org", text)]
    assert [(x["start"], x["end"]) for x in found] == spans and len(spans) > 5 * pii.RUN and len(text) > 5 * pii.BLOCK
    for x in found:
        before, after = text[max(0, x["start"] - pii.CONTEXT) : x["start"]], text[x["end"] : x["end"] + pii.CONTEXT]
        assert x["left"] == (WORD.findall(before) or [""])[-1].lower()
        assert x["right"] == (WORD.findall(after) or [""])[0].lower()
