"""Each operator against a brute-force version on a small fixture, with the cases that the docstrings define."""

import collections
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerframe.llm import bpe, chat, decision_list, decontamination, pii, rule_ensemble, set_join, suffix_dedup, token_counts, url_filters
from ledgerframe.llm.queries import TOKENIZERS

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.json"
DOCS = "doc_id long, text string, score string, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def some_words(rng: random.Random, n: int, size: int = 300) -> list[str]:
    return ["w" + str(rng.randrange(size)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts() -> list[tuple]:
    rng = random.Random(5)
    rows: list[tuple] = [(0, None), (1, ""), (2, "  \n\t"), (3, "One two"), (3, "One two"), (None, "One two three four"), (None, None)]
    base = some_words(rng, 120)
    for i in range(10, 30):  # near copies
        near = list(base)
        near[rng.randrange(120)] = "x" + str(i)
        rows.append((i, " ".join(near)))
    rows += [(i, " ".join(some_words(rng, rng.randrange(5, 200)))) for i in range(30, 60)]
    rows += [(i, rows[40][1]) for i in range(60, 64)]
    rows += [(70, "ab " * 3000), (71, "é日本🎉 " * 50), (72, "a" * 5000), (73, "<|endoftext|> a<|endoftext|>")]
    return [(i, t, "s", None) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, DOCS).repartition(3)


def test_bpe_is_the_library(docs, texts):
    got = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).select("doc_id", "text", "ids", "decoded").collect()
    library = Tokenizer.from_file(VOCABULARY)
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    digests = bpe.op10_bpe_round_trip(docs, VOCABULARY).filter("doc_id = 0").first()
    assert digests["n_tokens"] == 0 and digests["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def components_of(rows, percent, width):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        same = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), None if i is None else find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("percent", "width"), [(90, 3), (80, 5)])
def test_set_join_finds_all_links(docs, texts, percent, width):
    got = set_join.jaccard_components(docs, percent, width).collect()
    expected = components_of(texts, percent, width)
    assert len(got) == len(texts)
    assert all(r["component_id"] == (None if r["doc_id"] is None else expected[r["doc_id"]][1]) for r in got)
    assert all(r["n_shingles"] == expected[r["doc_id"]][0] for r in got if r["doc_id"] is not None)


def test_set_join_links_by_shared_differences(spark):
    """Variants around the threshold, many of which link with each other but not with the group's first."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(140):
        w = list(base)
        for at in rng.sample(range(0, 150, 6), rng.randint(0, 7)):
            w[at] = f"{rng.choice('xyz')}{at}"  # few other words for one place: differences that many share
        rows.append((i, " ".join(w)))
    got = set_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 90, 3).collect()
    expected = components_of(rows, 90, 3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected
    assert 1 < len({c for _, c in expected.values()}) < 140


def test_masks_fit_any_two_substitutions():
    width = decontamination.WINDOW
    for gone in itertools.combinations(range(width), decontamination.SUBSTITUTIONS):
        assert any(not {p + k for k in m} & set(gone) for m in decontamination.MASKS for p in range(width - m[-1]))


def test_decontamination(spark):
    rng = random.Random(2)
    item, short = some_words(rng, 30, 10**6), some_words(rng, 7, 10**6)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, "a b"), (4, None), (1, " ".join(item))], "item_id long, text string")
    two, three, one = item[5:18], item[5:18], list(short)
    two[3], two[9] = "p", "q"
    three[2], three[6], three[10] = "p", "q", "r"
    one[3] = "p"
    pad = some_words(rng, 40, 10**6)
    rows = [(1, pad + two + pad), (2, pad + three + pad), (3, pad + one), (4, [w.upper() for w in item]), (5, ["a", "b"]), (6, pad), (4, pad)]
    docs = spark.createDataFrame([(i, " ".join(w), "x") for i, w in rows] + [(None, " ".join(item), "x"), (9, None, "x")], "doc_id long, text string, n string")
    got = {(r["doc_id"], r["item_ids"]) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(1, "1"), (2, ""), (3, "2"), (4, "1"), (5, ""), (6, ""), (None, "1"), (9, "")}
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0


def test_decontamination_at_both_ends(spark):
    rng = random.Random(8)
    items = {1: some_words(rng, 30, 10**6), 2: some_words(rng, 13, 10**6), 3: some_words(rng, 7, 10**6), 4: some_words(rng, 5, 10**6), 5: some_words(rng, 12, 10**6)}
    pad = some_words(rng, 30, 10**6)
    texts = [t for w in items.values() for k in range(1, len(w) + 1) for t in (w[-k:] + pad, pad + w[:k], w[-k:], w[:k])]
    for k in (11, 12):  # one word different as well
        texts += [[*items[1][-k:-4], "p", *items[1][-3:], *pad], [*pad, *items[1][: k - 4], "p", *items[1][k - 3 : k]]]

    def places(w, item):
        size = min(len(item), 13)
        least = 11 if size == 13 else size - 1
        for at in range(1 - size, len(w)):
            for k in range(len(item) - size + 1):
                if sum(0 <= at + j < len(w) and w[at + j] == item[k + j] for j in range(size)) >= least:
                    yield max(at, 0), size

    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    expected = {(d, i, at, n) for d, w in enumerate(texts) for i, item in items.items() for at, n in places(w, item)}
    assert {tuple(r) for r in decontamination.overlaps(docs, bench).collect()} == expected


def test_suffix_dedup(spark):
    rng = random.Random(4)
    body = "".join(rng.choice("abcdé ") for _ in range(400))
    rows = [(1, "x" + body), (2, body[:230] + "?" + body[231:]), (3, None), (4, "ab" * 300), (5, "short"), (6, body), (6, body), (None, "tail " + body[100:390])]
    rows += [(i, "".join(rng.choice("abcdefgh") for _ in range(900))) for i in range(10, 15)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, runs int")
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    expected = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = {k for p in range(len(d) - 199) if seen[d[p : p + 200]] > 1 for k in range(p, p + 200)}
        spans = sum(1 for k in gone if k - 1 not in gone)
        expected.append((i, len(d), len(gone), spans, hashlib.sha256(bytes(c for k, c in enumerate(d) if k not in gone)).hexdigest()))
    assert collections.Counter(map(tuple, suffix_dedup.op3_suffix_dedup(docs).collect())) == collections.Counter(expected)


def test_hot_grams_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    test_suffix_dedup(spark)


def test_a_hot_passage_is_dealt_over_many_groups(spark, monkeypatch, tmp_path):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    around = ["".join(rng.choice("stuvwxyz") for _ in range(200)) for _ in range(600)]
    rows = [(i, a[:100] + passage + a[100:]) for i, a in enumerate(around)]
    rows += [(600 + i, a[:90] + passage[::-1] + a[:9]) for i, a in enumerate(around[:3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes, plain = str(tmp_path / "sizes"), suffix_dedup.common_at_least

    def noted(texts, width):
        with open(sizes, "a") as f:
            f.write(f"{sum(map(len, texts))}\n")
        return plain(texts, width)

    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    monkeypatch.setattr(suffix_dedup, "BATCH", 1 << 13)
    monkeypatch.setattr(suffix_dedup, "common_at_least", noted)
    got = {r["doc_id"]: r for r in suffix_dedup.op3_suffix_dedup(docs).collect()}
    data = [t.encode() for _, t in rows]
    seen = collections.Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    for (i, _), d in zip(rows, data, strict=True):
        gone = {k for p in range(len(d) - 199) if seen[d[p : p + 200]] > 1 for k in range(p, p + 200)}
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (len(gone), hashlib.sha256(bytes(c for k, c in enumerate(d) if k not in gone)).hexdigest())
    with open(sizes) as f:
        assert max(map(int, f)) <= 8 * suffix_dedup.BATCH


def test_token_counts(docs, texts):
    with open(VOCABULARY, encoding="utf-8") as f:
        vocabulary = set(token_counts.vocabulary_of(f.read()))
    longest = max(map(len, vocabulary))

    def greedy(word: bytes) -> int:
        n = 0
        while word:
            k = next((k for k in range(min(longest, len(word)), 1, -1) if word[:k] in vocabulary), 1)
            word, n = word[k:], n + 1
        return n

    expected = collections.Counter((i, len((t or "").encode().split()), sum(greedy(b" " + w) for w in (t or "").encode().split())) for i, t, *_ in texts)
    got = token_counts.count_tokens(docs, VOCABULARY).select("doc_id", "n_words", "n_tokens").collect()
    assert collections.Counter(map(tuple, got)) == expected


def test_chat(spark):
    rng = random.Random(1)
    rows = [(1, t, ["system", "user", "assistant"][min(t, 1 + t % 2)], "\\<|im_end|>\n" + "x" * rng.randrange(900)) for t in range(40)]
    rows += [(2, 0, "user", None), (2, 1, "assistant", ""), (None, None, None, "z"), (3, 0, "a\nb", "q" * 9000), (3, 1, "assistant", "é")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(turns, VOCABULARY, budget=900).collect()
    library = Tokenizer.from_file(VOCABULARY)
    assert all(w["n_tokens"] == len(library.encode(w["text"], add_special_tokens=False).ids) for w in windows)
    assert all(w["n_tokens"] <= 900 or w["n_turns"] == 1 for w in windows) and len(windows) > 10
    assert all(chat.turns_of(w["text"])[0][0] == "system" for w in windows if w["conv_id"] == 1)
    assert any(w["n_repeated"] > 1 for w in windows)
    got = {r["conv_id"]: r for r in chat.op7_chat(turns, VOCABULARY).collect()}
    by = collections.defaultdict(list)
    for c, _, role, text in rows:
        by[c].append((role or "", text or ""))
    by[-1] = [("user", chat.PROBE), ("assistant", chat.PROBE)]
    assert got.keys() == by.keys()
    for c, said in by.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert got[c]["n_turns"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_reserves_the_system_turn(spark):
    # the system turn has over half of the budget; beside the long turn there is no room for it
    said = [("system", "be kind " * 30)] + [("user" if t % 2 else "assistant", "yes " * (70 if t == 5 else 9)) for t in range(1, 12)]
    turns = spark.createDataFrame([(1, t, role, text) for t, (role, text) in enumerate(said)], "conv_id long, turn long, role string, text string")
    windows = [(w["n_tokens"], w["n_repeated"], chat.turns_of(w["text"])) for w in chat.format_windows(turns, VOCABULARY, budget=120).collect()]
    assert all(n <= 120 for n, _, _ in windows)
    assert [t[0][0] == "system" for _, _, t in windows] == [not any(x[1].startswith("yes " * 70) for x in t) for _, _, t in windows]
    assert [x for _, k, t in windows for x in t[k:]] == said


def test_url_filters(spark):
    urls = [f"https://{'www.' if i % 2 else ''}a{i % 5}.example.org/{l}/{n}{i}?q=1#f" for i in range(40) for l, n in (("es", 3), ("en", 1), ("fr", 2))]
    urls += [f"http://b{i}.com/{l}/x" for i in range(20) for l in ("fr", "de")] + ["HTTP://C.NET/es/1", "http://d.net/de/9", None, "no host", "http://ORG", "http://x.org/", ""]
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in url_filters.judge(pages).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = (u or "").partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fit = [(len(h + p), v, h + p) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, max(fit)[2] if fit else None)
        assert got[i]["verdict"] == max(fit)[1] if fit else got[i]["verdict"] in ("allow", "block")
    assert got[urls.index("http://d.net/de/9")]["verdict"] == "block"  # a mined rule: /de/ pages are blocked
    assert url_filters.judge(pages.limit(0)).count() == 0


def _labelled(spark, rows):
    return spark.createDataFrame([(f"u{i}", t, v) for i, (t, v) in enumerate(rows)], "url string, tokens array<string>, listed string")


def test_url_rules_of_many_shared_keys(spark):
    """25 keys that occur in all mixtures: the combinations stay bounded, the telling one is found."""
    rng = random.Random(8)
    rows = []
    for i in range(400):
        bad = i % 2 == 0
        rows.append(([f"q:k{k}" for k in range(25) if rng.random() < 0.8] + ["p0:de" if bad else "p0:fr"], "block" if bad else "allow"))
    rules = {tuple(r["tokens"]): r for r in url_filters.mine(_labelled(spark, rows)).collect()}
    assert len(rules) <= 2**url_filters.MAX_TOKENS / url_filters.MIN_SUPPORT
    for tokens, said in ((("p0:de",), "block"), (("p0:fr",), "allow")):
        assert rules[tokens]["said"] == said and rules[tokens]["confidence"] == 1 and rules[tokens]["support"] == 0.5
    for tokens, r in rules.items():  # brute force over all tokens
        held = [v for t, v in rows if set(tokens) <= set(t)]
        assert r["confidence"] == held.count(r["said"]) / len(held) and r["support"] == held.count(r["said"]) / len(rows)


def test_one_url_never_outranks_many(spark):
    rows = [(["h:odd.example.com", "p0:fr"], "block")] + [(["p0:fr", "p1:a"], "allow")] * 30 + [(["p0:de"], "block")] * 30
    rows += [(["h:few.com"], "block")] * 6
    rules = {tuple(r["tokens"]): r for r in url_filters.mine(_labelled(spark, rows)).collect()}
    assert ("h:odd.example.com",) not in rules and rules[("p0:fr",)]["said"] == "allow"
    assert rules[("p0:fr",)]["bound"] > rules[("h:few.com",)]["bound"]


def test_pii_base_and_discovery(spark):
    card, ip = "4111 1111-1111 1111", "10.0.0."
    rows = [(i, f"he said server {ip}{i} works. Card {card} here") for i in range(8)]
    rows += [(20, "x 4111111111111111 0000 y"), (21, "a@b.cc_d@e.ff 300.1.1.1 1.2.3.4.5.6.7.8 +1 (672) 555-0196"), (22, None), (22, None), (None, "m@n.org"), (23, "1" * 3000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, base int")
    got = {r["doc_id"]: r for r in pii.op4_pii(docs).collect()}
    assert got[21]["spans"] == "email:0:6,email:6:13,ip:24:31,ip:32:39,phone:40:57"
    assert (got[21]["n_email"], got[21]["n_ip"], got[21]["n_phone"], got[22]["spans"], got[23]["spans"], got[None]["spans"]) == (2, 2, 1, "", "", "email:0:7")
    assert got[20]["n_card"] == 0 and got[20]["spans"] == "card:2:18"  # known from elsewhere
    assert got[22]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.redact(docs).filter("doc_id = 1").first()["text"] == "he said server [IP] works. Card [CARD] here"


@pytest.mark.parametrize("size", [6, 100])
def test_pii_scores_mean_the_same_at_each_size(spark, size):
    rng = random.Random(size)

    def card(valid: bool) -> str:
        digits = [4, *(rng.randrange(10) for _ in range(14))]
        doubled = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
        return "".join(map(str, digits)) + str((-doubled + (0 if valid else 5)) % 10)

    texts = [f"Card {card(True)} thanks" for _ in range(size)] + [f"Card {card(False)} thanks"]
    texts += [f"Number {card(k >= 0.4 * size)} issued" for k in range(size)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.op4_pii(docs).collect()}
    assert all(got[i] == "card:5:21" for i in range(size + 1))  # the last is vouched for
    assert all(got[i] == ("card:7:23" if i - size - 1 >= 0.4 * size else "") for i in range(size + 1, 2 * size + 1))


def test_pii_goes_on_until_no_value_is_added(spark):
    # 9.9.9.300 and more are no addresses; each context has enough known ones once the one before it is settled
    bad = [4, 10, 15, 21, 28, 35]
    texts = [f"c{step} 9.9.9.{k} x{step}" for step, n in enumerate(bad) for k in (*range(100, 145), *range(300, 300 + n))]
    texts += [f"mixed 9.9.9.{k} y" for k in (*range(100, 145), *range(400, 440))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["value"] for r in pii.discovered(pii.base_spans(docs)).collect()}
    assert got == {f"9.9.9.{k}" for k in (*range(100, 145), *range(300, 335))}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    good = [(i, " ".join(some_words(rng, 60)), 1) for i in range(150)]
    bad = [(i, " ".join(w + "###" for w in some_words(rng, 60)), 0) for i in range(150, 260)]
    rows = good + bad
    return spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, None, "x"), (None, "a b", "x")], "doc_id long, text string, label string"), spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(7, 1, 1), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")


def test_quality_classifier(labelled):
    docs, labels = labelled
    got = rule_ensemble.op1_quality(docs, labels)
    found = got.join(labels.filter("toxic = 0 AND quality IS NOT NULL"), "doc_id").filter("held_out").collect()
    assert len(found) > 20 and all(r["predicted"] == r["quality"] for r in found)
    assert got.filter("score IS NULL OR score < 0 OR score > 1 OR held_out IS NULL").count() == 0 and got.count() == 262
    assert rule_ensemble.op1_quality(docs, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5


def test_quality_rules(labelled):
    docs, labels = labelled
    got = decision_list.op9_rules(docs, labels)
    found = got.join(labels.filter("toxic = 0 AND quality IS NOT NULL"), "doc_id").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in found) >= 0.98 * len(found)
    assert decision_list.fit(docs, labels.limit(0)) == []
    rows = [(1, "a b c d e f g h " * 4), (2, None), (3, " ".join(map(str, range(50))) + "\nx\nx\n \n\n"), (3, "")]
    counts = {(r["doc_id"], r["n_words"]): r for r in decision_list.judge(docs.sparkSession.createDataFrame(rows, "doc_id long, text string"), []).collect()}
    assert (counts[1, 32]["n_repeat_words"], counts[1, 32]["base_failed"]) == (32, True)
    assert (counts[3, 52]["n_dup_lines"], counts[3, 52]["n_repeat_words"], counts[3, 52]["kept"]) == (1, 0, True)
    assert counts[2, 0]["base_failed"] and counts[3, 0]["base_failed"]


def test_pipeline_stages_keep_columns(spark, labelled):
    import corpus_pipeline

    docs, _ = labelled
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars")).filter("doc_id < 20 OR doc_id IS NULL")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()
    assert corpus_pipeline.redacted(spark, docs, "").columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminated", "redacted", "tokens"]
