"""The corpus pipeline against plain Python, stage by stage and as a whole."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerframe.llm import pii, rule_ensemble
from ledgerframe.llm.queries import TOKENIZERS
from test_operators import WORD

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "what is the name of the river that flows through the old town of the north"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [w + s for w in ("ba", "co", "du", "fen", "gor", "hal") for s in ("", "ra", "ti", "mo", "ne", "lus", "der")]

    def prose(n):
        return " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))

    texts = {i: prose(rng.randrange(60, 160)) for i in range(120)}
    junk = {i: "###### $$$$ ||| <<>> " * rng.randrange(20, 40) for i in range(200, 260)}
    good = {**texts, 130: texts[3], 131: texts[3] + " ba", 132: prose(30) + " " + ITEM + " " + prose(30)}
    good |= {133 + k: prose(40) + f' mail ba.{k}@mail.example.org and token = "{hashlib.sha1(str(k).encode()).hexdigest()}" ' + prose(40) for k in range(8)}
    rows = list(good.items()) + list(junk.items())
    rows += [(5, prose(80)), (None, prose(90)), (None, prose(30) + " " + ITEM), (None, texts[7]), (9, texts[9])]
    rows = [(i, t, "en", "web", len(t)) for i, t in rows]
    labels = [(i, 1 if i < 200 else 0, 0) for i, *_ in rows if i is not None and i % 2 == 0]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), rows


def groups_of(rows):
    """Near-duplicate groups of different (doc_id, text), as lists."""
    sets = []
    for i, t in dict.fromkeys((i, t) for i, t, *_ in rows):
        w = WORD.findall((t or "").lower())
        sets.append((i, t, {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()))
    groups = [[k] for k in range(len(sets))]
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][2], sets[b][2]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ga, gb = (next(g for g in groups if k in g) for k in (a, b))
                if ga is not gb:
                    ga += gb
                    groups.remove(gb)
    return [[sets[k][:2] for k in g] for g in groups]


def contaminated(text):
    item, w = ITEM.split(), WORD.findall((text or "").lower())
    for at in range(-12, len(w)):
        for k in range(len(item) - 12):
            if sum(0 <= at + j < len(w) and w[at + j] == item[k + j] for j in range(13)) >= 11:
                return True
    return False


def test_stages_and_run_against_plain_python(spark, corpus, monkeypatch):
    folder, rows = corpus
    out, write = {}, corpus_pipeline.stored

    def noted(df, name):
        done = write(df, name)
        if name in dict(corpus_pipeline.STAGES):
            assert done.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            out[name] = [tuple(r) for r in done.collect()]
        return done

    monkeypatch.setattr(corpus_pipeline, "stored", noted)
    out["tokens"] = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    # 1: junk goes, prose stays
    assert all("###" not in r[1] for r in out["quality"])
    assert collections.Counter(r[:2] for r in out["quality"]) == collections.Counter(r[:2] for r in rows if "###" not in r[1])
    # 2: one row of each group, the one with the smallest doc_id
    kept = collections.Counter(r[:2] for r in out["near_duplicates"])
    want = groups_of(out["quality"])
    assert sum(kept.values()) == len(want)
    for g in want:
        left = [x for x in g if kept[x]]
        named = [i for i, _ in g if i is not None]
        assert len(left) == 1 and kept[left[0]] == 1 and (not named or left[0][0] is not None)
    # 3: texts with a passage go, and only these
    clean = [r for r in out["near_duplicates"] if not contaminated(r[1])]
    assert sorted(map(str, out["decontaminated"])) == sorted(map(str, clean)) and len(clean) < len(out["near_duplicates"])
    # 4: no address and no secret is left; other texts are as they were
    redacted = {r[:1] + r[2:4]: r[1] for r in out["redacted"]}
    assert len(out["redacted"]) == len(clean)
    changed = [(a, b) for a, b in zip(sorted(out["decontaminated"], key=str), sorted(out["redacted"], key=str), strict=True) if a != b]
    assert len(changed) == 8 and all("[EMAIL]" in b[1] and '"[SECRET]"' in b[1] and b[4] == len(b[1]) for _, b in changed) and redacted
    # 5: the library's ids
    library = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    want = collections.Counter((r[0], tuple(library.encode(r[1], add_special_tokens=False).ids)) for r in out["redacted"])
    assert collections.Counter((r[0], tuple(r[3])) for r in out["tokens"]) == want
    assert all(r[4] == len(r[3]) and r[5] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in r[3])).hexdigest() for r in out["tokens"])


def test_stages_of_an_empty_table(spark, corpus):
    folder, _ = corpus
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, folder).collect() == []


def test_scores_are_the_rules_of_the_model(spark, corpus):
    folder, _ = corpus
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = rule_ensemble.score(docs, rule_ensemble.fit(docs, labels))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored.collect())
    found = {r["doc_id"]: r["predicted"] for r in scored.filter(F.col("doc_id").isNotNull()).collect()}
    assert all(found[i] == (i < 200) for i in found)


def test_unseen_secrets_and_grouped_numbers_are_found_by_their_contexts(spark):
    rows = [(i, f"uses token = {hashlib.md5(str(i).encode()).hexdigest()} here") for i in range(40)]
    rows += [(100, "uses secret named = abcdef0123456789abcdef0123456789 here"), (101, "no tokens here")]
    rows += [(200 + i, f"call +1 (555) 010-{i:04} now") for i in range(40)] + [(300, "call (555) 010-9999 now"), (301, "in 12 of 40 cases")]
    got = {r["doc_id"]: r for r in pii.op4_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["spans"].startswith("secret:") and got[i]["n_spans"] == 1 for i in range(40))
    assert got[100]["spans"] == "secret:20:52" and got[101]["spans"] == "" and got[301]["spans"] == ""
    assert got[300]["spans"] == "phone:5:19"
