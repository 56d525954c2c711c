"""Operators 11 to 13 against brute force on small fixtures, with the cases that their docstrings define."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import hard_negatives, merkle, sharding

# hard negatives

VECTORS = "vec_id long, label int, embedding array<float>, q string, task string, part string"


def mined(rows):
    """The contract of op11, row by row."""
    sound = set()
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        sound.add((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for a, label, v in sound:
        if a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, lab) for i, lab, w in sound if i != a]
        positives = sorted((s, i) for s, i, lab in scored if lab == label)[:5]
        for s, p in positives:
            window = sorted((t, i) for t, i, lab in scored if lab != label and 50 * -s <= 100 * -t <= 95 * -s)
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(window[:3])]
    return collections.Counter(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(700):
        v = centres[rng.integers(6)] + rng.normal(size=16) * 0.3
        rows.append((i, 1 if i < 250 else int(rng.integers(10)), [float(x) for x in v]))
    rows += [(1000 + i, 3, rows[5][2]) for i in range(60)]  # equal vectors: ties go by vec_id
    rows += [(2000, None, rows[0][2]), (2050, 2, None), (2100, 2, [1.0, None]), (2150, 2, [float("nan")]), (2151, 2, [float("inf")])]
    rows += [(2200, 4, []), (2250, 4, [1.0, 2.0]), (None, 1, rows[0][2]), rows[100], rows[100], (150, 5, rows[7][2]), (-50, -3, rows[9][2])]
    return rows


@pytest.mark.parametrize(("block", "group", "part", "slice_"), [(256, 4096, 8192, 4096), (4, 8, 100, 30)])
def test_hard_negatives(spark, vectors, monkeypatch, block, group, part, slice_):
    for name, value in (("BLOCK", block), ("GROUP", group), ("PART", part), ("SLICE", slice_)):
        monkeypatch.setattr(hard_negatives, name, value)
    data = spark.createDataFrame([(*r, "x", "y", "z") for r in vectors], VECTORS).repartition(3)
    got = collections.Counter(map(tuple, hard_negatives.op11_hard_negatives(data).collect()))
    assert got == mined(vectors) and len(got) > 100
    assert hard_negatives.op11_hard_negatives(data.limit(0)).collect() == []


def test_bounds_pass_over_most_candidates_of_near_anchors():
    """Near anchors, far candidates: below the root no score is computed for the far ones."""
    rng = np.random.default_rng(5)
    anchors = rng.integers(90, 110, size=(40, 8))
    candidates = np.vstack([rng.integers(90, 110, size=(30, 8)), rng.integers(-5, 5, size=(2000, 8))]).astype(np.float64)
    order, parent, edge = hard_negatives.spanning_tree(anchors)
    assert sorted(order) == list(range(40)) and parent[0] == -1
    table = hard_negatives.pa.table({"block": [0] * 40, "vec_id": list(range(40)), "label": [0] * 40, "q": anchors.tolist()})
    block = hard_negatives.Block(hard_negatives._planted(table).select(["above", "edge", "vec_id", "label"]), anchors[order].astype(np.float64))
    walked = list(block.walk(candidates, np.sqrt((candidates**2).sum(axis=1)), lambda i, low, high: high >= 50000))
    assert all(np.array_equal(s, candidates[w] @ block.vectors[i]) for i, w, s in walked)
    assert sum(len(w) for _, w, _ in walked) <= 40 * 30 + 2000


def test_scores_beyond_doubles_are_exact(spark):
    big = 2.0**21 + 1
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, -1.0]), (2, 2, [big * 0.75, 3.0]), (3, 2, [big * 0.75, 5.0])]
    data = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives.mine(hard_negatives.quantised(data), hard_negatives.quantised(data).filter("vec_id = 0")).collect()
    q = {i: [math.floor(256 * x) for x in v] for i, _, v in rows}
    assert {(r["negative_id"], r["negative_score"]) for r in got} == {(i, sum(x * y for x, y in zip(q[0], q[i]))) for i in (2, 3)}


# sharding


def least_capacity(sizes, shards):
    def needs(capacity):
        n, room = 1, capacity
        for s in sizes:
            if s > room:
                n, room = n + 1, capacity
            room -= s
        return n

    return next(c for c in range(max(sizes, default=0), sum(sizes) + 1) if needs(c) <= shards)


def check_shards(rows, got, keys):
    """``rows`` of (doc_id, text) and what op12 made of them."""
    assert len(got) == len(rows)
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {(r["law"], r["grown_shard"]) for r in got} <= {("bytes", None)}
    slots, groups, bytes_ = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"]].add(r["shard"])
        bytes_[r["shard"]] += r["size"]
    assert set(slots) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())
    # brute force: groups above the fair share stand alone, the rest by the least capacity in the order of keys
    sizes = collections.Counter()
    for _, t in rows:
        sizes[keys[t or ""]] += len((t or "").encode()) + 1
    left, shards = dict(sizes), 8
    while left and shards > 1 and max(left.values()) * shards > sum(left.values()):
        k = min((k for k in left if left[k] == max(left.values())))
        assert bytes_[8 - shards] == left.pop(k)
        shards -= 1
    rest = [bytes_[s] for s in range(8 - shards, 8)]
    if left:
        capacity = least_capacity([left[k] for k in sorted(left)], shards)
        assert max(rest) <= capacity and sum(rest) == sum(left.values())
        assert min(rest) >= sum(left.values()) // shards - 2 * max(left.values())


@pytest.mark.parametrize("hot", [0, 200])
def test_sharding(spark, hot):
    rng = random.Random(hot)
    rows = [(i, "é" * rng.randrange(1, 60) + str(rng.randrange(120))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "x"), (5, "again"), (5, "again"), (None, None)]
    rows += [(2000 + i, "hot text of many copies") for i in range(hot)]
    data = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id long, text string, shard string, key string, part string").repartition(5)
    keys = {r["text"]: r["k"] for r in data.select("text", sharding.text_key(F.col("text")).alias("k")).collect()}
    keys[""] = keys[None]
    check_shards(rows, sharding.op12_sharding(data).collect(), keys)
    assert sharding.op12_sharding(data.limit(0)).collect() == []


@pytest.mark.parametrize("rows", [[(1, "one")], [(i, "same") for i in range(20)], [(i, str(i)) for i in range(17)]])
def test_sharding_of_few_groups(spark, rows):
    data = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r["text"]: r["k"] for r in data.select("text", sharding.text_key(F.col("text")).alias("k")).collect()} | {"": 0}
    check_shards(rows, sharding.op12_sharding(data).collect(), keys)


def test_written_shards_hold_whole_groups(spark, tmp_path):
    data = spark.createDataFrame([(i, "t" * (i % 9), i) for i in range(200)], "doc_id long, text string, n int")
    sharding.write_shards(data, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and set(back.columns) == {"doc_id", "text", "n", "shard"}
    assert back.groupBy("text").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc, text):
    values = [doc["doc_id"], doc["source"], doc["lang"], doc["n_chars"], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def manifested(docs):
    by = collections.defaultdict(list)
    for d in docs:
        by[d["lang"]].append(d)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        by[lang].sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf_of(d, d["text"])))
        trees[lang] = levels_of([leaf_of(d, d["text"]) for d in by[lang]])
    top = levels_of([trees[x][-1][0] for x in order])
    out = []
    for k, lang in enumerate(order):
        for c, d in enumerate(by[lang]):
            lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
            tampered = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0
            folded = leaf_of(d, d["text"].translate(lower) if tampered and d["text"] is not None else d["text"])
            proof = []
            for levels, at in ((trees[lang], c), (top, k)):
                for level in levels[:-1]:
                    run, slot = level[at // 8 * 8 : at // 8 * 8 + 8], at % 8
                    proof += run[:slot] + run[slot + 1 :]
                    folded = h(*run[:slot], folded, *run[slot + 1 :])
                    at //= 8
            root = top[-1][0]
            out.append((d["doc_id"], trees[lang][0][c], trees[lang][-1][0], root, h(*proof), folded, folded == root))
    return collections.Counter(out)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, at string, key string, c string, n string"


def some_documents(n, langs, rng, ids=None):
    texts = [None, "", "Some Text", "lower case only", "É Größe 日本", "Long " * 3000]
    return [{"doc_id": ids[i] if ids else i, "text": rng.choice(texts), "lang": rng.choice(langs), "source": rng.choice([None, "", "web"]), "n_chars": rng.choice([None, i])} for i in range(n)]


@pytest.mark.parametrize("case", ["dense", "sparse", "repeated", "one", "lone languages", "many languages"])
def test_merkle(spark, case, monkeypatch):
    rng = random.Random(case)
    if case == "dense":
        monkeypatch.setattr(merkle, "DIRECTORY_BITS", 1)  # so that a small table has a directory of several levels
        docs = some_documents(900, ["en", "de", None], rng)
    elif case == "sparse":
        docs = some_documents(150, ["en", None], rng, [rng.randrange(-(2**63), 2**63) for _ in range(148)] + [-(2**63), 2**63 - 1])
    elif case == "repeated":
        docs = some_documents(300, ["en", "de"], rng, [rng.choice([None, 5, 6, 7, 64, 127, 128, i]) for i in range(300)])
        docs += docs[:40]
    elif case == "one":
        docs = some_documents(1, ["en"], rng)
    elif case == "lone languages":
        docs = some_documents(100, ["en"], rng) + [{"doc_id": 200 + i, "text": "T", "lang": x, "source": "s", "n_chars": 1} for i, x in enumerate([None, "", "é", "z"])]
    else:
        docs = some_documents(400, [f"l{i}" for i in range(70)], rng)
    rows = [(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"], "a", "k", "c", "n") for d in docs]
    data = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    got = collections.Counter(map(tuple, merkle.op13_merkle(data).collect()))
    assert got == manifested(docs)


def test_merkle_of_nothing(spark):
    assert merkle.op13_merkle(spark.createDataFrame([], DOCUMENTS)).collect() == []
