"""Set join: how many pairs are met, and how many rounds components take."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import components, set_join
from test_operators import components_of


@pytest.mark.parametrize("percent,width", [(90, 3), (80, 5)])
def test_distant_copies_of_one_text_do_not_meet_all_others(spark, monkeypatch, percent, width):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(150)]

    def copy(edits, who):
        own = list(words)
        for k in range(edits):
            own[(k * 150 // edits + rng.randrange(150 // edits)) % 150] = f"x{who}.{k}"
        return " ".join(own)

    ids = [r[0] for r in spark.range(1, 101).orderBy(F.xxhash64("id")).collect()]
    distant = 14 if width == 3 else 8
    rows = [(ids[0], " ".join(words))] + [(i, copy(1 if k < 60 else distant, i)) for k, i in enumerate(ids[1:])]
    met, write = [], set_join.stored

    def noted(df, name="step"):
        done = write(df, name)
        if name == "met":
            met.append(done.count())
        return done

    monkeypatch.setattr(set_join, "stored", noted)
    got = set_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent, width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components_of(rows, percent, width)
    assert met[0] <= 2 * len(rows)  # 39 distant copies and all 100 make over 2,000 pairs


def test_components_end_with_the_round_that_finds_them(spark, monkeypatch):
    written, write = [], components.stored

    def noted(df, name="step"):
        written.append(name)
        return write(df, name)

    monkeypatch.setattr(components, "stored", noted)
    star = [(k, 1) for k in range(2, 30)] + [(50, 40)]
    found = components.components(spark.createDataFrame(star, "a long, b long"))
    assert dict(map(tuple, found.collect())) == {1: 1, 40: 40} | dict(star) and len(written) == 1
    assert {tuple(r) for r in components.linked(found).collect()} == set(star)
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 32), (31, 32), (7, 7), (None, 3)], "a long, b long")
    assert dict(map(tuple, components.components(chain).collect())) == {k: 0 for k in range(21)} | {30: 30, 31: 30, 32: 30}
    assert components.components(chain.limit(0)).collect() == []
