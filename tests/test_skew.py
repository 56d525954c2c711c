"""Hot keys: one document holding most lines is split across tasks, results unchanged."""

from ledgerframe.operators.joins import left_join_lines
from ledgerframe.operators.lookups import first_per_key

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
}


def _key(t):
    return tuple("" if v is None else str(v) for v in t)


def _with_conf(spark, conf, fn):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_document_lines_are_split_and_join_is_exact(spark):
    head = spark.createDataFrame([("HOT", 1), ("B", 2), ("C", 3), (None, 4)], "doc string, h int")
    rows = [("HOT", i) for i in range(20000)] + [("B", i) for i in range(5)] + [("X", 0)]
    lines = spark.createDataFrame(rows, "ldoc string, n int").repartition(8)

    def run():
        df = left_join_lines(head, lines, ["doc"], ["ldoc"])
        got = sorted(((r.doc, r.h, r.ldoc, r.n) for r in df.collect()), key=_key)
        return got, df._jdf.queryExecution().executedPlan().toString()

    got, plan = _with_conf(spark, SKEW_CONF, run)
    want = sorted(((r.doc, r.h, r.ldoc, r.n) for r in head.join(lines, head.doc == lines.ldoc, "left").collect()),
                  key=_key)
    assert got == want
    assert len(got) == 20000 + 5 + 2  # C and the NULL-key header once each, with NULL line columns
    assert "skew=true" in plan  # AQE split the hot document's partition


def test_first_per_key_on_hot_key_is_exact(spark):
    rows = [("HOT", i, f"v{i}") for i in range(20000, 0, -1)] + [("k2", 5, "a"), (None, 0, "n")]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(8)
    got = sorted((r.k or "", r.o, r.v) for r in first_per_key(df, ["k"], ["o", "v"]).collect())
    assert got == [("", 0, "n"), ("HOT", 1, "v1"), ("k2", 5, "a")]
