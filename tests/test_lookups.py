from pyspark.sql import functions as F

from ledgerframe.operators.joins import drop_null_keys, only_keys
from ledgerframe.operators.lookups import (
    distinct_list, first_per_key, labels, list_per_key, max_per_key, ordered_list,
)
from ledgerframe.plans.checks import fanout_keys, missing_labels


def test_first_per_key_total_order_nulls_last(spark):
    df = spark.createDataFrame([("k", None, "z"), ("k", "b", "y"), ("k", "b", "x"), ("j", None, "w")],
                               "k string, o string, v string")
    got = sorted(tuple(r) for r in first_per_key(df, ["k"], ["o", "v"]).collect())
    assert got == [("j", None, "w"), ("k", "b", "x")]


def test_max_per_key_independent_columns(spark):
    df = spark.createDataFrame([("k", "a", "2"), ("k", "b", "1"), ("k", None, None)], "k string, x string, y string")
    assert [tuple(r) for r in max_per_key(df, ["k"], ["x", "y"]).collect()] == [("k", "b", "2")]


def test_lists(spark):
    df = spark.createDataFrame([("k", "b", 2), ("k", "a", 1), ("k", "b", 3), ("k", None, 0), ("n", None, 1)],
                               "k string, v string, o int")
    got = {r.k: (r.d, r.o) for r in df.groupBy("k").agg(distinct_list("v").alias("d"),
                                                         ordered_list("v", [F.col("o")], "|").alias("o")).collect()}
    assert got == {"k": ("a, b", "a|b|b"), "n": (None, None)}
    assert {r.k: r.l for r in list_per_key(df, ["k"], "v", "l").collect()} == {"k": "a, b"}


def test_ordered_list_ties_break_on_value(spark):
    df = spark.createDataFrame([("k", "z", 1), ("k", "a", 1)], "k string, v string, o int")
    assert df.groupBy("k").agg(ordered_list("v", [F.col("o")], "").alias("l")).first().l == "az"


def test_labels_keep_fanout(spark):
    df = spark.createDataFrame([(666, "1", "en_US", "A"), (666, "1", "en_US", "B"), (100, "1", "en_US", "C"),
                                (666, "1", "zh_TW", "D")], "e int, k string, lang string, v string")
    got = sorted(r.v for r in labels(df, "k", "v", lang_col="lang", ent_col="e", entity=666).collect())
    assert got == ["A", "B"]


def test_only_keys_and_drop_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    assert [r.v for r in only_keys(df, ["k"], keys, ["x"]).collect()] == [1]
    assert drop_null_keys(df, ["k"]).count() == 2


def test_checks(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2")], "k string, j string")
    assert [tuple(r) for r in fanout_keys(df, ["k", "j"], "t").collect()] == [("t", "a|1", 2)]
    labels_df = spark.createDataFrame([("a",)], "k string")
    assert [r.key for r in missing_labels(df, "k", labels_df, "k").collect()] == ["b"]
