"""Sorts by known cuts and lists in two levels: order, NULLs, hot keys."""

import datetime as dt
import random

from ledgerframe.operators.lookups import ordered_list
from ledgerframe.operators.ranges import long_list_per_key, range_cuts, sort_by_known_cuts
from pyspark.sql import functions as F

SCHEMA = "d timestamp_ntz, k string, n int"


def _rows(n):
    rng = random.Random(3)
    days = [None] + [dt.datetime(1995, 3, 1 + i, 23, 30, 0, i) for i in range(9)]
    return [(rng.choice(days), rng.choice([None, "", "a'b", "B", "b", "Ü"]), rng.choice([None, *range(40)])) for _ in range(n)]


def _order(row):
    return [(v is None, 0 if v is None else v) for v in row]


def test_known_cuts_give_the_order_of_a_sort(spark):
    rows = _rows(3000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for ranges in (1, 2, 7, 30):
        got = sort_by_known_cuts(df, ["d", "k", "n"], df, ranges)
        assert [tuple(r) for r in got.collect()] == sorted(rows, key=_order)
    sizes = [r["count"] for r in sort_by_known_cuts(df, ["d", "k", "n"], df, 7).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 7 and max(sizes) < 3 * 3000 / 7


def test_known_cuts_of_other_rows_and_of_none(spark):
    rows = _rows(200)
    df = spark.createDataFrame(rows, SCHEMA)
    few, none = df.limit(3), df.filter("false")
    for keys in (few, none):
        assert [tuple(r) for r in sort_by_known_cuts(df, ["d", "k", "n"], keys, 4).collect()] == sorted(rows, key=_order)
    assert sort_by_known_cuts(none, ["d", "k"], none, 4).collect() == []


def test_cuts_are_few_whatever_the_rows(spark):
    keys = spark.range(200_000).select((F.col("id") % 1000).alias("n"))
    cuts = range_cuts(keys, ["n"], 4)
    assert len(cuts) == 3 and all(abs(c[0] - want) < 150 for c, want in zip(cuts, (250, 500, 750), strict=True))
    assert len(range_cuts(keys.select(F.lit(1).alias("n")), ["n"], 50)) == 1


def test_long_lists_equal_plain_lists(spark):
    rng = random.Random(4)
    rows = [("HOT", f"D{rng.randint(0, 900)}", rng.choice(["x", "y", "", None])) for _ in range(4000)]
    rows += [(k, rng.choice([None, "D1", "D2"]), rng.choice(["x", "", None])) for k in ("a", "b", None) for _ in range(4)]
    rows += [("none", "D1", None), ("twice", "D1", "x"), ("twice", "D1", "x")]
    df = spark.createDataFrame(rows, "k string, o string, v string").repartition(6)
    for sep in ("", "|"):
        want = df.groupBy("k").agg(ordered_list("v", [F.col("o")], sep).alias("l")).collect()
        got = long_list_per_key(df, ["k"], "v", ["o"], "l", sep, ranges=8).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 6


def test_no_task_reads_all_rows_of_a_hot_key(spark):
    df = spark.range(8000).select(F.lit("HOT").alias("k"), F.format_string("D%05d", "id").alias("o"), F.lit("x").alias("v"))
    ranged = df.repartitionByRange(8, "k", "o", "v")
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2000
    assert long_list_per_key(df, ["k"], "v", ["o"], "l", ranges=8).first().l == "x" * 8000
