import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerframe.functions.compat import (
    by_prefix, concat_null_safe, date_text, date_text_mon, decode, decode_passthrough, first_number,
    is_null_or_token, last_chars, normalised_key, nvl, per_thousand,
)
from ledgerframe.functions.predicates import (
    closed_month, day_range, equals_optional, in_month, not_contains_or_null, not_in, starts_with_any,
)
from ledgerframe.params import DateRange, MonthParam


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_first_number_and_per_thousand(spark):
    df = spark.createDataFrame([("BAG 25KG 2",), ("LOOSE",), (None,), ("7",), ("x0012y",)], "s string")
    got = _rows(df.select(first_number("s"), per_thousand("s")))
    assert got == [(Decimal(25), Decimal("0.025")), (None, Decimal("0.000")), (None, Decimal("0.000")),
                   (Decimal(7), Decimal("0.007")), (Decimal(12), Decimal("0.012"))]
    assert df.select(per_thousand("s")).schema[0].dataType.simpleString() == "decimal(18,3)"


def test_last_chars_short_text_is_null(spark):
    # T11: the source database gives NULL for SUBSTR(s, -6) of a shorter text.
    df = spark.createDataFrame([("00001234",), ("123",), ("123456",), (None,)], "s string")
    assert [r[0] for r in df.select(last_chars("s", 6)).collect()] == ["001234", None, "123456", None]


def test_concat_null_safe(spark):
    # T9: NULL parts are skipped, an all-NULL concatenation is NULL.
    df = spark.createDataFrame([("A", "RC-1"), (None, "RC-2"), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(concat_null_safe("a", F.lit(","), "b")).collect()]
    assert got == ["A,RC-1", ",RC-2", ","]
    assert [r[0] for r in df.select(concat_null_safe("a", "a")).collect()] == ["AA", None, None]


def test_decodes(spark):
    df = spark.createDataFrame([("X",), ("Y",), ("Q",), (None,), ("NULL",)], "s string")
    m = {"X": "Voided", "Y": "Confirmed"}
    assert [r[0] for r in df.select(decode("s", m, "NOT Match")).collect()] == \
        ["Voided", "Confirmed", "NOT Match", "NOT Match", "NOT Match"]
    assert [r[0] for r in df.select(decode_passthrough("s", m)).collect()] == \
        ["Voided", "Confirmed", "Q", None, "NULL"]
    assert [r[0] for r in df.select(is_null_or_token("s")).collect()] == [False, False, False, True, True]


def test_by_prefix_and_constant_branch(spark):
    df = spark.createDataFrame([("F001", "a", "b", "c"), ("CN02", "a", "b", "c"), ("IV03", "a", "b", "c")],
                               "k string, x string, y string, z string")
    got = [r[0] for r in df.select(by_prefix("k", [("F", "x"), ("CN", "y")], "z")).collect()]
    assert got == ["a", "b", "c"]
    got = [r[0] for r in df.select(by_prefix("k", [("F", F.lit("WASTE"))], "z")).collect()]
    assert got == ["WASTE", "c", "c"]


def test_normalised_key_and_nvl(spark):
    df = spark.createDataFrame([("6200 ",), (" 61",), (None,)], "s string")
    assert [r[0] for r in df.select(normalised_key("s")).collect()] == ["6200", "61", None]
    assert [r[0] for r in df.select(nvl("s", " ")).collect()] == ["6200 ", " 61", " "]


def test_date_texts(spark):
    df = spark.createDataFrame([(dt.datetime(1995, 3, 7, 23, 5),)], "d timestamp_ntz")
    assert _rows(df.select(date_text("d"), date_text_mon("d"))) == [("07/03/1995", "07 Mar 1995")]


def test_day_range_keeps_end_day_evening(spark):
    rows = [(dt.datetime(1995, 3, 1, 0, 0),), (dt.datetime(1995, 3, 31, 23, 0),), (dt.datetime(1995, 4, 1),),
            (dt.datetime(1995, 2, 28, 23, 59),)]
    df = spark.createDataFrame(rows, "d timestamp_ntz")
    r = DateRange(dt.date(1995, 3, 1), dt.date(1995, 3, 31))
    assert df.filter(day_range("d", r)).count() == 2
    assert df.filter(in_month("d", MonthParam(1995, 3))).count() == 2


def test_closed_month_drops_last_day_evening(spark):
    # T5: BETWEEN first AND last day at midnight.
    rows = [(dt.datetime(1995, 3, 31, 0, 0),), (dt.datetime(1995, 3, 31, 23, 0),), (dt.datetime(1995, 3, 1),)]
    df = spark.createDataFrame(rows, "d timestamp_ntz")
    got = sorted(r[0] for r in df.filter(closed_month("d", MonthParam(1995, 3))).collect())
    assert got == [dt.datetime(1995, 3, 1), dt.datetime(1995, 3, 31)]


def test_not_in_drops_null_and_not_contains_keeps_null(spark):
    df = spark.createDataFrame([("X",), ("Y",), (None,)], "s string")
    assert [r[0] for r in df.filter(not_in("s", ["X"])).collect()] == ["Y"]
    df2 = spark.createDataFrame([("XC090-1",), ("XC-2",), (None,)], "s string")
    assert sorted(df2.filter(not_contains_or_null("s", "XC090")).collect(), key=str) == \
        sorted(spark.createDataFrame([("XC-2",), (None,)], "s string").collect(), key=str)


def test_starts_with_any_and_optional(spark):
    df = spark.createDataFrame([("6100",), ("7100",), ("1100",)], "s string")
    assert df.filter(starts_with_any("s", ["6", "7"])).count() == 2
    assert equals_optional(df, "s", None).count() == 3
    assert equals_optional(df, "s", "1100").count() == 1


def test_date_filters_do_not_depend_on_session_zone(spark):
    rows = [(dt.datetime(1995, 3, 1, 0, 0),), (dt.datetime(1995, 3, 31, 23, 0),), (dt.datetime(1995, 4, 1),),
            (dt.datetime(1995, 2, 28, 23, 59),)]
    df = spark.createDataFrame(rows, "d timestamp_ntz")
    r = DateRange(dt.date(1995, 3, 1), dt.date(1995, 3, 31))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/Los_Angeles", "Asia/Bangkok", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = sorted(x.d for x in df.filter(day_range("d", r)).collect())
            assert got == [dt.datetime(1995, 3, 1, 0, 0), dt.datetime(1995, 3, 31, 23, 0)], zone
            assert [x[0] for x in df.select(date_text("d")).collect()][0] == "01/03/1995"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_long_digit_runs_are_unknown_not_an_error(spark):
    rows = [("12 pcs", "0.012"), ("1" * 18, "1" * 15 + ".111"), ("9" * 20, None), ("9" * 38, None), ("9" * 45, None), ("none", "0.000"), (None, "0.000")]
    df = spark.createDataFrame(rows, "s string, want string")
    got = df.select("s", "want", per_thousand("s").cast("string").alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
