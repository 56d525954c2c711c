import datetime as dt

import pytest

from ledgerframe.params import DateRange, MonthParam, ParameterError, optional_text


def test_month_param_parse_and_bounds():
    p = MonthParam.parse("2", "2024")
    assert (p.year, p.month) == (2024, 2)
    assert p.first_day == dt.date(2024, 2, 1)
    assert p.last_day == dt.date(2024, 2, 29)
    assert p.next_first_day == dt.date(2024, 3, 1)
    assert MonthParam(1995, 12).next_first_day == dt.date(1996, 1, 1)


@pytest.mark.parametrize("month,year", [(None, "1995"), ("3", ""), ("13", "1995"), ("0", "1995"), ("x", "1995")])
def test_month_param_rejects(month, year):
    with pytest.raises(ParameterError):
        MonthParam.parse(month, year)


def test_date_range_parse():
    r = DateRange.parse("1995-01-31", "1995-02-01")
    assert r.start == dt.date(1995, 1, 31) and r.end_exclusive == dt.date(1995, 2, 2)


@pytest.mark.parametrize("start,end", [
    ("", "1995-01-01"), ("1995-1-1", "1995-01-02"), ("1995/01/01", "1995-01-02"),
    ("1995-02-30", "1995-03-01"), ("1995-03-02", "1995-03-01"),
])
def test_date_range_rejects(start, end):
    with pytest.raises(ParameterError):
        DateRange.parse(start, end)


def test_optional_text():
    assert optional_text(None) is None and optional_text("") is None and optional_text("17") == "17"
