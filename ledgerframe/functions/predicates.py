"""Row filters written so Catalyst can push them into the Parquet scan.

Date filters compare the raw timestamp column with literals (never ``month(d) = m``, which
stops pushdown, T6); prefix filters become ``StringStartsWith`` source filters.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DateRange, MonthParam
from ..sources.schemas import SEVERAL_MONTHS
from .compat import ColumnOrName, _col

# Fixed value: the tenant every report reads.
DEFAULT_ENTITY = 666


def ts_literal(day: dt.date | dt.datetime) -> Column:
    """A zone-free timestamp literal (folds to a constant, so it is pushed down).

    Built from text: a Python datetime literal would pass through the session time zone and
    shift when the session zone differs from the driver machine's.
    """
    if not isinstance(day, dt.datetime):
        day = dt.datetime(day.year, day.month, day.day)
    return F.lit(day.isoformat(sep=" ")).cast("timestamp_ntz")


def day_range(c: ColumnOrName, dates: DateRange) -> Column:
    """``d >= start AND d < end + 1 day``: whole calendar days, any time of day."""
    s = _col(c)
    return (s >= ts_literal(dates.start)) & (s < ts_literal(dates.end_exclusive))


def in_month(c: ColumnOrName, period: MonthParam) -> Column:
    """``TO_CHAR(d,'MM') = m AND TO_CHAR(d,'YYYY') = y`` rewritten as a half-open range."""
    s = _col(c)
    return (s >= ts_literal(period.first_day)) & (s < ts_literal(period.next_first_day))


def closed_month(c: ColumnOrName, period: MonthParam) -> Column:
    """``d BETWEEN first day AND last day``, both at midnight: later times on the last day drop (T5)."""
    return _col(c).between(ts_literal(period.first_day), ts_literal(period.last_day))


def _yyyymm(day: dt.date) -> int:
    return day.year * 100 + day.month


def on_days(df: DataFrame, c: str, dates: DateRange, month_column: str = "doc_month") -> DataFrame:
    """``df`` filtered to ``dates`` on column ``c``; when the table is stored partitioned by
    month (``doc_month`` = yyyymm), the same range is also put on the partition column so only
    the matching folders are listed and read."""
    out = df.filter(day_range(c, dates))
    if month_column in df.columns:
        out = out.filter(F.col(month_column).between(_yyyymm(dates.start), _yyyymm(dates.end)))
    return out


def on_month(df: DataFrame, c: str, period: MonthParam, closed: bool = False,
             month_column: str = "doc_month") -> DataFrame:
    """``df`` filtered to one month (half-open, or closed at midnight of the last day, T5), with
    the partition column pruned too when present."""
    out = df.filter(closed_month(c, period) if closed else in_month(c, period))
    if month_column in df.columns:
        out = out.filter(F.col(month_column) == _yyyymm(period.first_day))
    return out


def lines_in(df: DataFrame, first: dt.date, last: dt.date, month_column: str = "doc_month") -> DataFrame:
    """Lines of documents dated from ``first`` to ``last``, without the partition column.

    A partitioned lake stores a line under the month of its header (see ``write_erp_lake``), so only
    the folders of those months are read, and the one for lines whose headers have several months.
    These are more lines than the period's, never fewer: join them to the dated headers. Tables
    without the column stay as they are.
    """
    if month_column not in df.columns:
        return df
    month = F.col(month_column)
    return df.filter(month.between(_yyyymm(first), _yyyymm(last)) | (month == SEVERAL_MONTHS)).drop(month_column)


def starts_with_any(c: ColumnOrName, prefixes: Sequence[str]) -> Column:
    """``c LIKE 'p1%' OR c LIKE 'p2%' ...``."""
    s = _col(c)
    cond = s.startswith(prefixes[0])
    for p in prefixes[1:]:
        cond = cond | s.startswith(p)
    return cond


def not_contains_or_null(c: ColumnOrName, text: str) -> Column:
    """``c NOT LIKE '%text%' OR c IS NULL``."""
    s = _col(c)
    return ~s.contains(text) | s.isNull()


def not_in(c: ColumnOrName, values: Sequence[object]) -> Column:
    """``c NOT IN (...)``: NULL is neither in nor out, so NULL rows drop."""
    return ~_col(c).isin(*values)


def equals_optional(df: DataFrame, c: ColumnOrName, value: object | None) -> DataFrame:
    """``(:p IS NULL OR c = :p)``: the filter exists only when the value is given."""
    return df if value is None else df.filter(_col(c) == F.lit(value))


def for_entity(df: DataFrame, c: ColumnOrName, entity: int = DEFAULT_ENTITY) -> DataFrame:
    """Tenant filter on an integer entity column."""
    return df.filter(_col(c) == F.lit(int(entity)))


def tenant_rows(df: DataFrame, c: ColumnOrName, entity: int, strict: bool) -> DataFrame:
    """The tenant filter the source report omits (T1): applied only with ``strict_entity``."""
    return for_entity(df, c, entity) if strict else df
