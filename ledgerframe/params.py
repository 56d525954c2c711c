"""Report parameters, validated on the driver before any plan is built.

Month reports take a month and a year; document reports take a closed range of calendar days
given as ``YYYY-MM-DD`` text, and the AP report an optional supplier code. Validation is
stricter than a plain text check: impossible dates (30 February) and months outside 1-12 are
rejected here instead of failing inside a Spark job.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass

_ISO_DAY = re.compile(r"^\d{4}-\d{2}-\d{2}$")

# Error texts that callers of the parameter contract see.
MISSING_MONTH = "Missing month or year parameter"
MISSING_DATES = "Missing startDate or endDate"
BAD_DATE_FORMAT = "Invalid date format (YYYY-MM-DD only)"
REVERSED_DATES = "startDate must be <= endDate"


class ParameterError(ValueError):
    """A report parameter is missing or malformed."""


@dataclass(frozen=True)
class MonthParam:
    """One calendar month: ``MonthParam.parse("3", "1995")`` or ``MonthParam(1995, 3)``."""

    year: int
    month: int

    def __post_init__(self) -> None:
        if not 1 <= self.month <= 12:
            raise ParameterError(f"month must be 1..12, got {self.month}")
        if not 1 <= self.year <= 9999:
            raise ParameterError(f"year out of range: {self.year}")

    @classmethod
    def parse(cls, month: object, year: object) -> "MonthParam":
        if month in (None, "") or year in (None, ""):
            raise ParameterError(MISSING_MONTH)
        try:
            return cls(int(str(year).strip()), int(str(month).strip()))
        except ValueError as exc:
            raise ParameterError(f"month and year must be whole numbers: {exc}") from None

    @property
    def first_day(self) -> dt.date:
        return dt.date(self.year, self.month, 1)

    @property
    def last_day(self) -> dt.date:
        return dt.date(self.year, self.month, calendar.monthrange(self.year, self.month)[1])

    @property
    def next_first_day(self) -> dt.date:
        return self.last_day + dt.timedelta(days=1)


@dataclass(frozen=True)
class DateRange:
    """Closed range of calendar days; rows match from ``start`` 00:00 up to ``end`` 23:59:59.999."""

    start: dt.date
    end: dt.date

    def __post_init__(self) -> None:
        if self.start > self.end:
            raise ParameterError(REVERSED_DATES)

    @classmethod
    def parse(cls, start: object, end: object) -> "DateRange":
        if not start or not end:
            raise ParameterError(MISSING_DATES)
        if not _ISO_DAY.match(str(start)) or not _ISO_DAY.match(str(end)):
            raise ParameterError(BAD_DATE_FORMAT)
        try:
            first = dt.date.fromisoformat(str(start))
            last = dt.date.fromisoformat(str(end))
        except ValueError as exc:
            raise ParameterError(f"Invalid date: {exc}") from None
        return cls(first, last)

    @property
    def end_exclusive(self) -> dt.date:
        return self.end + dt.timedelta(days=1)


def optional_text(value: object) -> str | None:
    """An optional filter value: absent and empty both mean "no filter"."""
    if value is None:
        return None
    text = str(value)
    return text if text != "" else None
