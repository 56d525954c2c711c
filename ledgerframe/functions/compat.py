"""Column expressions that reproduce the ERP database's scalar semantics with built-ins.

Every helper returns a plain ``Column`` made only of ``pyspark.sql.functions`` calls, so it
stays JVM-side inside whole-stage codegen; there is no Python UDF anywhere in the package.

Semantic decisions (see SURVEY section 2.11):
* empty text counts as NULL in the source database (T9): concatenation skips NULL parts and
  an all-NULL concatenation is NULL;
* ``SUBSTR(s, -n)`` of a text shorter than ``n`` is NULL (T11);
* ``TO_NUMBER(REGEXP_SUBSTR(s, '[0-9]+'))`` is the first run of digits, NULL when there is
  none, and a digits-per-thousand quotient is exact at three decimals (T8).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Date text layouts used by the reports.
DAY_MONTH_YEAR = "dd/MM/yyyy"
DAY_MON_YEAR = "dd MMM yyyy"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_text(c: ColumnOrName) -> Column:
    """``TO_CHAR(d, 'DD/MM/YYYY')``."""
    return F.date_format(_col(c), DAY_MONTH_YEAR)


def date_text_mon(c: ColumnOrName) -> Column:
    """``TO_CHAR(d, 'DD Mon YYYY')`` with English month abbreviations."""
    return F.date_format(_col(c), DAY_MON_YEAR)


def first_digits(c: ColumnOrName) -> Column:
    """``REGEXP_SUBSTR(s, '[0-9]+')``: the first run of digits, NULL when there is none."""
    return F.regexp_substr(_col(c), F.lit("[0-9]+"))


def first_number(c: ColumnOrName) -> Column:
    """``TO_NUMBER`` of the first digits; NULL without digits, and beyond 38 of them."""
    return first_digits(c).try_cast("decimal(38,0)")


def per_thousand(c: ColumnOrName) -> Column:
    """The first number per thousand, exact at three decimals: 0 without digits.

    A number too large for ``decimal(18,3)`` (over 18 significant digits) is unknown: NULL, neither
    0 nor an error that ends the report.
    """
    digits = first_digits(c)
    return F.when(digits.isNull(), F.lit(0).cast("decimal(18,3)")).otherwise(
        F.concat(digits, F.lit("E-3")).try_cast("decimal(18,3)"))


def last_chars(c: ColumnOrName, n: int = 6) -> Column:
    """``SUBSTR(s, -n)``: the last ``n`` characters, NULL when the text is shorter."""
    s = _col(c)
    return F.when(F.length(s) >= n, F.substring(s, -n, n))


def concat_null_safe(*parts: ColumnOrName) -> Column:
    """``a || b || c`` with NULL parts skipped; NULL when nothing is left."""
    joined = F.concat_ws("", *[_col(p) for p in parts])
    return F.nullif(joined, F.lit(""))


def nvl(c: ColumnOrName, default: object) -> Column:
    """``NVL(x, default)``."""
    return F.coalesce(_col(c), F.lit(default))


def decode(c: ColumnOrName, mapping: Mapping[str, str], default: ColumnOrName | str | None) -> Column:
    """``CASE WHEN c = k1 THEN v1 ... ELSE default END``; ``default`` may be a column."""
    s = _col(c)
    expr: Column | None = None
    for key, value in mapping.items():
        expr = F.when(s == key, F.lit(value)) if expr is None else expr.when(s == key, F.lit(value))
    fallback = default if isinstance(default, Column) else F.lit(default)
    return fallback if expr is None else expr.otherwise(fallback)


def decode_passthrough(c: ColumnOrName, mapping: Mapping[str, str]) -> Column:
    """``CASE`` mapping codes to text; any other code (and NULL) passes through unchanged."""
    return decode(c, mapping, _col(c))


def is_null_or_token(c: ColumnOrName, token: str = "NULL") -> Column:
    """True for SQL NULL and for the literal text ``'NULL'``."""
    s = _col(c)
    return s.isNull() | (s == token)


def by_prefix(c: ColumnOrName, choices: Sequence[tuple[str, ColumnOrName]], default: ColumnOrName) -> Column:
    """``CASE WHEN c LIKE 'p1%' THEN a WHEN c LIKE 'p2%' THEN b ELSE d END``.

    Choice values are columns or names; pass ``F.lit(..)`` for a constant branch.
    """
    s = _col(c)
    expr: Column | None = None
    for prefix, value in choices:
        cond = s.startswith(prefix)
        expr = F.when(cond, _col(value)) if expr is None else expr.when(cond, _col(value))
    return _col(default) if expr is None else expr.otherwise(_col(default))


def normalised_key(c: ColumnOrName) -> Column:
    """``TRIM(TO_CHAR(x))``: text form without surrounding blanks, for join keys."""
    return F.trim(_col(c).cast("string"))
