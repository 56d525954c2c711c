"""Table sources: a lazy name -> DataFrame mapping over Parquet folders or a JDBC database.

Reports take a ``Mapping[str, DataFrame]``; nothing is read until a report's plan runs, and
Catalyst prunes every scan to the columns and rows the plan needs.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .schemas import (
    CLUSTER_KEYS,
    DOC_MONTH,
    DOCUMENT_DATES,
    ERP_SCHEMAS,
    FILTER_KEYS,
    LINE_HEADERS,
    NO_MONTH,
    PERIOD_PARTITIONS,
    SEVERAL_MONTHS,
)


class Tables(Mapping[str, DataFrame]):
    """Read-on-first-use mapping of table names to DataFrames (each built once)."""

    def __init__(self, names: list[str] | tuple[str, ...], build: Callable[[str], DataFrame]):
        self._names = list(names)
        self._build = build
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._made:
            self._made[name] = self._build(name)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def blanks_to_null(df: DataFrame) -> DataFrame:
    """Empty text becomes NULL in every string column, as the source database stores it (T9)."""
    cols = [
        F.nullif(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def read_erp_lake(spark: SparkSession, root: str, fmt: str = "parquet", normalise_blanks: bool = False) -> Tables:
    """ERP tables stored as ``<root>/<table>`` folders (Parquet by default) with declared schemas.

    Facts written clustered by document date (see ``write_erp_lake``) let the pushed date range
    skip row groups by their min/max statistics. ``write_erp_lake`` already stores empty text
    as NULL; pass ``normalise_blanks=True`` only for files written by other tools (the wrapper
    then stops string equality filters from reaching the scan; date and number filters still do).
    """

    def build(name: str) -> DataFrame:
        # A declared schema: no footer-reading inference job per table, and type drift in the
        # files fails the read instead of changing report types.
        df = spark.read.schema(ERP_SCHEMAS[name]).format(fmt).load(f"{root}/{name}")
        return blanks_to_null(df) if normalise_blanks else df

    return Tables(list(ERP_SCHEMAS), build)


def as_declared(df: DataFrame, name: str) -> DataFrame:
    """The columns of ERP table ``name`` in any case or order, cast to their declared types.

    Databases hand out numbers as wide decimals and dates as timestamps of the session zone;
    reports compare an integer tenant and zone-free dates. A timestamp keeps the wall-clock time
    that it shows in the session zone. Other columns are dropped, a missing one is an error.
    """
    found = {c.lower(): c for c in df.columns}
    declared = StructType.fromDDL(ERP_SCHEMAS[name]).fields
    missing = [f.name for f in declared if f.name not in found]
    if missing:
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")
    return df.select(*[F.col(found[f.name]).cast(f.dataType).alias(f.name) for f in declared])


def _sql_literal(value: object) -> str:
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (int, Decimal)) and not isinstance(value, bool):
        return str(value)
    raise TypeError(f"no literal for {value!r}")


def range_predicates(column: str, cuts: Sequence[object]) -> list[str]:
    """WHERE conditions that deal out all rows of a table, each row to exactly one of them.

    ``cuts`` ascend strictly; the ranges are half-open, open at both ends, and rows without a value have
    a condition of their own. Text works like dates and numbers, so document numbers can be dealt out.
    The database must order the column as ``cuts`` do: for text, give cuts in its collation.
    """
    if any(a >= b for a, b in zip(cuts, cuts[1:])):  # type: ignore[operator]
        raise ValueError("cuts must ascend strictly")
    if not cuts:
        return ["1 = 1"]
    at = [_sql_literal(c) for c in cuts]
    between = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(at, at[1:])]
    return [f"{column} < {at[0]}", *between, f"{column} >= {at[-1]}", f"{column} IS NULL"]


def month_cuts(first: dt.date, last: dt.date) -> list[dt.date]:
    """The first days of all months from that of ``first`` to the one after that of ``last``."""
    months = range(first.year * 12 + first.month - 1, last.year * 12 + last.month + 1)
    return [dt.date(m // 12, m % 12 + 1, 1) for m in months]


def connection_shares(wanted: Mapping[str, int], budget: int) -> dict[str, int]:
    """How many connections each table may hold, at most ``budget`` in all and ``wanted[table]`` each.

    Every table gets one; the others go one at a time to the table whose tasks have the most left to read.
    """
    if budget < len(wanted):
        raise ValueError(f"{len(wanted)} tables need as many connections, the budget is {budget}")
    shares = dict.fromkeys(wanted, 1)
    for _ in range(budget - len(wanted)):
        open_ = [n for n in wanted if shares[n] < wanted[n]]
        if not open_:
            break
        shares[max(open_, key=lambda n: (wanted[n] / shares[n], n))] += 1
    return shares


def read_erp_jdbc(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    partitioning: Mapping[str, tuple[str, int, int]] | None = None,
    num_partitions: int = 10,
    predicates: Mapping[str, Sequence[str]] | None = None,
    budget: int | None = None,
    names: Sequence[str] | None = None,
) -> Tables:
    """ERP tables straight from the database over JDBC.

    Connection details come from the caller only. A large table is read in parallel either by
    ``predicates``, one condition a range (``range_predicates`` over dates or document numbers), or by
    ``partitioning``: ``(numeric column, lower bound, upper bound)``. Documents and lines grow, and one
    task can't read them: without either they are refused. Label tables are read by one task. Columns
    get their declared types (``as_declared``).

    Without ``budget``, ``num_partitions`` caps the connections of each table. ``budget`` is one bound for
    the tables in ``names`` (all by default), each read once: they share it (``connection_shares``), and
    the tasks of a table read its ranges one after the other, a connection at a time. A plan that reads
    a table several times at once needs a budget that is smaller by as much.
    """
    parts, ranges = dict(partitioning or {}), {k: list(v) for k, v in (predicates or {}).items()}
    both = sorted(parts.keys() & ranges.keys())
    if both:
        raise ValueError(f"either partitioning or predicates for {', '.join(both)}")
    used = list(names or ERP_SCHEMAS)
    wanted = {n: len(ranges[n]) if n in ranges else num_partitions if n in parts else 1 for n in used}
    if budget is None:
        shares = {n: min(num_partitions, w) for n, w in wanted.items()}
    else:
        shares = connection_shares(wanted, budget)

    def build(name: str) -> DataFrame:
        if name in ranges:
            df = spark.read.jdbc(url, name, predicates=ranges[name], properties=properties)
            # a task of a coalesced read goes through its ranges one by one, so it holds one connection
            df = df.coalesce(shares[name])
        elif name in parts:
            column, lower, upper = parts[name]
            df = spark.read.jdbc(url, name, column=column, lowerBound=lower, upperBound=upper,
                                 numPartitions=shares[name], properties=properties)
        elif name in CLUSTER_KEYS or name in DOCUMENT_DATES:
            raise ValueError(f"{name} grows with the business: give its partitioning (column, lower, upper) or predicates")
        else:
            df = spark.read.jdbc(url, name, properties=properties)
        # The source database stores empty text as NULL already: no normalisation needed.
        return as_declared(df, name)

    return Tables(used, build)


# Tables the test-data driver writes, one Parquet file each.
DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def read_driver_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The generated TPC-H-style tables at ``<sf_dir>/<name>.parquet``."""
    return Tables(DRIVER_TABLES, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def with_header_month(lines: DataFrame, name: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``lines`` with ``doc_month``, the month of the header that bears their document number.

    A number whose headers have different months gets SEVERAL_MONTHS, one without a dated header
    (or NULL) gets NO_MONTH: no dated header can match such a line. Headers are reduced to one row a
    number first, so lines are never multiplied; a hot document is split by the join on its left side.
    """
    header, head_no, line_no = LINE_HEADERS[name]
    day = DOCUMENT_DATES[header]
    month = (F.year(day) * 100 + F.month(day)).cast("int")
    months = tables[header].filter(F.col(head_no).isNotNull()).groupBy(F.col(head_no).alias("__no")).agg(
        F.min(month).alias("__first"), F.max(month).alias("__last"))
    found = lines.join(months, F.col(line_no) == F.col("__no"), "left")
    one = F.when(F.col("__first") == F.col("__last"), F.col("__first")).otherwise(F.lit(SEVERAL_MONTHS))
    known = F.when(F.col("__first").isNull(), F.lit(NO_MONTH)).otherwise(one)
    return found.withColumn(DOC_MONTH, known.cast("int")).drop("__no", "__first", "__last")


def write_erp_lake(tables: Mapping[str, DataFrame], root: str, names: list[str] | None = None,
                   mode: str = "overwrite", normalise_blanks: bool = True, files: int | None = None,
                   partitioned: bool = False) -> None:
    """Store ERP tables as Parquet folders with empty text stored as NULL.

    With ``files`` set, each large table is written as that many files: document headers
    range-clustered by their report date, lines and other large tables hash-clustered by their
    document key (size ``files`` so a file holds about 128 MB). Small label tables keep one
    file. ``partitioned`` adds folder partitions: headers by ``doc_month`` (yyyymm of the report
    date), lines by the ``doc_month`` of their header, period tables by their year and month
    columns. Voucher lines are clustered on two columns: within a month (or a flat file) they lie in the
    order of their account, which R1 filters by prefix. Without ``files`` the incoming partitioning is kept and rows are only sorted by the
    document date within each file. Each table is one distributed write; a lost executor only
    re-runs its own tasks.
    """
    for name in names or list(tables):
        df = blanks_to_null(tables[name]) if normalise_blanks else tables[name]
        date_col = DOCUMENT_DATES.get(name)
        key_col = CLUSTER_KEYS.get(name)
        if files is not None and date_col is not None:
            df = df.repartitionByRange(files, date_col)
        elif files is not None and key_col is not None and not (partitioned and name in LINE_HEADERS):
            df = df.repartition(files, key_col)
        parts: list[str] = []
        if partitioned and date_col is not None:
            df = df.withColumn(DOC_MONTH, (F.year(date_col) * 100 + F.month(date_col)).cast("int"))
            parts = [DOC_MONTH]
        elif partitioned and name in LINE_HEADERS and LINE_HEADERS[name][0] in tables:
            df, parts = with_header_month(df, name, tables), [DOC_MONTH]
            if files is not None:
                # a month's lines in one to a few files: range by month, then by what reports filter, or document
                df = df.repartitionByRange(files, DOC_MONTH, FILTER_KEYS.get(name, key_col))
        elif partitioned and name in PERIOD_PARTITIONS:
            parts = PERIOD_PARTITIONS[name]
        if date_col is not None:
            df = df.sortWithinPartitions(*parts, date_col)
        elif name in FILTER_KEYS:
            df = df.sortWithinPartitions(*parts, FILTER_KEYS[name])
        writer = df.write.mode(mode)
        if parts:
            writer = writer.partitionBy(*parts)
        writer.parquet(f"{root}/{name}")
