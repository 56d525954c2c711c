"""Report outputs: JSON rows (positional arrays or named objects), labelled CSV, row counts.

All writers are distributed DataFrame writes (one file per task, committed by Spark's output
committer, so a lost executor's task is simply re-run); nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType


def _json_value(df: DataFrame, name: str):
    # A variant keeps each value's own JSON type (text, number, null) inside one array;
    # numbers print as the shortest decimal text (12.50 -> 12.5, 100.00 -> 100).
    # A date and time is ISO text to the millisecond. It has no zone; it is written as if in UTC.
    if isinstance(df.schema[name].dataType, (TimestampType, TimestampNTZType)):
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").cast("variant")
    return F.col(name).cast("variant")


def rows_as_arrays(df: DataFrame, alias: str = "row") -> DataFrame:
    """One JSON array per row, values in column order: ``["AP-1", 3, null, 12.5]``."""
    return df.select(F.to_json(F.array(*[_json_value(df, c) for c in df.columns])).alias(alias))


def rows_as_objects(df: DataFrame, upper_keys: bool = True, alias: str = "row") -> DataFrame:
    """One JSON object per row keyed by column name; NULL fields are kept as ``null``.

    The source database reports unquoted names in upper case, so keys are upper-cased here
    (and only here; DataFrame columns stay lower case).
    """
    fields = [_json_value(df, c).alias(c.upper() if upper_keys else c) for c in df.columns]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(alias))


def write_json_rows(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the single text column made by ``rows_as_arrays`` / ``rows_as_objects``."""
    rows.write.mode(mode).text(path)


def relabel(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rename columns positionally to human headers."""
    if len(labels) != len(df.columns):
        raise ValueError(f"{len(labels)} labels for {len(df.columns)} columns")
    return df.toDF(*labels)


def write_labelled_csv(df: DataFrame, labels: Sequence[str], path: str, year: int | None = None,
                       month: int | None = None, mode: str = "overwrite") -> None:
    """CSV with a header row of ``labels``; with a period the files land under
    ``year=YYYY/month=M`` (the spreadsheet export named by year and month)."""
    out = relabel(df, labels)
    writer = out
    parts: list[str] = []
    if year is not None and month is not None:
        writer = out.withColumn("year", F.lit(int(year))).withColumn("month", F.lit(int(month)))
        parts = ["year", "month"]
    w = writer.write.mode(mode).option("header", True)
    if parts:
        w = w.partitionBy(*parts)
    w.csv(path)


def with_row_count(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """Attach a row counter that is filled by whatever action runs the report (no second pass)."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias(name)), obs
