"""Ranges of ordered rows: cuts from a narrow sample, a sort by known cuts, long lists in pieces.

``orderBy`` samples its input to find its ranges, and computes the last joins below it a second time
for that. Where a report has its sort columns in a table that is written already, the cuts come from
there: the joins run once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import ColumnOrName, _col

#: Rows of the sample for each range: what reaches the driver is bounded by the number of ranges.
SAMPLE_PER_RANGE = 100


def _place(columns: Sequence[Column]) -> Column:
    """One comparable value for a row: ascending in each column, NULLs last."""
    parts = [x for i, c in enumerate(columns) for x in (c.isNull().alias(f"n{i}"), c.alias(f"k{i}"))]
    return F.struct(*parts)


def default_ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_cuts(keys: DataFrame, by: Sequence[str], ranges: int) -> list[tuple]:
    """At most ``ranges - 1`` different ascending rows of ``keys[by]`` (NULLs last) that cut it into similar parts.

    Some ``ranges * SAMPLE_PER_RANGE`` rows come to the driver. The sample decides how even the
    ranges are, never which rows a result has.
    """
    total = keys.count()
    if total == 0 or ranges < 2:
        return []
    share = min(1.0, ranges * SAMPLE_PER_RANGE / total)
    narrow = keys.select(*by)
    sample = narrow if share == 1.0 else narrow.sample(share, seed=7)
    rows = sorted((tuple(r) for r in sample.collect()), key=lambda r: [(v is None, 0 if v is None else v) for v in r])
    picked = [rows[i * len(rows) // ranges] for i in range(1, ranges)] if rows else []
    return list(dict.fromkeys(picked))


def range_number(columns: Sequence[Column], types: Sequence, cuts: Sequence[tuple]) -> Column:
    """How many of ``cuts`` are not above the row, found in two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    literals = [_place([F.lit(None if v is None else str(v)).cast(t) for v, t in zip(cut, types, strict=True)]) for cut in cuts]
    step = math.isqrt(len(cuts) - 1) + 1
    place = _place(columns)

    def not_above(some: Column) -> Column:
        return F.size(F.filter(some, lambda cut: cut <= place))

    coarse = literals[step - 1::step]
    if not coarse:
        return not_above(F.array(*literals))
    before = not_above(F.array(*coarse)) * step
    return before + not_above(F.slice(F.array(*literals), before + 1, F.lit(step)))


def sort_by_known_cuts(df: DataFrame, by: Sequence[str], keys: DataFrame, ranges: int | None = None) -> DataFrame:
    """``df`` in ascending order of ``by`` (NULLs last), its ranges cut by a sample of ``keys``.

    ``keys`` is a cheap table with the columns ``by``, best the written rows that ``df`` was joined from.
    Rows that are equal in ``by`` lie in one range, as in any range sort.
    """
    ranges = ranges or default_ranges(df)
    types = [keys.schema[c].dataType for c in by]
    number = range_number([F.col(c) for c in by], types, range_cuts(keys, by, ranges))
    dealt = df.repartitionById(ranges, number.cast("int"))
    return dealt.sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in by])


def long_list_per_key(df: DataFrame, keys: Sequence[str], value: ColumnOrName, order: Sequence[str], alias: str,
                      sep: str = "", ranges: int | None = None) -> DataFrame:
    """``ordered_list`` per key in two levels, for keys with very many rows.

    Equal rows are counted map-side. All rows are range-partitioned by key, order and value, so a hot
    key spans many ranges; each range makes one text of its part, and the parts are put together in
    the order of the ranges. A task holds one range's rows of a key, and of a whole key only the list
    itself. NULL values are skipped; a key without values gets NULL.
    """
    rows = df.select(*keys, *order, _col(value).alias("__v"))
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n"))
    by = [F.col(c).asc_nulls_last() for c in [*keys, *order, "__v"]]
    ranged = counted.repartitionByRange(ranges or default_ranges(df), *by).withColumn("__range", F.spark_partition_id())
    text = F.array_join(F.array_repeat("__v", F.col("__n").cast("int")), sep)
    element = F.struct(_place([F.col(c) for c in [*order, "__v"]]).alias("p"), text.alias("t"))
    items = F.array_sort(F.collect_list(F.when(F.col("__v").isNotNull(), element)))
    pieces = ranged.groupBy(*keys, "__range").agg(items.alias("__items"))
    piece = F.array_join(F.transform("__items", lambda x: x["t"]), sep)
    pieces = pieces.select(*keys, F.when(F.size("__items") > 0, F.struct("__range", piece.alias("t"))).alias("__piece"))
    parts = F.array_sort(F.collect_list("__piece"))
    whole = F.array_join(F.transform(parts, lambda x: x["t"]), sep)
    return pieces.groupBy(*keys).agg(F.nullif(whole, F.lit("")).alias(alias))
