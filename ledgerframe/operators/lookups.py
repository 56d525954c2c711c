"""Lookup builders: the right-hand sides of the reports' left joins.

Each builder returns a DataFrame keyed by the join key(s), so the caller's left join either
keeps the fan-out of a non-unique lookup on purpose (``labels``), or is guaranteed one match
per key (``first_per_key``, ``max_per_key``, ``list_per_key``).

Scale notes:
* ``first_per_key`` is ``row_number() = 1`` over a total order; Spark plans a partial
  ``WindowGroupLimit`` before the shuffle, so a hot key ships one row per map task.
* ``max_per_key`` / list builders aggregate partially before the shuffle.
* A list is one output value per key. Distinct lists are deduplicated map-side; ``ordered_list``
  keeps repeats, so all rows of one key meet in one task; ``ranges.long_list_per_key`` is for hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import ColumnOrName, _col


def labels(
    df: DataFrame,
    key: str,
    label: str | Sequence[str],
    *,
    lang_col: str | None = None,
    lang: str = "en_US",
    ent_col: str | None = None,
    entity: int | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Rows of a label table restricted to one language / tenant (conditions of the ON clause).

    Not deduplicated: a key with several rows fans out, exactly like the source query.
    """
    cond = F.lit(True)
    if lang_col is not None:
        cond = cond & (F.col(lang_col) == lang)
    if ent_col is not None and entity is not None:
        cond = cond & (F.col(ent_col) == F.lit(int(entity)))
    if where is not None:
        cond = cond & where
    cols = [label] if isinstance(label, str) else list(label)
    return df.filter(cond).select(key, *cols)


def first_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[ColumnOrName],
    cols: Sequence[str] | None = None,
) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order) = 1``, ascending, NULLs last.

    ``order`` must be a total order within a key (add tie-breaks), otherwise the winner
    would depend on task scheduling and re-executed tasks could disagree.
    """
    window = Window.partitionBy(*keys).orderBy(*[_col(o).asc_nulls_last() for o in order])
    keep = list(keys) + [c for c in (cols or df.columns) if c not in keys]
    return (
        df.withColumn("__rn", F.row_number().over(window))
        .filter(F.col("__rn") == 1)
        .select(*keep)
    )


def max_per_key(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``SELECT keys, MAX(c) AS c ... GROUP BY keys``: one row per key."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in cols])


def distinct_list(value: ColumnOrName, sep: str = ", ") -> Column:
    """Aggregate: ``LISTAGG(DISTINCT v, sep) WITHIN GROUP (ORDER BY v)``; NULL for no values."""
    joined = F.array_join(F.array_sort(F.collect_set(_col(value))), sep)
    return F.nullif(joined, F.lit(""))


def ordered_list(value: ColumnOrName, order: Sequence[ColumnOrName], sep: str = "") -> Column:
    """Aggregate: ``LISTAGG(v, sep) WITHIN GROUP (ORDER BY order)``; NULL values skipped.

    Elements are sorted by ``order`` ascending with NULLs last and then by the value itself,
    so equal order keys still give one deterministic text.
    """
    v = _col(value)
    parts = []
    for i, o in enumerate(order):
        parts += [_col(o).isNull().alias(f"n{i}"), _col(o).alias(f"k{i}")]
    elem = F.struct(*parts, v.alias("v"))
    items = F.array_sort(F.collect_list(F.when(v.isNotNull(), elem)))
    joined = F.array_join(F.transform(items, lambda x: x["v"]), sep)
    return F.nullif(joined, F.lit(""))


def list_per_key(df: DataFrame, keys: Sequence[str], value: ColumnOrName, alias: str, sep: str = ", ") -> DataFrame:
    """Sorted distinct list per key. Distinct (key, value) pairs are formed first (a partial
    aggregate on the map side) so duplicates never travel to the task that builds the list."""
    pairs = df.select(*keys, _col(value).alias("__v")).filter(F.col("__v").isNotNull()).distinct()
    return pairs.groupBy(*keys).agg(distinct_list("__v", sep).alias(alias))
