"""Join helpers shared by the reports.

* ``only_keys``: restrict a large lookup to the keys a parameter-filtered driving set can
  reach, before the lookup is deduplicated or aggregated. A left-semi join keeps whole key
  groups, so any per-key result (first row, MAX, list) is unchanged for the kept keys. AQE
  broadcasts the key set when its measured size is under the threshold and shuffles otherwise.
* ``drop_null_keys``: NULL never equals anything, so rows with a NULL join key can leave a
  lookup before its window or aggregate; otherwise they form one hot partition.
* ``left_join_lines``: header LEFT JOIN lines, written so that one document holding a large
  share of all lines is still split across tasks (AQE splits a skewed partition only on the
  left side of a left outer join, but on either side of an inner join). It is lazy and reads the
  lines twice.
* ``lines_of_headers``: the same rows with the lines read once: the inner join is written to the
  shared folder, and what has no lines, like every key that lookups are cut down to, comes from there.
* ``joined_once``: rows left-joined with lookups as a step of their own, so its shuffles don't stay on
  disk beside those of the joins that follow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .steps import written_once


def only_keys(df: DataFrame, cols: Sequence[str], keys: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose ``cols`` appear as ``key_cols`` in ``keys`` (a left-semi join).

    The key set is deduplicated first (partially, map-side), so a hot key costs one row per
    map task on the build side.
    """
    renamed = keys.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key_cols)]).distinct()
    cond = [df[c] == renamed[f"__k{i}"] for i, c in enumerate(cols)]
    return df.join(renamed, cond, "left_semi")


def drop_null_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return df.filter(cond)


def left_join_lines(head: DataFrame, lines: DataFrame, head_keys: Sequence[str],
                    line_keys: Sequence[str]) -> DataFrame:
    """``head LEFT JOIN lines ON head_keys = line_keys`` as inner join plus unmatched headers.

    Same rows as the left outer join: every header with its matching lines, and each header
    without any (including NULL keys) once with NULL line columns. The inner join can be split
    by AQE on whichever side is skewed; unmatched headers come from a left-anti join against
    the distinct line keys, so a hot document contributes one key row per map task there.
    """
    cond = [head[h] == lines[k] for h, k in zip(head_keys, line_keys)]
    matched = head.join(lines, cond, "inner")
    # only keys that a header can reach are looked at, not those of the whole line table
    reached = only_keys(lines.select(*line_keys), line_keys, head, head_keys)
    keys = reached.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(line_keys)]).distinct()
    anti = [head[h] == keys[f"__k{i}"] for i, h in enumerate(head_keys)]
    unmatched = head.join(keys, anti, "left_anti").select(
        *head.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in lines.schema.fields])
    return matched.unionByName(unmatched)


def matched_lines(head: DataFrame, lines: DataFrame, head_keys: Sequence[str], line_keys: Sequence[str]) -> DataFrame:
    """The inner join of ``lines_of_headers``: a small header side is broadcast, a hot document
    is split on either side, and lines outside the headers never leave the map side."""
    return head.join(lines, [head[h] == lines[k] for h, k in zip(head_keys, line_keys)], "inner")


def lines_of_headers(head: DataFrame, lines: DataFrame, head_keys: Sequence[str], line_keys: Sequence[str],
                     name: str = "lines") -> DataFrame:
    """``head LEFT JOIN lines`` with one scan of the lines, as rows read back from the shared folder.

    The matched rows are written once (only the columns that ``head`` and ``lines`` bring, so
    select what the report needs first); headers without lines, NULL keys included, are those
    whose key is not among them.
    """
    matched = written_once(matched_lines(head, lines, head_keys, line_keys), name)
    keys = matched.select(*[F.col(h).alias(f"__k{i}") for i, h in enumerate(head_keys)]).distinct()
    bare = head.join(keys, [head[h] == keys[f"__k{i}"] for i, h in enumerate(head_keys)], "left_anti")
    bare = bare.select(*head.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in lines.schema.fields])
    return matched.unionByName(bare)


def joined_once(rows: DataFrame, lookups: Sequence[tuple[DataFrame, Column]], name: str, drop: Sequence[str] = ()) -> DataFrame:
    """``rows`` left-joined with each lookup on its condition, without the columns ``drop``, as rows read back from the shared folder."""
    for lookup, condition in lookups:
        rows = rows.join(lookup, condition, "left")
    return written_once(rows.drop(*drop), name)
