"""Benchmark decontamination by spaced-seed hashing (operator 2).

Texts and benchmark items are lower-cased (A-Z) words. A training document is contaminated by an
item if WINDOW words of both, side by side, differ in at most SUBSTITUTIONS places (similarity 0.8
or more); an item of fewer words is looked for as a whole, with one word different at most. Words
that a window has beyond either end of the document count as different.
Each mask selects six of up to eleven words and ignores those between. Whatever places two
substitutions take in a window, one mask fits between them (the tests try all), so a hash of the
selected words is the same on both sides: hashes join, and what stands around a hit is verified.
Each shorter length has two masks of its own: one word different leaves a half of the item as it is.

Defined results: null or empty texts and items match nothing; items of fewer than MIN_WORDS words
are not looked for; repeated items count each, rows that repeat a doc_id share their verdict, rows
without one are judged together; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import bitmap_of, in_bitmap, lower_ascii, stored, words

WINDOW, SUBSTITUTIONS = 13, 2
MIN_WORDS = 5
#: Fixed masks: the selected word positions. Each starts with two neighbours.
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8),)


NONE_SQL = "cast(array() as array<int>)"
#: (mask, length of the items that it is for or 0, its place in such an item)
Mask = tuple[tuple[int, ...], int, int]


def all_masks(lengths: list[int]) -> list[Mask]:
    """The masks for windows, and two for each length of shorter items: their halves."""
    halves = [(tuple(range(k)), n, at) for n in lengths for k, at in ((n // 2, 0), (n - n // 2, n // 2))]
    return [(m, 0, 0) for m in MASKS] + halves


def _hash(w: Column, at: Column, mask: Mask) -> Column:
    """Of the selected words at a place, and of the mask itself."""
    return F.xxhash64(F.lit(",".join(map(str, mask))), *[F.get(w, at + k) for k in mask[0]])


def _hits(w: Column, places: Column, mask: Mask) -> Column:
    return F.transform(places, lambda i: F.struct(i.alias("at"), _hash(w, i, mask).alias("h")))


def _upto(last: Column) -> Column:
    """0, 1, ... last; nothing if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.expr(NONE_SQL))


def _fitting(w: Column, mask: Mask, known: Column) -> Column:
    """The places of a document at which the mask's hash may be a seed."""
    return F.filter("places", lambda i: (i + mask[0][-1] < F.size(w)) & in_bitmap(_hash(w, i, mask), known))


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, words): verified overlaps; start counts the document's words from 0.

    A window that hangs over the start is given as from 0; ``words`` counts those of the item."""
    items = benchmark.select("item_id", words(lower_ascii(F.col("text"))).alias("iw")).filter(F.size("iw") >= MIN_WORDS)
    items = items.withColumn("n", F.size("iw"))
    lengths = sorted(r[0] for r in items.filter(F.col("n") < WINDOW).select("n").distinct().collect())  # WINDOW values at most
    masks = all_masks(lengths)
    w, n = F.col("iw"), F.col("n")
    of_item = [_hits(w, F.when(n >= WINDOW, _upto(n - 1 - m[0][-1])).otherwise(F.expr(NONE_SQL)) if not m[1] else F.when(n == m[1], F.array(F.lit(m[2]))).otherwise(F.expr(NONE_SQL)), m) for m in masks]
    seeds = items.select("item_id", "iw", "n", F.explode(F.concat(*of_item)).alias("s")).select("item_id", "iw", "n", F.col("s.at").alias("iat"), F.col("s.h").alias("h"))
    seeds = stored(seeds, "seeds")
    # the first two words of a mask, then its hash, must be known: both bitmaps have a fixed size
    firsts = items.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("iw") - 2), lambda i: F.xxhash64(F.get("iw", i), F.get("iw", i + 1)))).alias("p"))
    pairs, known = bitmap_of(firsts), bitmap_of(seeds.select("h"))
    doc = docs.select(F.col(doc_id).alias("doc_id"), words(lower_ascii(F.col(text))).alias("w"))
    w, n = F.col("w"), F.size("w")
    doc = doc.withColumn("places", F.filter(_upto(n - 2), lambda i: in_bitmap(F.xxhash64(F.get(w, i), F.get(w, i + 1)), pairs)))
    fit = [_hits(w, _fitting(w, m, known), m) for m in masks]
    hit = doc.withColumn("hits", F.concat(*fit))
    around = F.transform("hits", lambda x: F.struct(x["at"].alias("at"), x["h"].alias("h"), F.greatest(x["at"] - WINDOW, F.lit(0)).alias("from"), F.transform(F.sequence(F.greatest(x["at"] - WINDOW, F.lit(0)), F.least(x["at"] + 2 * WINDOW, F.size("w") - 1)), lambda i: F.get("w", i)).alias("near")))
    # the outer form and a stored table keep these long expressions from being copied into filters
    found = stored(hit.select("doc_id", F.explode_outer(around).alias("x")).filter("x IS NOT NULL").select("doc_id", "x.*"), "hits").join(seeds, "h")
    # side by side: document word at - iat + j stands beside item word j
    length = F.least(F.col("n"), F.lit(WINDOW))
    low, high = F.greatest(F.col("iat") - (WINDOW - 1), F.lit(0)), F.least(F.col("iat") + 2 * (WINDOW - 1), F.col("n") - 1)
    equal = F.transform(F.sequence(low, high), lambda j: F.coalesce((F.get("iw", j) == F.when(F.col("at") - F.col("iat") + j - F.col("from") >= 0, F.get("near", F.col("at") - F.col("iat") + j - F.col("from")))).cast("int"), F.lit(0)))
    found = found.select("doc_id", "item_id", (F.col("at") - F.col("iat")).alias("shift"), "iat", low.alias("low"), length.alias("length"), equal.alias("equal"))
    found = stored(found, "found")
    least = F.when(F.col("length") == WINDOW, F.lit(WINDOW - SUBSTITUTIONS)).otherwise(F.col("length") - 1)
    first = F.filter(F.sequence(F.lit(0), F.greatest(F.size("equal") - F.col("length"), F.lit(0))), lambda k: F.aggregate(F.slice("equal", k + 1, F.col("length")), F.lit(0), lambda a, b: a + b) >= least)
    windows = F.transform(first, lambda k: k + F.col("low"))
    good = found.select("doc_id", "item_id", "length", "shift", F.explode_outer(windows).alias("at")).filter("at IS NOT NULL")
    return good.select("doc_id", "item_id", F.greatest(F.col("shift") + F.col("at"), F.lit(0)).cast("long").alias("start"), F.col("length").cast("long").alias("words")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids): one row for each row of ``docs``."""
    found = overlaps(docs, benchmark).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    found = stored(found, "overlaps").withColumnRenamed("doc_id", "_id")
    joined = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return joined.select("doc_id", (F.size(ids) > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), F.concat_ws(",", F.transform(ids, lambda x: x.cast("string"))).alias("item_ids"))


#: The same in SQL without masks: WINDOW words with two substitutions have four equal words in a row.
SQL = """
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), long_items AS (SELECT * FROM b WHERE len(w) >= 13
), dg AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d)
), bg AS (SELECT item_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM long_items)
), shifts AS (SELECT DISTINCT doc_id, item_id, dg.i - bg.i AS shift FROM dg JOIN bg USING (g)
), sums AS (
  SELECT doc_id, item_id, j, (CASE WHEN j + shift >= 1 AND d.w[j + shift] = l.w[j] THEN 1 ELSE 0 END) AS e, shift, len(l.w) AS n
  FROM (SELECT s.doc_id, s.item_id, s.shift, unnest(range(1, len(l.w) + 1)) AS j FROM shifts s JOIN long_items l USING (item_id)) x
  JOIN d USING (doc_id) JOIN long_items l USING (item_id)
), windows AS (
  SELECT doc_id, item_id, sum(e) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS same, n - j + 1 AS rest FROM sums
), hits AS (SELECT DISTINCT doc_id, item_id FROM windows WHERE rest >= 13 AND same >= 11
), found AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, n IS NOT NULL AS contaminated, CAST(coalesce(n, 0) AS BIGINT) AS n_items, coalesce(ids, '') AS item_ids FROM documents LEFT JOIN found USING (doc_id)
"""
