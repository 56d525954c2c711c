"""Sharding by a minimax contiguous partition (operator 12).

Rows with equal texts are one atomic group. Groups stand in the order of a hash of their text;
prefix sums of their sizes turn "how far does a shard of this capacity reach from here" into the
last group end that is not beyond a position. The smallest capacity for which a greedy walk needs
no more than the given number of shards is found by search, with a few dozen capacities in one
job, and the shards are cut there.

* A group above the fair share of what is left takes a shard of its own, the largest first; no
  other cut could do better for it, and the remaining groups share the remaining shards evenly.
* Of all cuts that keep the capacity, those nearest to equal shares are taken: ``last[j]`` is the
  farthest end of shard j in the greedy walk from the left, ``first[j]`` the nearest end in the walk
  from the right, and every end between them is feasible.

The driver holds positions, a few group sizes and the cuts: no more of them than shards or
candidate capacities, whatever the input. Shards are an expression over the text's hash, so
assigning rows needs neither join nor shuffle.

Defined results: a null text has no bytes and belongs with the empty ones; rows that repeat are
rows of one group, each with a slot of its own; a null doc_id changes nothing; an empty table gives
no rows; further columns are left out (``assign`` keeps them and replaces a column of its own name).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.llm.common import forget, stored

#: Capacities tried in one job.
CANDIDATES = 100
#: Group sizes are added up in this many ranges of the hash first, then within each.
RANGE_BITS = 12


def text_key(text: Column) -> Column:
    """The hash by which groups are told apart and ordered."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


@dataclass(frozen=True)
class ShardPlan:
    """Shards 0, 1, ... of the keys in ``alone``, then one more after each key in ``cuts``."""

    shards: int
    capacity: int
    alone: tuple[int, ...]
    cuts: tuple[int, ...]

    def shard(self, key: Column) -> Column:
        place = F.lit(min(len(self.alone), self.shards - 1))
        for cut in self.cuts:
            place = place + (key > F.lit(cut)).cast("int")
        for i, k in enumerate(self.alone):
            place = F.when(key == F.lit(k), i).otherwise(place)
        return place.cast("int")


class _Ends:
    """The group ends on the line of all sizes, looked up many at a time."""

    def __init__(self, groups: DataFrame, largest: int):
        ranges = F.shiftright("key", 64 - RANGE_BITS)
        found = groups.groupBy(ranges.alias("range")).agg(F.sum("size").alias("size"))
        # one row for each range: a fixed number of rows at most
        before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        starts = found.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
        within = Window.partitionBy("range").orderBy("key")
        placed = groups.withColumn("range", ranges).repartitionByRange("range").withColumn("end", F.sum("size").over(within))
        placed = placed.join(F.broadcast(starts), "range").select("key", (F.col("start") + F.col("end")).alias("end"))
        self.table, self.largest = stored(placed, "ends"), largest

    def _near(self, spans: list[tuple[int, int]]) -> DataFrame:
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        condition = F.lit(False)
        for a, b in merged:
            condition = condition | F.col("end").between(a, b)
        return self.table.filter(condition)

    def last_until(self, positions: list[int]) -> list[int]:
        """For each of the ascending positions the last end that is not beyond it, 0 if there is none."""
        below = F.lit(positions).cast("array<bigint>")
        near = self._near([(p - self.largest, p) for p in positions])
        # an end counts for the first position that it is not beyond, and so for all later ones
        nearest = F.size(F.filter(below, lambda p: p < F.col("end"))).alias("i")
        found = {r["i"]: r["end"] for r in near.groupBy(nearest).agg(F.max("end").alias("end")).collect()}
        reached = 0
        return [reached := max(reached, found.get(i, 0)) for i in range(len(positions))]

    def first_from(self, position: int) -> int:
        """The first end at ``position`` or beyond it; the caller knows that there is one."""
        return self._near([(position, position + self.largest)]).agg(F.min("end")).first()[0]

    def keys_at(self, ends: list[int]) -> list[int]:
        found = {r["end"]: r["key"] for r in self.table.filter(F.col("end").isin(ends)).collect()}
        return [found[e] for e in ends if e in found]


def _walk(ends: _Ends, capacities: list[int], total: int, shards: int) -> list[list[int]]:
    """The greedy walk for each capacity: its shard ends, without the last shard's."""
    at = [0] * len(capacities)
    walks: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards - 1):
        goals = [min(p + c, total) for p, c in zip(at, capacities, strict=True)]
        open_ = sorted({g for g in goals if g < total})
        reached = dict(zip(open_, ends.last_until(open_), strict=True)) if open_ else {}
        at = [reached.get(g, total) for g in goals]
        for walk, p in zip(walks, at, strict=True):
            walk.append(p)
    return walks


def _smallest_capacity(ends: _Ends, total: int, shards: int) -> int:
    """The least capacity that ``shards`` shards in a row get by with.

    A shard that the walk closes holds more than capacity - largest group, so an equal share and
    one group more is always enough. Each round tries capacities evenly spread over what is open.
    """
    share = -(-total // shards)
    too_small, enough = max(share, ends.largest) - 1, share + ends.largest
    while enough - too_small > 1:
        step = max(1, -(-(enough - too_small) // (CANDIDATES + 1)))
        tried = list(range(too_small + step, enough, step))
        for c, walk in zip(tried, _walk(ends, tried, total, shards), strict=True):
            if total - walk[-1] <= c:
                enough = c
                break
            too_small = c
    return enough


def _balanced_ends(ends: _Ends, capacity: int, total: int, shards: int) -> list[int]:
    """Shard ends within ``capacity`` that lie as near to equal shares as the groups allow."""
    first = [0] * (shards - 1)
    after = total
    for j in range(shards - 2, -1, -1):
        after = first[j] = ends.first_from(after - capacity) if after > capacity else 0
    chosen, at = [], 0
    for j in range(shards - 1):
        goal = min(at + capacity, max(first[j], (j + 1) * total // shards), total)
        at = max(at, ends.last_until([goal])[0] if goal < total else total)
        chosen.append(at)
    return chosen


def plan_shards(sizes: DataFrame, shards: int = 8) -> ShardPlan:
    """The plan for rows (key, size): equal keys stay together, the largest shard is as small as can be."""
    groups = stored(sizes.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    left = groups.agg(F.sum("size")).first()[0] or 0
    alone: list[int] = []
    for r in groups.orderBy(F.col("size").desc(), "key").limit(shards).collect():
        if len(alone) == shards - 1 or r["size"] * (shards - len(alone)) <= left:
            break
        alone.append(r["key"])
        left -= r["size"]
    rest = groups.filter(~F.col("key").isin(alone)) if alone else groups
    largest, capacity, cuts = rest.agg(F.max("size")).first()[0] or 0, left, []
    if left and shards - len(alone) > 1:
        ends = _Ends(rest, largest)
        capacity = _smallest_capacity(ends, left, shards - len(alone))
        cuts = ends.keys_at([e for e in _balanced_ends(ends, capacity, left, shards - len(alone)) if e < left])
        forget(ends.table)
    forget(groups)
    return ShardPlan(shards, capacity, tuple(alone), tuple(cuts))


def assign(docs: DataFrame, plan: ShardPlan, text: str = "text", shard: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row; narrow, nothing moves."""
    return docs.withColumn(shard, plan.shard(text_key(F.col(text))))


def write_shards(docs: DataFrame, path: str, shards: int = 8, text: str = "text") -> ShardPlan:
    """Write ``docs`` as Parquet folders ``shard=0`` and so on under ``path``; returns the plan."""
    plan = plan_shards(docs.select(text_key(F.col(text)).alias("key"), size_of(F.col(text)).alias("size")), shards)
    assign(docs, plan, text).write.partitionBy("shard").parquet(path)
    return plan


def with_slots(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """``rows`` (columns ``part`` and ``row``: where a stored row stands) with its place in its shard.

    Rows are numbered within each (shard, part) and moved on by the number of rows in earlier
    parts: no task sees more of a shard than one part holds, however large the shard.
    """
    counts = rows.groupBy(shard, "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(shard).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy(shard, "part").orderBy("row"))
    return rows.withColumn("place", place).join(starts, [shard, "part"]).withColumn("slot", F.col("start") + F.col("place") - 1).drop("place", "start")


def op12_sharding(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row; the law is ``bytes``.

    Slots follow the order in which the rows were read; a null text has the checksum of no bytes.
    """
    text = F.col("text")
    rows = docs.select("doc_id", size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), text_key(text).alias("key"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "rows")
    plan = plan_shards(rows.select("key", "size"), shards)
    placed = with_slots(rows.withColumn("shard", plan.shard(F.col("key"))))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
