"""Connected components of a graph given as a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import forget, stored


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One contraction: the neighbours of each node move to its smallest neighbour.

    With ``both_ways`` a node hands on its larger neighbours, else its smaller ones and itself.
    Smallest neighbours come from an aggregate (reduced before the shuffle), not from a list per
    node; the join back is one that Spark splits where a node has very many neighbours.
    """
    if both_ways:
        seen = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        moved = seen.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _done(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, which has none: then that is the smallest node reachable."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger")).filter("smaller > 1 OR smaller + larger > 1").isEmpty()


def linked(classes: DataFrame) -> DataFrame:
    """As few links (a, b) as give the components ``classes`` (node, component)."""
    return classes.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); component is the smallest node reachable.

    Null ends and self-links are dropped, repeated links count once; no links give no rows. Each
    round is written to the shared folder; the driver only sees whether another one is needed.
    """
    now = stored(links.select("a", "b").dropna().filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _done(now):
        after = stored(_stars(_stars(now, True), False), "links")
        forget(now)
        now = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
