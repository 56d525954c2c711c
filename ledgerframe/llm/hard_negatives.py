"""Hard-negative mining with anchor spanning-tree bounds (operator 11).

Anchors are put into blocks of similar ones, and each block gets a minimum spanning tree over the
distances of its anchors. For a candidate x with norm |x|, a child anchor's score lies within
``score(parent, x) -/+ edge * |x|``; where the parent's score itself is known by bounds only, these
are widened by the edge. Walking down the tree, an anchor computes the scores of those candidates
only whose bounds overlap its window:

* positives: candidates of the anchor's label whose upper bound reaches the best scores found so far;
* negatives: candidates of other labels whose bounds meet a positive's window and, if enough
  candidates are known to lie inside, reach the least of them.

Scores are integers and exact: bounds decide only what is computed. Anchors (a stated query set)
meet all candidates in tasks of at most about GROUP anchors and PART candidates; each task hands on
a few rows for each anchor, and windows over these choose the final ones. A label that holds most
rows is spread over all parts. Nothing is collected, nothing broadcast.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite component
take no part; vectors of different lengths are filled up with zeros; an empty vector scores 0 with
all; rows that repeat in all three columns count once, different rows of one vec_id are rows of
their own, and never each other's positives or negatives; ties go to the smaller vec_id; an empty
table gives no rows; further columns are ignored. Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.llm.common import stored, workers_import

#: Anchors of one spanning tree, about.
BLOCK = 256
#: Anchors and candidates of one task, about; a task's memory follows from these and the dimension.
GROUP = 4096
PART = 8192
#: Candidates that meet a tree at once: two numbers for each anchor of the tree and each of them.
SLICE = 4096


@dataclass(frozen=True)
class Mining:
    """How many positives and negatives, and the window of negatives in percent of the positive's score."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


def quantised(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, q) of the rows that take part: components become ``floor(scale * x)``."""
    value = F.transform(F.col(vector).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(2.0**62)))
    unsound = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), value.alias("v")).dropna()
    q = F.when(sound, F.transform("v", lambda x: F.floor(x))).otherwise(F.raise_error(F.lit("a vector component is beyond 62 bits")).cast("array<bigint>"))
    return base.filter(~unsound).select("vec_id", "label", q.alias("q")).dropDuplicates()


def _similar_first(q: Column) -> Column:
    """A sortable code: the signs of eight fixed mixtures of the components."""

    def mixture(k: int) -> Column:
        signed = F.transform(q, lambda x, i: F.when(F.pmod(F.xxhash64(F.lit(k), i), F.lit(2)) == 0, x.cast("double")).otherwise(-x.cast("double")))
        return F.aggregate(signed, F.lit(0.0), lambda a, x: a + x) > 0

    code = F.lit(0)
    for k in range(8):
        code = code * 2 + mixture(k).cast("int")
    return code


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows of a matrix of doubles or, where these aren't exact, of integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _exact(*matrices: np.ndarray) -> tuple[np.ndarray, ...]:
    """The matrices as doubles if all their inner products are exact in doubles."""
    most = [max((abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))) for m in matrices]
    width = max(m.shape[1] for m in matrices)
    if width * max(most) ** 2 < 2**53:
        return tuple(m.astype(np.float64) for m in matrices)
    if width * max(most) ** 2 >= 2**63:
        raise OverflowError("scores beyond 64 bits")
    return matrices


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree from row 0: rows in the order they join it."""
    n, v = len(vectors), vectors.astype(np.float64)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    nearest, best = np.zeros(n, np.int64), np.full(n, np.inf)
    free = np.ones(n, bool)
    at = 0
    for i in range(n):
        order[i], free[at] = at, False
        apart = np.sqrt(((v - v[at]) ** 2).sum(axis=1))
        closer = free & (apart < best)
        best[closer], nearest[closer] = apart[closer], at
        if i + 1 < n:
            at = int(np.argmin(np.where(free, best, np.inf)))
            parent[at], edge[at] = nearest[at], best[at]
    return order, parent, edge


_TREE_SCHEMA = "block long, place int, above int, edge double, vec_id long, label long, q array<bigint>"


def _planted(table: pa.Table) -> pa.Table:
    """The anchors of one block in the order of its spanning tree; ``above`` is the parent's place."""
    width = max([len(x) for x in table["q"].to_pylist()] or [0])
    order, parent, edge = spanning_tree(_matrix(table["q"], width))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    above = np.where(parent < 0, -1, place[parent])[order]
    taken = table.take(pa.array(order))
    columns = [taken["block"], pa.array(np.arange(len(order)), pa.int32()), pa.array(above, pa.int32()), pa.array(edge[order]), taken["vec_id"], taken["label"], taken["q"]]
    return pa.table(columns, names=["block", "place", "above", "edge", "vec_id", "label", "q"])


def planted_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors (vec_id, label, q) with their block, its tree and ``task``: blocks that meet candidates together."""
    anchors = stored(anchors.withColumn("code", _similar_first(F.col("q"))), "anchors")
    n = anchors.count()
    blocks = max(1, -(-n // BLOCK))
    ranged = anchors.repartitionByRange(blocks, "label", "code", "vec_id").withColumn("block", F.spark_partition_id().cast("long"))
    ranged = stored(ranged.select("block", "vec_id", "label", "q"), "blocks")
    trees = ranged.groupBy("block").applyInArrow(_planted, _TREE_SCHEMA)
    return stored(trees.withColumn("task", F.floor(F.col("block") * BLOCK / GROUP)), "trees")


class Block:
    """One tree of anchors against slices of candidates."""

    def __init__(self, table: pa.Table, vectors: np.ndarray):
        self.above = table["above"].to_numpy()
        self.edge = table["edge"].to_numpy()
        self.ids = table["vec_id"].to_numpy()
        self.labels = table["label"].to_numpy()
        self.vectors = vectors

    def walk(self, candidates: np.ndarray, norms: np.ndarray, needed) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, indexes, scores) for the candidates that ``needed(anchor, low, high)`` asks for."""
        n = len(candidates)
        low, high = np.empty((len(self.ids), n)), np.empty((len(self.ids), n))
        for i in range(len(self.ids)):
            if self.above[i] < 0:
                scores = candidates @ self.vectors[i]
                low[i] = high[i] = scores
                wanted = np.flatnonzero(needed(i, low[i], high[i]))
                yield i, wanted, scores[wanted]
                continue
            reach = self.edge[i] * norms * (1 + 1e-9) + 1e-6
            np.subtract(low[self.above[i]], reach, out=low[i])
            np.add(high[self.above[i]], reach, out=high[i])
            wanted = np.flatnonzero(needed(i, low[i], high[i]))
            scores = candidates[wanted] @ self.vectors[i]
            low[i, wanted] = high[i, wanted] = scores
            yield i, wanted, scores


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the n highest scores, ties by smaller id."""
    if len(scores) > 4 * n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:n]]
    return np.lexsort((ids, -scores))[:n]


def _met(anchors: pa.Table, candidates: pa.Table):
    """The blocks of a task, its candidates as a matrix, their norms, ids and labels."""
    width = max(int(np.diff(t["q"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (anchors, candidates))
    a, c = _exact(_matrix(anchors["q"], width), _matrix(candidates["q"], width))
    norms = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
    return a, c, norms, candidates["vec_id"].to_numpy(), candidates["label"].to_numpy()


def _blocks(anchors: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray]]:
    numbers = anchors["block"].to_numpy()
    for b in np.unique(numbers):
        rows = np.flatnonzero(numbers == b)
        rows = rows[np.argsort(anchors["place"].to_numpy()[rows], kind="stable")]
        yield anchors.take(pa.array(rows)), rows


_POSITIVES = "task long, block long, place int, positive_id long, positive_score long"


def _positives_of(mining: Mining):
    def found(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and candidates.num_rows:
            a, c, norms, ids, labels = _met(anchors, candidates)
            task = anchors["task"][0].as_py()
            for table, rows in _blocks(anchors):
                block = Block(table, a[rows])
                number = table["block"][0].as_py()
                own = np.flatnonzero(np.isin(labels, block.labels))  # others are no positives here
                best = [(np.empty(0, a.dtype), np.empty(0, np.int64))] * len(rows)
                for start in range(0, len(own), SLICE):
                    part = own[start : start + SLICE]

                    def needed(i, low, high, part=part, block=block, best=best):
                        same = (labels[part] == block.labels[i]) & (ids[part] != block.ids[i])
                        known = np.concatenate([best[i][0], low[same]])
                        if len(known) >= mining.positives:
                            same &= high >= np.partition(known, len(known) - mining.positives)[len(known) - mining.positives]
                        return same

                    for i, wanted, scores in block.walk(c[part], norms[part], needed):
                        s, v = np.concatenate([best[i][0], scores]), np.concatenate([best[i][1], ids[part[wanted]]])
                        top = _best(s, v, mining.positives)
                        best[i] = (s[top], v[top])
                out += [(task, number, i, int(v), int(s)) for i, (ss, vs) in enumerate(best) for s, v in zip(ss, vs, strict=True)]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], names=["task", "block", "place", "positive_id", "positive_score"])

    return found


_NEGATIVES = "anchor_id long, block long, place int, number int, positive_id long, positive_score long, negative_id long, negative_score long"


def _negatives_of(mining: Mining):
    def found(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and candidates.num_rows:
            a, c, norms, ids, labels = _met(anchors, candidates)
            for table, rows in _blocks(anchors):
                block = Block(table, a[rows])
                number = table["block"][0].as_py()
                positives = [[(p["id"], p["score"]) for p in x] for x in table["positives"].to_pylist()]
                # 100 * score within low * positive and high * positive, in whole numbers
                windows = [[(-(-mining.low * s // 100), mining.high * s // 100) for _, s in x] for x in positives]
                best = [[(np.empty(0, a.dtype), np.empty(0, np.int64)) for _ in x] for x in positives]
                for start in range(0, len(c), SLICE):
                    part = slice(start, start + SLICE)

                    def needed(i, low, high, part=part, block=block, best=best, windows=windows):
                        other = (labels[part] != block.labels[i]) & (ids[part] != block.ids[i])
                        wanted = np.zeros(len(other), bool)
                        for (least, most), (known, _) in zip(windows[i], best[i], strict=True):
                            if least > most:
                                continue
                            meets = other & (high >= least) & (low <= most)
                            inside = np.concatenate([known, low[meets & (low >= least) & (high <= most)]])
                            if len(inside) >= mining.negatives:
                                meets &= high >= np.partition(inside, len(inside) - mining.negatives)[len(inside) - mining.negatives]
                            wanted |= meets
                        return wanted

                    for i, wanted, scores in block.walk(c[part], norms[part], needed):
                        at = ids[part][wanted]
                        for k, (least, most) in enumerate(windows[i]):
                            inside = (scores >= least) & (scores <= most)
                            s, v = np.concatenate([best[i][k][0], scores[inside]]), np.concatenate([best[i][k][1], at[inside]])
                            top = _best(s, v, mining.negatives)
                            best[i][k] = (s[top], v[top])
                for i, per in enumerate(best):
                    for k, (ss, vs) in enumerate(per):
                        out += [(int(block.ids[i]), number, i, k, *positives[i][k], int(v), int(s)) for s, v in zip(ss, vs, strict=True)]
        columns = list(zip(*out, strict=True)) or [[]] * 8
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
        names = ["anchor_id", "block", "place", "number", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pa.table([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], names=names)

    return found


def mine(rows: DataFrame, anchors: DataFrame, mining: Mining = Mining()) -> DataFrame:  # noqa: B008
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for quantised rows and anchors."""
    spark = rows.sparkSession
    workers_import(spark)
    rows = stored(rows, "vectors")
    trees = planted_anchors(anchors)
    parts = max(1, -(-rows.count() // PART))
    tasks = (trees.agg(F.max("task")).first()[0] or 0) + 1
    spread = F.pmod(F.xxhash64("vec_id", "label"), F.lit(parts))
    met = rows.withColumn("part", spread).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)).cast("array<bigint>")))
    met = met.repartition(parts * tasks, "task", "part")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))

    def meeting(side: DataFrame, schema: str, how) -> DataFrame:
        side = side.withColumn("part", every).repartition(parts * tasks, "task", "part")
        return side.groupBy("task", "part").cogroup(met.groupBy("task", "part")).applyInArrow(how, schema)

    anchor = ["task", "block", "place"]
    first = Window.partitionBy(*anchor).orderBy(F.desc("positive_score"), "positive_id")
    chosen = meeting(trees, _POSITIVES, _positives_of(mining)).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= mining.positives)
    listed = chosen.groupBy(*anchor).agg(F.sort_array(F.collect_list(F.struct("r", F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives"))
    # an anchor without positives asks for nothing, but its children's bounds come through it
    none = F.array().cast("array<struct<r:int,id:bigint,score:bigint>>")
    asked = trees.join(stored(listed, "positives"), anchor, "left").withColumn("positives", F.coalesce("positives", none))
    found = meeting(asked, _NEGATIVES, _negatives_of(mining))
    window = Window.partitionBy("block", "place", "number").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= mining.negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose vec_id 50 divides; every seventh vec_id has its label moved on by one."""
    rows = quantised(embeddings)
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = stored(rows, "quantised")
    return mine(rows, rows.filter(F.col("vec_id") % 50 == 0))


SQL = """
WITH sound AS (
    SELECT DISTINCT vec_id, label::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), rows_ AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, q FROM sound
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
           list_inner_product(a.q, r.q)::BIGINT AS score
    FROM rows_ a JOIN rows_ r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), positives AS (
    SELECT * FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
    SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
    FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
     AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 3
"""
