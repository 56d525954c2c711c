"""Merkle dataset manifest by bitmap-rank indexing (operator 13).

Every row is a leaf. Per language, the doc_ids form a bitmap of 64-bit words, built by merging the
words of all map tasks and kept for words that have a bit only. A directory of counts over the words,
in levels of 4,096 entries, gives the number of leaves before a word; with the popcount of the word's
lower bits that is a leaf's coordinate, without sorting the leaves.

Coordinates make the tree a matter of keys: a node's parent is its coordinate divided by eight, the
remainder is its slot. Each level groups the nodes by (language, parent) into an array of eight slots
and hashes it. The way back, from the root to the leaves, hands each run of slots the runs above it,
so that every leaf has its whole proof without being joined to each level.

Defined results: a null lang is a language of its own, before all others; null doc_ids come before
all others; rows that repeat a doc_id within a language are separate leaves in the order of their
digests (equal digests are interchangeable); null, empty and very long texts are hashed as they
are; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.llm.common import forget, lower_ascii, stored

#: Children of a node.
FANOUT = 8
FANOUT_BITS = 3
#: A directory level adds up the counts of this many entries (as a power of two).
DIRECTORY_BITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Column) -> Column:
    """H of an array of hexadecimal digests, concatenated."""
    return F.sha2(F.array_join(parts, ""), 256)


def leaf_digest(**fields: Column) -> Column:
    """H of the fields, each ``-`` if null, else the number of its UTF-8 bytes, ``:`` and its value."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[part(fields[f]) for f in FIELDS]), 256)


def leaves_of(docs: DataFrame, claim: Column | None = None) -> DataFrame:
    """(key, doc_id, leaf, claim): ``key`` orders languages, null first; ``claim`` is carried along."""
    key = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    return docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(**{f: F.col(f) for f in FIELDS}).alias("leaf"), (F.lit(None).cast("string") if claim is None else claim).alias("claim"))


def _before(level: DataFrame, top: int) -> DataFrame:
    """(key, at, n) with ``before``: the sum of n over the smaller ``at`` of the same key.

    ``at`` is at least 0 and at most ``top``. A window adds up 2 ** DIRECTORY_BITS entries at most;
    what lies before such a block comes from the next level, whose entries are the blocks.
    """
    block = F.shiftright("at", DIRECTORY_BITS)
    within = Window.partitionBy("key", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = level.withColumn("block", block).withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    if top >> DIRECTORY_BITS == 0:
        return placed.drop("block")
    blocks = level.groupBy("key", block.alias("at")).agg(F.sum("n").alias("n"))
    blocks = _before(blocks, top >> DIRECTORY_BITS).select("key", F.col("at").alias("block"), F.col("before").alias("start"))
    return placed.join(blocks, ["key", "block"]).withColumn("before", F.col("before") + F.col("start")).drop("block", "start")


def coordinates(leaves: DataFrame) -> DataFrame:
    """``leaves`` (key, doc_id, leaf, ...; stored) with ``c``, their place in the language, and ``total``, its leaves."""
    lo, hi = leaves.agg(F.min(F.shiftright("doc_id", 6)), F.max(F.shiftright("doc_id", 6))).first()
    lo, top = (0, 0) if lo is None else (lo, hi - lo + 1)
    # word 0 holds the rows without a doc_id
    at = F.coalesce(F.shiftright("doc_id", 6) - lo + 1, F.lit(0))
    bit = F.col("doc_id").bitwiseAND(F.lit(63)).cast("int")
    spread = leaves.withColumn("at", at).withColumn("bit", bit)
    words = spread.groupBy("key", "at").agg(F.coalesce(F.bit_or(F.expr("shiftleft(1L, bit)")), F.lit(0)).alias("word"), F.count("*").alias("n"))
    words = stored(words, "bitmap")
    totals = words.groupBy("key").agg(F.sum("n").alias("total"))
    directory = _before(words.select("key", "at", "n"), top).select("key", "at", "before").join(words, ["key", "at"]).join(totals, "key")
    directory = stored(directory.withColumn("repeats", F.col("n") > F.bit_count("word")).drop("n"), "directory")
    forget(words)
    placed = spread.join(directory, ["key", "at"])
    rank = F.col("before") + F.bit_count(F.expr("word & ~shiftleft(-1L, bit)"))
    unique = placed.filter(~F.col("repeats")).withColumn("c", rank)
    if directory.filter("repeats").isEmpty():
        return unique.drop("at", "bit", "word", "before", "repeats")
    return unique.unionByName(_repeated(placed.filter("repeats"))).drop("at", "bit", "word", "before", "repeats")


def _repeated(placed: DataFrame) -> DataFrame:
    """The same for words in which a doc_id repeats: counts by bit, then by the digest's first digits, then rows."""
    placed = placed.withColumn("bit", F.coalesce("bit", F.lit(0))).withColumn("digits", F.substring("leaf", 1, 3))
    parts = placed.groupBy("key", "at", "bit", "digits").agg(F.count("*").alias("n"))
    bits = parts.groupBy("key", "at", "bit").agg(F.sum("n").alias("n"))
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    bits = bits.select("key", "at", "bit", F.coalesce(F.sum("n").over(earlier(["key", "at"], "bit")), F.lit(0)).alias("lower"))
    parts = parts.select("key", "at", "bit", "digits", F.coalesce(F.sum("n").over(earlier(["key", "at", "bit"], "digits")), F.lit(0)).alias("lesser"))
    own = F.row_number().over(Window.partitionBy("key", "at", "bit", "digits").orderBy("leaf")) - 1
    found = placed.withColumn("own", own).join(bits, ["key", "at", "bit"]).join(parts, ["key", "at", "bit", "digits"])
    return found.withColumn("c", F.col("before") + F.col("lower") + F.col("lesser") + F.col("own")).drop("digits", "lower", "lesser", "own")


def _runs(nodes: DataFrame, *carried: str) -> DataFrame:
    """Nodes (key, c, n, digest) as runs (key, at, n, run): arrays by slot, n the level's nodes of the key."""
    slot = F.struct(F.col("c").bitwiseAND(F.lit(FANOUT - 1)).cast("int").alias("slot"), "digest", *carried)
    return nodes.groupBy("key", F.shiftright("c", FANOUT_BITS).alias("at"), "n").agg(F.sort_array(F.collect_list(slot)).alias("slots")).withColumn("run", F.col("slots.digest"))


def _parents(runs: DataFrame) -> DataFrame:
    more = F.shiftright(F.col("n") + (FANOUT - 1), FANOUT_BITS)
    return runs.select("key", F.col("at").alias("c"), more.alias("n"), digest(F.col("run")).alias("digest"))


def _climb(runs: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels of runs above ``runs`` (itself included), and the (key, digest) that each key ends with.

    A key whose level has one node is done with it; the others go on. ``most``: the largest n.
    """
    lone = runs.filter("n = 1").select("key", F.col("run")[0].alias("digest"))
    levels, tops = [runs], [lone]
    while most > 1:
        nodes = _parents(levels[-1].filter("n > 1"))
        tops.append(nodes.filter("n = 1").select("key", "digest"))
        most = -(-most // FANOUT)
        if most > 1:
            levels.append(stored(_runs(nodes.filter("n > 1")).drop("slots"), "level"))
    found = tops[0]
    for t in tops[1:]:
        found = found.union(t)
    return levels, found


def _descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest level's runs with ``steps``: the runs above a run's hash, each with the slot on the way.

    ``above`` has key, steps (above the key's top) and further columns, which are handed down.
    """
    handed = [c for c in above.columns if c != "key"]
    done: DataFrame | None = None
    for k in reversed(range(len(levels))):
        level = levels[k]
        found = level.filter(F.col("n") <= FANOUT).join(above, "key")
        if done is not None:
            upper = done.select("key", F.col("at").alias("up"), F.col("run").alias("up_run"), *handed)
            step = F.array(F.struct(F.col("up_run").alias("run"), F.col("at").bitwiseAND(F.lit(FANOUT - 1)).cast("int").alias("slot")))
            lower = level.filter(F.col("n") > FANOUT).withColumn("up", F.shiftright("at", FANOUT_BITS)).join(upper, ["key", "up"])
            found = found.unionByName(lower.withColumn("steps", F.concat(step, "steps")).drop("up", "up_run"))
        done = found
    return done


def _with_own_step(rows: DataFrame) -> DataFrame:
    """Runs to nodes: one row for each slot, its own run put before the steps (a lone node has none)."""
    rows = rows.withColumn("own", F.explode("slots"))
    step = F.array(F.struct("run", F.col("own.slot").alias("slot")))
    return rows.withColumn("steps", F.when(F.col("n") > 1, F.concat(step, "steps")).otherwise(F.col("steps")))


def fold(start: Column, steps: Column) -> Column:
    """The root that ``start`` leads to with the other members of each run on its way."""

    def up(at: Column, step: Column) -> Column:
        return digest(F.transform(step["run"], lambda x, i: F.when(i == step["slot"], at).otherwise(x)))

    return F.aggregate(steps, start, up)


def siblings(steps: Column) -> Column:
    """All digests of a proof in one array, level by level, left to right."""
    return F.flatten(F.transform(steps, lambda s: F.filter(s["run"], lambda x, i: i != s["slot"])))


def manifest(leaves: DataFrame) -> DataFrame:
    """(key, doc_id, leaf, claim, c, steps, subroot, root) for ``leaves`` (see ``leaves_of``).

    ``steps`` is the proof: for each level the run of digests and the slot on the way to the root.
    """
    leaves = stored(leaves, "leaves")
    placed = coordinates(leaves).withColumnRenamed("leaf", "digest").withColumnRenamed("total", "n")
    lowest = stored(_runs(placed, "doc_id", "claim", "c"), "runs")
    forget(leaves)
    levels, tops = _climb(lowest, lowest.agg(F.max("n")).first()[0] or 0)
    tops = stored(tops, "subroots")
    # the languages' own tree: as many rows as languages
    count = tops.count()
    order = Window.orderBy("key")
    nodes = tops.select(F.lit("").alias("key"), (F.row_number().over(order) - 1).cast("long").alias("c"), F.lit(count).cast("long").alias("n"), "digest", F.col("key").alias("lang_key"))
    languages = stored(_runs(nodes, "lang_key"), "languages")
    upper, roots = _climb(languages, count)
    no_steps = F.array().cast("array<struct<run:array<string>,slot:int>>")
    above = _with_own_step(_descend(upper, roots.select("key", F.col("digest").alias("root"), no_steps.alias("steps"))))
    above = stored(above.select(F.col("own.lang_key").alias("key"), F.col("own.digest").alias("subroot"), "root", "steps"), "roots")
    found = _with_own_step(_descend(levels, above))
    return found.select("key", F.col("own.doc_id").alias("doc_id"), F.col("own.digest").alias("leaf"), F.col("own.claim").alias("claim"), F.col("own.c").alias("c"), "steps", "subroot", "root")


def verified(proofs: DataFrame) -> DataFrame:
    """``proofs`` with ``folded_root``, what the claim (else the leaf) leads to, and ``verified``."""
    folded = proofs.withColumn("folded_root", fold(F.coalesce("claim", "leaf"), F.col("steps")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    Claimed are the leaves themselves, but for rows whose doc_id's checksum 3 divides: there the
    leaf of the text in lower case.
    """
    tampered = {f: F.col(f) for f in FIELDS} | {"text": lower_ascii(F.col("text"))}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = verified(manifest(leaves_of(docs, F.when(chosen, leaf_digest(**tampered)))))
    return found.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("steps"))).alias("proof_sha256"), "folded_root", "verified")


#: The same rows by sorting and by one recursive step a level.
SQL = """
WITH RECURSIVE crc_input AS (
    SELECT DISTINCT doc_id, encode(CAST(doc_id AS VARCHAR)) AS b FROM documents WHERE doc_id IS NOT NULL
), crc AS (
    SELECT doc_id, octet_length(b) AS len, b, 0 AS i, 4294967295::BIGINT AS r FROM crc_input
    UNION ALL
    SELECT doc_id, len, b, i + 1,
           list_reduce([xor(r, ascii(decode(b[i + 1:i + 1]))::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
                       lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))
    FROM crc WHERE i < len
), chosen AS (
    SELECT doc_id FROM crc WHERE i = len AND xor(r, 4294967295::BIGINT) % 3 = 0
), rows_ AS (
    SELECT d.doc_id, d.lang, d.text,
           CASE WHEN d.doc_id IS NULL THEN '-' ELSE strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id END
           || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
           || CASE WHEN d.lang IS NULL THEN '-' ELSE strlen(d.lang) || ':' || d.lang END
           || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
           c.doc_id IS NOT NULL AS tampered
    FROM documents d LEFT JOIN chosen c ON d.doc_id = c.doc_id
), leaves AS (
    SELECT doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
           CASE WHEN tampered THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' ||
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) END AS claim
    FROM rows_
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS c,
           count(*) OVER (PARTITION BY lang) AS total
    FROM leaves
), tree AS (
    SELECT 0 AS level, lang, c, total AS n, leaf AS digest FROM placed
    UNION ALL
    SELECT level + 1, lang, c // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY c))
    FROM tree WHERE n > 1 GROUP BY level, lang, c // 8, n
), subroots AS (
    SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS c, count(*) OVER () AS n
    FROM tree WHERE n = 1
), top AS (
    SELECT 0 AS level, c, n, subroot AS digest FROM subroots
    UNION ALL
    SELECT level + 1, c // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY c))
    FROM top WHERE n > 1 GROUP BY level, c // 8, n
), runs AS (
    SELECT level, lang, c // 8 AS up, list(digest ORDER BY c) AS run FROM tree WHERE n > 1 GROUP BY level, lang, c // 8
), top_runs AS (
    SELECT level, c // 8 AS up, list(digest ORDER BY c) AS run FROM top WHERE n > 1 GROUP BY level, c // 8
), walk AS (
    SELECT p.lang, p.c AS own, p.doc_id, p.leaf, s.subroot, s.c AS lang_c, 0 AS level, p.c AS pos, '' AS proof,
           coalesce(p.claim, p.leaf) AS folded
    FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
    UNION ALL
    SELECT w.lang, own, doc_id, leaf, subroot, lang_c, w.level + 1, pos // 8,
           proof || array_to_string(run[:pos % 8], '') || array_to_string(run[pos % 8 + 2:], ''),
           sha256(array_to_string(run[:pos % 8], '') || folded || array_to_string(run[pos % 8 + 2:], ''))
    FROM walk w JOIN runs r ON r.level = w.level AND r.lang IS NOT DISTINCT FROM w.lang AND r.up = w.pos // 8
), in_lang AS (
    SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY lang, own ORDER BY level DESC) = 1
), to_root AS (
    SELECT lang, own, doc_id, leaf, subroot, 0 AS level, lang_c AS pos, proof, folded FROM in_lang
    UNION ALL
    SELECT lang, own, doc_id, leaf, subroot, t.level + 1, pos // 8,
           proof || array_to_string(run[:pos % 8], '') || array_to_string(run[pos % 8 + 2:], ''),
           sha256(array_to_string(run[:pos % 8], '') || folded || array_to_string(run[pos % 8 + 2:], ''))
    FROM to_root t JOIN top_runs r ON r.level = t.level AND r.up = t.pos // 8
), done AS (
    SELECT * FROM to_root QUALIFY row_number() OVER (PARTITION BY lang, own ORDER BY level DESC) = 1
)
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = digest AS verified
FROM done, (SELECT digest FROM top WHERE n = 1) AS root
"""
