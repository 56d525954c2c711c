"""Removal of repeated byte strings by a Burrows-Wheeler transform (operator 3).

Each byte covered by a string of ``width`` bytes that starts anywhere else too is removed.

Dealing out: every window of ``width`` bytes belongs to its least gram (by hash, the leftmost).
Windows of one gram that follow each other are one stretch of text, so a window is in one stretch
only, and equal windows are in stretches with the same gram. Stretches that are wholly equal are
counted; one copy of each different stretch of a gram that has several goes to the transform.
Grams with very many different stretches would be too much for one transform: the windows of these
stretches are counted by a hash of 128 bits, and those that are there more than once are repeated.

Threshold-bounded interval expansion: over a batch of stretches, suffixes are sorted, and starting
from the empty string, intervals of the transform are extended backwards, breadth first. Extending an
interval of strings of length l by a character gives a bound between suffixes whose common prefix is
l long, if that bound has no value yet. Values come in increasing order, and the expansion stops at
``width``: suffixes without a bound between them by then share ``width`` bytes.

Defined results: null texts are empty; texts shorter than ``width`` lose nothing; repeated rows are
documents of their own, so they lose all bytes if they are long enough; rows without a doc_id are
treated like others; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.bpe import ragged
from ledgerframe.llm.common import forget, stored, workers_import

WIDTH = 200
#: Bytes of a gram: 32 + 16.
GRAM = 48
#: The windows of a gram with more different stretches are counted one by one.
HOT = 2_000
#: Bytes of text that one transform is made for, about.
BATCH = 1 << 20
#: Texts are looked at in pieces of so many windows.
PIECE = 1 << 22
_SEED = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * _SEED
    factor, by = 0x100000001B3, {}
    for step in (1, 2, 4, 8, 16):
        by[step] = h
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor % (1 << 64)
    out = h[: len(raw) - GRAM + 1] * np.uint64(factor) + by[16][32 : 32 + len(raw) - GRAM + 1]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def least_grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window, the place of its least gram; the leftmost of equal ones."""
    span = width - GRAM + 1
    place = np.arange(len(hashes), dtype=np.uint64)
    low = (hashes >> np.uint64(24) << np.uint64(24)) | place
    size = 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    return (low & np.uint64((1 << 24) - 1)).astype(np.int64)


def stretches(raw: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and gram hash of each stretch."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for begin in range(0, max(0, len(raw) - width + 1), PIECE):
        part = raw[begin : begin + PIECE + width - 1]
        hashes = gram_hashes(part)
        least = least_grams(hashes, width)
        cuts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        ends = np.r_[cuts[1:], len(least)]
        out.append((cuts + begin, ends - cuts + width - 1, hashes[least[cuts]].view(np.int64)))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def window_hashes(raw: bytes, width: int) -> np.ndarray:
    """Two halves of a hash of each window, a row each."""
    digests = b"".join(xxhash.xxh3_128_digest(raw[a : a + width]) for a in range(len(raw) - width + 1))
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in order of their first ``depth`` symbols at least, by doubling.

    The first keys hold as many symbols as fit into 63 bits, so the first rounds need no sort.
    """
    n, done = len(symbols), 1
    key = symbols.astype(np.int64) + 1
    bits = int(key.max()).bit_length()
    while 2 * done * bits <= 63:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - done)] = key[done:]
        key = key << (bits * done) | behind
        done *= 2
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        if done >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - done] += rank[done:] + 1
        done *= 2


def common_at_least(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the joined texts (each followed by an end of its own): does a suffix elsewhere share
    ``width`` bytes with the one that starts here? And the places at which the texts start."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    n = int((lengths + 1).sum())
    symbols = np.empty(n, np.int64)
    ends = starts + lengths
    inside = np.ones(n, bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + len(texts)
    symbols[ends] = np.arange(len(texts))
    order = suffix_order(symbols, width + 1)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    transform = symbols[order - 1]  # the symbol before each suffix
    back = place[order - 1]  # where the suffix that begins with it stands
    bounded = np.zeros(n + 1, bool)
    bounded[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    alphabet = len(texts) + 256
    for _ in range(width):
        if not len(low):
            break
        size = high - low
        row = ragged(np.arange(n), low, size)
        key = np.repeat(np.arange(len(low)), size) * alphabet + transform[row]
        by = np.argsort(key)  # rows of one interval and symbol together
        key, to = key[by], back[row[by]]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        new_low, new_high = np.minimum.reduceat(to, first), np.maximum.reduceat(to, first) + 1
        fresh = ~bounded[new_high]
        new_low, new_high = new_low[fresh], new_high[fresh]
        bounded[new_high] = True
        low, high = new_low, new_high
    shared = ~bounded
    out = np.zeros(n, bool)
    out[order] = shared[:-1] | shared[1:]
    return out, starts


def covered(flags: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Runs of bytes covered by the windows that start where ``flags`` is set."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    first = np.r_[True, at[1:] > at[:-1] + width]
    last = np.r_[first[1:], True]
    return list(zip(at[first].tolist(), (at[last] + width).tolist(), strict=True))


_OCCURRENCES = "rid long, start int, length int, gram long, body long"
_PARTS = "gram long, body long, bucket long, part binary"
_COVERS = "gram long, body long, runs array<struct<start:int,end:int>>, high array<long>, low array<long>"


def removed_runs(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(rid, runs): what goes from each text that loses anything. ``docs`` has rid and text."""
    workers_import(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = (text or "").encode()
                if len(data) < width:
                    continue
                start, length, gram = stretches(np.frombuffer(data, np.uint8), width)
                body = np.array([xxhash.xxh3_64_intdigest(data[a : a + n]) for a, n in zip(start.tolist(), length.tolist(), strict=True)], np.uint64)
                for c, x in zip(columns, (np.full(len(start), rid, np.int64), start.astype(np.int32), length.astype(np.int32), gram, body.view(np.int64)), strict=True):
                    c.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["rid", "start", "length", "gram", "body"])

    seen = stored(docs.select("rid", "text").mapInArrow(cut, _OCCURRENCES), "stretches")
    several = seen.groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1").select("gram")
    multi = stored(seen.join(several, "gram", "left_semi"), "multi")
    forget(seen)
    bodies = stored(multi.groupBy("gram", "body").agg(F.count("*").alias("k"), F.min(F.struct("rid", "start", "length")).alias("one")), "bodies")
    open_ = bodies.groupBy("gram").agg(F.count("*").alias("different")).filter("different > 1")
    wanted = bodies.join(open_, "gram").select("one.*", "gram", "body", (F.col("different") > HOT).alias("hot"))
    total = wanted.agg(F.sum(F.col("length").cast("long"))).first()[0] or 0
    buckets = max(1, total // BATCH)
    by_text = wanted.groupBy("rid").agg(F.collect_list(F.struct("start", "length", "gram", "body", "hot")).alias("wanted"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.int64()), ("body", pa.int64()), ("bucket", pa.int64()), ("part", pa.binary())])
        for batch in batches:
            out = []
            for text, asked in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                data = text.encode()
                for x in asked:
                    # hot stretches lie in buckets of their own, where it doesn't matter which are together
                    bucket = buckets + x["body"] % buckets if x["hot"] else x["gram"] % buckets
                    out.append({"gram": x["gram"], "body": x["body"], "bucket": bucket, "part": data[x["start"] : x["start"] + x["length"]]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    texts = docs.select("rid", "text").join(by_text, "rid").dropDuplicates(["rid"])
    parts = texts.mapInArrow(take, _PARTS)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def expand(table: pa.Table) -> pa.Table:
        raw = table.column("part").to_pylist()
        runs, high, low = ([None] * len(raw) for _ in range(3))
        if table.column("bucket")[0].as_py() >= buckets:
            hashes = [window_hashes(t, width) for t in raw]
            high, low = [h[:, 0] for h in hashes], [h[:, 1] for h in hashes]
        else:
            flags, starts = common_at_least(raw, width)
            runs = [[{"start": a, "end": b} for a, b in covered(flags[s : s + len(t) - width + 1], width)] for s, t in zip(starts.tolist(), raw, strict=True)]
        longs = pa.list_(pa.int64())
        return pa.table({"gram": table.column("gram"), "body": table.column("body"), "runs": pa.array(runs, kind), "high": pa.array(high, longs), "low": pa.array(low, longs)})

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [[{"start": a, "end": b} for a, b in covered(np.bincount(at) > 0, width)] for at in batch.column("at").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("gram"), batch.column("body"), pa.array(runs, kind)], names=["gram", "body", "runs"])

    expanded = stored(parts.groupBy("bucket").applyInArrow(expand, _COVERS).filter("size(runs) > 0 OR high IS NOT NULL"), "expanded")
    windows = expanded.filter("high IS NOT NULL").select("gram", "body", F.posexplode(F.arrays_zip("high", "low"))).select("gram", "body", F.col("pos").alias("at"), "col.high", "col.low")
    # equal windows have the same gram, so these are all of them; counts are combined before they are shuffled
    again = stored(windows.groupBy("high", "low").agg(F.count("*").alias("k")).filter("k > 1").select("high", "low"), "again")
    counted = windows.join(again, ["high", "low"], "left_semi").groupBy("gram", "body").agg(F.collect_list("at").alias("at")).mapInArrow(join_up, "gram long, body long, runs array<struct<start:int,end:int>>")
    covers = expanded.filter("runs IS NOT NULL").select("gram", "body", "runs").union(counted).select("gram", "body", F.explode("runs").alias("r"))
    covers = stored(covers.select("gram", "body", F.col("r.start").alias("from"), F.col("r.end").alias("to")), "covers")
    whole = multi.join(bodies.filter("k > 1").select("gram", "body"), ["gram", "body"], "left_semi").select("rid", F.col("start").alias("from"), (F.col("start") + F.col("length")).alias("to"))
    partly = multi.join(covers, ["gram", "body"]).select("rid", (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to"))
    runs = whole.union(partly).groupBy("rid").agg(F.sort_array(F.collect_set(F.struct(F.col("from").alias("start"), F.col("to").alias("end")))).alias("runs"))
    return runs


def merged(runs: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of sorted ones."""
    out: list[tuple[int, int]] = []
    for r in runs:
        if out and r["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r["end"]))
        else:
            out.append((r["start"], r["end"]))
    return out


def deduplicate(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, runs, kept): the removed runs of each text, and the bytes that are left."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    runs = removed_runs(base, width)
    joined = base.join(runs, "rid", "left").select("doc_id", "text", "runs")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            kept, gone = [], []
            for t, r in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                data, runs_ = t.encode(), merged(r or [])
                cuts = [0, *(x for run in runs_ for x in run), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                gone.append([{"start": a, "end": b} for a, b in runs_])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.encode()) for t in batch.column("text").to_pylist()], pa.int64()), pa.array(gone, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "runs", "kept"])

    return joined.mapInArrow(drop, "doc_id long, n_bytes long, runs array<struct<start:int,end:int>>, kept binary")


def op3_suffix_dedup(docs: DataFrame) -> DataFrame:
    out = deduplicate(docs)
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + (r["end"] - r["start"]))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
