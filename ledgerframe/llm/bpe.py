"""Byte-pair encoding and decoding with a pair occurrence index (operator 10).

A batch of texts is cut into pre-tokens; the distinct new ones of the batch are laid out as one
long list of symbols. An index maps each mergeable pair, by its rank, to all its positions in that
list. Ranks are taken in ascending order; all positions of the pair merge at once and only the
lists of the pairs next to a merge get new positions. A merge of rank r only makes pairs of ranks
above r (its product doesn't exist before), so one ascending pass gives what merging each
pre-token by itself gives.

Defined results: null and empty texts have no ids; repeated rows are encoded like any other row;
extra columns stay. Texts of any length are encoded whole; what a task remembers of earlier
pre-tokens is bounded by ``CACHE_BYTES``. Special tokens written in a text become their ids, as in
the tokenizers library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.llm.common import workers_import

#: Fixed value: how byte-level vocabularies cut texts (the public GPT-2 pattern).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_BYTES = 64 << 20
BATCH_CHARS = 8 << 20
LONG_PIECE = 1 << 10


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[0] : +lengths[0]], values[starts[1] : +lengths[1]], ... one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.arange(total) - np.repeat(ends - lengths - starts, lengths)]


class PairIndexBpe:
    """Encoder and decoder of one byte-level vocabulary, given as a tokenizers JSON text."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model, alphabet = data["model"], byte_alphabet()
        self.specials = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        vocab = model["vocab"]
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        raw = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items() if i not in set(self.specials.values())}
        raw |= {i: s.encode() for s, i in self.specials.items()}
        lengths = np.zeros(self.size, np.int64)
        for i, b in raw.items():
            lengths[i] = len(b)
        self.token_len, self.token_start = lengths, np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(raw.get(i, b"") for i in range(self.size)), np.uint8)
        self.of_byte = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * (self.size + 1) + right
        order = np.argsort(keys)
        self.keys, self.rank_of_key = keys[order], order
        self.split = regex.compile(SPLIT)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.cache: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all pre-tokens; the cache holds the number of each and their ids one after another."""
        self.cache = {s: i for i, s in enumerate(self.specials)}
        self.ids = np.array(list(self.specials.values()), np.int64)
        self.id_len = np.ones(len(self.specials), np.int64)
        self.cached_bytes = 0

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it never merges."""
        if not len(self.keys):
            return np.full(len(a), -1)
        key = a * (self.size + 1) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        text = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.array([len(p) for p in pieces], np.int64)
        n, stop = len(text) + len(pieces), self.size  # a symbol that no pair has ends each piece
        ends = np.cumsum(lengths + 1) - 1
        inside = np.ones(n, bool)
        inside[ends] = False
        sym = np.full(n + 1, stop, np.int64)
        sym[:n][inside] = self.of_byte[text]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        before[0] = n

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(rank: np.ndarray, at: np.ndarray) -> None:
            known = rank >= 0
            rank, at = rank[known], at[known]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        add(self.ranks(sym[: n - 1], sym[1:n]), np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b, new = self.left[r], self.right[r], self.product[r]
            at = at[(sym[at] == a) & (sym[after[at]] == b)]
            if a == b and len(at) > 1:  # in a run like "aaaa" every second position merges, from the left
                at = np.unique(at)
                chained = np.r_[False, after[at[:-1]] == at[1:]]
                first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            elif len(lists) > 1 and len(at) > 1:
                at = np.unique(at)
            if not len(at):
                continue
            gone = after[at]
            then = after[gone]
            sym[at], sym[gone] = new, -1
            after[at], before[then] = then, at
            prior = before[at]
            add(np.r_[self.ranks(sym[prior], sym[at]), self.ranks(sym[at], sym[then])], np.r_[prior, at])
        sym = sym[:n]
        left = sym >= 0
        count = np.diff(np.r_[0, np.cumsum(left)[ends]]) - 1
        return sym[left & (sym != stop)], count

    def learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        ids, count = self.merge(raw)
        self.cache.update(zip(pieces, range(len(self.id_len), len(self.id_len) + len(pieces)), strict=True))
        self.ids, self.id_len = np.concatenate([self.ids, ids]), np.concatenate([self.id_len, count])
        self.cached_bytes += sum(map(len, raw)) + 100 * len(raw)

    def pieces(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.specials):
            return self.split.findall(text)
        parts = self.special.split(text)
        return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self.split.findall(part))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        if self.cached_bytes > CACHE_BYTES:
            self.clear()
        cut = [self.pieces(t) for t in texts]
        new = set().union(*cut) - self.cache.keys()
        once = [p for p in new if len(p) > LONG_PIECE]
        self.learn([p for p in new if len(p) <= LONG_PIECE])
        for p in once:
            self.learn([p])
        numbers = np.fromiter((self.cache[p] for c in cut for p in c), np.int64, sum(map(len, cut)))
        starts, lengths = np.cumsum(self.id_len) - self.id_len, self.id_len[numbers]
        ids = ragged(self.ids, starts[numbers], lengths)
        pieces_upto = np.r_[0, np.cumsum([len(c) for c in cut])]
        ids_upto = np.r_[0, np.cumsum(lengths)]
        return ids, np.diff(ids_upto[pieces_upto.astype(np.int64)])

    def decode(self, ids: np.ndarray) -> str:
        """What the ids spell; bytes that aren't UTF-8 become the replacement character."""
        raw = ragged(self.token_bytes, self.token_start[ids], self.token_len[ids])
        return raw.tobytes().decode("utf-8", "replace")


_MADE: dict[int, PairIndexBpe] = {}


def codec_of(shared) -> PairIndexBpe:
    """One codec a worker, from the vocabulary that the driver broadcast."""
    key = hash(shared.value)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = PairIndexBpe(shared.value)
    return _MADE[key]


def shared_spec(df: DataFrame, path: str):
    """The vocabulary file has a fixed size (50,257 entries here): small enough to broadcast."""
    workers_import(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """Texts in blocks of bounded size; a longer text is a block of its own."""
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > BATCH_CHARS:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def _added(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in columns}
    return pa.RecordBatch.from_arrays([*kept.values(), *columns.values()], names=[*kept, *columns])


def _with(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    new = {n for n, _ in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in new] + [T.StructField(n, t) for n, t in fields])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the array column ``ids`` (and without an older column of that name)."""
    shared = shared_spec(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in batches:
            done = [codec.encode(b) for b in blocks([t or "" for t in batch.column(text).to_pylist()])]
            flat = np.concatenate([x for x, _ in done] or [np.zeros(0, np.int64)]).astype(np.int32)
            upto = np.r_[0, np.cumsum(np.concatenate([n for _, n in done] or [np.zeros(0, np.int64)]))].astype(np.int32)
            yield _added(batch, {ids: pa.ListArray.from_arrays(pa.array(upto), pa.array(flat))})

    return df.mapInArrow(run, _with(df, [(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the string column ``text`` that its ids spell (null ids: empty)."""
    shared = shared_spec(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in batches:
            rows = (codec.decode(np.array(x or [], np.int64)) for x in batch.column(ids).to_pylist())
            yield _added(batch, {text: pa.array(rows, pa.string())})

    return df.mapInArrow(run, _with(df, [(text, T.StringType())]))


def round_trip(df: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: n_tokens, ids_sha256 and decoded_sha256 instead of ``text``.

    ``with_ids`` adds the ids themselves. One codec in one worker a core serves both ways. ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the
    decoded text in UTF-8, both lowercase hex.
    """
    shared = shared_spec(df, path)
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    all_fields = fields + [("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in batches:
            out: list[tuple[int, str, str]] = []
            flats: list[np.ndarray] = []
            for block in blocks([t or "" for t in batch.column(text).to_pylist()]):
                flat, count = codec.encode(block)
                flats.append(flat)
                for ids in np.split(flat, np.cumsum(count)[:-1]):
                    back = codec.decode(ids).encode()
                    out.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()))
            kept = batch.drop_columns([text]) if text in batch.schema.names else batch
            columns = zip(*out, strict=True) if out else ([], [], [])
            made = {n: pa.array(c, pa.int64() if n == "n_tokens" else pa.string()) for (n, _), c in zip(fields, columns, strict=True)}
            if with_ids:
                upto = np.r_[0, np.cumsum([n for n, _, _ in out])].astype(np.int32)
                made["ids"] = pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate([*flats, np.zeros(0, np.int64)]).astype(np.int32)))
            yield _added(kept, made)

    schema = _with(df.drop(text), all_fields)
    return df.mapInArrow(run, schema)


def op10_bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    return round_trip(docs.select("doc_id", F.col("text")), path)
