"""Token counts by a linear longest-match automaton (operator 8).

The vocabulary is a trie with failure links. Where a word can't go on from a trie state, the link
leads to the state that is left once the longest pieces are popped; how many are popped on the way
is computed beforehand. So one pass over the bytes of a word counts its greedy longest-match pieces,
and no piece is ever built. Words are what white space separates, each with a leading space.

Defined results: null and empty texts have 0 words and 0 tokens; words of any length are walked
whole; bytes that the vocabulary lacks count as one token each; repeated rows are counted each.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerframe.llm.bpe import byte_alphabet
from ledgerframe.llm.common import workers_import

#: Words remembered by a task; beyond that it forgets all and starts anew.
CACHE_WORDS = 1 << 19
#: Words up to so many bytes are walked side by side.
SHORT = 64


class LongestMatch:
    """Counts greedy longest-match pieces for a set of byte strings."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        pieces = {p for p in vocabulary if p} | {bytes([b]) for b in range(256)}
        go: list[dict[int, int]] = [{}]
        final = [False]
        for p in pieces:
            at = 0
            for c in p:
                if c not in go[at]:
                    go[at][c] = len(go)
                    go.append({})
                    final.append(False)
                at = go[at][c]
            final[at] = True
        link, pops = [0] * len(go), [0] * len(go)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in go[u].items():
                queue.append(v)
                if final[v]:
                    pops[v] = 1  # the whole string is a piece: pop it, start anew
                    continue
                z, n = link[u], pops[u]
                while c not in go[z]:  # ends at the root, which has every byte
                    n, z = n + pops[z], link[z]
                link[v], pops[v] = go[z][c], n
        self.go, self.link, self.pops = go, link, pops
        keys = np.array([u << 8 | c for u, out in enumerate(go) for c in out], np.int64)
        to = np.array([v for out in go for v in out.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.link_of, self.pops_of = np.array(link, np.int64), np.array(pops, np.int64)

    def count_one(self, word: bytes) -> int:
        go, link, pops, at, n = self.go, self.link, self.pops, 0, 0
        for c in word:
            while c not in go[at]:
                n, at = n + pops[at], link[at]
            at = go[at][c]
        while at:
            n, at = n + pops[at], link[at]
        return n

    def _step(self, at: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        out, todo = np.empty_like(at), np.arange(len(at))
        while len(todo):
            key = at[todo] << 8 | c[todo]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[place] == key
            out[todo[found]] = self.to[place[found]]
            todo = todo[~found]
            n[todo] += self.pops_of[at[todo]]
            at[todo] = self.link_of[at[todo]]
        return out

    def count(self, words: list[bytes]) -> list[int]:
        """Pieces of each word; short words go side by side, byte by byte."""
        total = np.zeros(len(words), np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        short = np.flatnonzero(lengths <= SHORT)
        short = short[np.argsort(-lengths[short], kind="stable")]
        if len(short):
            raw = np.frombuffer(b"".join(words[i].ljust(SHORT, b"\0") for i in short.tolist()), np.uint8).reshape(-1, SHORT).astype(np.int64)
            size, at, n = lengths[short], np.zeros(len(short), np.int64), np.zeros(len(short), np.int64)
            for k in range(int(size[0])):
                live = int(np.searchsorted(-size, -k, side="left"))  # sorted by length: the first are longer than k
                part = n[:live]
                at[:live] = self._step(at[:live].copy(), raw[:live, k], part)
            while (at > 0).any():
                n += self.pops_of[at]
                at = self.link_of[at]
            total[short] = n
        for i in np.flatnonzero(lengths > SHORT).tolist():
            total[i] = self.count_one(words[i])
        return total.tolist()


def vocabulary_of(spec: str) -> list[bytes]:
    """The pieces of a byte-level tokenizers JSON text."""
    alphabet = byte_alphabet()
    return [bytes(alphabet[c] for c in s) for s in json.loads(spec)["model"]["vocab"] if all(c in alphabet for c in s)]


_MADE: dict[int, LongestMatch] = {}


def count_tokens(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with n_words and n_tokens (older columns of these names are replaced)."""
    workers_import(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary has a fixed size
    names = ["n_words", "n_tokens"]
    kept = [c for c in df.columns if c not in (text, *names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = LongestMatch(vocabulary_of(shared.value))
        automaton, known = _MADE[key], {}
        for batch in batches:
            words = [(t or "").encode().split() for t in batch.column(text).to_pylist()]  # bytes split at ASCII white space
            if len(known) > CACHE_WORDS:
                known.clear()
            new = list(set().union(*words) - known.keys())
            known.update(zip(new, automaton.count([b" " + w for w in new]), strict=True))
            columns = [pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(known.__getitem__, w)) for w in words], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], names=[*kept, *names])

    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, T.LongType()) for n in names])
    return df.select(*kept, text).mapInArrow(run, schema)
