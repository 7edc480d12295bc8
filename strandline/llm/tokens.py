"""Encoding of a corpus by a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose ids a task remembers; beyond that it forgets all and starts anew.
REMEMBERED = 400_000
#: Documents encoded at a time.
SLICE = 256


class PerfectHash:
    """A minimal perfect hash of fixed keys by displacement: each bucket has the factor that brings its keys to free slots, a bucket of one key
    the slot itself. The key at the slot is compared, so other keys are told apart for certain."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.seed = -1
        while True:
            self.seed += 1
            if self._place(keys):
                break
        slots = self.slots(keys)
        self.keys: list[bytes] = [b""] * n
        self.index = np.zeros(n, np.int32)
        for i, (s, k) in enumerate(zip(slots.tolist(), keys)):
            self.keys[s] = k
            self.index[s] = i

    def _halves(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seed, digest = self.seed, xxhash.xxh3_64_intdigest
        h = np.fromiter((digest(k, seed) for k in keys), np.uint64, len(keys))
        return (h % np.uint64(self.buckets)).astype(np.int64), ((h >> np.uint64(8)) % np.uint64(self.n)).astype(np.int64), ((h >> np.uint64(36)) % np.uint64(self.n)).astype(np.int64)

    def _place(self, keys: list[bytes]) -> bool:
        n = self.n
        self.buckets = max(1, n // 3)
        self.shift = np.zeros(self.buckets, np.int64)
        bucket, start, step = self._halves(keys)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(n, bool)
        sizes = np.diff(bounds)
        for b in np.argsort(-sizes, kind="stable").tolist():
            size = int(sizes[b])
            if size == 0:
                break
            if size == 1:
                continue
            members = order[bounds[b] : bounds[b + 1]]
            for first in range(0, n, 1024):
                tried = np.arange(first, min(first + 1024, n))
                at = (start[members][:, None] + tried * step[members][:, None]) % n
                hits = np.flatnonzero(free[at].all(axis=0))
                d = next((int(h) for h in hits if len(set(at[:, h].tolist())) == size), None)
                if d is not None:
                    free[at[:, d]] = False
                    self.shift[b] = first + d
                    break
            else:
                return False
        left = iter(np.flatnonzero(free).tolist())
        for b in np.flatnonzero(sizes == 1).tolist():
            self.shift[b] = -1 - next(left)
        return True

    def slots(self, keys: list[bytes]) -> np.ndarray:
        bucket, start, step = self._halves(keys)
        d = self.shift[bucket]
        return np.where(d < 0, -1 - d, (start + d * step) % self.n)

    def find(self, keys: list[bytes]) -> list[int]:
        """The index of each key, -1 for one that isn't there."""
        slots = self.slots(keys)
        known = self.keys
        return [i if known[s] == k else -1 for k, s, i in zip(keys, slots.tolist(), self.index[slots].tolist())]


class Encoder:
    """pattern cuts a text into pre-tokens. Two tiers turn those into ids: the perfect hash for whole tokens, merging for all others."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.hash = PerfectHash(list(ranks))
        self.ids = list(ranks.values())
        self.memo: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Encoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Merges neighbouring parts by rank, the leftmost of equal ones first: parts are linked by their ends, pairs wait in a heap, and one
        whose parts have changed since is skipped."""
        ranks, n = self.ranks, len(piece)
        after = list(range(1, n + 1))  # of a part, by its start: the start of the next one
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            middle = after[i]
            if middle < 0 or middle >= n or after[middle] != end:
                continue
            after[i], after[middle] = end, -1
            before[end] = i
            if end < n and (r := ranks.get(piece[i : after[end]])) is not None:
                heappush(heap, (r, i, after[end]))
            if i and (r := ranks.get(piece[before[i] : end])) is not None:
                heappush(heap, (r, before[i], end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and flat ids."""
        cut = regex.compile(self.pattern).findall
        pieces = [cut(t) if t else [] for t in texts]
        memo, ids = self.memo, self.ids
        if len(memo) > REMEMBERED:
            memo.clear()
        new = [p for p in dict.fromkeys(chain.from_iterable(pieces)) if p not in memo]
        raw = [p.encode() for p in new]
        for p, b, i in zip(new, raw, self.hash.find(raw) if raw else []):
            memo[p] = (ids[i],) if i >= 0 else self.merged(b)
        rows = [np.fromiter(chain.from_iterable(map(memo.__getitem__, ps)), np.int32) for ps in pieces]
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) for r in rows], out=offsets[1:])
        return offsets, np.concatenate(rows) if rows else np.zeros(0, np.int32)


def encode(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """Rows (key, ids): the ids of each whole text, without special tokens. A null and an empty text give an empty list; a null key stays.

    path: the vocabulary (base64 token, rank), a file of fixed size that the driver reads once and broadcasts. Further columns are not read;
    repeated rows are encoded each.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(Encoder.from_file(path, pattern))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                offsets, flat = encoder.encode(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["key", "ids"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(encoded, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
