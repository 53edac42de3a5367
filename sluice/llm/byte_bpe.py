"""Operator 3: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of a pre-token are a doubly linked list. The queue has a bucket for each merge rank, which
holds list positions, and a tree of bitmaps over the ranks with buckets that aren't empty:
find-first-set from the root gives the lowest rank in a fixed number of steps, whatever the
pre-token's length. An entry is stale once the pair at its position has another rank; it is skipped.
Equal ranks leave by position, so the leftmost pair merges first. A pre-token of n bytes takes
O(n log n) in the worst case, where a rescan for each merge takes O(n^2).

Null text: empty; empty text: no ids, and no bytes when decoded. Lone surrogates can't occur in a
Spark string. Repeated rows are encoded one by one.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import claim, map_texts

#: Bits of a bitmap node; entries of the cache of pre-tokens before it is emptied; bytes of a cached pre-token at most.
NODE_BITS, CACHE, CACHED_BYTES = 8, 1_000_000, 64
NODE_MASK = (1 << NODE_BITS) - 1

_codecs: dict[tuple[str, str], ByteBPE] = {}


class RankQueue:
    """Positions by rank; ``pop`` gives the lowest rank and its leftmost position."""

    __slots__ = ("buckets", "leaves", "root")

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.leaves = [0] * ((ranks >> NODE_BITS) + 1)  # a bit for each rank that has a bucket
        self.root = 0  # a bit for each leaf that isn't empty

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        leaf = rank >> NODE_BITS
        self.leaves[leaf] |= 1 << (rank & NODE_MASK)
        self.root |= 1 << leaf

    def pop(self) -> tuple[int, int]:
        """Needs an entry: check ``root`` first."""
        root, leaves = self.root, self.leaves
        leaf = (root & -root).bit_length() - 1
        x = leaves[leaf]
        low = x & -x
        rank = (leaf << NODE_BITS) + low.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        leaves[leaf] = x = x ^ low
        if not x:
            self.root = root & (root - 1)
        return rank, bucket[0]


class ByteBPE:
    """Encoder and decoder of a rank file; ``pattern`` splits a text into pre-tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.pairs: dict[int, int] = {}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(pattern)
        self.queue = RankQueue(max(self.bytes_of) + 1)
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.single[b] for b in piece]
        n, queue, rank_of, found = len(ids), self.queue, self.rank_of, self.pairs.get
        push, pop = queue.push, queue.pop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        at = []  # the rank of the pair that begins at a position now, -1: none
        for i in range(n - 1):
            rank = found(ids[i] << 20 | ids[i + 1])
            if rank is None:
                rank = rank_of(ids[i], ids[i + 1])
            at.append(rank)
            if rank >= 0:
                push(rank, i)
        at.append(-1)
        while queue.root:
            rank, i = pop()
            if at[i] != rank:  # stale
                continue
            j = after[i]
            ids[i], ids[j], at[j] = rank, -1, -1
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                new = found(rank << 20 | ids[k])
                if new is None:
                    new = rank_of(rank, ids[k])
                at[i] = new
                if new >= 0:
                    push(new, i)
            else:
                at[i] = -1
            if h >= 0:
                new = found(ids[h] << 20 | rank)
                if new is None:
                    new = rank_of(ids[h], rank)
                at[h] = new
                if new >= 0:
                    push(new, h)
        return [x for x in ids if x >= 0]

    def rank_of(self, left: int, right: int) -> int:
        """The rank of two neighbouring tokens' pair, -1: none; kept by their ids."""
        rank = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
        if len(self.pairs) >= CACHE:
            self.pairs.clear()
        self.pairs[left << 20 | right] = rank
        return rank

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words, known = self.split.findall(text), self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) >= CACHE:
            known.clear()
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = np.array(self.merge(w.encode()), dtype="<u4").tobytes()
                if len(w) <= CACHED_BYTES:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> ByteBPE:
    """The codec of a rank file; one for each worker process, with its caches."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBPE(path, pattern)
    claim("byte_bpe", _codecs.clear)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers, binary) and the bytes they decode to. No shuffle."""

    def make():
        bpe = codec(path, pattern)

        def run(texts: list[str]) -> list:
            ids = [bpe.encode(t) for t in texts]
            return [ids, [bpe.decode(x) for x in ids]]

        return run

    return map_texts(docs, make, [("ids", T.BinaryType()), ("decoded", T.BinaryType())])


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the same, made where the ids are."""

    def make():
        bpe = codec(path, pattern)

        def run(texts: list[str]) -> list:
            ids = [bpe.encode(t) for t in texts]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            return [[len(x) // 4 for x in ids], [sha(x) for x in ids], [sha(bpe.decode(x)) for x in ids]]

        return run

    return map_texts(docs, make, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())])
