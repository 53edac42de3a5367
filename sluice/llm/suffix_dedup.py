"""Operator 9: removal of repeated byte strings by a distributed difference-cover algorithm.

Only the order of suffixes up to their first ``length`` bytes matters here, so the difference cover has a
large period v and one level of names is enough:

1. Sampled suffixes: those at places whose remainder modulo v is in a difference cover. If two strings of
   ``length`` bytes are equal, some shift below v brings both starts to sampled places, and the
   length - v + 1 bytes from there are equal. Windows of that size are named by hash and sorted in buckets;
   equal neighbours are repeated. This leaves the starts that can be repeated at all.
2. Remaining suffixes: the starts up to v - 1 before a repeated sampled place are named by 80 bits and the bucket (whose bits grow
   with the data; 128 bits inside a block) of their ``length`` bytes and sorted in buckets; equal neighbours are repeated starts, in any document or the same.
3. Each document drops the bytes that repeated starts cover, judged on the input.

Documents are dealt to blocks by id. Within a block equal names are sent once, and of documents
that are copies of each other only the first publishes its starts (a copy of at least ``length`` bytes is repeated as
a whole), so a common passage or a large group of copies sends one entry from each block, not one for each occurrence. A
bucket answers with one bit for each entry in the order that it got them, and a block finds its entries again by the same
deterministic steps; nothing is broadcast or collected. The texts shuffle once a step.

The recursion on names of the classical period-3 algorithm isn't used: at three of eight bytes for a rank and a place
it writes over ten times the text for each level.

Null and empty texts: 0 bytes, nothing removed. Null and repeated ids: each row by itself; equal rows repeat each other.
Empty table: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, text_bytes

# Perfect difference sets, by period.
COVERS = {
    1: (0,),
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (1, 5, 11, 24, 25, 27),
    133: (1, 2, 4, 13, 21, 35, 39, 82, 89, 95, 105, 110),
}
#: Text bytes of a block, about; entry bytes of a bucket, about; bytes hashed at once.
BLOCK, BUCKET, SEGMENT = 3 << 20, 4 << 20, 1 << 20
_RNG = np.random.default_rng(0x5EED)
_TABLES = [_RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15, 0xD1B54A32D192ED03]
_M = np.uint64(0xBF58476D1CE4E5B9)
#: 128 bits of a whole text.
_DIGEST = np.dtype([("a", "<u8"), ("b", "<u8")])


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def window_hash(data: np.ndarray, at: np.ndarray, length: int, which: int) -> np.ndarray:
    """64-bit hash of the ``length`` bytes from each of the ascending places ``at``."""
    size = SEGMENT + length
    if (which, length) not in _POWERS:
        _POWERS[which, length] = _powers(_BASES[which], size), _powers(pow(_BASES[which], -1, 2**64), size)
    up, down = _POWERS[which, length]
    out = np.zeros(len(at), np.uint64)
    for lo in range(0, len(data), SEGMENT):
        i, j = np.searchsorted(at, (lo, lo + SEGMENT))
        if i == j:
            continue
        part = _TABLES[which][data[lo : lo + size]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)], dtype=np.uint64)])
        own = at[i:j] - lo
        out[i:j] = (sums[own + length] - sums[own]) * down[own]
    out = (out ^ (out >> np.uint64(31))) * _M
    return out ^ (out >> np.uint64(29))


class BlockOfDocs:
    """The texts of a block, in a fixed order, and its entries for the buckets."""

    def __init__(self, pdf: pd.DataFrame, length: int, buckets: int):
        texts = [(t or "").encode() for t in pdf["text"]]
        shas = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
        ids = [(0, 0) if pd.isna(i) else (1, int(i)) for i in pdf["doc_id"]]
        order = sorted(range(len(texts)), key=lambda k: (ids[k], shas[k]))
        self.ids, self.texts, self.shas = [ids[k] for k in order], [texts[k] for k in order], [shas[k] for k in order]
        self.length, self.buckets = length, buckets
        self.period = max(v for v in COVERS if 3 * v <= max(3, length) or v == 1)
        self.window = length - self.period + 1
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        self.starts = self.ends - [len(t) for t in self.texts]

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sampled places, then distinct keys (bucket << 32 | rest), which key each place has, and whether a key recurs here."""
        cover = np.array(COVERS[self.period])
        places = []
        for a, b in zip(self.starts, self.ends, strict=True):
            n = b - a - self.window + 1
            if n > 0 and b - a >= self.length:
                p = (np.arange(0, n, self.period)[:, None] + cover).reshape(-1)
                places.append(a + p[p < n])
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        h = window_hash(self.data, at, self.window, 0)
        key = ((h >> np.uint64(32)) % np.uint64(self.buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
        keys, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        return at, keys, inverse, n > 1

    def copies(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For documents of at least ``length`` bytes: distinct digests with their bucket, which one each has (-1: none), recurring, and the first of each."""
        long = np.flatnonzero(self.ends - self.starts >= self.length)
        d = np.frombuffer(b"".join(self.shas[i] for i in long), _DIGEST)
        keys, first, inverse, n = np.unique(d, return_index=True, return_inverse=True, return_counts=True)
        which = np.full(len(self.texts), -1, np.int64)
        which[long] = inverse
        return keys, which, n > 1, long[first]

    def possible(self, repeated: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Starts from which ``length`` bytes may be repeated: near repeated sampled places, not in skipped documents."""
        n = len(self.data)
        edge = np.zeros(n + 1, np.int32)
        doc = np.searchsorted(self.ends, repeated, side="right")
        np.add.at(edge, np.maximum(repeated - self.period + 1, self.starts[doc]), 1)
        np.add.at(edge, repeated + 1, -1)
        ok = np.cumsum(edge[:-1]) > 0
        for i, (a, b) in enumerate(zip(self.starts, self.ends, strict=True)):
            ok[a if skip[i] else max(a, b - self.length + 1) : b] = False
        return np.flatnonzero(ok)

    def named(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names of starts, by bucket: bucket, 64 bits, 16 bits, which name each start has, recurring here."""
        h, g = (window_hash(self.data, at, self.length, k) for k in (0, 1))
        h = h ^ np.uint64(self.length)
        _, first, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        if (g[first][inverse] != g).any():  # 64 bits collide here: the names are the pairs
            _, first, inverse, n = np.unique(np.rec.fromarrays([h, g]), return_index=True, return_inverse=True, return_counts=True)
        h, g = h[first], g[first]
        bucket = ((g >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return bucket[order], h[order], (g[order] & np.uint64(0xFFFF)).astype(np.uint16), back[inverse], (n > 1)[order]


def _cuts(bucket: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(bucket, np.arange(buckets + 1))


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)


def _equal_neighbours(h: np.ndarray, g: np.ndarray | None = None) -> np.ndarray:
    """Which entries have an equal one, from the sorted order."""
    order = np.argsort(h, kind="stable") if g is None else np.lexsort((g, h))
    s = h[order]
    same = s[1:] == s[:-1]
    if g is not None:
        t = g[order]
        same &= t[1:] == t[:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


_ENTRY = "bucket int, block long, names binary, more binary, here binary, docs binary"
_REPLY = "block long, step int, bucket int, bits binary, docs binary"


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``."""
    ws = Workspace(spark, "suffix-dedup")
    _, size = text_bytes(docs)
    blocks, buckets = max(1, -(-size // BLOCK)), max(32, size // (BUCKET * 4))
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("block", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(blocks)))

    def entries_a(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b = BlockOfDocs(pdf, length, buckets)
        _, keys, _, here = b.samples()
        cut, rest = _cuts(keys >> np.uint64(32), buckets), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        d, _, twice, _ = b.copies()
        dealt = (d["a"] % np.uint64(buckets)).astype(np.int64)
        rows = []
        for k in range(buckets):
            own, mine = slice(cut[k], cut[k + 1]), dealt == k
            if cut[k] < cut[k + 1] or mine.any():
                rows.append((k, key[0], rest[own].tobytes(), b"", _bits(here[own]), d[mine].tobytes() + _bits(twice[mine])))
        return pd.DataFrame(rows, columns=["bucket", "block", "names", "more", "here", "docs"])

    def answer_a(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        names = [np.frombuffer(x, np.uint32) for x in pdf["names"]]
        at = np.cumsum([0, *map(len, names)])
        twice = _equal_neighbours(np.concatenate(names))
        digests = [_split_docs(x) for x in pdf["docs"]]
        all_ = np.concatenate([x for x, _ in digests]) if digests else np.zeros(0, _DIGEST)
        again, first = _equal_neighbours(all_["a"], all_["b"]), np.zeros(len(all_), bool)
        first[np.unique(all_, return_index=True)[1]] = True  # blocks are in order
        to = np.cumsum([0, *(len(x) for x, _ in digests)])
        rows = []
        for i, (block, here) in enumerate(zip(pdf["block"], pdf["here"], strict=True)):
            own, mine = slice(at[i], at[i + 1]), slice(to[i], to[i + 1])
            rows.append((block, 0, key[0], _bits(twice[own] | _unbits(here, at[i + 1] - at[i])), _bits(np.concatenate([again[mine] | digests[i][1], first[mine]]))))
        return pd.DataFrame(rows, columns=["block", "step", "bucket", "bits", "docs"])

    def after_a(b: BlockOfDocs, reply: pd.DataFrame):
        """Starts that may be repeated, and of each document whether it is a copy."""
        at, keys, inverse, _ = b.samples()
        got = {r.bucket: r for r in reply[reply["step"] == 0].itertuples()}
        cut = _cuts(keys >> np.uint64(32), buckets)
        d, which, _, first_here = b.copies()
        dealt = (d["a"] % np.uint64(buckets)).astype(np.int64)
        twice, copied, first = np.zeros(len(keys), bool), np.zeros(len(d), bool), np.zeros(len(d), bool)
        for k, r in got.items():
            twice[cut[k] : cut[k + 1]] = _unbits(r.bits, cut[k + 1] - cut[k])
            mine = np.flatnonzero(dealt == k)
            said = _unbits(r.docs, 2 * len(mine))
            copied[mine], first[mine] = said[: len(mine)], said[len(mine) :]
        is_copy = np.where(which >= 0, copied[which], False) if len(d) else np.zeros(len(b.texts), bool)
        publishes = np.zeros(len(b.texts), bool)
        publishes[first_here[first]] = True
        return b.possible(at[twice[inverse]], is_copy & ~publishes), is_copy

    def entries_b(key: tuple, pdf: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        b = BlockOfDocs(pdf, length, buckets)
        at, _ = after_a(b, reply)
        bucket, h, g, _, here = b.named(at)
        cut = _cuts(bucket, buckets)
        rows = [(k, key[0], h[own].tobytes(), g[own].tobytes(), _bits(here[own]), b"") for k in range(buckets) if cut[k] < cut[k + 1] for own in [slice(cut[k], cut[k + 1])]]
        return pd.DataFrame(rows, columns=["bucket", "block", "names", "more", "here", "docs"])

    def answer_b(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = [np.frombuffer(x, np.uint64) for x in pdf["names"]]
        at = np.cumsum([0, *map(len, names)])
        twice = _equal_neighbours(np.concatenate(names), np.concatenate([np.frombuffer(x, np.uint16) for x in pdf["more"]]))
        rows = [(block, 1, key[0], _bits(twice[at[i] : at[i + 1]] | _unbits(here, at[i + 1] - at[i])), b"") for i, (block, here) in enumerate(zip(pdf["block"], pdf["here"], strict=True))]
        return pd.DataFrame(rows, columns=["block", "step", "bucket", "bits", "docs"])

    def removed(key: tuple, pdf: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        b = BlockOfDocs(pdf, length, buckets)
        at, is_copy = after_a(b, reply)
        bucket, _, _, which, _ = b.named(at)
        cut, twice = _cuts(bucket, buckets), np.zeros(len(bucket), bool)
        for r in reply[reply["step"] == 1].itertuples():
            twice[cut[r.bucket] : cut[r.bucket + 1]] = _unbits(r.bits, cut[r.bucket + 1] - cut[r.bucket])
        starts = at[twice[which]]
        edge = np.zeros(len(b.data) + 1, np.int32)
        edge[starts] += 1
        edge[starts + length] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for i, (lo, hi) in enumerate(zip(b.starts, b.ends, strict=True)):
            own = gone[lo:hi] if not is_copy[i] else np.ones(hi - lo, bool)
            spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
            out.append((b.ids[i][1] if b.ids[i][0] else None, hi - lo, int(own.sum()), spans, hashlib.sha256(b.data[lo:hi][~own].tobytes()).hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    by_block = table.groupBy("block")
    reply = ws.save(by_block.applyInPandas(entries_a, _ENTRY).groupBy("bucket").applyInPandas(answer_a, _REPLY), "samples")
    more = ws.save(by_block.cogroup(reply.groupBy("block")).applyInPandas(entries_b, _ENTRY).groupBy("bucket").applyInPandas(answer_b, _REPLY), "starts")
    return by_block.cogroup(reply.unionByName(more).groupBy("block")).applyInPandas(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _split_docs(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Digests and recurrence bits of n documents from 16 * n + ceil(n / 8) bytes."""
    n = len(raw) * 8 // 129
    while 16 * n + -(-n // 8) < len(raw):
        n += 1
    return np.frombuffer(raw, _DIGEST, n), _unbits(raw[16 * n :], n)
