"""Operator 1: token ids in shard files with a minimal perfect hash index.

A shard is one binary image: its documents' keys in ascending order, the ids of all of them in one raw
payload (16 bits an id where the vocabulary allows it), and an index. The index is a minimal perfect
hash of the keys: each of a few bitmap levels takes the keys that are alone in their cell, and a key's
slot is the rank of its bit. A slot stores a 32-bit fingerprint of its key and the ordinal of the key's
first document, so a lookup reads a constant number of cells and rejects foreign keys.

Images are rows of a Parquet table, so that Spark's committer, and not a task, publishes files, on any
file system that Spark can write.

Null text: empty, its only id is the end id. Null keys: they sort first and are read by position.
Repeated keys: a run of ordinals under one slot, in the order of their texts. Empty table: no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, groups, slices, text_bytes
from .word_bpe import encoder

#: Text bytes of a partition, token ids of a shard.
PARTITION_BYTES, SHARD_IDS = 32 << 20, 2 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser over an array of integers."""
    z = x.astype(np.int64, copy=False).view(np.uint64) + np.uint64((int(_MIX[0]) * (seed + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * _MIX[1]
    z = (z ^ (z >> np.uint64(27))) * _MIX[2]
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct integer keys: slot(key) runs from 0 to the number of keys less one."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - 1 + base)
            base += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.6) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            m = int(len(rest) * gamma) + 1
            cell = (mix(rest, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(cell, minlength=m) == 1
            levels.append(alone)
            rest = rest[~alone[cell]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key, -1 where every level rejects it; foreign keys may get any slot."""
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(rest):
                break
            cell = (mix(keys[rest], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[cell]
            out[rest[hit]] = ranks[cell[hit]]
            rest = rest[~hit]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 77) >> np.uint64(32)).astype("<u4")


def _pack(meta: dict, arrays: dict[str, np.ndarray]) -> bytes:
    head = json.dumps(meta | {"arrays": {k: [str(a.dtype), len(a)] for k, a in arrays.items()}}).encode()
    return b"SLTK" + len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays.values())


def _unpack(image: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    if image[:4] != b"SLTK":
        raise ValueError("not a token shard")
    n = int.from_bytes(image[4:8], "little")
    meta, at, out = json.loads(image[8 : 8 + n]), 8 + n, {}
    for k, (dtype, count) in meta["arrays"].items():
        out[k] = np.frombuffer(image, dtype, count, at)
        at += out[k].nbytes
    return meta, out


def build_shard(keys: list[int | None], ids: list[bytes], wide: bool) -> bytes:
    """The image of documents in ascending order of key, nulls first; ``ids`` as 32-bit integers."""
    n_null = sum(k is None for k in keys)
    own = np.array(keys[n_null:], dtype=np.int64)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    unique = own[first]
    index = PerfectHash.build(unique)
    slots = index.slots(unique)
    prints, ordinals = np.zeros(len(unique), "<u4"), np.zeros(len(unique), "<u4")
    prints[slots], ordinals[slots] = _fingerprint(unique), first + n_null
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("<i8")
    payload = np.frombuffer(b"".join(ids), "<u4").astype("<u4" if wide else "<u2")
    return _pack(
        {"n_null": n_null, "levels": [len(x) for x in index.levels]},
        {"keys": own.astype("<i8"), "offsets": offsets, "prints": prints, "ordinals": ordinals}
        | {f"level{i}": np.packbits(x) for i, x in enumerate(index.levels)}
        | {"payload": payload},
    )


class Shard:
    """A shard read back; ``get(key)`` gives the ids of each document with that key."""

    def __init__(self, image: bytes):
        meta, a = _unpack(image)
        self.keys, self.offsets, self.prints, self.ordinals, self.payload = (a[k] for k in ("keys", "offsets", "prints", "ordinals", "payload"))
        self.n_null = meta["n_null"]
        self.index = PerfectHash([np.unpackbits(a[f"level{i}"], count=n).astype(bool) for i, n in enumerate(meta["levels"])])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The ordinal of each key's first document, -1 for a key that is not here."""
        slots = self.index.slots(keys)
        ok = slots >= 0
        ok[ok] = self.prints[slots[ok]] == _fingerprint(keys[ok])
        out = np.full(len(keys), -1, np.int64)
        out[ok] = self.ordinals[slots[ok]]
        real = out >= 0
        out[real] = np.where(self.keys[out[real] - self.n_null] == keys[real], out[real], -1)
        return out

    def ids(self, ordinal: int) -> np.ndarray:
        return self.payload[self.offsets[ordinal] : self.offsets[ordinal + 1]]

    def get(self, key: int) -> list[np.ndarray]:
        at = int(self.find(np.array([key], np.int64))[0])
        out = []
        while at >= 0 and at - self.n_null < len(self.keys) and self.keys[at - self.n_null] == key:
            out.append(self.ids(at))
            at += 1
        return out


def write_shards(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode ``docs`` and write shards in ascending order of doc_id at ``path``.

    One range shuffle of the texts; a row of the table is (part, seq, rel_start, n_tokens, n_docs, lo, hi, image).
    """
    _, size = text_bytes(docs)
    parts = max(1, -(-size // PARTITION_BYTES))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        wide = max(enc.whole.get_vocab_size(), end_id + 1) > 1 << 16
        keys, ids, held, seq, start = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, ids, held, seq, start
            real = [k for k in keys if k is not None]
            row = {
                "part": [part], "seq": [seq], "rel_start": [start], "n_tokens": [held], "n_docs": [len(keys)],
                "lo": [real[0] if real else None], "hi": [real[-1] if real else None], "image": [build_shard(keys, ids, wide)],
            }
            keys, ids, held, seq, start = [], [], 0, seq + 1, start + held
            return pa.RecordBatch.from_pydict(row, schema=_SHARDS)

        for own, texts in groups(batches):
            for key, x in zip(own, enc.encode_all(texts), strict=True):
                keys.append(key)
                ids.append(x + end)
                held += len(ids[-1]) // 4
                if held >= SHARD_IDS:
                    yield flush()
        if keys:
            yield flush()

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .mapInArrow(run, _SHARDS_SQL)
        .write.option("parquet.compression", "zstd")
        .parquet(path)
    )


_SHARDS_SQL = "part int, seq int, rel_start long, n_tokens long, n_docs long, lo long, hi long, image binary"
_SHARDS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("rel_start", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("image", pa.binary())])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row per document of the shards at ``path``: doc_id, start, n_tokens, ids_crc32.

    Each document is read through the index by its key. The driver only sums a total for each partition.
    """
    shards = spark.read.parquet(path)
    totals = {r[0]: r[1] for r in shards.groupBy("part").agg(F.sum("n_tokens")).collect()}
    base = np.cumsum([0, *[totals.get(p, 0) for p in range(max(totals, default=-1) + 1)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            part, rel, image = (batch.column(i)[0].as_py() for i in range(3))
            s = Shard(image)
            first = s.find(s.keys)
            if (first < 0).any():
                raise ValueError("a key is not found in its own shard")
            # repeated keys stand in a run from the first
            run_at = np.arange(len(s.keys)) - np.searchsorted(s.keys, s.keys)
            ordinals = np.concatenate([np.arange(s.n_null), first + run_at])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": [None] * s.n_null + s.keys.tolist(),
                    "start": s.offsets[ordinals] + rel + base[part],
                    "n_tokens": s.offsets[ordinals + 1] - s.offsets[ordinals],
                    "ids_crc32": [zlib.crc32(s.ids(o).astype("<u4").tobytes()) for o in ordinals],
                },
                schema=_DOCS,
            )

    return shards.select("part", "rel_start", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The ids of the documents whose doc_id is in ``keys``: doc_id, ids (array of int).

    Keys meet the shards whose key range holds them; in a shard each lookup takes constant time.
    """
    shards = spark.read.parquet(path)
    meta = shards.select("part", "seq", "lo", "hi").where(F.col("lo").isNotNull())
    want = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    near = want.join(meta, (want.doc_id >= meta.lo) & (want.doc_id <= meta.hi)).groupBy("part", "seq").agg(F.collect_list("doc_id").alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            s, out = Shard(batch.column(0)[0].as_py()), {"doc_id": [], "ids": []}
            for key in batch.column(1)[0].as_py():
                for ids in s.get(key):
                    out["doc_id"].append(key)
                    out["ids"].append(ids.astype(np.int32))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return shards.select("part", "seq", "image").join(near, ["part", "seq"]).select("image", "wanted").mapInArrow(run, "doc_id long, ids array<int>")


def token_index(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as shards in the shared folder and read every document back through the index."""
    ws = Workspace(spark, "token-store")
    write_shards(spark, docs, f"{ws.root}/shards", tokenizer, end_id)
    return read_documents(spark, f"{ws.root}/shards")
