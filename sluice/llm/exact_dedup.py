"""Operator 8: exact de-duplication by two-pass Bloom filtering.

Pass one hashes each normalised text (JVM-side) and writes (doc_id, digest, length) once. Each task
sets the digests' bits in two filters, "seen" and "seen again"; filters of different tasks merge chunk by
chunk, where a bit that two tasks set becomes "seen again". Pass two tests each digest: one whose bits
are not all in "seen again" is unique for sure and its row passes straight through; only the others,
and never a text, shuffle to be grouped by their digest.

The filter has 16 bits for each row up to a stated bound, so what is broadcast is at most 32 MB. Where rows are too
many for that, the filter fills up and lets more unique rows into the shuffle: narrow rows of id, length and digest, in
the same grouping that repeated ones take, so every size gives the same rows and no case is dropped.

Hot groups: a group of copies sets the same bits once for each task, and its rows combine in their
tasks before the shuffle; the join back is a plain join that AQE splits where a key is hot.

Null text: empty; all empty texts are equal. Null doc_id: an ordinary row; among equally long texts it
comes after every id. Repeated doc_ids: rows of the same id in one group count singly and all are kept if that
id is. Ties: the smallest doc_id. Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MAX_BITS, MAX_IDS, Workspace, without

BITS_A_ROW, HASHES = 16, 2
#: Bits of a chunk, the unit in which filters are merged.
CHUNK_BITS = 1 << 16


def normalised(text: str = "text"):
    """The text without the characters [\\x20\\x09-\\x0D]; null is empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), " \t\n\x0b\x0c\r", "")


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    """A power of two, at least a chunk and at most ``max_bits``."""
    return int(min(max_bits, max(CHUNK_BITS, 1 << (max(1, rows * BITS_A_ROW) - 1).bit_length())))


def _bits_of(h: np.ndarray, m: int) -> list[np.ndarray]:
    """The places of each 64-bit hash in a filter of ``m`` bits."""
    h = h.view(np.uint64)
    return [((h >> np.uint64(32 * (i % 2))) * np.uint64(0x9E3779B1 + 2 * i) >> np.uint64(3)) % np.uint64(m) for i in range(HASHES)]


def repeated_filter(hashes: DataFrame, m: int) -> np.ndarray:
    """The "seen again" filter of a one-column frame of 64-bit hashes, as packed bits.

    A task sends its chunks as bit positions or as bitmaps, whichever is smaller.
    """
    n_chunks = m // CHUNK_BITS

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a bit is "seen again" in a task if two different rows set it
        seen, again = np.zeros(m // 8, np.uint8), np.zeros(m // 8, np.uint8)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(h), 1 << 20):
                for b in _bits_of(h[at : at + (1 << 20)], m):
                    bits, n = np.unique(b, return_counts=True)
                    byte, mask = (bits >> np.uint64(3)).astype(np.int64), (1 << (bits & np.uint64(7))).astype(np.uint8)
                    dup = (n > 1) | ((seen[byte] & mask) > 0)
                    np.bitwise_or.at(again, byte[dup], mask[dup])
                    np.bitwise_or.at(seen, byte, mask)
        size = CHUNK_BITS // 8
        for c in np.flatnonzero(seen.reshape(n_chunks, size).any(axis=1)):
            part = [zlib.compress(x[c * size : (c + 1) * size].tobytes(), 1) for x in (seen, again)]
            yield pa.RecordBatch.from_pydict({"chunk": [int(c)], "seen": [part[0]], "again": [part[1]]}, schema=_CHUNK)

    def merge(key: tuple, parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
        seen, again = np.zeros(CHUNK_BITS // 8, np.uint8), np.zeros(CHUNK_BITS // 8, np.uint8)
        for pdf in [parts]:
            for s, a in zip(pdf["seen"], pdf["again"], strict=True):
                s, a = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (s, a))
                again |= a | (seen & s)
                seen |= s
        return pd.DataFrame({"chunk": [key[0]], "again": [zlib.compress(again.tobytes(), 1)]})

    merged = hashes.mapInArrow(local, "chunk int, seen binary, again binary").groupBy("chunk").applyInPandas(merge, "chunk int, again binary")
    out = np.zeros(m // 8, np.uint8).reshape(n_chunks, -1)
    for r in merged.collect():  # at most MAX_BITS in all
        out[r[0]] = np.frombuffer(zlib.decompress(r[1]), np.uint8)
    return out.reshape(-1)


_CHUNK = pa.schema([("chunk", pa.int32()), ("seen", pa.binary()), ("again", pa.binary())])


def with_flag(table: DataFrame, hash_col: str, bits: np.ndarray, m: int, flag: str) -> DataFrame:
    """``table`` with a boolean: may the hash be repeated? False is certain."""
    sent = table.sparkSession.sparkContext.broadcast(np.packbits(np.zeros(0)) if not len(bits) else bits)

    @F.pandas_udf(T.BooleanType())
    def test(h: pd.Series) -> pd.Series:
        filter_, ok = sent.value, np.ones(len(h), bool)
        for b in _bits_of(h.to_numpy(), m):
            ok &= (filter_[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return pd.Series(ok)

    return table.withColumn(flag, test(F.col(hash_col)))


def exact_groups(spark: SparkSession, docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``."""
    ws = Workspace(spark, "exact-dedup")
    digest = F.unhex(F.sha2(normalised().cast("binary"), 256))
    table = ws.save(
        docs.select(F.col("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("n"), digest.alias("digest")), "digests"
    ).withColumn("h", F.xxhash64("digest"))
    m = filter_bits(table.count(), max_bits)
    maybe = with_flag(table, "h", repeated_filter(table.select("h"), m), m, "maybe")
    maybe = ws.save(maybe.drop("h"), "tested")
    ws.drop("digests")
    some = maybe.where("maybe")
    # written, so that the join below stands on two plain shuffles, which AQE can split where a group is large
    groups = some.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"),
        # the longest, then the smallest id; nulls last
        F.min(F.struct((-F.col("n")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("id"))).getField("id").alias("keep_id"),
    )
    own = some.join(ws.save(groups, "groups"), "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    alone = maybe.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return alone.unionByName(own)


def drop_copies(spark: SparkSession, docs: DataFrame, max_ids: int = MAX_IDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, that stay. Only rows whose id may be a dropped one's are hashed again, and no other shuffles."""
    ws = Workspace(spark, "exact-dedup-dropped")
    gone = ws.save(exact_groups(spark, docs, max_bits).where("NOT kept").select(F.col("doc_id"), F.unhex("text_sha256").alias("digest")).distinct(), "dropped")
    flag = F.unhex(F.sha2(normalised().cast("binary"), 256))
    return without(ws, docs, gone, [F.col("doc_id"), flag], max_ids, max_bits)
