"""Operator 6: exact top-k by integer inner product over a bit-sliced index.

Components become floor(256 * x). A block of rows, sorted by id, is stored as bit slices: for each dimension
the values above the block's least one, a bitmap of rows for each binary digit. A query's scores of a whole block
are made by bitmap arithmetic: slices shifted by the digits of the query's components are summed by carry-save
adders, negative components apart, and the two sums are subtracted. The k highest are then taken
from the most significant slice downward; rows that tie at the boundary are resolved by id, so the result is exact.

Queries are written in blocks of about QUERY_BLOCK, and blocks of queries meet blocks of the index in tiles, all in one job: a tile
holds one block of queries and about TILE_BLOCKS of the index, whatever the tables' sizes. It keeps the k best of each
query, so what shuffles then is k rows for a query and tile. Nothing is collected or broadcast.

Rows with a component of 2**26 or more after scaling stand in blocks of their own, whose values are Python integers, so every finite
vector takes part and every order is exact; a score beyond a long is given as the long nearest to it.

No part take: null ids, vectors null or holding null or non-finite components. Vectors of different dimensions don't meet; ones
without components meet each other with score 0. Repeated ids: each row is a candidate, but not of a query with its id; such a query is
asked once, with the vector that sorts first. Empty table: no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace

BLOCK_ROWS, QUERY_BLOCK, TILE_BLOCKS = 16_384, 4_096, 8
#: From here on a scaled component is kept as a Python integer.
WIDE = 1 << 26
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def finite(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok)
        .select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    )


def quantised(v: np.ndarray) -> np.ndarray:
    """floor(256 * v) of a matrix, in longs, or as Python integers where a component is wide."""
    if not v.size or np.abs(v).max() < WIDE / 256:
        return np.floor(v * 256).astype(np.int64)
    big = lambda x: math.floor(x * 256) if abs(x) < 2.0**60 else int(x) * 256
    return np.array([[big(x) for x in row] for row in v.tolist()], dtype=object).reshape(v.shape)


_INDEX = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("bits", pa.int32()), ("ids", pa.binary()), ("least", pa.string()), ("slices", pa.binary())])
_INDEX_SQL = "dim int, n int, bits int, ids binary, least string, slices binary"


def _block(ids: np.ndarray, v: np.ndarray) -> dict:
    order = np.argsort(ids, kind="stable")
    ids, q = ids[order], quantised(v[order])
    least = q.min(axis=0)
    u = q - least
    bits = max(1, int(u.max()).bit_length()) if u.size else 1
    words = -(-len(ids) // 64)
    planes = np.zeros((q.shape[1], bits, words * 64), np.uint8)
    for b in range(bits):
        planes[:, b, : len(ids)] = ((u >> b) & 1).T
    return {"dim": [q.shape[1]], "n": [len(ids)], "bits": [bits], "ids": [ids.tobytes()], "least": [json.dumps(least.tolist())], "slices": [np.packbits(planes, axis=2, bitorder="little").tobytes()]}


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and vectors of a batch, as a matrix for each dimension and width."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
    for dim in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dim)
        v = flat[at[own][:, None] + np.arange(dim)]
        wide = (np.abs(v) >= WIDE / 256).any(axis=1)
        for part in (~wide, wide):
            if part.any():
                yield ids[own][part], v[part]


def build_index(vectors: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the bit-sliced index; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], tuple[list, list]] = {}

        def emit(key: tuple[int, bool]) -> pa.RecordBatch:
            ids, v = held.pop(key)
            return pa.RecordBatch.from_pydict(_block(np.concatenate(ids), np.concatenate(v)), schema=_INDEX)

        for batch in batches:
            for ids, v in _by_dimension(batch):
                key = v.shape[1], bool(v.size and np.abs(v).max() >= WIDE / 256)
                for lo in range(0, len(ids), rows):
                    a, b = held.setdefault(key, ([], []))
                    a.append(ids[lo : lo + rows])
                    b.append(v[lo : lo + rows])
                    if sum(map(len, a)) >= rows:
                        yield emit(key)
        for key in list(held):
            yield emit(key)

    return finite(vectors).mapInArrow(run, _INDEX_SQL)


def _sum(columns: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Carry-save addition: bitmaps by weight to one bitmap for each weight."""
    out, w = [], 0
    while columns:
        parts = columns.pop(w, None)
        rows = np.concatenate(parts) if parts else np.zeros((0, words), np.uint64)
        while len(rows) >= 2:
            third = len(rows) // 3
            if third:
                a, b, c, rest = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third], rows[3 * third :]
                x = a ^ b
                rows, carry = np.concatenate([x ^ c, rest]), (a & b) | (c & x)
            else:
                rows, carry = rows[:1] ^ rows[1:2], rows[:1] & rows[1:2]
            columns.setdefault(w + 1, []).append(carry)
        out.append(rows[0] if len(rows) else np.zeros(words, np.uint64))
        w += 1
    return out


class Block:
    """A block of the index, ready for queries."""

    def __init__(self, n: int, dim: int, bits: int, ids: bytes, least: str, slices: bytes):
        self.n, self.ids, self.least, self.words = n, np.frombuffer(ids, np.int64), json.loads(least), -(-n // 64)
        self.slices = np.frombuffer(slices, np.uint8).reshape(dim, bits, self.words * 8).view(np.uint64)
        all_ = np.zeros(self.words * 64, np.uint8)
        all_[:n] = 1
        self.all = np.packbits(all_, bitorder="little").view(np.uint64)

    def _weighted(self, size: np.ndarray, dims: np.ndarray) -> list[np.ndarray]:
        """Slices of the sum over ``dims`` of size times value."""
        columns: dict[int, list[np.ndarray]] = {}
        top = int(size.max()).bit_length() if len(size) else 0
        for b in range(top):
            own = dims[(size >> b) & 1 == 1]
            if len(own):
                for s in range(self.slices.shape[1]):
                    columns.setdefault(b + s, []).append(self.slices[own, s])
        return _sum(columns, self.words)

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        """Ids and scores of the k best rows, without those of ``query_id``; equal scores by id. Scores are Python integers."""
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        a, b = self._weighted(q[up], up), self._weighted(-q[down], down)
        width = max(len(a), len(b)) + 1
        zero = np.zeros(self.words, np.uint64)
        a, b = a + [zero] * (width - len(a)), b + [zero] * (width - len(b))
        # a - b in two's complement; the sign slice is turned so that larger scores have larger digits
        carry, digits = ~zero, []
        for x, y in zip(a, b, strict=True):
            y = ~y
            t = x ^ y
            digits.append(t ^ carry)
            carry = (x & y) | (carry & t)
        digits[-1] = ~digits[-1]
        # the boundary, from the most significant slice downward
        sure, maybe = zero.copy(), self.all.copy()
        for i in range(np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, side="right")):
            maybe[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        for d in reversed(digits):
            x = sure | (maybe & d)
            n = int(np.bitwise_count(x).sum())
            if n > k:
                maybe = maybe & d
            else:
                sure, maybe = x, maybe & ~d
                if n == k:
                    break
        places = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
        rows = places(sure)
        if len(rows) < k:  # ties at the boundary: the smallest ids
            rows = np.concatenate([rows, places(maybe)[: k - len(rows)]])
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        value = [0] * len(rows)
        for w, d in enumerate(digits):
            for i, one in enumerate(((d[word] >> bit) & np.uint64(1)).tolist()):
                value[i] += one << w if w < width - 1 else -((1 - one) << w)
        shift = sum(x * y for x, y in zip(q.tolist(), self.least, strict=True))
        return self.ids[rows], [x + shift for x in value]


def search(spark: SparkSession, vectors: DataFrame, k: int = 5, every: int = 50, block_rows: int = BLOCK_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, its k best among all other rows."""
    ws = Workspace(spark, "top-k")
    index = ws.save(build_index(vectors, block_rows), "index")
    asked = finite(vectors.where(F.col("vec_id") % every == 0)).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = ws.save(asked, "queries")
    n, blocks = asked.count(), index.count()
    columns = max(1, -(-n // query_block))
    # tiles of fewer index blocks where there would be too few for the cores
    rows = max(1, min(blocks, max(-(-blocks // TILE_BLOCKS), 2 * spark.sparkContext.defaultParallelism // columns)))
    left = index.withColumn("r", F.pmod(F.xxhash64("ids"), F.lit(rows)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    right = asked.withColumn("c", F.pmod(F.xxhash64("vec_id"), F.lit(columns)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def tile(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        blocks = [Block(r.n, r.dim, r.bits, r.ids, r.least, r.slices) for r in own.itertuples()]
        for query_id, v in zip(queries["vec_id"], queries["v"], strict=True):
            q = quantised(np.asarray(v, float).reshape(1, -1))[0]
            best: list[tuple[int, int]] = []
            for block, dim in zip(blocks, own["dim"], strict=True):
                if dim == len(q):
                    ids, score = block.top(query_id, q, k)
                    best += zip((-s for s in score), ids.tolist(), strict=True)
            out += [(query_id, i, -s) for s, i in sorted(best)[:k]]
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": str})
        return pd.DataFrame([(a, b, str(c)) for a, b, c in out], columns=["query_id", "vec_id", "score"])

    found = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInPandas(tile, "query_id long, vec_id long, score string")
    # scores that don't fit a long still order by their digits: sign, then length, then the digits themselves
    high = F.when(F.col("score").startswith("-"), 0).otherwise(1)
    size = F.when(high == 0, -F.length("score")).otherwise(F.length("score"))
    digits = F.when(high == 1, F.col("score")).otherwise(F.translate("score", "0123456789", "9876543210"))
    best = Window.partitionBy("query_id").orderBy(F.desc(high), F.desc(size), F.desc(digits), "vec_id")
    near = F.expr("try_cast(score AS bigint)")
    value = F.coalesce(near, F.when(high == 1, F.lit(_MOST)).otherwise(F.lit(_LEAST)))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", value.alias("score"))
