"""Operator 10: best-fit packing of documents into sequences of at most ``capacity`` tokens.

Bulk-synchronous best fit, decreasing. Pieces are range-sorted by length (a counting sort: a length
is one of ``capacity`` values, and a piece's rank within its length comes from counts of each task),
and open sequences are sorted by gap. A round takes one length: its pieces, by rank, go to the
sequences of the smallest gap that holds them, then to the next gap (the successor sweep); what is
left opens new sequences; gaps are updated and the next round begins. Sequences of one gap are
interchangeable, so a round handles runs of ranks and of sequences, and a whole plan has a few runs
for each length however many pieces there are. Only the histogram of lengths reaches the driver.

A document longer than the capacity is cut into pieces of ``capacity`` tokens, the last may be shorter.
Null text: empty, so one end id. Null or repeated doc_id: each row is packed by itself.
Empty table: no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, groups
from .word_bpe import encoder


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """A row per piece, with its rank among the pieces of its length in its task (part, local)."""
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for keys, texts in groups(batches):
            out: list[list] = [[] for _ in schema]
            for key, ids in zip(keys, enc.encode_all(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    for column, x in zip(out, (key, k, at // 4, n, zlib.crc32(own), part, seen[n]), strict=True):
                        column.append(x)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long")


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Runs of the best-fit plan: of a length's pieces, from rank ``rank`` on, go to sequences from ``seq`` on at ``offset``."""
    gaps: list[int] = []  # sorted; the gaps that some open sequence has
    open_: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, number)
    runs: list[tuple[int, int, int, int]] = []
    fresh = 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in open_:
                bisect.insort(gaps, gap)
                open_[gap] = []
            open_[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        at = bisect.bisect_left(gaps, length)
        taken: list[tuple[int, int, int]] = []
        while left and at < len(gaps):
            gap, own = gaps[at], open_[gaps[at]]
            first, n = own[-1]
            k = min(n, left)
            runs.append((length, rank, first, capacity - gap))
            if k == n:
                own.pop()
            else:
                own[-1] = (first + k, n - k)
            if not own:
                del open_[gap], gaps[at]
            if gap - length >= length:  # best fit tries the gap just made before any larger one
                add(gap - length, first, k)
                at = bisect.bisect_left(gaps, length)
            else:
                taken.append((gap - length, first, k))
            rank, left = rank + k, left - k
        for x in taken:
            add(*x)
        if left:
            each = capacity // length
            full, over = divmod(left, each)
            for layer in range(each if full else 0):
                runs.append((length, rank, fresh, layer * length))
                rank += full
            add(capacity - each * length, fresh, full)
            fresh += full
            for layer in range(over):
                runs.append((length, rank + layer, fresh, layer * length))
            if over:
                add(capacity - over * length, fresh, 1)
                fresh += 1
    runs.sort()
    a = np.array(runs, dtype=np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "seq": a[:, 2], "offset": a[:, 3]}


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of ``docs``."""
    ws = Workspace(spark, "packing")
    table = ws.save(pieces(docs, tokenizer, end_id, capacity), "pieces")
    by_part = ws.save(table.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    runs = plan({r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # a run is found by (length, rank) in one sorted array
    shift = np.int64(1) << np.int64(48)
    keys = runs["length"] * shift + runs["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            seq = runs["seq"][at] + rank - runs["rank"][at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(5)], pa.array(seq), pa.array(runs["offset"][at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return (
        table.join(based, ["length", "part"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
        .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )
