"""What the operators share: the work folder, written stages and Arrow maps over texts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that an Arrow map holds as Python objects at once, and those that Spark sends a worker at once.
SLICE_ROWS, BATCH_ROWS = 512, 1024
#: Characters of texts that are encoded at once, at about which a group ends.
GROUP_CHARS = 4 << 20


#: Bits of a filter of keys: what is broadcast with it is at most 32 MB. Up to so many ids, with a digest each, are broadcast themselves: about as much.
MAX_BITS, MAX_IDS = 1 << 28, 1 << 18


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only in local mode may the session have none; driver and executors are then one process, and a folder of the machine serves.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"/tmp/sluice-work/{os.getpid()}"
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows in an Arrow batch: texts make the default of 10,000 tens of MB on either side of each task.

    It stays, because a plan that is handed out reads it when it runs.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the length of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Workspace:
    """Intermediate tables of one operator call, written in the shared folder.

    A written table cuts the lineage: a lost executor costs the tasks it ran, not the stages before. The shuffle files of
    a write go when it ends, so what an operator holds on disk is its tables and one stage's shuffle.
    """

    made: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.made.append(self.root)
        small_batches(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def local(self, name: str) -> str | None:
        """A new folder for files that all processes open, or None where the shared folder isn't in a file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if files.getUri().getScheme() != "file":
            return None
        os.makedirs(out := path.toUri().getPath(), exist_ok=True)
        return out

    def drop(self, *names: str) -> None:
        """Delete these tables, or all with none named."""
        jvm = self.spark.sparkContext._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete all tables that operators of this process wrote, once their results aren't needed any more."""
    jvm = spark.sparkContext._jvm
    while Workspace.made:
        path = jvm.org.apache.hadoop.fs.Path(Workspace.made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def marked(ws: Workspace, docs: DataFrame, key: Column, keys: DataFrame, flag: str, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with a boolean column: may the 64-bit ``key`` be one of the one column of ``keys``? False is certain.

    A bitmap of 16 bits a key, up to ``max_bits``, is built in parts where the keys are and broadcast, so rows of ``docs`` don't
    shuffle. A fuller bitmap says yes more often, up to always; callers settle those rows exactly. A null key gets False.
    """
    keys = keys.toDF("h").where("h IS NOT NULL")
    n = keys.count()
    if not n:
        return docs.withColumn(flag, F.lit(False))
    m = min(max_bits, max(1 << 15, 1 << (16 * n - 1).bit_length()))
    bit = F.pmod(F.col("h"), F.lit(m)) + 1
    bits = np.zeros(max(m // 8, 4096), np.uint8)
    parts = keys.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    for k, part in parts.collect():  # at most max_bits in all
        bits[(k - 1) * 4096 : k * 4096] = np.frombuffer(part, np.uint8)
    sent = ws.spark.sparkContext.broadcast(bits)

    @F.pandas_udf(T.BooleanType())
    def test(h: pd.Series) -> pd.Series:
        at = h.to_numpy()
        return pd.Series((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return docs.withColumn(flag, F.coalesce(key.isNotNull() & test(F.coalesce(F.pmod(key, F.lit(m)), F.lit(0).cast("long"))), F.lit(False)))


def among(ws: Workspace, docs: DataFrame, key: str, ids: DataFrame, max_ids: int = MAX_IDS, max_bits: int = MAX_BITS) -> tuple[DataFrame, bool]:
    """The rows of ``docs`` whose ``key`` (a long) is in the one column of ``ids``, without a shuffle of ``docs``, and whether exactly those.

    Up to ``max_ids`` ids are broadcast as they are; beyond that a bitmap lets some other rows through.
    """
    ids = ids.toDF(key).where(F.col(key).isNotNull()).distinct()
    if ids.count() <= max_ids:
        return docs.join(F.broadcast(ids), key, "left_semi"), True
    return marked(ws, docs, F.xxhash64(key), ids.select(F.xxhash64(key)), "_wanted", max_bits).where("_wanted").drop("_wanted"), False


def without(ws: Workspace, docs: DataFrame, gone: DataFrame, own: list[Column], max_ids: int = MAX_IDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, whose values of ``own`` aren't a row of ``gone`` (its columns in that order, nulls equal).

    Up to ``max_ids`` gone rows are broadcast, and texts stay where they are. Beyond that a bitmap of gone values of the first column
    marks rows: the others pass straight through, and only marked ones shuffle, in an anti join. The columns after the first are
    only made for rows whose first is a gone one's.
    """
    flag = "_marked_" + uuid.uuid4().hex[:8]
    names = [f"_gone_{i}_{flag}" for i in range(len(own))]
    gone = gone.toDF(*names)
    same = own[0].eqNullSafe(F.col(names[0]))
    if gone.count() <= max_ids:
        for c, name in zip(own[1:], names[1:], strict=True):
            same = same & (F.when(c.eqNullSafe(F.col(name)), 1).otherwise(0) > 0)  # no join key, so made for matches only
        return docs.join(F.broadcast(gone), same, "left_anti")
    said = marked(ws, docs, F.xxhash64(own[0]), gone.select(F.xxhash64(names[0])), flag, max_bits)
    for c, name in zip(own[1:], names[1:], strict=True):
        same = same & c.eqNullSafe(F.col(name))
    rest = said.where(F.col(flag)).drop(flag).join(gone, same, "left_anti")
    return said.where(~F.col(flag)).drop(flag).unionByName(rest)


_caches: dict[str, Callable[[], None]] = {}
_trimmed: set[tuple[str, int | None]] = set()


def claim(name: str, clear: Callable[[], None] | None = None) -> None:
    """Of the caches that operators keep in a worker process from task to task, leave only ``name``'s.

    ``clear`` empties them; a worker is used by several operators in turn, and then holds one's caches at once.
    """
    for other, empty in _caches.items():
        if other != name:
            empty()
    if clear:
        _caches[name] = clear
    task = TaskContext.get()
    now = (name, task.taskAttemptId() if task else None)
    if now not in _trimmed:  # once a task
        _trimmed.clear()
        _trimmed.add(now)
        trim()


def trim() -> None:
    """Give free memory of this process back to the system; the allocators keep it otherwise, task after task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """Keys and texts of rows in their order, about ``GROUP_CHARS`` characters at once."""
    keys, texts, size = [], [], 0
    for batch in slices(batches):
        for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            keys.append(key)
            texts.append(text)
            size += len(text) + 1
            if size >= GROUP_CHARS:
                yield keys, texts
                keys, texts, size = [], [], 0
                pa.default_memory_pool().release_unused()
    if keys:
        yield keys, texts


def map_texts(
    docs: DataFrame, make: Callable[[], Callable[[list[str]], list]], fields: list[tuple[str, T.DataType]],
    id_col: str = "doc_id", text_col: str = "text", nulls: bool = False,
) -> DataFrame:
    """A row per row of ``docs``: its id as it is (nulls too) and the columns that ``make()(texts)`` returns.

    ``make`` runs once in each task. With ``nulls`` the function also sees null texts as None.
    """
    small_batches(docs.sparkSession)
    sel = docs.select(F.col(id_col), F.col(text_col))
    schema = T.StructType([sel.schema[0], *[T.StructField(n, t) for n, t in fields]])
    arrow = [_arrow_type(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in slices(batches):
            out = fn(batch.column(1).to_pylist() if nulls else texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, type=t) for x, t in zip(out, arrow, strict=True)]], names=schema.names
            )

    return sel.mapInArrow(run, schema)


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def text_bytes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of the texts; one scan, no Python."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    return int(row[0]), int(row[1] or 0)


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; a null id is held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(True))
