"""Structured Streaming: micro-batch upserts, what was seen before, tails, and state kept by source across restarts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import merge


class Snapshot:
    """A keyed table in hash buckets; a batch rewrites the buckets that it touches, and versions older than ``keep`` go.

    ``root/data/v<epoch>/bucket=<k>`` holds rows, ``root/manifest/v<epoch>`` says which version each bucket is at. A repeated
    epoch starts from the manifest before it and so writes the same rows again.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 32, keep: int = 3):
        self.spark, self.root, self.key, self.buckets, self.keep = spark, root, key, buckets, keep

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def versions(self) -> list[int]:
        at = self._path("manifest")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(x.getPath().getName()[1:]) for x in fs.listStatus(at)) if fs.exists(at) else []

    def manifest(self, before: int | None = None) -> dict[int, int]:
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return {}
        return {int(k): v for k, v in json.loads(self.spark.read.text(f"{self.root}/manifest/v{known[-1]}").first()[0]).items()}

    def _rows(self, at: dict[int, int]) -> DataFrame | None:
        if not at:
            return None
        paths = [f"{self.root}/data/v{v}/bucket={k}" for k, v in sorted(at.items())]
        return self.spark.read.parquet(*paths)

    def read(self) -> DataFrame | None:
        return self._rows(self.manifest())

    def apply(self, batch: DataFrame, epoch: int, seen: str, first: str = "first_seen", last: str = "last_seen") -> None:
        """Merge ``batch``, one row a key, whose rows carry the time ``seen``."""
        old = self.manifest(before=epoch)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # at most ``buckets``
        own = self._rows({k: v for k, v in old.items() if k in touched})
        if own is None:
            nxt = batch.withColumn(first, F.col(seen)).withColumn(last, F.col(seen)).drop(seen)
        else:
            nxt = merge.apply(batch, own, self.key, seen, first, last)
        nxt.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/v{epoch}")
        now = old | dict.fromkeys(touched, epoch)
        self.spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest/v{epoch}")
        self._forget(epoch)

    def _forget(self, epoch: int) -> None:
        kept = [v for v in self.versions() if v > epoch - self.keep]
        used = {v for m in kept for v in json.loads(self.spark.read.text(f"{self.root}/manifest/v{m}").first()[0]).values()}
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for v in self.versions():
            if v not in kept:
                self._path("manifest", f"v{v}").getFileSystem(conf).delete(self._path("manifest", f"v{v}"), True)
        data = self._path("data")
        fs = data.getFileSystem(conf)
        for x in fs.listStatus(data):
            if int(x.getPath().getName()[1:]) not in used:
                fs.delete(x.getPath(), True)


def upsert_stream(spark: SparkSession, stream: DataFrame, root: str, key: str, confidence: str, position: str, seen: str, buckets: int = 32) -> DataStreamWriter:
    """Merge a stream into a Snapshot under ``root``; of a batch's rows of one key the most confident counts."""
    table = Snapshot(spark, root, key, buckets)

    def write(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            table.apply(merge.best_of_batch(batch, key, confidence, position), epoch, seen)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint")


def polling(writer: DataStreamWriter, seconds: float = 5.0) -> DataStreamWriter:
    """A batch every so many seconds."""
    return writer.trigger(processingTime=f"{seconds} seconds")


def changed_only(batch: DataFrame, trusted: DataFrame, source: str = "source", body: str = "body") -> DataFrame:
    """``batch`` without bodies that their source has served in a trusted batch before: what a conditional request saves.

    ``trusted`` has source and sha; of equal bodies in ``batch`` each row stays.
    """
    sha = F.sha2(F.coalesce(F.col(body).cast("binary"), F.lit(b"")), 256)
    known = trusted.select(F.col(source).alias("_s"), F.col("sha").alias("_h")).distinct()
    return batch.join(known, (F.col(source) == F.col("_s")) & (sha == F.col("_h")), "left_anti")


def tail(events: DataFrame, after: int, id_col: str = "event_id") -> DataFrame:
    """Events past a cursor; the stream's checkpoint moves it on."""
    return events.where(F.col(id_col) > after)


def reindex_due(elapsed: float, grown: int, interval: float = 900.0, least: int = 40) -> bool:
    """Enough time or enough new rows, and never sooner than a quarter of the interval."""
    return (elapsed >= interval or grown >= least) and elapsed >= interval / 4


State = tuple


def fold_stream(events: DataFrame, key: str, order: str, columns: list[str], start: State, step: Callable[[State, tuple], tuple[State, tuple]], state: str, out: str) -> DataFrame:
    """key, order and what ``step`` says of each event of a stream, by source; state survives restarts with the checkpoint.

    ``step(state, values)`` gives the next state and the output. Within a micro-batch events run by ``order``; one that comes later
    than its successors' batch is run when it comes, as a poll's result is.
    """

    names = [key, order, *(c.split()[0] for c in out.split(","))]

    def run(group: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        pdf = pd.concat(list(frames)).sort_values(order, kind="stable")
        said = []
        for values in zip(*(pdf[c].tolist() for c in columns), strict=True):
            now, told = step(now, values)
            said.append(told)
        held.update(now)
        yield pd.DataFrame([(group[0], o, *t) for o, t in zip(pdf[order].tolist(), said, strict=True)], columns=names)

    return events.select(key, order, *columns).groupBy(key).applyInPandasWithState(run, f"{key} {dict(events.dtypes)[key]}, {order} {dict(events.dtypes)[order]}, {out}", state, "append", "NoTimeout")


def drift_step(weight: float = 0.2, least: int = 5):
    """(mean, var, n) and a rate to the next state and whether the rate is an alarm."""

    def step(now: State, values: tuple) -> tuple[State, tuple]:
        (mean, var, n), (rate,) = now, values
        z = (rate - mean) / max(max(var, 1e-6) ** 0.5, 0.05)
        if n >= least and z <= -3.0 and rate < mean - 0.15:
            return now, (True,)
        d = rate - mean
        return ((rate, 0.0, 1) if n == 0 else (mean + weight * d, (1 - weight) * (var + weight * d * d), n + 1)), (False,)

    return step


def drift_stream(rates: DataFrame, weight: float = 0.2, least: int = 5) -> DataFrame:
    """source, batch, alarm for a stream of (source, batch, rate)."""
    return fold_stream(rates, "source", "batch", ["rate"], (0.0, 0.0, 0), drift_step(weight, least), "mean double, var double, n long", "alarm boolean")


def breaker_step(threshold: int = 3):
    """(state, failures, health) and whether a poll failed to the next state."""

    def step(now: State, values: tuple) -> tuple[State, tuple]:
        (state, fails, health), (failed,) = now, values
        if not failed:
            now = ("closed", 0, min(1.0, health * 0.7 + 0.3))
        elif fails + 1 >= threshold:
            now = ("open", fails + 1, health * 0.6)
        else:
            now = (state, fails + 1, health * 0.85)
        return now, (now[0], now[2])

    return step


def breaker_stream(polls: DataFrame, key: str = "source", order: str = "id", failed: str = "failed") -> DataFrame:
    """source, id, breaker, health after each poll."""
    return fold_stream(polls, key, order, [failed], ("closed", 0, 1.0), breaker_step(), "state string, fails long, health double", "breaker string, health double")


def bandit_step(limit: float = 60.0):
    """(alpha, beta) and whether a poll succeeded to the next posterior."""

    def step(now: State, values: tuple) -> tuple[State, tuple]:
        a, b = now[0] + bool(values[0]), now[1] + (not values[0])
        now = (a * 0.7, b * 0.7) if a + b > limit else (a, b)
        return now, now

    return step


def bandit_stream(polls: DataFrame, key: str = "source", order: str = "id", ok: str = "ok", prior: tuple[float, float] = (2.0, 1.0)) -> DataFrame:
    """source, id, alpha, beta after each poll."""
    return fold_stream(polls, key, order, [ok], prior, bandit_step(), "alpha double, beta double", "alpha double, beta double")


def hourly(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Events an hour and type; late ones are taken for two hours."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, "2 hours").groupBy(F.window(ts, "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
