"""Keyed merge of a batch into a snapshot, and last-write-wins state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_of_batch(batch: DataFrame, key: str, confidence: str, position: str) -> DataFrame:
    """One row a key: the most confident, the first of equals. A struct minimum combines before the shuffle."""
    rest = [c for c in batch.columns if c != key]
    best = F.min(F.struct((-F.col(confidence)).alias("_c"), F.col(position).alias("_p"), *rest)).alias("_r")
    return batch.groupBy(key).agg(best).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def classify(batch: DataFrame, snapshot: DataFrame, key: str, payload: str) -> DataFrame:
    """``batch`` with action: new, updated (another payload) or touched."""
    known = snapshot.select(key, F.col(payload).alias("_old"), F.lit(True).alias("_known"))
    action = F.when(F.col("_known").isNull(), "new").when(~F.col("_old").eqNullSafe(F.col(payload)), "updated").otherwise("touched")
    return batch.join(known, key, "left").withColumn("action", action).drop("_old", "_known")


def apply(batch: DataFrame, snapshot: DataFrame, key: str, seen: str, first: str = "first_seen", last: str = "last_seen") -> DataFrame:
    """The next snapshot: a batch's row replaces its key's, first_seen stays, last_seen moves. One full join on the key."""
    fields = [c for c in snapshot.columns if c not in (key, first, last)]
    b, s = batch.alias("b"), snapshot.alias("s")
    hit = F.col(f"b.{seen}").isNotNull()
    return b.join(s, F.col(f"b.{key}") == F.col(f"s.{key}"), "full").select(
        F.coalesce(F.col(f"b.{key}"), F.col(f"s.{key}")).alias(key),
        *[F.when(hit, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in fields],
        F.coalesce(F.col(f"s.{first}"), F.col(f"b.{seen}")).alias(first),
        F.coalesce(F.col(f"b.{seen}"), F.col(f"s.{last}")).alias(last),
    )


def last_write(df: DataFrame, key: str, value: str, *version: str) -> DataFrame:
    """Newest value of each key."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*version)).alias(value))


def newest(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The n first rows of each key by ``order``; Spark cuts each task's rows before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn") <= n)
