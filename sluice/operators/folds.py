"""Order-dependent state folds: a group's events, sorted, run through one JVM-side ``aggregate``.

A fold needs the events of its key together; its state is small and its events are narrow (a time and a
flag), so the array of a key is some bytes for each event. Keys spread over the shuffle.

Where steps compose, a key's history is never gathered: the ladder and the gated health are folded by time slices, each
summed up as one function (``clamped_sum``), and a key of any length costs one short row a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(df: DataFrame, key: list[str], *event: Column) -> DataFrame:
    """key, events: the events of each key as a sorted array of structs."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*event))).alias("events"))


def folded(df: DataFrame, key: list[str], event: list[Column], start: Column, step) -> DataFrame:
    """key, r: the state after all events of a key, in the order of the event's fields."""
    return ordered(df, key, *event).withColumn("r", F.aggregate("events", start, step)).drop("events")


def clamped_sum(df: DataFrame, key: list[str], order: list[str], slice_: Column, change: Column, low: int, high: int, start: int = 0) -> DataFrame:
    """key, value: a running sum that is clamped to low..high at each step, after all events of a key.

    A run of steps maps x to min(top, max(bottom, x + sum)), and two such maps make one again. So events are folded
    within (key, slice), where ``slice_`` orders before ``order``, and then only slices within a key; no key's events meet in one task.
    """
    three = lambda s, b, t: F.struct(s.alias("s"), b.alias("b"), t.alias("t"))
    then = lambda a, c: three(a["s"] + c["s"], F.least(c["t"], F.greatest(c["b"], a["b"] + c["s"])), F.least(c["t"], F.greatest(c["b"], a["t"] + c["s"])))
    wide = high - low + abs(start) + 1
    same = three(F.lit(0).cast("long"), F.lit(-wide).cast("long"), F.lit(wide).cast("long"))
    own = df.select(*key, slice_.alias("_slice"), *order, change.cast("long").alias("_d"))
    one = lambda a, e: then(a, three(e["d"], F.lit(low).cast("long"), F.lit(high).cast("long")))
    parts = folded(own, [*key, "_slice"], [*map(F.col, order), F.col("_d").alias("d")], same, one)
    all_ = folded(parts, key, [F.col("_slice").alias("slice"), F.col("r").alias("f")], same, lambda a, e: then(a, e["f"]))
    return all_.select(*key, F.least(F.col("r.t"), F.greatest(F.col("r.b"), F.lit(start) + F.col("r.s"))).cast("int").alias("value"))


def breaker(df: DataFrame, key: str, order: list[str], failed: Column, threshold: int = 3) -> DataFrame:
    """key, state, fails, health after all events: success closes and heals, the third failure in a row opens."""
    state = lambda s, f, h: F.struct(s.alias("state"), f.alias("fails"), h.alias("health"))
    start = state(F.lit("closed"), F.lit(0).cast("long"), F.lit(1.0))

    def step(a: Column, e: Column) -> Column:
        fails, health = a["fails"] + 1, a["health"]
        fail = F.when(fails >= threshold, state(F.lit("open"), fails, health * 0.6)).otherwise(state(a["state"], fails, health * 0.85))
        return F.when(e["failed"], fail).otherwise(state(F.lit("closed"), F.lit(0).cast("long"), F.least(F.lit(1.0), health * 0.7 + 0.3)))

    return ordered(df, [key], *order, failed.alias("failed")).withColumn("r", F.aggregate("events", start, step)).select(key, "r.*")


def ladder(df: DataFrame, key: str, order: list[str], failed: Column, rungs: int, slice_: Column | None = None) -> DataFrame:
    """key, rung: one down on failure, one up on success, clamped at each step. ``slice_`` cuts long histories, by time for instance."""
    change = F.when(failed, 1).otherwise(-1)
    return clamped_sum(df, [key], order, F.lit(0) if slice_ is None else slice_, change, 0, rungs - 1).withColumnRenamed("value", "rung")


def bandit(df: DataFrame, key: list[str], order: list[str], ok: Column, alpha: float = 2.0, beta: float = 1.0, limit: float = 60.0) -> DataFrame:
    """key, alpha, beta, mean: a Beta posterior whose evidence shrinks by 0.7 when it passes the limit."""
    pair = lambda a, b: F.struct(a.alias("alpha"), b.alias("beta"))

    def step(p: Column, e: Column) -> Column:
        a, b = p["alpha"] + e["ok"].cast("double"), p["beta"] + (~e["ok"]).cast("double")
        return F.when(a + b > limit, pair(a * 0.7, b * 0.7)).otherwise(pair(a, b))

    out = ordered(df, key, *order, ok.alias("ok")).withColumn("r", F.aggregate("events", pair(F.lit(alpha), F.lit(beta)), step)).select(*key, "r.*")
    return out.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def token_bucket(df: DataFrame, key: str, order: list[str], at: Column, rate: float, capacity: float) -> DataFrame:
    """key, granted, denied: requests against a bucket that refills with time."""
    s = lambda t, last, g, d: F.struct(t.alias("tokens"), last.alias("last"), g.alias("granted"), d.alias("denied"))

    def step(a: Column, e: Column) -> Column:
        have = F.when(a["last"].isNull(), F.lit(capacity)).otherwise(F.least(F.lit(capacity), a["tokens"] + (e["at"] - a["last"]) * rate))
        return F.when(have >= 1.0, s(have - 1.0, e["at"], a["granted"] + 1, a["denied"])).otherwise(s(have, e["at"], a["granted"], a["denied"] + 1))

    zero = s(F.lit(capacity), F.lit(None).cast("double"), F.lit(0).cast("long"), F.lit(0).cast("long"))
    return ordered(df, [key], at.alias("at"), *order).select(key, F.aggregate("events", zero, step).alias("r")).select(key, "r.granted", "r.denied")


def fill_rates(rows: DataFrame, key: list[str], fields: tuple[str, ...]) -> DataFrame:
    """key, field, rate: the share of rows whose field is more than blank, for each field; one aggregate, then a row a field."""
    filled = [F.avg(F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "", 1.0).otherwise(0.0)).alias(f) for f in fields]
    return rows.groupBy(*key).agg(*filled).unpivot(key, list(fields), "field", "rate")


def drift(rates: DataFrame, key: list[str], batch: str, rate: str, weight: float = 0.2, least: int = 5) -> DataFrame:
    """key, mean, var, n, alarms (array of batch, rate, mean, z): a gated EWMA that an alarm doesn't move."""
    alarm = "array<struct<batch:long,rate:double,baseline:double,z:double>>"
    s = lambda m, v, n, a: F.struct(m.alias("mean"), v.alias("var"), n.alias("n"), a.alias("alarms"))

    def step(a: Column, e: Column) -> Column:
        z = (e["rate"] - a["mean"]) / F.greatest(F.sqrt(F.greatest(a["var"], F.lit(1e-6))), F.lit(0.05))
        bad = (a["n"] >= least) & (z <= -3.0) & (e["rate"] < a["mean"] - 0.15)
        d = e["rate"] - a["mean"]
        told = F.concat(a["alarms"], F.array(F.struct(e["batch"].cast("long").alias("batch"), e["rate"].alias("rate"), a["mean"].alias("baseline"), z.alias("z"))))
        return F.when(bad, s(a["mean"], a["var"], a["n"], told)).when(a["n"] == 0, s(e["rate"], F.lit(0.0), F.lit(1).cast("long"), a["alarms"])).otherwise(s(a["mean"] + weight * d, (1 - weight) * (a["var"] + weight * d * d), a["n"] + 1, a["alarms"]))

    zero = s(F.lit(0.0), F.lit(0.0), F.lit(0).cast("long"), F.array().cast(alarm))
    return ordered(rates, key, F.col(batch).alias("batch"), F.col(rate).alias("rate")).withColumn("r", F.aggregate("events", zero, step)).select(*key, "r.*")
