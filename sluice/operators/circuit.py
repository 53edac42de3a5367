"""Circuit breaker with cooldown and probes, and the scheduling policy that drives it, as one fold over a source's polls.

State of a source: breaker (closed, open, half_open), consecutive failures, when it opened, health and rung. An event is a poll
at a time, with its verdict and status, or an operator's ``reset``. Order within a source is by time, then id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import folded

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


def cooldown(fails: Column, base: float = 90.0, most: float = 1800.0) -> Column:
    """Seconds for which an open breaker denies; it doubles with each failure in a row."""
    return F.least(base * F.pow(F.lit(2.0), F.least(F.greatest(fails, F.lit(1)), F.lit(40)) - 1), F.lit(most))


def check(state: Column, fails: Column, opened_at: Column, now: Column) -> tuple[Column, Column, Column]:
    """allowed, the state after the check, and seconds to wait when denied."""
    left = cooldown(fails) - (now - F.coalesce(opened_at, F.lit(0.0)))
    denied = (state == OPEN) & (left > 0)
    return ~denied, F.when(denied, OPEN).when(state == CLOSED, CLOSED).otherwise(HALF_OPEN), F.when(denied, left).otherwise(0.0)


def run_policy(polls: DataFrame, key: str, at: str, verdict: str, status: str, order: list[str], rungs: int = 3, threshold: int = 3) -> DataFrame:
    """key, breaker, fails, opened_at, health, rung, asked, denied, next_due after all of a source's polls.

    ok (clean, unchanged): success and one rung up. deferred: nothing but a wait of 20 s. skipped: one rung down. drift: one rung down,
    again in 60 s. blocked, or status 403 or 429: opened at once, health as it is. Anything else: a failure, the third in a row opens.
    reset: as new. A poll that the breaker denies changes nothing.
    """
    names = ("breaker", "fails", "opened_at", "health", "rung", "asked", "denied", "next_due")
    pack = lambda *v: F.struct(*[c.alias(n) for c, n in zip(v, names, strict=True)])
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("double")

    def step(a: Column, e: Column) -> Column:
        now = e["at"]
        ok, state, wait = check(a["breaker"], a["fails"], a["opened_at"], now)
        kept = lambda **v: pack(*[v.get(n, state if n == "breaker" else a["asked"] + 1 if n == "asked" else a[n]) for n in names])
        down, up = F.least(a["rung"] + 1, F.lit(rungs - 1)), F.greatest(a["rung"] - 1, F.lit(0))
        fails = a["fails"] + 1
        failed = F.when(fails >= threshold, kept(breaker=F.lit(OPEN), fails=fails, opened_at=now, health=a["health"] * 0.6, rung=down, next_due=now + 60)).otherwise(kept(fails=fails, health=a["health"] * 0.85, rung=down, next_due=now + 60))
        v = e["verdict"]
        return (
            F.when(v == "reset", kept(breaker=F.lit(CLOSED), fails=zero, opened_at=none, health=F.lit(1.0), asked=a["asked"]))
            .when(~ok, kept(breaker=a["breaker"], asked=a["asked"], denied=a["denied"] + 1, next_due=now + wait))
            .when(v == "deferred", kept(next_due=now + 20))
            .when(v.isin("clean", "unchanged"), kept(breaker=F.lit(CLOSED), fails=zero, opened_at=none, health=F.least(F.lit(1.0), a["health"] * 0.7 + 0.3), rung=up, next_due=now + 300))
            .when(v == "skipped", kept(rung=down, next_due=now + 300))
            .when(v == "drift", kept(rung=down, next_due=now + 60))
            .when((v == "blocked") | F.coalesce(e["status"].isin(403, 429), F.lit(False)), kept(breaker=F.lit(OPEN), fails=fails, opened_at=now, rung=down, next_due=now + 60))
            .otherwise(failed)
        )

    start = pack(F.lit(CLOSED), zero, none, F.lit(1.0), F.lit(0), zero, zero, none)
    event = [F.col(at).cast("double").alias("at"), *map(F.col, order), F.col(verdict).alias("verdict"), F.col(status).cast("int").alias("status")]
    return folded(polls, [key], event, start, step).select(key, "r.*")
