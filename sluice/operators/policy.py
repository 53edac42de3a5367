"""Crawl policies: robots files to rules by agent, and the longest matching rule for each url."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def parse_robots(text: str | None) -> dict[str, dict]:
    """Rules by agent: lists of allow and disallow patterns in order, and the last valid crawl delay. Directives outside a group don't count."""
    groups: dict[str, dict] = {}
    agents: list[str] = []
    heading = False
    for line in (text or "").splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            agents = [*agents, value.lower()] if heading else [value.lower()]
            heading = True
            groups.setdefault(agents[-1], {"allow": [], "disallow": [], "delay": None})
            continue
        heading = False
        for own in (groups[a] for a in agents):
            if key in ("allow", "disallow") and value:
                own[key].append(value)
            elif key == "disallow":  # without a value: all is allowed
                own["allow"].append("/")
            elif key == "crawl-delay":
                try:
                    own["delay"] = float(value)
                except ValueError:
                    pass
    return groups


def robots_rules(files: DataFrame, agent: str = "*", origin: str = "origin", status: str = "status", body: str = "body") -> DataFrame:
    """origin, reachable, delay, kind, pattern: a row for each rule of the agent's group or else the wildcard's; an origin without rules has one with null kind.

    Status 5xx and null (no answer): unreachable. 4xx: reachable, without rules.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for o, s, text in pdf.itertuples(index=False):
                reachable = not pd.isna(s) and s < 500
                groups = parse_robots(text) if reachable and s < 400 else {}
                own = groups.get(agent.lower()) or groups.get("*") or {"allow": [], "disallow": [], "delay": None}
                rules = [(k, p) for k in ("allow", "disallow") for p in own[k]]
                out += [(o, reachable, own["delay"], k, p) for k, p in rules or [(None, None)]]
            yield pd.DataFrame(out, columns=["origin", "reachable", "delay", "kind", "pattern"])

    return files.select(origin, F.col(status).cast("double"), body).mapInPandas(run, "origin string, reachable boolean, delay double, kind string, pattern string")


def crawl_allowed(urls: DataFrame, rules: DataFrame, id_col: str, url: str = "url") -> DataFrame:
    """id, allowed, reason for each url: the longest matching pattern decides, ties allow, no match allows, an unreachable policy denies.

    Rules join by origin, so a site's urls meet its own rules only. An origin without a row in ``rules`` counts as unreachable.
    """
    path = F.coalesce(F.nullif(F.parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    at = urls.select(F.col(id_col), F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.parse_url(url, F.lit("AUTHORITY"))).alias("_origin"), path.alias("_path"))
    hit = at.join(rules.withColumnRenamed("origin", "_origin"), "_origin", "left")
    longest = lambda k: F.coalesce(F.max(F.when((F.col("kind") == k) & F.regexp("_path", X.robots_regex("pattern")), F.length("pattern"))), F.lit(-1))
    best = hit.groupBy(id_col).agg(longest("allow").alias("a"), longest("disallow").alias("d"), F.coalesce(F.bool_and("reachable"), F.lit(False)).alias("ok"))
    return best.select(
        id_col, (F.col("ok") & ((F.col("d") < 0) | (F.col("a") >= F.col("d")))).alias("allowed"),
        F.when(~F.col("ok"), "unreachable").when(F.col("d") < 0, "no match").when(F.col("a") >= F.col("d"), "allow").otherwise("disallow").alias("reason"),
    )
