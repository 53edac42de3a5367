"""Raw posting records to the canonical row, and what is rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def _clean(name: str, limit: int, have: set[str]) -> Column:
    return X.clean_text(F.col(name), limit) if name in have else F.lit("")


def normalise(raw: DataFrame, as_of: Column, source: str | Column = "source") -> DataFrame:
    """The canonical columns and ``rejected`` for each raw record; a record without title or url after cleaning is rejected.

    Fields that ``raw`` lacks count as absent. Nothing is dropped here, so that a batch can be counted with its rejects.
    Times: ``as_of`` is first_seen and last_seen.
    """
    have = set(raw.columns)
    absent = lambda c: F.nullif(c, F.lit(""))
    title, url, company, location = _clean("title", 300, have), _clean("url", 500, have), _clean("company", 200, have), _clean("location", 200, have)
    description = _clean("description", 4000, have)
    tags = F.transform(F.slice(F.coalesce(F.col("tags"), F.array().cast("array<string>")), 1, 12), lambda t: X.clean_text(t, 40)) if "tags" in have else F.array().cast("array<string>")
    rows = raw.select(
        (F.col(source) if isinstance(source, str) else source).alias("source"), title.alias("title"), company.alias("_company"), location.alias("_location"), url.alias("url"), description.alias("_description"),
        absent(_clean("source_job_id", 120, have)).alias("source_job_id"), (F.col("salary") if "salary" in have else F.lit(None).cast("string")).alias("_salary"), (F.col("remote").cast("string") if "remote" in have else F.lit(None).cast("string")).alias("_remote"),
        (X.parse_date("posted_at") if "posted_at" in have else F.lit(None).cast("timestamp")).alias("posted_at"), F.to_json(tags).alias("tags"), (F.coalesce(F.col("confidence"), F.lit(1.0)) if "confidence" in have else F.lit(1.0)).alias("confidence"),
    )
    out = rows.select(
        X.canonical_id("_company", "title", "_location").alias("canonical_id"), "source", "source_job_id", "title", absent(F.col("_company")).alias("company"), absent(F.col("_location")).alias("location"),
        X.is_remote("_location", "title", "_remote").cast("int").alias("remote"), "url", absent(F.col("_description")).alias("description"), absent(X.extract_salary("_salary", "_description")).alias("salary_text"),
        "posted_at", as_of.alias("first_seen"), as_of.alias("last_seen"), "tags", "confidence", ((F.col("title") == "") | (F.col("url") == "")).alias("rejected"),
    )
    return out.withColumn("payload_hash", X.payload_hash("title", "company", "location", "url", "description", "salary_text", "tags"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("rejected")).drop("rejected")


def report(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One row for each source: new, updated, touched, rejected, total; of a batch's rows of one key the most confident counts."""
    from . import merge

    best = merge.best_of_batch(accepted(rows).withColumn("_pos", F.monotonically_increasing_id()), "canonical_id", "confidence", "_pos")
    done = merge.classify(best, snapshot, "canonical_id", "payload_hash").groupBy("source").agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("new", "updated", "touched")])
    total = rows.groupBy("source").agg(F.count_if("rejected").alias("rejected"), F.count(F.lit(1)).alias("total"))
    return total.join(done, "source", "left").select("source", *[F.coalesce(a, F.lit(0)).alias(a) for a in ("new", "updated", "touched")], "rejected", "total")


def mean_confidence(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """source, confidence (mean, 3 digits) and whether it calls for a warning."""
    return rows.groupBy("source").agg(F.round(F.avg("confidence"), 3).alias("confidence")).withColumn("warn", F.col("confidence") < least)
