"""Postings with many copies, against DuckDB over the same tables; and no join that sends a large side to the driver."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_catalog import rows

from sluice import catalog
from sluice.ml import tagger
from sluice.operators import search
from sluice.plans import dashboard  # noqa: F401  it registers its queries


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """Four copies of 500 parts, some seen at other times, one in a later company."""
    at = tmp_path_factory.mktemp("copied")
    d = duckdb.connect()
    d.execute("""CREATE TABLE part AS SELECT p_partkey + 2000 * k AS p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN 'Brand#' || k ELSE p_brand END AS p_brand, p_type, p_size,
        p_retailprice + CASE WHEN (p_partkey + k) % 4 = 0 THEN -20 * k ELSE (p_partkey % 2) * k END AS p_retailprice FROM '/root/testdata/sf0.01/part.parquet', range(4) t(k) WHERE p_partkey < 500""")
    d.execute(f"COPY part TO '{at}/part.parquet'")
    return d, str(at)


def check(spark, copied, name):
    d, at = copied
    df = catalog.QUERIES[name](spark, at)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= (name in ("duplicate_pairs", "dup_survivors")), plan  # block_pairs sends a row for each block of many terms
    got = df.toPandas()
    assert rows(got) == rows(d.execute(catalog.ORACLE_SQL[name]).df())
    return got


def test_pairs(spark, copied):
    assert len(check(spark, copied, "duplicate_pairs")) > 1000


def test_similar(spark, copied):
    assert len(check(spark, copied, "similar_topk")) > 200


def test_identity(spark, copied):
    check(spark, copied, "identity_space")


def test_survivors(spark, copied):
    assert len(check(spark, copied, "dup_survivors")) > 500


def test_survivors_need_no_pairs_of_rows(spark):
    jobs = spark.range(20_000).selectExpr("id", "'Senior lamp' AS title", "'Brand' AS company", "'x' AS location", "id % 3 AS first_seen")
    got = search.surviving(jobs, "id", 20_000)
    # 200 million pairs
    assert got.count() == 19_999 and {(r.dup, r.dup_of) for r in got.where("dup < 6").collect()} == {(1, 0), (2, 0), (3, 0), (4, 0), (5, 0)}
    back = search.surviving(jobs.withColumn("first_seen", -F.col("id")), "id", 20_000)
    assert {(r.dup, r.dup_of) for r in back.where("dup < 3").collect()} == {(0, 1), (1, 2), (2, 3)} and back.count() == 19_999


def test_survivors_of_unknown_times(spark):
    jobs = spark.createDataFrame([(1, None), (2, 5), (3, 4), (4, None)], "id long, first_seen int").selectExpr("*", "'Senior lamp' AS title", "'Brand' AS company", "'x' AS location")
    want = {tuple(r) for r in search.survivors(search.find_duplicates(jobs, "id", 4), jobs, "id").collect()}
    assert {tuple(r) for r in search.surviving(jobs, "id", 4).collect()} == want


def test_tagger_learns_from_distinct_rows(spark, copied, monkeypatch):
    d, at = copied
    seen, fit = [], tagger.LogisticRegression.fit
    monkeypatch.setattr(tagger.LogisticRegression, "fit", lambda self, x: seen.append(x.agg(F.count("*"), F.sum("weight")).first()) or fit(self, x))
    jobs = dashboard.jobs(spark, at)
    out, metrics = tagger.tag(jobs, "id", cross_validate=False)
    assert out.count() == 2000 == metrics["n_rows"]
    # four copies are one row that weighs four times as much; weights sum up to the rows with a label
    labelled = [round(2000 * metrics[f"{f}_coverage"]) for f in ("role_family", "seniority")]
    assert len(seen) == 2 and all(n <= 500 and abs(w - m) <= 1 for (n, w), m in zip(seen, labelled))
