"""The queries of the engine by name, and the SQL that gives the same rows where SQL can.

The tables stand in for an ingestion log: events are fetches (an ``error`` is a failed one), documents postings,
pages raw responses, suppliers and parts the names to normalise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as X
from .functions import trust
from .operators import folds, merge, vectors
from .session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


def failed():
    """A failed fetch."""
    return F.col("event_type") == "error"


# ---- operational analytics


@query("""SELECT user_id, count(*) AS fetches, count(*) FILTER (event_type = 'error') AS errors,
    round(100.0 * count(*) FILTER (event_type <> 'error') / greatest(count(*), 1), 1) AS clean_pct, max(ts) AS last_seen FROM events GROUP BY user_id""")
def source_health(spark, d):
    clean = F.round(F.count_if(~failed()) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1)), 1)
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("fetches"), F.count_if(failed()).alias("errors"), clean.alias("clean_pct"), F.max("ts").alias("last_seen"))


@query("SELECT event_type AS verdict, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1")
def verdict_mix(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.join(F.broadcast(now), F.expr("ts > now - INTERVAL 30 DAYS")).groupBy(F.col("event_type").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))  # one row is broadcast


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 40")
def recent_rows(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(40)


@query("SELECT event_id, ts, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 40")
def event_cursor(spark, d):
    return table(spark, d, "events").where("event_id > 500").select("event_id", "ts", "event_type").orderBy("event_id").limit(40)


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 60")
def events_tail(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type").orderBy(F.desc("event_id")).limit(60)


@query("SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INTEGER) AS rn FROM events) WHERE rn <= 12")
def newest_n_per_source(spark, d):
    return merge.newest(table(spark, d, "events").select("user_id", "event_id"), "user_id", 12, F.desc("event_id"))


@query("""SELECT user_id, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 2) AS success FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 12 GROUP BY user_id""")
def recent_success_rate(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return merge.newest(e, "user_id", 12, F.desc("event_id")).groupBy("user_id").agg(F.round(F.avg(F.when(failed(), 0.0).otherwise(1.0)), 2).alias("success"))


@query("""WITH c AS (SELECT * FROM events WHERE event_type <> 'error'),
    w AS (SELECT event_id, user_id, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING) AS vs FROM c)
    SELECT event_id, user_id, CASE WHEN vs IS NULL OR len(vs) < 3 THEN 20.0 ELSE greatest(list_sort(vs)[CAST(len(vs) // 2 + 1 AS INTEGER)], 1.0) END AS median FROM w""")
def rolling_upper_median(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-25, -1)
    vs = F.array_sort(F.collect_list("value").over(w))
    c = table(spark, d, "events").where(~failed()).select("event_id", "user_id", vs.alias("vs"))
    n = F.size("vs")
    return c.select("event_id", "user_id", F.when(n < 3, 20.0).otherwise(F.greatest(F.try_element_at("vs", F.floor(n / 2).cast("int") + 1), F.lit(1.0))).alias("median"))


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn
    FROM (SELECT * FROM labels ORDER BY doc_id DESC LIMIT 500)) SELECT *, round(tp / nullif(tp + fp, 0), 4) AS "precision", round(tp / nullif(tp + fn, 0), 4) AS recall FROM c""")
def confusion_matrix(spark, d):
    x = table(spark, d, "labels").orderBy(F.desc("doc_id")).limit(500)
    n = lambda p, y: F.count_if((F.col("quality") == p) & (F.col("toxic") == y))
    c = x.agg(n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 1).alias("fn"), n(0, 0).alias("tn"))
    return c.select("*", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 4).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 4).alias("recall"))


@query("SELECT user_id, date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_window_60s(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy(us).rangeBetween(-60_000_000, 0)).alias("in_window"))


@query("SELECT event_id, round(1.5 - 0.5 * cos((hour(ts) - 14) / 24.0 * 2 * pi()), 6) AS weight FROM events")
def circadian_weight(spark, d):
    return table(spark, d, "events").select("event_id", F.round(1.5 - 0.5 * F.cos((F.hour("ts") - 14) / 24.0 * 2 * F.pi()), 6).alias("weight"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS start FROM s GROUP BY ALL""")
def session_gap(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    fresh = F.when(F.expr("lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)") >= F.expr("ts - INTERVAL 6 HOURS"), 0).otherwise(1)
    return e.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w)).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"))


# ---- state: last write, registration, retention, folds


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def keyed_last_write(spark, d):
    return merge.last_write(table(spark, d, "events"), "user_id", "value", "event_id")


@query("""SELECT coalesce(b.k, s.k) AS k, coalesce(b.name, s.name) AS name, s.bal AS bal, b.k IS NOT NULL AS enabled FROM
    (SELECT s_suppkey AS k, s_name AS name FROM supplier WHERE s_nationkey <= 16) b FULL JOIN (SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier WHERE s_nationkey >= 8) s ON b.k = s.k""")
def registration_upsert(spark, d):
    s = table(spark, d, "supplier")
    b = s.where("s_nationkey <= 16").select(F.col("s_suppkey").alias("bk"), F.col("s_name").alias("bn"))
    old = s.where("s_nationkey >= 8").select(F.col("s_suppkey").alias("sk"), F.col("s_name").alias("sn"), F.col("s_acctbal").alias("bal"))
    return b.join(old, F.col("bk") == F.col("sk"), "full").select(F.coalesce("bk", "sk").alias("k"), F.coalesce("bn", "sn").alias("name"), "bal", F.col("bk").isNotNull().alias("enabled"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 4000")
def prune_keep_newest(spark, d):
    return table(spark, d, "orders").select("o_orderkey").orderBy(F.desc("o_orderkey")).limit(4000)


_FOLD = """WITH RECURSIVE e AS (SELECT user_id, event_type = 'error' AS failed, value, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS i FROM events), f AS (
    SELECT user_id, CAST(0 AS BIGINT) AS i, {zero} FROM (SELECT DISTINCT user_id FROM events)
    UNION ALL SELECT f.user_id, f.i + 1, {step} FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT user_id, {out} FROM f WHERE (user_id, i) IN (SELECT user_id, max(i) FROM e GROUP BY user_id)"""


@query(_FOLD.format(order="ts, event_id", zero="'closed' AS state, CAST(0 AS BIGINT) AS fails, CAST(1.0 AS DOUBLE) AS health",
    step="CASE WHEN NOT failed THEN 'closed' WHEN fails + 1 >= 3 THEN 'open' ELSE state END, CASE WHEN failed THEN fails + 1 ELSE 0 END, CASE WHEN NOT failed THEN least(1.0, health * 0.7 + 0.3) WHEN fails + 1 >= 3 THEN health * 0.6 ELSE health * 0.85 END",
    out="state, fails, round(health, 6) AS health"))
def breaker_fold(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return folds.breaker(e, "user_id", ["ts", "event_id"], failed()).select("user_id", "state", "fails", F.round("health", 6).alias("health"))


@query(_FOLD.format(order="ts, event_id", zero="CAST(0 AS INTEGER) AS rung", step="CASE WHEN failed THEN least(rung + 1, 3) ELSE greatest(rung - 1, 0) END", out="rung"))
def ladder_fold(spark, d):
    return folds.ladder(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], failed(), 4)


_BANDIT = "CASE WHEN alpha + beta + 1 > 60 THEN ({x}) * 0.7 ELSE {x} END"


@query(_FOLD.format(order="ts, event_id", zero="CAST(2 AS DOUBLE) AS alpha, CAST(1 AS DOUBLE) AS beta",
    step=_BANDIT.format(x="alpha + CASE WHEN failed THEN 0 ELSE 1 END") + ", " + _BANDIT.format(x="beta + CASE WHEN failed THEN 1 ELSE 0 END"),
    out="round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(alpha / (alpha + beta), 6) AS mean"))
def bandit_posterior(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return folds.bandit(e, ["user_id"], ["ts", "event_id"], ~failed()).select("user_id", *[F.round(c, 6).alias(c) for c in ("alpha", "beta", "mean")])


@query(_FOLD.format(order="epoch_us(ts), event_id", zero="CAST(5 AS DOUBLE) AS tokens, CAST(NULL AS DOUBLE) AS last_at, CAST(0 AS BIGINT) AS granted, CAST(0 AS BIGINT) AS denied",
    step="""CASE WHEN coalesce(least(5.0, tokens + (sec - last_at) * 0.00001), 5.0) >= 1 THEN coalesce(least(5.0, tokens + (sec - last_at) * 0.00001), 5.0) - 1 ELSE coalesce(least(5.0, tokens + (sec - last_at) * 0.00001), 5.0) END, sec,
    granted + CASE WHEN coalesce(least(5.0, tokens + (sec - last_at) * 0.00001), 5.0) >= 1 THEN 1 ELSE 0 END, denied + CASE WHEN coalesce(least(5.0, tokens + (sec - last_at) * 0.00001), 5.0) >= 1 THEN 0 ELSE 1 END""", out="granted, denied"))
def token_bucket_fold(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return folds.token_bucket(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", ["event_id"], at, 0.00001, 5.0)


_RATES = "SELECT source, batch, avg(CASE WHEN n_chars > 800 THEN 1.0 ELSE 0.0 END) AS rate FROM (SELECT source, n_chars, doc_id // 40 AS batch FROM documents) GROUP BY source, batch"


def _rates(spark, d):
    """Share of long texts by source and batch of ids, in place of a field's fill rate."""
    x = table(spark, d, "documents").select("source", F.expr("doc_id div 40").alias("batch"), "n_chars")
    return x.groupBy("source", "batch").agg(F.avg(F.when(F.col("n_chars") > 800, 1.0).otherwise(0.0)).alias("rate"))


@query("SELECT source, batch, round(rate, 6) AS rate FROM (" + _RATES + ")")
def fill_rate_by_batch(spark, d):
    return _rates(spark, d).select("source", "batch", F.round("rate", 6).alias("rate"))


@query(f"""WITH RECURSIVE r AS ({_RATES}), e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY batch) AS i FROM r), f AS (
    SELECT source, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS var, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS alarms FROM (SELECT DISTINCT source FROM r)
    UNION ALL SELECT source, i, CASE WHEN bad THEN mean WHEN n = 0 THEN rate ELSE mean + 0.2 * (rate - mean) END, CASE WHEN bad THEN var WHEN n = 0 THEN 0 ELSE 0.8 * (var + 0.2 * (rate - mean) * (rate - mean)) END,
        CASE WHEN bad THEN n ELSE n + 1 END, alarms + CASE WHEN bad THEN 1 ELSE 0 END
    FROM (SELECT f.source, f.i + 1 AS i, mean, var, n, alarms, rate, n >= 5 AND (rate - mean) / greatest(sqrt(greatest(var, 1e-6)), 0.05) <= -3.0 AND rate < mean - 0.15 AS bad FROM f JOIN e ON e.source = f.source AND e.i = f.i + 1))
    SELECT source, round(mean, 6) AS mean, round(var, 6) AS var, n, alarms FROM f WHERE (source, i) IN (SELECT source, max(i) FROM e GROUP BY source)""")
def drift_ewma(spark, d):
    return folds.drift(_rates(spark, d), ["source"], "batch", "rate").select("source", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"), "n", F.size("alarms").cast("long").alias("alarms"))


# ---- text, identity and merge


def _key(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[\(\[\{{][^\)\]\}}]{{0,60}}[\)\]\}}]', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _company(x: str) -> str:
    return f"regexp_replace({_key(x)}, '( ({'|'.join(X.COMPANY_NOISE)}))+$', '')"


def _title(x: str) -> str:
    out = _key(rf"regexp_replace({x}, '(?i)\b({'|'.join(X.TITLE_NOISE)})\b', ' ', 'g')")
    for short, full in (("sr", "senior"), ("jr", "junior"), ("(eng|engr)", "engineer")):
        out = rf"regexp_replace({out}, '\b{short}\b', '{full}', 'g')"
    return out


_NAMES = "(SELECT s_suppkey AS id, s_name || CASE s_suppkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' (Remote) GmbH' WHEN 2 THEN ' Labs LLC' ELSE '' END AS company FROM supplier)"


def _names(spark, d):
    tail = F.element_at(F.array(*map(F.lit, (", Inc.", " (Remote) GmbH", " Labs LLC", ""))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat("s_name", tail).alias("company"))


@query(f"SELECT id, {_key('company')} AS key, {_company('company')} AS company_key FROM {_NAMES}")
def norm_company(spark, d):
    return _names(spark, d).select("id", X.norm_key("company").alias("key"), X.norm_company("company").alias("company_key"))


_PARTS = "(SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Sr. ' WHEN 1 THEN 'Jr ' WHEN 2 THEN 'Full-time ' ELSE '' END || p_name || CASE p_partkey % 3 WHEN 0 THEN ' (Remote)' WHEN 1 THEN ' eng' ELSE '' END AS title, p_brand AS location FROM part)"


def _parts(spark, d):
    n = F.col("p_partkey")
    head = F.when(n % 5 == 0, "Sr. ").when(n % 5 == 1, "Jr ").when(n % 5 == 2, "Full-time ").otherwise("")
    return table(spark, d, "part").select(n.alias("id"), F.concat(head, "p_name", F.when(n % 3 == 0, " (Remote)").when(n % 3 == 1, " eng").otherwise("")).alias("title"), F.col("p_brand").alias("location"))


@query(f"SELECT id, {_title('title')} AS title_key FROM {_PARTS}")
def norm_title(spark, d):
    return _parts(spark, d).select("id", X.norm_title("title").alias("title_key"))


@query(f"SELECT id, substr(sha1(concat_ws('|', {_company('location')}, {_title('title')}, split_part({_key('location')}, ' ', 1))), 1, 20) AS canonical_id FROM {_PARTS}")
def canonical_id(spark, d):
    return _parts(spark, d).select("id", X.canonical_id("location", "title", "location").alias("canonical_id"))


@query(r"""SELECT page_id, substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')), 1, 4000) AS text FROM pages""")
def clean_html(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean_text("html").alias("text"))


@query("SELECT doc_id, regexp_matches(text, '(?i)\\b(remote|anywhere|work from home|wfh|distributed)\\b') AS remote FROM documents")
def is_remote(spark, d):
    return table(spark, d, "documents").select("doc_id", X.is_remote("text").alias("remote"))


@query("SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@query("""SELECT h AS id, doc_id, n_chars FROM (SELECT doc_id, n_chars, substr(sha1(text), 1, 20) AS h, row_number() OVER (PARTITION BY sha1(text) ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1""")
def batch_dedupe_best(spark, d):
    x = table(spark, d, "documents").select(F.substring(F.sha1("text"), 1, 20).alias("id"), "doc_id", "n_chars", F.col("n_chars").alias("conf"), F.col("doc_id").alias("pos"))
    return merge.best_of_batch(x, "id", "conf", "pos").select("id", "doc_id", "n_chars")


def _orders(spark, d):
    """Every order is in the snapshot (older ones), the batch (newer ones) or both; orders that are filled have another price in the batch."""
    o = table(spark, d, "orders").withColumn("_day", F.col("o_orderdate").cast("date"))
    old = o.where("_day < DATE '1999-01-01'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("last_seen"))
    new = o.where("_day >= DATE '1997-01-01'").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("price"), F.expr("o_orderdate + INTERVAL 400 DAYS").alias("seen"))
    return old, new


_OLD = "(SELECT o_orderkey AS k, o_totalprice AS price, o_orderdate AS t FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1999-01-01')"
_NEW = "(SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderdate + INTERVAL 400 DAY AS t FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-01-01')"


@query(f"SELECT CASE WHEN o.k IS NULL THEN 'new' WHEN o.price <> n.price THEN 'updated' ELSE 'touched' END AS action, count(*) AS n FROM {_NEW} n LEFT JOIN {_OLD} o ON n.k = o.k GROUP BY 1")
def upsert_report(spark, d):
    old, new = _orders(spark, d)
    return merge.classify(new, old, "k", "price").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT coalesce(n.k, o.k) AS k, coalesce(n.price, o.price) AS price, coalesce(o.t, n.t) AS first_seen, coalesce(n.t, o.t) AS last_seen FROM {_NEW} n FULL JOIN {_OLD} o ON n.k = o.k")
def upsert_apply(spark, d):
    old, new = _orders(spark, d)
    return merge.apply(new, old, "k", "seen")


# ---- responses, policies and rules


@query("""SELECT page_id, round(ln(1 + length(html)), 6) AS log_body_len, CAST(length(html) < 512 AS INTEGER) AS body_is_tiny, round(len(regexp_extract_all(substr(html, 1, 16384), '<[a-zA-Z/!][^>]{0,80}>')) / greatest(length(html), 1) * 1000.0, 6) AS tag_density,
    round(len(list_distinct(string_split(substr(html, 1, 4096), ''))) / 96.0, 6) AS char_diversity FROM pages""")
def block_features(spark, d):
    f = trust.body_features("html")
    return table(spark, d, "pages").select("page_id", F.round(f["log_body_len"], 6).alias("log_body_len"), f["body_is_tiny"].alias("body_is_tiny"), F.round(f["tag_density"], 6).alias("tag_density"), F.round(f["char_diversity"], 6).alias("char_diversity"))


@query("SELECT page_id, " + " + ".join(f"CAST(contains(h, '{t}') AS INTEGER)" for t in trust.BLOCK_TOKENS) + " AS n FROM (SELECT page_id, lower(substr(html, 1, 8192)) AS h FROM pages)")
def block_token_count(spark, d):
    return table(spark, d, "pages").select("page_id", trust.body_features("html")["n_block_tokens"].alias("n"))


@query("SELECT event_id, CASE WHEN p >= 0.75 THEN 'blocked' WHEN p >= 0.5 THEN 'suspect' ELSE 'clean' END AS verdict FROM (SELECT event_id, (event_id % 100) / 100.0 AS p FROM events)")
def verdict_case(spark, d):
    return table(spark, d, "events").select("event_id", trust.verdict((F.col("event_id") % 100) / 100.0).alias("verdict"))


_RULES = [("allow", "/"), ("disallow", "/page"), ("disallow", "/*/a"), ("allow", "/page/1"), ("disallow", "/*5$"), ("disallow", "/private")]


@query("""WITH r(kind, pattern) AS (VALUES """ + ", ".join(f"('{k}', '{p}')" for k, p in _RULES) + r"""), u AS (SELECT page_id, CASE WHEN regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) END AS path FROM pages),
    m AS (SELECT page_id, coalesce(max(length(pattern)) FILTER (kind = 'allow'), -1) AS a, coalesce(max(length(pattern)) FILTER (kind = 'disallow'), -1) AS d FROM u JOIN r ON regexp_matches(path, '^' || replace(replace(pattern, '.', '\.'), '*', '.*')) GROUP BY page_id)
    SELECT page_id, coalesce(a >= d, true) AS allowed FROM pages LEFT JOIN m USING (page_id)""")
def robots_longest_match(spark, d):
    rules = spark.createDataFrame(_RULES, "kind string, pattern string")
    path = F.coalesce(F.nullif(F.parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/"))
    hit = table(spark, d, "pages").select("page_id", path.alias("path")).join(F.broadcast(rules), F.regexp("path", X.robots_regex("pattern")), "left")  # _RULES, a few rows
    longest = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.length("pattern"))), F.lit(-1))
    return hit.groupBy("page_id").agg((longest("allow") >= longest("disallow")).alias("allowed"))


_WORDS = (("first", r"\b(antique|aquamarine|almond)\b"), ("second", r"\b(blue|black|blush)\b"), ("third", r"\b(red|green|steel)\b"))


@query("SELECT p_partkey, coalesce(CASE " + " ".join(f"WHEN regexp_matches(p_name, '(?i){p}') THEN '{label}'" for label, p in _WORDS) + " END, 'none') AS label FROM part")
def rule_label(spark, d):
    return table(spark, d, "part").select("p_partkey", F.coalesce(X.first_rule("p_name", _WORDS), F.lit("none")).alias("label"))


@query("SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM conversations), 6) AS share FROM (SELECT CASE WHEN regexp_matches(text, '(?i)\\b(the|and)\\b') THEN 'en' WHEN regexp_matches(text, '(?i)\\b(der|und)\\b') THEN 'de' END AS label FROM conversations) WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 3")
def rule_coverage(spark, d):
    x = table(spark, d, "conversations").select(X.first_rule("text", (("en", r"\b(the|and)\b"), ("de", r"\b(der|und)\b"))).alias("label"))
    n = x.agg(F.count(F.lit(1)).alias("total"))
    return x.where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").join(F.broadcast(n)).select("label", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row is broadcast


# ---- vectors: benchmark items are the queries, conversations the short documents

_TERMS = "SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM (SELECT conv_id * 1000 + turn AS id, text FROM conversations)"
_TFIDF = f"""t AS (SELECT id, term, count(*) AS tf FROM ({_TERMS}) GROUP BY ALL), nd AS (SELECT count(*) AS nd FROM conversations), f AS (SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) <= 0.85 * (SELECT nd FROM nd)),
    w0 AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + nd) / (1 + df)) + 1) AS w FROM t JOIN f USING (term) CROSS JOIN nd), w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w0)"""


def _turns(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")


def _weights(spark, d):
    x = _turns(spark, d)
    return vectors.tfidf(x, "id", vectors.word_terms("text"), x.count(), max_df=0.85)


@query(f"SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM ({_TERMS}) GROUP BY term")
def doc_frequency(spark, d):
    t = _turns(spark, d).select("id", F.explode(vectors.word_terms("text")).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query(f"WITH {_TFIDF} SELECT id, term, round(w, 5) AS w FROM w")
def tfidf_word(spark, d):
    return _weights(spark, d).select("id", "term", F.round("w", 5).alias("w"))


_QUERY = "q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM benchmark)"


@query(f"""WITH {_TFIDF}, {_QUERY}, s AS (SELECT item_id, id, round(sum(w), 6) AS score FROM q JOIN w USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM s)
    SELECT item_id, id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM r WHERE rank <= 5 AND score > 0.02""")
def search_topk(spark, d):
    q = table(spark, d, "benchmark").select("item_id", F.explode(vectors.word_terms("text")).alias("term")).distinct().withColumn("qw", F.lit(1.0))
    return vectors.search(_weights(spark, d), q, "id", "item_id", 5, 0.02).select("item_id", "id", "rank", F.round("score", 4).alias("score"))


_BLOCK = "b AS (SELECT conv_id * 1000 + turn AS id, role AS blk FROM conversations)"


@query(f"WITH {_TFIDF}, {_BLOCK}, x AS (SELECT w.*, blk FROM w JOIN b USING (id)) SELECT a.id AS a, c.id AS b, round(sum(a.w * c.w), 4) AS score FROM x a JOIN x c ON a.blk = c.blk AND a.term = c.term AND a.id < c.id GROUP BY 1, 2 HAVING sum(a.w * c.w) >= 0.75")
def near_duplicates_blocked(spark, d):
    c = table(spark, d, "conversations")
    blocks = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role")
    return vectors.block_pairs(_weights(spark, d), blocks, "id", "role", 0.75).select("a", "b", F.round("score", 4).alias("score"))


@query("SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 120) WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def topk_then_filter(spark, d):
    best = F.desc("o_totalprice"), F.col("o_orderkey")
    return table(spark, d, "orders").orderBy(*best).limit(120).where("o_orderstatus = 'F'").orderBy(*best).limit(40).select("o_orderkey", "o_totalprice")
