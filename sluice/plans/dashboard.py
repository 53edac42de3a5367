"""Queries of the engine over postings, sources and fetches, by name, with SQL where SQL can give the same rows.

Postings stand on parts, sources on suppliers, polls on events; rows are made by expressions, so every table is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import text as X
from ..functions import trust
from ..ml import blocks, tagger
from ..operators import circuit, folds, merge, normalise, policy, search, vectors
from ..session import table
from ..sources import adapters, board

query = C.query

# ---- views

JOBS = """(SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Junior ' WHEN 2 THEN 'Staff ' ELSE '' END || p_name || CASE p_partkey % 4 WHEN 0 THEN ' engineer' WHEN 1 THEN ' backend' WHEN 2 THEN ' data scientist' ELSE '' END AS title,
    CASE WHEN p_partkey % 17 = 0 THEN '  ' ELSE p_brand END AS company, p_type AS location, p_size AS size, p_retailprice AS first_seen, p_partkey % 3 AS source_no FROM part)"""


def jobs(spark, d) -> DataFrame:
    n = F.col("p_partkey")
    head = F.when(n % 5 == 0, "Senior ").when(n % 5 == 1, "Junior ").when(n % 5 == 2, "Staff ").otherwise("")
    tail = F.when(n % 4 == 0, " engineer").when(n % 4 == 1, " backend").when(n % 4 == 2, " data scientist").otherwise("")
    return table(spark, d, "part").select(
        n.alias("id"), F.concat(head, "p_name", tail).alias("title"), F.when(n % 17 == 0, "  ").otherwise(F.col("p_brand")).alias("company"), F.col("p_type").alias("location"), F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("first_seen"), (n % 3).alias("source_no"), F.array(F.lower("p_type")).alias("tags"), F.lit("").alias("description"),
    )


_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(lower({{c}}), '{p}') THEN '{label}'" for label, p in X.ROLES) + " END"
_LEVEL = "CASE " + " ".join(f"WHEN regexp_matches(lower({{c}}), '{p}') THEN '{label}'" for label, p in X.SENIORITY) + " END"

# ---- filters, order, small aggregates


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0 AND s_nationkey <= 12 ORDER BY s_name")
def due_sources(spark, d):
    """Sources that are enabled and due, by name."""
    return table(spark, d, "supplier").where("s_acctbal > 0 AND s_nationkey <= 12").select("s_suppkey", "s_name").orderBy("s_name")


@query(f"SELECT company, count(*) AS n, max(id) AS last_id FROM {JOBS} WHERE company IS NOT NULL AND trim(company) <> '' GROUP BY company ORDER BY company")
def known_companies(spark, d):
    return jobs(spark, d).where("company IS NOT NULL AND trim(company) <> ''").groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id")).orderBy("company")


@query("SELECT count(*) AS labelled, count(*) FILTER (toxic = 1) AS yes, max(d.doc_id) AS last_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NOT NULL")
def truth_known(spark, d):
    known = table(spark, d, "labels").where("toxic IS NOT NULL").select("doc_id", "toxic")
    return table(spark, d, "documents").select("doc_id").join(known, "doc_id").agg(F.count(F.lit(1)).alias("labelled"), F.count_if(F.col("toxic") == 1).alias("yes"), F.max("doc_id").alias("last_id"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0)")
def rows_in_list(spark, d):
    """Rows whose key is in a list that is itself a table."""
    want = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(want, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("""WITH n AS (SELECT user_id, arg_max(event_type, event_id) AS newest, count(*) AS polls, count(*) FILTER (event_type <> 'error') AS clean FROM events GROUP BY user_id)
    SELECT c_custkey AS source, coalesce(newest, 'none') AS newest, coalesce(polls, 0) AS polls, round(clean / polls, 2) AS success, c_mktsegment = 'MACHINERY' AS synthetic, coalesce(newest = 'error', false) AS excluded
    FROM customer LEFT JOIN n ON c_custkey = user_id""")
def sources_dashboard(spark, d):
    """Every registered source with its state: newest verdict, polls, success and flags; one pass over the polls instead of one a source."""
    n = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("newest"), F.count(F.lit(1)).alias("polls"), F.count_if(~C.failed()).alias("clean"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return c.join(n, F.col("c_custkey") == F.col("user_id"), "left").select(
        F.col("c_custkey").alias("source"), F.coalesce("newest", F.lit("none")).alias("newest"), F.coalesce("polls", F.lit(0)).alias("polls"), F.round(F.col("clean") / F.col("polls"), 2).alias("success"),
        (F.col("c_mktsegment") == "MACHINERY").alias("synthetic"), F.coalesce(F.col("newest") == "error", F.lit(False)).alias("excluded"),
    )


@query("""WITH c AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type <> 'error'),
    l AS (SELECT user_id, list_sort(list(floor(value))) AS i, list_sort(list(value * 10)) AS t, count(*) AS n FROM c WHERE rn <= 25 GROUP BY user_id)
    SELECT user_id, CASE WHEN n < 3 THEN 20.0 ELSE greatest(i[CAST(n // 2 + 1 AS INTEGER)], 1.0) END AS median_items, round(CASE WHEN n < 3 THEN 500.0 ELSE greatest(t[CAST(n // 2 + 1 AS INTEGER)], 50.0) END, 6) AS median_latency FROM l""")
def source_baselines(spark, d):
    """Upper medians of the last 25 clean polls with their floors, and the pair for a cold start."""
    c = merge.newest(table(spark, d, "events").where(~C.failed()).select("user_id", "event_id", "value"), "user_id", 25, F.desc("event_id"))
    g = c.groupBy("user_id").agg(F.array_sort(F.collect_list(F.floor("value").cast("double"))).alias("i"), F.array_sort(F.collect_list(F.col("value") * 10)).alias("t"), F.count(F.lit(1)).alias("n"))
    upper = lambda c, cold, least: F.when(F.col("n") < 3, cold).otherwise(F.greatest(F.try_element_at(c, F.floor(F.col("n") / 2).cast("int") + 1), F.lit(least)))
    return g.select("user_id", upper("i", 20.0, 1.0).alias("median_items"), F.round(upper("t", 500.0, 50.0), 6).alias("median_latency"))


@query("SELECT lang, round(avg(n_chars / 4000.0), 3) AS confidence, avg(n_chars / 4000.0) < 0.8 AS warn FROM documents GROUP BY lang")
def extraction_confidence(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.avg(F.col("n_chars") / 4000.0).alias("m"))
    return g.select("lang", F.round("m", 3).alias("confidence"), (F.col("m") < 0.8).alias("warn"))


@query("""WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS ws FROM documents)
    SELECT doc_id, len(ws) AS n_tags, array_to_string(list_sort(ws)[1:12], ' ') AS tags FROM t""")
def first_tags(spark, d):
    ws = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: x != ""))
    return table(spark, d, "documents").select("doc_id", F.size(ws).cast("long").alias("n_tags"), F.array_join(F.slice(F.array_sort(ws), 1, 12), " ").alias("tags"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS last, substr(sha1(url), 1, 12) AS client FROM pages")
def page_keys(spark, d):
    return table(spark, d, "pages").select("page_id", X.last_segment("url").alias("last"), X.client_key("url").alias("client"))


@query("""SELECT doc_id, to_json(list_value(lang, source)) AS tags, substr(sha1(concat_ws(chr(31), coalesce(lang, chr(0)), CAST(n_chars AS VARCHAR), coalesce(source, chr(0)))), 1, 16) AS payload FROM documents""")
def json_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", F.to_json(F.array("lang", "source")).alias("tags"), X.payload_hash("lang", "n_chars", "source").alias("payload"))


# ---- drift of six fields


_FIELDS = ("title", "company", "location", "url", "description", "posted_at")
_ROWS = """(SELECT source, doc_id // 40 AS batch, substr(text, 1, 30) AS title, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE source END AS company, lang AS location, CASE WHEN n_chars > 800 THEN 'u' END AS url, substr(text, 400, 50) AS description,
    CASE WHEN (doc_id // 40) % 20 = 19 THEN '' ELSE '2024' END AS posted_at FROM documents)"""
_RATES6 = "SELECT source, batch, field, avg(CASE WHEN trim(coalesce(v, '')) <> '' THEN 1.0 ELSE 0.0 END) AS rate FROM (UNPIVOT (SELECT source, batch, " + ", ".join(f"coalesce({f}, '') AS {f}" for f in _FIELDS) + f" FROM {_ROWS}) ON " + ", ".join(_FIELDS) + " INTO NAME field VALUE v) GROUP BY ALL"


def _field_rates(spark, d) -> DataFrame:
    text, n = F.col("text"), F.col("doc_id")
    batch = F.expr("doc_id div 40")
    rows = table(spark, d, "documents").select(
        "source", batch.alias("batch"), F.substring(text, 1, 30).alias("title"), F.when(n % 7 == 0, " ").otherwise(F.col("source")).alias("company"), F.col("lang").alias("location"), F.when(F.col("n_chars") > 800, "u").alias("url"),
        F.substring(text, 400, 50).alias("description"), F.when(batch % 20 == 19, "").otherwise("2024").alias("posted_at"),
    )
    return folds.fill_rates(rows, ["source", "batch"], _FIELDS)


@query(f"SELECT source, batch, field, round(rate, 6) AS rate FROM ({_RATES6})")
def fill_rates(spark, d):
    return _field_rates(spark, d).select("source", "batch", "field", F.round("rate", 6).alias("rate"))


_DRIFT6 = f"""WITH RECURSIVE r AS MATERIALIZED ({_RATES6}), e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source, field ORDER BY batch) AS i FROM r), f AS (
    SELECT source, field, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS var, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS batch, CAST(NULL AS DOUBLE) AS rate, CAST(NULL AS DOUBLE) AS baseline, CAST(NULL AS DOUBLE) AS z, false AS bad FROM (SELECT DISTINCT source, field FROM r)
    UNION ALL SELECT source, field, i, CASE WHEN bad THEN mean WHEN n = 0 THEN rate ELSE mean + 0.2 * (rate - mean) END, CASE WHEN bad THEN var WHEN n = 0 THEN 0 ELSE 0.8 * (var + 0.2 * (rate - mean) * (rate - mean)) END,
        CASE WHEN bad THEN n ELSE n + 1 END, batch, rate, mean, z, bad
    FROM (SELECT *, n >= 5 AND z <= -3.0 AND rate < mean - 0.15 AS bad FROM (SELECT f.source, f.field, f.i + 1 AS i, f.mean, f.var, f.n, e.batch, e.rate, (e.rate - f.mean) / greatest(sqrt(greatest(f.var, 1e-6)), 0.05) AS z FROM f JOIN e ON e.source = f.source AND e.field = f.field AND e.i = f.i + 1)))"""


@query(_DRIFT6 + " SELECT source, field, batch, round(rate, 4) AS rate, round(baseline, 4) AS baseline, round(z, 3) AS z, 'quarantine' AS action FROM f WHERE bad")
def drift_log(spark, d):
    """A row for each alarm of a field."""
    out = folds.drift(_field_rates(spark, d), ["source", "field"], "batch", "rate").select("source", "field", F.explode("alarms").alias("a"))
    return out.select("source", "field", "a.batch", F.round("a.rate", 4).alias("rate"), F.round("a.baseline", 4).alias("baseline"), F.round("a.z", 3).alias("z"), F.lit("quarantine").alias("action"))


@query(_DRIFT6 + " SELECT source, batch, count(*) AS fields, string_agg(field, ',' ORDER BY field) AS drifted FROM f WHERE bad GROUP BY source, batch")
def drift_events(spark, d):
    """One event for a batch whose fields drifted."""
    out = folds.drift(_field_rates(spark, d), ["source", "field"], "batch", "rate").select("source", "field", F.explode("alarms.batch").alias("batch"))
    return out.groupBy("source", "batch").agg(F.count(F.lit(1)).alias("fields"), F.array_join(F.array_sort(F.collect_list("field")), ",").alias("drifted"))


@query(_DRIFT6 + " SELECT source, field, round(mean, 3) AS baseline, n FROM f WHERE (source, field, i) IN (SELECT source, field, max(i) FROM e GROUP BY ALL)")
def drift_baseline(spark, d):
    return folds.drift(_field_rates(spark, d), ["source", "field"], "batch", "rate").select("source", "field", F.round("mean", 3).alias("baseline"), "n")


# ---- breaker with cooldown, and the policy


_VERDICT = "CASE event_type WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'error' WHEN 2 THEN 'suspect' ELSE 'drift' END WHEN 'signup' THEN 'skipped' ELSE CASE WHEN event_id % 31 = 0 THEN 'deferred' WHEN event_id % 97 = 0 THEN 'reset' ELSE 'clean' END END"
_ALLOWED = "(breaker <> 'open' OR least(90 * pow(2, greatest(fails, 1) - 1), 1800) - (sec - coalesce(opened_at, 0)) <= 0)"


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) / 1e6 / 1000 AS sec, {_VERDICT} AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (
    SELECT user_id, CAST(0 AS BIGINT) AS i, 'closed' AS breaker, CAST(0 AS BIGINT) AS fails, CAST(NULL AS DOUBLE) AS opened_at, CAST(1 AS DOUBLE) AS health, 0 AS rung, CAST(0 AS BIGINT) AS asked, CAST(0 AS BIGINT) AS denied FROM (SELECT DISTINCT user_id FROM events)
    UNION ALL SELECT user_id, i, CASE WHEN v = 'reset' THEN 'closed' WHEN NOT ok THEN breaker WHEN v = 'clean' THEN 'closed' WHEN v = 'blocked' THEN 'open' WHEN v IN ('error', 'suspect') AND fails + 1 >= 3 THEN 'open' WHEN breaker = 'closed' THEN 'closed' ELSE 'half_open' END,
        CASE WHEN v = 'reset' THEN 0 WHEN NOT ok THEN fails WHEN v = 'clean' THEN 0 WHEN v IN ('blocked', 'error', 'suspect') THEN fails + 1 ELSE fails END,
        CASE WHEN v = 'reset' THEN NULL WHEN NOT ok THEN opened_at WHEN v = 'clean' THEN NULL WHEN v = 'blocked' THEN sec WHEN v IN ('error', 'suspect') AND fails + 1 >= 3 THEN sec ELSE opened_at END,
        CASE WHEN v = 'reset' THEN 1 WHEN NOT ok THEN health WHEN v = 'clean' THEN least(1.0, health * 0.7 + 0.3) WHEN v IN ('error', 'suspect') THEN CASE WHEN fails + 1 >= 3 THEN health * 0.6 ELSE health * 0.85 END ELSE health END,
        CASE WHEN v = 'reset' OR NOT ok OR v = 'deferred' THEN rung WHEN v = 'clean' THEN greatest(rung - 1, 0) ELSE least(rung + 1, 2) END,
        CASE WHEN v = 'reset' OR NOT ok THEN asked ELSE asked + 1 END, CASE WHEN v <> 'reset' AND NOT ok THEN denied + 1 ELSE denied END
    FROM (SELECT *, {_ALLOWED} AS ok FROM (SELECT f.*  EXCLUDE (i), f.i + 1 AS i, e.sec, e.v FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)))
    SELECT user_id, breaker, fails, round(opened_at, 3) AS opened_at, round(health, 6) AS health, rung, asked, denied FROM f WHERE (user_id, i) IN (SELECT user_id, max(i) FROM e GROUP BY user_id)""")
def poll_policy(spark, d):
    """What the scheduler's policy makes of every source's polls: breaker with cooldown and probes, health, rung, denials."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 1000).alias("sec"), F.expr(_VERDICT).alias("v"), F.lit(None).cast("int").alias("status"))
    out = circuit.run_policy(e, "user_id", "sec", "v", "status", ["event_id"])
    return out.select("user_id", "breaker", "fails", F.round("opened_at", 3).alias("opened_at"), F.round("health", 6).alias("health"), "rung", "asked", "denied")


@query("""WITH s AS (SELECT s_suppkey AS source, CASE s_suppkey % 3 WHEN 0 THEN 'closed' WHEN 1 THEN 'open' ELSE 'half_open' END AS state, s_nationkey % 7 AS fails, CAST(s_suppkey AS DOUBLE) AS opened_at FROM supplier),
    c AS (SELECT *, least(90 * pow(2, greatest(fails, 1) - 1), 1800) - (500 - opened_at) AS wait FROM s)
    SELECT source, NOT (state = 'open' AND wait > 0) AS allowed, CASE WHEN state = 'open' AND wait > 0 THEN 'open' WHEN state = 'closed' THEN 'closed' ELSE 'half_open' END AS after, round(CASE WHEN state = 'open' AND wait > 0 THEN wait ELSE 0 END, 3) AS retry_after FROM c""")
def breaker_check(spark, d):
    n = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(n.alias("source"), F.when(n % 3 == 0, "closed").when(n % 3 == 1, "open").otherwise("half_open").alias("state"), (F.col("s_nationkey") % 7).alias("fails"), n.cast("double").alias("opened_at"))
    ok, after, wait = circuit.check(F.col("state"), F.col("fails"), F.col("opened_at"), F.lit(500.0))
    return s.select("source", ok.alias("allowed"), after.alias("after"), F.round(wait, 3).alias("retry_after"))


@query("""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'closed' WHEN 1 THEN 'open' END AS state, s_acctbal > 0 AS enabled FROM supplier)
    SELECT count(*) AS sources, count(*) FILTER (coalesce(state, 'closed') = 'closed' AND enabled) AS healthy FROM s""")
def healthy_sources(spark, d):
    n = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(F.when(n % 3 == 0, "closed").when(n % 3 == 1, "open").alias("state"), (F.col("s_acctbal") > 0).alias("enabled"))
    return s.agg(F.count(F.lit(1)).alias("sources"), F.count_if((F.coalesce("state", F.lit("closed")) == "closed") & F.col("enabled")).alias("healthy"))


# ---- labels by rules, duplicates, similar postings


@query(f"SELECT id, {_ROLE.format(c='title')} AS role, {_LEVEL.format(c='title')} AS level FROM {JOBS}")
def rule_labels(spark, d):
    return jobs(spark, d).select("id", X.label_role("title").alias("role"), X.label_seniority("title").alias("level"))


def _term_sql(prefix: str, min_df: int, source: str) -> str:
    return f"""{prefix}t AS (SELECT id, term, count(*) AS tf FROM ({source}) GROUP BY ALL), {prefix}f AS (SELECT term, count(*) AS df FROM {prefix}t GROUP BY term HAVING count(*) >= {min_df}),
    {prefix}v AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM j)) / (1 + df)) + 1) AS w FROM {prefix}t JOIN {prefix}f USING (term)), {prefix}w AS (SELECT id, '{prefix}:' || term AS term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {prefix}v)"""


_IDENT = f"""j AS MATERIALIZED (SELECT *, concat_ws(' ', nullif(title, ''), nullif(location, '')) AS doc FROM {JOBS}), ws AS (SELECT id, regexp_extract_all(lower(doc), '[a-z0-9_]{{2,}}') AS x, list_filter(string_split(regexp_replace(lower(doc), '\\s+', ' ', 'g'), ' '), lambda y: y <> '') AS y FROM j),
    {_term_sql('w', 1, "SELECT id, unnest(list_concat(x, list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1]))) AS term FROM ws")},
    {_term_sql('c', 1, "SELECT id, substr(p, i, k) AS term FROM (SELECT id, ' ' || unnest(y) || ' ' AS p FROM ws), range(3, 6) a(k), range(1, 200) b(i) WHERE i + k - 1 <= length(p)")},
    u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT * FROM ww UNION ALL SELECT * FROM cw))"""


@query(f"WITH {_IDENT} SELECT id, term, round(w, 5) AS w FROM u")
def identity_space(spark, d):
    """Words and character n-grams of title and location, side by side."""
    x = jobs(spark, d)
    return search.identity_space(x, "id", x.count()).select("id", "term", F.round("w", 5).alias("w"))


_DUPES = f"""{_IDENT}, bl AS (SELECT id, regexp_replace({C._key('company')}, '( ({'|'.join(X.COMPANY_NOISE)}))+$', '') AS blk, {_LEVEL.format(c='title')} AS lv FROM j WHERE trim(company) <> ''),
    ub AS MATERIALIZED (SELECT doc, blk, lv, min(id) AS rep FROM bl JOIN j USING (id) WHERE blk <> '' GROUP BY ALL), mem AS MATERIALIZED (SELECT id, rep FROM bl JOIN j USING (id) JOIN ub ON ub.doc = j.doc AND ub.blk = bl.blk AND ub.lv IS NOT DISTINCT FROM bl.lv),
    rp AS (SELECT a.rep AS x, b.rep AS y, sum(p.w * q.w) AS score FROM ub a JOIN ub b ON a.blk = b.blk AND a.lv IS NOT DISTINCT FROM b.lv AND a.rep < b.rep JOIN u p ON p.id = a.rep JOIN u q ON q.id = b.rep AND p.term = q.term GROUP BY 1, 2 HAVING sum(p.w * q.w) >= 0.75),
    pairs AS (SELECT least(m.id, n.id) AS a, greatest(m.id, n.id) AS b, score FROM rp JOIN mem m ON m.rep = x JOIN mem n ON n.rep = y UNION ALL SELECT m.id, n.id, 1.0 FROM mem m JOIN mem n ON m.rep = n.rep AND m.id < n.id)"""


@query(f"WITH {_DUPES} SELECT a, b, round(score, 4) AS score FROM pairs")
def duplicate_pairs(spark, d):
    """Near-duplicate postings of one company and one seniority."""
    x = jobs(spark, d)
    return search.find_duplicates(x, "id", x.count()).select("a", "b", F.round("score", 4).alias("score"))


@query(f"""WITH {_DUPES}, s AS (SELECT a, b, ja.first_seen <= jb.first_seen AS early FROM pairs JOIN j ja ON ja.id = a JOIN j jb ON jb.id = b)
    SELECT dup, arg_min(keeper, a * 100000000 + b) AS dup_of FROM (SELECT a, b, CASE WHEN early THEN a ELSE b END AS keeper, CASE WHEN early THEN b ELSE a END AS dup FROM s) GROUP BY dup""")
def dup_survivors(spark, d):
    """Each duplicate and the earlier posting that stands for it."""
    x = jobs(spark, d)
    return search.surviving(x, "id", x.count())


@query(f"""WITH {_IDENT}, s AS (SELECT a.id AS query, b.id, round(sum(a.w * b.w), 6) AS score FROM u a JOIN u b ON a.term = b.term AND a.id <> b.id WHERE a.id % 50 = 0 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) SELECT query, id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM r WHERE rank <= 6 AND score > 0.3""")
def similar_topk(spark, d):
    """The six nearest postings of every fiftieth one."""
    x = jobs(spark, d)
    return search.similar(x, "id", x.where("id % 50 = 0").select("id"), x.count()).select("query", "id", "rank", F.round("score", 4).alias("score"))


@query("""WITH t AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM documents) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), f AS (SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) <= 0.85 * (SELECT n FROM n)),
    v AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM t JOIN f USING (term) CROSS JOIN n), w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM v), x AS MATERIALIZED (SELECT w.*, lang || '/' || source AS blk FROM w JOIN documents ON doc_id = id)
    SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 4) AS score FROM x a JOIN x b ON a.blk = b.blk AND a.term = b.term AND a.id < b.id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.75""")
def near_duplicate_documents(spark, d):
    """Documents of one language and source whose word vectors are near."""
    x = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.concat_ws("/", "lang", "source").alias("blk"), (F.col("lang").isNotNull() & F.col("source").isNotNull()).alias("ok"))
    w = vectors.tfidf(x, "id", vectors.word_terms("text"), x.count(), max_df=0.85)
    return vectors.block_pairs(w, x.where("ok").select("id", "blk"), "id", "blk", 0.75).select("a", "b", F.round("score", 4).alias("score"))


@query("""WITH h AS (SELECT doc_id AS id, n_chars / 20000.0 AS score, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn FROM documents WHERE n_chars / 20000.0 > 0.02)
    SELECT h.id, round(score, 6) AS score, lang, source = 'src0' AS synthetic FROM h JOIN documents ON doc_id = id WHERE rn <= 120 AND source <> 'src1' ORDER BY score DESC, h.id LIMIT 40""")
def search_hits_joined(spark, d):
    """The best 120 hits joined to their rows, then filtered and cut; fewer than 40 may be left."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    hits = docs.select("id", (F.col("n_chars") / 20000.0).alias("score")).where("score > 0.02").orderBy(F.desc("score"), "id").limit(120)
    rows = docs.drop("n_chars").join(F.broadcast(hits), "id")  # 120 rows
    return rows.where("source <> 'src1'").orderBy(F.desc("score"), "id").limit(40).select("id", F.round("score", 6).alias("score"), "lang", (F.col("source") == "src0").alias("synthetic"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = (SELECT min(vec_id) FROM v))
    SELECT vec_id, round(list_inner_product(e, qe) / sqrt(list_inner_product(e, e) * list_inner_product(qe, qe)), 5) AS score FROM v, q""")
def dense_cosine(spark, d):
    """One vector against all."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    one = v.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return v.join(F.broadcast(one)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 5).alias("score"))  # one row is broadcast


# ---- dates, salaries, hiring titles, crawl policies


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00') END AS at FROM orders""")
def parsed_dates(spark, d):
    """Dates in three forms, and one that is no date."""
    n, day = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("timestamp")
    said = F.when(n == 0, F.date_format(day, "yyyy-MM-dd")).when(n == 1, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n == 2, F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(X.parse_date(said), "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query(r"""SELECT p_partkey, regexp_extract('pay $' || CAST(p_size AS VARCHAR) || 'k - $' || CAST(p_size + 9 AS VARCHAR) || 'k a year', '\$\d+k - \$\d+k', 0) AS salary FROM part""")
def salaries(spark, d):
    text = F.concat(F.lit("pay $"), F.col("p_size").cast("string"), F.lit("k - $"), (F.col("p_size") + 9).cast("string"), F.lit("k a year"))
    return table(spark, d, "part").select("p_partkey", X.extract_salary(F.lit(""), text).alias("salary"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS company, CASE WHEN s_suppkey % 3 = 0 THEN 'Head of Design' ELSE s_name || ' news' END AS role, CASE WHEN s_suppkey % 3 = 0 THEN 1.0 ELSE 0.45 END AS confidence FROM supplier""")
def hiring_titles(spark, d):
    title = F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit(" (YC P26) Is Hiring a Head of Design"))).otherwise(F.concat("s_name", F.lit(" news")))
    own = X.hiring_split(title)
    return table(spark, d, "supplier").select("s_suppkey", own["company"].alias("company"), own["role"].alias("role"), own["confidence"].alias("confidence"))


_ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nCrawl-delay: 2\nAllow: /en/1\nDisallow: /en/\nDisallow: /*page$\nDisallow: /fr/8*2\n"


@query(r"""WITH u AS (SELECT page_id, page_id % 5 AS m, coalesce(nullif(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), ''), '/') AS path FROM pages),
    h AS (SELECT *, CASE WHEN starts_with(path, '/en/1') THEN 5 ELSE -1 END AS a, greatest(CASE WHEN starts_with(path, '/en/') THEN 4 ELSE -1 END, CASE WHEN regexp_matches(path, '^/.*page$') THEN 7 ELSE -1 END, CASE WHEN regexp_matches(path, '^/fr/8.*2') THEN 7 ELSE -1 END) AS d FROM u)
    SELECT page_id, m <> 4 AND (m = 3 OR d < 0 OR a >= d) AS allowed, CASE WHEN m = 4 THEN 'unreachable' WHEN m = 3 OR d < 0 THEN 'no match' WHEN a >= d THEN 'allow' ELSE 'disallow' END AS reason FROM h""")
def crawl_policy(spark, d):
    """Every page against its site's policy; sites serve rules, nothing (404), or fail."""
    host = F.concat(F.lit("http://site"), (F.col("page_id") % 5).cast("string"))
    urls = table(spark, d, "pages").select("page_id", F.concat(host, F.regexp_extract("url", "^https?://[^/]+(.*)$", 1)).alias("url"))
    files = spark.createDataFrame([(f"http://site{i}", s, _ROBOTS) for i, s in enumerate((200, 200, 200, 404, 503))], "origin string, status int, body string")
    return policy.crawl_allowed(urls, policy.robots_rules(files), "page_id")


# ---- parsing, normalising and learning: rows only where SQL has no counterpart


@query("SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'broken' ELSE 'ok' END AS state, CASE WHEN page_id % 9 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN page_id % 9 = 0 THEN NULL ELSE 'Remote (EU)' END AS location FROM pages")
def adapter_json(spark, d):
    """Two postings in each body, and bodies that are cut short."""
    job = '{"id":1,"title":"A","company_name":"B","candidate_required_location":"EU","url":"u","tags":["x"],"category":"c"}'
    bodies = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 9 == 0, '{"jobs":[' + job).otherwise('{"jobs":[' + job + ",7," + job + "]}").alias("body"))
    got = adapters.remotive(bodies).groupBy("page_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("location").alias("location"))
    return bodies.select("page_id", F.when(F.col("page_id") % 9 == 0, "broken").otherwise("ok").alias("state")).join(got, "page_id", "left").select("page_id", "state", F.coalesce("n", F.lit(0)).alias("n"), "location")


@query("SELECT doc_id, lang AS company, 'role ' || CAST(doc_id AS VARCHAR) AS title, 'http://x/' || CAST(doc_id AS VARCHAR) AS url, source AS location FROM documents")
def adapter_rss(spark, d):
    """A feed for each document, with a bare ampersand and a namespace."""
    n = F.col("doc_id").cast("string")
    body = F.concat(F.lit('<rss xmlns:m="urn:m"><channel><m:item><title>'), "lang", F.lit(": role "), n, F.lit("</title><link>http://x/"), n, F.lit("</link><region>"), "source", F.lit("</region><description>a & b</description></m:item></channel></rss>"))
    return adapters.weworkremotely(table(spark, d, "documents").select("doc_id", body.alias("body"))).select("doc_id", "company", "title", "url", "location")


def _raw(spark, d) -> DataFrame:
    n = F.col("id")
    return jobs(spark, d).select(
        F.concat(F.lit("s"), "source_no").alias("source"), "title", "company", "location", F.when(n % 11 == 0, " ").otherwise(F.concat(F.lit("http://j/"), n)).alias("url"), F.lit("<p>Work from home</p>").alias("description"),
        F.lit("2024-05-01").alias("posted_at"), F.array(F.lit(" a "), F.lit("b")).alias("tags"), F.lit(1.0).alias("confidence"), n.cast("string").alias("source_job_id"),
    )


@query(f"SELECT 's' || source_no AS source, count(*) FILTER (id % 11 = 0) AS rejected, count(*) AS total FROM {JOBS} GROUP BY 1")
def normalise_rejects(spark, d):
    rows = normalise.normalise(_raw(spark, d), F.lit("2024-06-01").cast("timestamp"))
    return rows.groupBy("source").agg(F.count_if("rejected").alias("rejected"), F.count(F.lit(1)).alias("total"))


@query(f"""WITH n AS (SELECT id, 's' || source_no AS source, title, trim(company) AS company, location, substr(sha1(concat_ws('|', {C._company("trim(company)")}, {C._title('title')}, split_part({C._key('location')}, ' ', 1))), 1, 20) AS canonical_id FROM {JOBS} WHERE id % 11 <> 0),
    b AS (SELECT canonical_id, arg_min(source, id) AS source, arg_min(title, id) AS title FROM n GROUP BY canonical_id), s AS (SELECT DISTINCT canonical_id, 1 AS k FROM n WHERE id % 2 = 0)
    SELECT t.source, count(b.canonical_id) FILTER (s.k IS NULL) AS new, count(b.canonical_id) FILTER (s.k IS NOT NULL) AS known, t.rejected, t.total
    FROM (SELECT 's' || source_no AS source, count(*) FILTER (id % 11 = 0) AS rejected, count(*) AS total FROM {JOBS} GROUP BY 1) t LEFT JOIN b ON b.source = t.source LEFT JOIN s ON s.canonical_id = b.canonical_id GROUP BY ALL""")
def write_report(spark, d):
    """What a batch writes against a snapshot that holds the keys of every other posting: new, known (updated or touched), rejected, total."""
    raw = _raw(spark, d).withColumn("id", F.col("source_job_id").cast("long"))
    rows = normalise.normalise(raw, F.lit("2024-06-01").cast("timestamp"))
    ok = normalise.accepted(rows).withColumn("_pos", F.col("source_job_id").cast("long"))
    old = ok.where("_pos % 2 = 0").select("canonical_id", "payload_hash").dropDuplicates(["canonical_id"])
    best = merge.best_of_batch(ok, "canonical_id", "confidence", "_pos")
    done = merge.classify(best, old, "canonical_id", "payload_hash").groupBy("source").agg(F.count_if(F.col("action") == "new").alias("new"), F.count_if(F.col("action") != "new").alias("known"))
    total = rows.groupBy("source").agg(F.count_if("rejected").alias("rejected"), F.count(F.lit(1)).alias("total"))
    return total.join(done, "source", "left").select("source", F.coalesce("new", F.lit(0)).alias("new"), F.coalesce("known", F.lit(0)).alias("known"), "rejected", "total")


def _responses(spark, d) -> DataFrame:
    n = F.col("page_id")
    return trust.response_features(table(spark, d, "pages").select(
        n, F.col("html").alias("body"), F.when(n % 13 == 0, 403).when(n % 7 == 0, 301).otherwise(200).alias("status"), F.when(n % 4 == 0, "application/json").otherwise("text/html").alias("content_type"), F.when(n % 3 == 0, "json").otherwise("html").alias("expected_content"),
        (n % 40).cast("int").alias("items"), (n % 900).cast("double").alias("latency_ms"), (n % 3).cast("int").alias("n_redirects"), F.when(n % 5 == 0, "__cf_bm=x").alias("set_cookie"), F.when(n % 13 == 0, "60").alias("retry_after"), F.lit(25.0).alias("median_items"), F.lit(400.0).alias("median_latency_ms"),
    ))


_STATUS = "CASE WHEN page_id % 13 = 0 THEN 403 WHEN page_id % 7 = 0 THEN 301 ELSE 200 END"
_COUNT = lambda tokens, c: " + ".join(f"CAST(contains({c}, '{t}') AS INTEGER)" for t in tokens)


@query(f"""WITH p AS (SELECT page_id, html, lower(substr(html, 1, 8192)) AS h, {_STATUS} AS status, CASE WHEN page_id % 4 = 0 THEN 'application/json' ELSE 'text/html' END AS ct, CASE WHEN page_id % 3 = 0 THEN 'json' ELSE 'html' END AS want FROM pages)
    SELECT page_id, CAST(status = 200 AS DOUBLE) AS is_2xx, CAST(status = 301 AS DOUBLE) AS is_3xx, CAST(status = 403 AS DOUBLE) AS is_403, CAST(0 AS DOUBLE) AS is_429, CAST(0 AS DOUBLE) AS is_5xx, CAST(contains(ct, want) AS DOUBLE) AS ctype_match, CAST(want = 'json' AND contains(ct, 'html') AS DOUBLE) AS ctype_html_when_json,
    CAST(page_id % 5 = 0 AS DOUBLE) AS has_challenge_cookie, CAST(page_id % 13 = 0 AS DOUBLE) AS has_retry_after, round(ln(1 + length(html)), 6) AS log_body_len, CAST({_COUNT(trust.BLOCK_TOKENS, 'h')} AS DOUBLE) AS n_block_tokens, CAST(({_COUNT(trust.CAPTCHA_TOKENS, 'h')}) > 0 AS DOUBLE) AS has_captcha_token,
    round(len(regexp_extract_all(substr(html, 1, 16384), '<[a-zA-Z/!][^>]{{0,80}}>')) / greatest(length(html), 1) * 1000.0, 6) AS tag_density, round(len(list_distinct(string_split(substr(html, 1, 4096), ''))) / 96.0, 6) AS char_diversity, round(length(regexp_extract(h, '(?s)<title[^>]*>(.{{0,200}}?)</title>', 1)) / 100.0, 6) AS title_len,
    CAST(length(html) < 512 AS DOUBLE) AS body_is_tiny, round(ln(1 + page_id % 40), 6) AS log_items, round(least((page_id % 40) / 25.0, 3.0), 6) AS items_vs_median, round(least((page_id % 900) / 400.0, 5.0), 6) AS latency_vs_median, CAST(page_id % 3 AS DOUBLE) AS n_redirects, round(ln(26.0), 6) AS log_median_items FROM p""")
def response_features(spark, d):
    """All 21 features of each response."""
    return _responses(spark, d).select("page_id", *[F.round(c, 6).alias(c) for c in blocks.FEATURES])


@query(f"SELECT page_id, CASE WHEN {_STATUS} = 403 OR page_id % 40 = 0 THEN 1.0 ELSE 0.0 END AS block_prob FROM pages")
def block_fallback(spark, d):
    """The plain rule that stands in before a model is ready."""
    return blocks.BlockClassifier().score(_responses(spark, d)).select("page_id", "block_prob")


@query()
def block_verdicts(spark, d):
    """A trained classifier's probability, verdict and reasons for each response."""
    model = blocks.BlockClassifier().fit(spark)
    out = model.explain(model.score(_responses(spark, d)))
    return out.select("page_id", F.round("block_prob", 6).alias("block_prob"), trust.verdict("block_prob").alias("verdict"), F.to_json("reasons").alias("reasons"))


@query()
def block_model(spark, d):
    """Held-out quality and the largest weights of the classifier, which learns from generated responses."""
    m = blocks.BlockClassifier().fit(spark).metrics
    rows = [(k, float(v)) for k, v in m.items() if k != "top_weights"] + [(f"weight {k}", float(v)) for k, v in m["top_weights"].items()]
    return spark.createDataFrame(rows, "name string, value double")


@query()
def tagged_jobs(spark, d):
    """Role and seniority of each posting: the rules', else the model's where it is sure."""
    out, _ = tagger.tag(jobs(spark, d), "id", cross_validate=False)
    return out if out is not None else jobs(spark, d).select("id", F.lit(None).cast("string").alias("role_family"), F.lit(None).cast("string").alias("seniority"))


@query(f"""WITH l AS (SELECT id, {_ROLE.format(c='title')} AS role FROM {JOBS}), c AS (SELECT role, count(*) AS n FROM l WHERE role IS NOT NULL GROUP BY role)
    SELECT role, n, n >= 3 AS kept, round((SELECT count(role) FROM l) / (SELECT count(*) FROM l), 3) AS coverage FROM c""")
def class_coverage(spark, d):
    """Classes of the rules' labels, which of them a model may learn, and the share of rows with one."""
    x = jobs(spark, d).select(X.label_role("title").alias("role"))
    share = x.agg(F.round(F.count("role") / F.count(F.lit(1)), 3).alias("coverage"))
    return x.where("role IS NOT NULL").groupBy("role").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.col("n") >= tagger.MIN_CLASS).join(F.broadcast(share))  # one row is broadcast


@query()
def latent_search(spark, d):
    """The twenty nearest conversation turns of a query in the reduced space."""
    x = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    index = search.LatentIndex(x, "id", F.substring("text", 1, 600), dims=48, most=3000)
    asked = table(spark, d, "benchmark").orderBy("item_id").select("text").first()
    return index.search(spark, asked["text"]).select("id", F.round("score", 4).alias("score"))


@query()
def synthetic_board(spark, d):
    """The synthetic board through its page: rendered, parsed and normalised."""
    raw = adapters.board_html(board.render_html(board.postings(spark), 3)).withColumn("source", F.lit("board"))
    return normalise.accepted(normalise.normalise(raw, F.lit("2025-01-15").cast("timestamp"))).select("canonical_id", "title", "company", "location", "url", "confidence", "remote")


@query()
def thompson_tier(spark, d):
    """A pace tier for each source, drawn from its posteriors."""
    e = table(spark, d, "events").select(F.col("user_id").alias("source"), F.element_at(F.array(*map(F.lit, ("brisk", "steady", "gentle"))), (F.col("event_id") % 3 + 1).cast("int")).alias("tier"), "ts", "event_id", "event_type")
    return blocks.thompson(folds.bandit(e, ["source", "tier"], ["ts", "event_id"], ~C.failed()))


@query("SELECT user_id AS source, CAST(2 + count(*) FILTER (event_type <> 'error') AS DOUBLE) AS alpha, CAST(1 + count(*) FILTER (event_type = 'error') AS DOUBLE) AS beta, round((2 + count(*) FILTER (event_type <> 'error')) / (3.0 + count(*)), 3) AS mean, round(CAST(count(*) AS DOUBLE), 1) AS n FROM events GROUP BY user_id")
def bandit_snapshot(spark, d):
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("source")).agg((2 + F.count_if(~C.failed())).cast("double").alias("alpha"), (1 + F.count_if(C.failed())).cast("double").alias("beta"))
    return blocks.posterior(g.withColumn("tier", F.lit("steady")), {"steady": (2.0, 1.0)}).drop("tier")
