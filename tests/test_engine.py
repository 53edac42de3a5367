"""Breaker, policy, folds, duplicates, search and the learned operators on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.functions import text as X
from sluice.ml import blocks, tagger
from sluice.operators import circuit, folds, policy, search
from sluice.sources import board


def test_cooldown_and_probe(spark):
    rows = [("closed", 0, 0.0, 5.0, True, "closed"), ("open", 3, 0.0, 100.0, False, "open"), ("open", 3, 0.0, 360.0, True, "half_open"), ("open", 0, 0.0, 89.0, False, "open"), ("open", 50, 0.0, 1799.0, False, "open"), ("open", 50, 0.0, 1800.0, True, "half_open"), ("half_open", 9, 0.0, 0.0, True, "half_open")]
    df = spark.createDataFrame(rows, "s string, f int, o double, now double, ok boolean, after string")
    ok, after, wait = circuit.check(F.col("s"), F.col("f"), F.col("o"), F.col("now"))
    assert df.where((ok != F.col("ok")) | (after != F.col("after")) | ((wait > 0) == F.col("ok"))).count() == 0


def test_policy_fold(spark):
    polls = [("a", i, float(t), v, s) for i, (t, v, s) in enumerate([(0, "clean", 200), (10, "error", 500), (20, "suspect", 200), (30, "empty", 200), (40, "clean", 200), (400, "clean", 200), (410, "blocked", 200), (411, "reset", None), (412, "skipped", 200), (413, "error", 403)])]
    r = circuit.run_policy(spark.createDataFrame(polls, "k string, id long, at double, v string, s int"), "k", "at", "v", "s", ["id"]).first()
    # the poll at 40 is denied, that at 400 is the probe that closes, 410 opens, the reset clears, 403 opens again
    assert (r.breaker, r.fails, r.opened_at, r.denied, r.asked, r.rung) == ("open", 1, 413.0, 1, 8, 2) and r.health == 1.0


def test_clamped_sum_in_slices(spark):
    rng = random.Random(2)
    rows = [("k%d" % (i % 3), i, rng.choice((-1, 1, 1))) for i in range(400)]
    want = {}
    for k, _, d in rows:
        want[k] = min(3, max(0, want.get(k, 0) + d))
    df = spark.createDataFrame(rows, "k string, i long, d int")
    for size in (1, 7, 1000):
        got = folds.clamped_sum(df, ["k"], ["i"], F.expr(f"i div {size}"), F.col("d"), 0, 3).collect()
        assert {r.k: r.value for r in got} == want


@pytest.mark.parametrize("path,allowed", [("/", True), ("/private/x", False), ("/private/open/x", True), ("/a/b.pdf", False), ("/a/b.pdf?x", False), ("/a/b.pdfx", True), ("", True)])
def test_robots(spark, path, allowed):
    text = "Disallow: /ignored\nUser-agent: bot\nUser-agent: *\nDisallow: /private # here\nAllow: /private/open\nDisallow: /*.pdf$\nCrawl-delay: 1.5\nCrawl-delay: x\n\nUser-agent: other\nDisallow: /\n"
    files = spark.createDataFrame([("http://h", 200, text)], "origin string, status int, body string")
    rules = policy.robots_rules(files, "bot")
    assert {r.delay for r in rules.collect()} == {1.5}
    got = policy.crawl_allowed(spark.createDataFrame([(1, f"http://h{path}")], "id int, url string"), rules, "id").first()
    assert got.allowed == allowed


@pytest.mark.parametrize("status,body,allowed", [(404, None, True), (500, "", False), (None, None, False), (200, "", True), (200, "User-agent: *\nDisallow:\n", True)])
def test_robots_defaults(spark, status, body, allowed):
    rules = policy.robots_rules(spark.createDataFrame([("http://h", status, body)], "origin string, status int, body string"))
    urls = spark.createDataFrame([(1, "http://h/x"), (2, "http://unknown/x")], "id int, url string")
    assert {r.id: r.allowed for r in policy.crawl_allowed(urls, rules, "id").collect()} == {1: allowed, 2: False}


def test_text_helpers(spark):
    df = spark.createDataFrame([("Café Ñandú Øre &eacute; &amp; <b>x</b>", "http://h/a/b")], "t string, u string")
    r = df.select(X.without_accents("t").alias("plain"), X.clean_text("t", every_entity=True).alias("all"), X.last_segment("u").alias("last"), F.length(X.client_key("u")).alias("n")).first()
    assert r.plain.startswith("Cafe Nandu") and r["all"] == "Café Ñandú Øre é & x" and (r.last, r.n) == ("b", 12)


def jobs(spark):
    rows = board.postings(spark).withColumn("first_seen", F.when(F.col("id").startswith("sbx-dup"), 2).otherwise(1))
    blank = rows.limit(1).withColumn("company", F.lit("  ")).withColumn("id", F.lit("blank"))
    twin = rows.where("id = 'sbx-004'")
    return rows.unionByName(blank).unionByName(twin.withColumn("id", F.lit("twin"))).unionByName(twin.withColumn("id", F.lit("plain")).withColumn("title", F.lit("Golang Developer")))


def test_duplicates(spark):
    x = jobs(spark).cache()
    pairs = search.find_duplicates(x, "id", x.count(), 0.6).cache()
    found = {(r.a, r.b) for r in pairs.collect()}
    assert ("sbx-004", "twin") in found  # equal documents
    assert not any("blank" in p for p in found)
    assert ("plain", "sbx-004") not in found and ("plain", "twin") not in found  # another seniority
    assert ("sbx-004", "twin") in {(r.a, r.b) for r in search.find_duplicates(x, "id", x.count()).collect()}
    kept = {r.dup: r.dup_of for r in search.survivors(pairs, x, "id").collect()}
    assert kept["twin"] == "sbx-004" and not set(kept) & {a for a, b in found if a not in {d for d in kept}}


def test_latent_index(spark):
    x = board.postings(spark).cache()
    text = search.search_document()
    index = search.LatentIndex(x, "id", text, dims=20)
    got = index.search(spark, "payments backend", 5).collect()
    titles = {r.id: r.title for r in x.collect()}
    assert got and all("Payments Backend" in titles[r.id] for r in got[:3]) and [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    assert index.search(spark, "   ").count() == 0 and index.search(spark, "zzzzqqqq").count() == 0
    near = index.similar("sbx-dup-0", 3).collect()
    assert any("Payments Backend" in titles[r.id] for r in near) and all(r.id != "sbx-dup-0" for r in near)
    assert index.similar("none") is None and 0 < index.status()["explained_variance"] <= 1
    small = search.LatentIndex(x.limit(11), "id", text)
    assert not small.ready and small.search(spark, "x") is None and small.status() == {"ready": False, "n_docs": 11}


def test_block_classifier(spark):
    model = blocks.BlockClassifier()
    rows = blocks.split(blocks.trust.response_features(blocks.generated(spark, 200)))
    plain = model.score(rows)
    assert plain.where((F.col("block_prob") == 1) != (F.col("status").isin(403, 429) | (F.col("items") == 0))).count() == 0
    assert model.explain(plain).where("size(reasons) > 0").count() == 0
    model.fit(spark, 600)
    # The least held-out quality.
    assert model.metrics["precision"] >= 0.9 and model.metrics["recall"] >= 0.9 and len(model.metrics["top_weights"]) == 8
    told = model.explain(model.score(rows)).select("reasons").first()[0]
    assert len(told) == 4 and [abs(r.part) for r in told] == sorted((abs(r.part) for r in told), reverse=True)


def test_tagger(spark):
    few, said = tagger.tag(board.postings(spark).limit(39), "id")
    assert few is None and not said["trained"]
    out, m = tagger.tag(board.postings(spark), "id", cross_validate=False)
    got = {r.id: r for r in out.collect()}
    rules = {r.id: (r.a, r.b) for r in board.postings(spark).select("id", X.label_role(search.label_text()).alias("a"), X.label_seniority(search.label_text()).alias("b")).collect()}
    assert len(got) == 51 and m["trained"] and 0 < m["role_family_coverage"] < 1
    assert all(a is None or got[i].role_family == a for i, (a, _) in rules.items()) and all(b is None or got[i].seniority == b for i, (_, b) in rules.items())


def test_draws_repeat(spark):
    rows = spark.createDataFrame([("s", "a", 50.0, 1.0), ("s", "b", 1.0, 50.0), ("t", "a", 1.0, 50.0), ("t", "b", 50.0, 1.0)], "source string, tier string, alpha double, beta double")
    got = lambda: sorted(map(tuple, blocks.thompson(rows).collect()))
    assert got() == got() == [("s", "a"), ("t", "b")]
    gaps = spark.range(200).select(blocks.next_gap(F.lit(1.0), F.lit(1.0), F.lit(2), F.col("id")).alias("low"), blocks.next_gap(F.lit(600.0), F.lit(1.0), F.lit(14), F.col("id")).alias("g"), blocks.retry_gap(F.lit(4.0), F.col("id")).alias("r"))
    r = gaps.agg(F.min("low"), F.max("low"), F.expr("percentile(g, 0.5)"), F.min("r"), F.max("r")).first()
    assert r[0] == 5.0 and 450 < r[2] < 750 and 1 <= r[3] and r[4] <= 12
