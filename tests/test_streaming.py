"""A stream's result equals the batch's; repeated batches and restarts too."""

from sluice.streaming import feeds


def drain(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_upsert(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "k long, price double, conf double, pos long, seen long"
    rows = [(1, 1.0, 0.5, 1, 10), (1, 2.0, 0.9, 2, 10), (2, 5.0, 1.0, 3, 10)], [(2, 6.0, 1.0, 4, 20), (3, 7.0, 1.0, 5, 20)], [(9, 1.0, 1.0, 6, 30)]
    table = feeds.Snapshot(spark, str(tmp_path / "out"), "k", buckets=4, keep=2)
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        q = feeds.upsert_stream(spark, spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), "k", "conf", "pos", "seen", buckets=4).trigger(availableNow=True).start()
        q.awaitTermination()
    said = lambda: {r.k: (r.price, r.first_seen, r.last_seen) for r in table.read().collect()}
    want = {1: (2.0, 10, 10), 2: (6.0, 10, 20), 3: (7.0, 20, 20), 9: (1.0, 30, 30)}
    assert said() == want
    # the last batch again gives the same rows
    from sluice.operators import merge

    table.apply(merge.best_of_batch(spark.createDataFrame(rows[-1], schema), "k", "conf", "pos"), table.versions()[-1], "seen")
    assert said() == want


def test_old_versions_go(spark, tmp_path):
    table = feeds.Snapshot(spark, str(tmp_path), "k", buckets=2, keep=2)
    for epoch in range(5):
        table.apply(spark.createDataFrame([(1, float(epoch), epoch)], "k long, v double, seen long"), epoch, "seen")
    assert table.versions() == [3, 4] and sorted(p.name for p in (tmp_path / "data").iterdir()) == ["v3", "v4"]
    assert [tuple(r)[:2] for r in table.read().select("k", "v").collect()] == [(1, 4.0)]


def test_drift(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", b, 0.0 if b == 8 else 1.0) for b in range(10)], "source string, batch long, rate double").write.parquet(src)
    drain(feeds.drift_stream(spark.readStream.schema("source string, batch long, rate double").parquet(src)), tmp_path, "drift_out")
    assert [r.batch for r in spark.table("drift_out").where("alarm").collect()] == [8]


def test_breaker_and_bandit_across_restarts(spark, tmp_path):
    schema = "source string, id long, failed boolean, ok boolean"
    polls = [("a", i, i % 7 in (2, 3, 4), i % 7 not in (2, 3, 4)) for i in range(80)]
    src = str(tmp_path / "in")
    step, state, want = feeds.breaker_step(), ("closed", 0, 1.0), {}
    for _, i, failed, _ in polls:
        state, want[i] = step(state, (failed,))
    got = {}
    for n, part in enumerate((polls[:30], polls[30:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        out = str(tmp_path / "b-out")
        stream = feeds.breaker_stream(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
        stream.awaitTermination()
        got = {r.id: (r.breaker, round(r.health, 9)) for r in spark.read.parquet(out).collect()}
    assert got == {i: (s, round(h, 9)) for i, (s, h) in want.items()} and {s for s, _ in got.values()} == {"open", "closed"}
    drain(feeds.bandit_stream(spark.readStream.schema(schema).parquet(src)), tmp_path, "bandit_out")
    assert spark.table("bandit_out").where("alpha + beta > 60").count() == 0


def test_what_was_seen_before(spark):
    import hashlib

    batch = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("a", None)], "source string, body string")
    trusted = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest()), ("a", hashlib.sha256(b"").hexdigest())], "source string, sha string")
    assert {tuple(r) for r in feeds.changed_only(batch, trusted).collect()} == {("a", "y"), ("b", "x")}


def test_reindex():
    assert [feeds.reindex_due(e, g) for e, g in ((100, 99), (230, 39), (230, 40), (899, 0), (900, 0))] == [False, False, True, False, True]


def test_tail_and_polling(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(10)], "event_id long").write.parquet(str(tmp_path / "in"))
    stream = feeds.tail(spark.readStream.schema("event_id long").parquet(str(tmp_path / "in")), 6)
    q = feeds.polling(stream.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "c")), 0.1).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in spark.table("tailed").collect()) == [7, 8, 9]
