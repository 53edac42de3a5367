"""Payloads of every board, malformed ones too, and the synthetic board through all three of its forms."""

import pytest
from pyspark.sql import functions as F

from sluice.operators import normalise
from sluice.sources import adapters, board


def bodies(spark, *texts):
    return spark.createDataFrame([("s", t) for t in texts], "source string, body string")


def test_remotive(spark):
    body = '{"jobs":[{"id":7,"title":"A","company_name":"B","candidate_required_location":"USA","url":"u","publication_date":"2024-01-02","tags":["x"],"category":"c"},{"title":"D","tags":"no list"},5,"x",null]}'
    got = adapters.remotive(bodies(spark, body, "{broken", None, "[]", '{"jobs":{}}')).orderBy("title").collect()
    assert [(r.source, r.source_job_id, r.title, r.company, r.location, r.remote, r.tags) for r in got] == [("s", "7", "A", "B", "Remote (USA)", "true", ["x", "c"]), ("s", "", "D", None, "Remote", "true", [])]


def test_arbeitnow(spark):
    body = '{"data":[{"slug":"a","title":"T","created_at":1700000000,"remote":true,"tags":["x"],"job_types":{"1":"m"}},{"slug":"b","tags":"w","job_types":null},{"slug":"c","tags":"","job_types":[]}]}'
    got = {r.source_job_id: r for r in adapters.arbeitnow(bodies(spark, body)).collect()}
    assert [got[k].tags for k in "abc"] == [["x", "m"], ["w"], []]
    assert got["a"].posted_at == "1700000000" and [got[k].remote for k in "ab"] == ["true", "false"]


def test_hackernews(spark):
    body = '{"hits":[{"objectID":"1","title":"Acme (YC S21) is hiring a Backend Engineer","url":"u"},{"objectID":"2","title":"Something else"}]}'
    a, b = adapters.hackernews(bodies(spark, body)).orderBy("source_job_id").collect()
    assert (a.company, a.title, a.url, a.confidence, a.tags) == ("Acme", "Backend Engineer", "u", 1.0, ["yc"])
    assert (b.company, b.title, b.url, b.confidence) == (None, "Something else", "https://news.ycombinator.com/item?id=2", 0.45)


def test_rss_and_atom(spark):
    rss = "<rss><channel><item><title>Acme: Data & ML Engineer</title><link>u</link><guid>g</guid></item><x><item><title>No colon here</title><link>v</link><region>EU</region><category>c</category></item></x></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>B: Role one</title><link href="http://l"/><summary>s</summary><updated>2024-01-01</updated></entry></feed>'
    got = adapters.weworkremotely(bodies(spark, rss, atom, "not xml", None, rss[:150])).collect()
    assert [(r.company, r.title, r.location, r.url) for r in got[:3]] == [("Acme", "Data & ML Engineer", "Anywhere", "u"), (None, "No colon here", "EU", "v"), ("B", "Role one", "Anywhere", "http://l")]
    assert got[1].tags == ["c"] and got[2].posted_at == "2024-01-01" and got[2].description == "s"
    assert [r.title for r in got[3:]] == ["Data & ML Engineer"]


@pytest.mark.parametrize("title,want", [("Eng: Platform", ("Eng", "Platform")), ("A: B", (None, "A: B")), ("x" * 46 + ": role", (None, "x" * 46 + ": role")), (": role here", (None, ": role here"))])
def test_title_split(spark, title, want):
    r = adapters.weworkremotely(bodies(spark, f"<a><item><title>{title}</title></item></a>")).first()
    assert (r.company, r.title) == want


def test_udtf(spark):
    adapters.register(spark)
    bodies(spark, "<a><item><title>B: Role</title></item></a>").createOrReplaceTempView("payloads")
    got = spark.sql("SELECT source, i.title, i.company FROM payloads, LATERAL parse_items('rss', body) i").collect()
    assert [tuple(r) for r in got] == [("s", "Role", "B")]


@pytest.mark.parametrize("version,confidence", [(1, 1.0), (2, None), (3, None)])
def test_board_html(spark, version, confidence):
    rows = board.postings(spark).where("id < 'sbx-010'")
    want = {(r.title, r.company, r.location, r.url, r.description) for r in rows.collect()}
    got = adapters.board_html(board.render_html(rows, version)).collect()
    assert {(r.title, r.company, r.location, r.url, r.description) for r in got} == want
    assert {r.source_job_id for r in got} == {u[3].rpartition("/")[2] for u in want}
    assert all(r.confidence == 1.0 if confidence else r.confidence < 1.0 for r in got)


def test_board_json_and_rss(spark):
    rows = board.postings(spark)
    want = {(r.id, r.title, r.company) for r in rows.collect()}
    assert len(want) == 51
    assert {(r.source_job_id, r.title, r.company) for r in adapters.board_json(board.render_json(rows)).collect()} == want
    assert {(r.source_job_id, r.title, r.company) for r in adapters.board_rss(board.render_rss(rows)).collect()} == want
    assert adapters.board_html(bodies(spark, "<html><body>No items</body></html>", None, "")).count() == 0


def test_normalise(spark):
    raw = spark.createDataFrame([("s", " <b>A</b> &amp; B ", "Acme, Inc.", "Remote", "u", "pay $90k", None), ("s", " ", "c", "l", "u", None, None), ("s", "t", "c", "l", "", None, ["a"])], "source string, title string, company string, location string, url string, description string, tags array<string>")
    rows = normalise.normalise(raw, F.lit("2024-01-01").cast("timestamp"))
    r = normalise.accepted(rows).first()
    assert (r.title, r.company, r.remote, r.salary_text, r.tags, r.confidence) == ("A & B", "Acme, Inc.", 1, "$90k", "[]", 1.0)
    assert rows.where("rejected").count() == 2
    first = normalise.report(rows, normalise.accepted(rows).limit(0)).first()
    again = normalise.report(rows, normalise.accepted(rows)).first()
    assert tuple(first) == ("s", 1, 0, 0, 2, 3) and tuple(again) == ("s", 0, 0, 1, 2, 3)


def test_many_tags(spark):
    raw = spark.createDataFrame([("s", "t", "u", [f" t{i} " for i in range(20)])], "source string, title string, url string, tags array<string>")
    r = normalise.normalise(raw, F.lit("2024-01-01").cast("timestamp")).first()
    assert r.tags == "[" + ",".join(f'"t{i}"' for i in range(12)) + "]" and r.company is None
