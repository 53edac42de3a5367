"""A synthetic job board for tests and demonstrations: its postings, and the three forms in which it serves them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPANIES = ("Alder Labs", "Brine Analytics", "Cinder Systems", "Dune AI", "Ember Compute", "Fjord Freight", "Gale Robotics", "Heath Health", "Isle Networks", "Juniper Energy", "Knoll Data", "Loam Optics")
ROLES = ("Payments Backend Engineer", "ML Engineer, Ranking", "Warehouse Data Engineer", "Cloud Engineer", "Senior Golang Developer", "Applied Scientist", "Principal Engineer", "Data Analyst", "Android Engineer", "Junior Web Developer", "Product Manager", "Technical Recruiter")
PLACES = ("Remote (Nordics)", "Porto, PT", "Gdansk, PL", "Remote (Anywhere)", "Leeds, UK", "Denver, CO", "Remote (LATAM)", "Osaka, JP")
AREAS = ("the billing service", "our event store", "the ranking layer", "nightly exports", "the search index", "device sync")
STACKS = ("Go and MySQL", "Spark and Parquet", "Rust and NATS", "Kotlin and gRPC", "Scala and Pulsar")
SALARIES = ("", "$110k - $150k", "€60k - €80k", "₹24 LPA", "£70k")
TAGS = ("golang", "search", "sql", "gcp", "terraform", "etl", "kotlin")
#: Reworded titles of postings that are there already: what the near-duplicate pass must find.
RELISTED = ((0, "Payments Backend Engineer, Core"), (3, "Cloud Engineer (Remote)"), (10, "Product Manager - Growth"))


def _at(values: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))


def _draw(salt: str, seed: int) -> Column:
    return F.xxhash64("id", F.lit(salt), F.lit(seed))


def postings(spark: SparkSession, n: int = 48, seed: int = 424242, as_of: str = "2025-01-15 00:00:00") -> DataFrame:
    """``n`` postings and the re-listings; the same for the same arguments, whatever the partitions."""
    i = F.col("i")
    turn = F.floor(i / len(COMPANIES))
    # role and place run at other periods than the company, so that no two of a round are the same job
    base = spark.range(n).select(F.col("id").alias("i")).select(
        F.format_string("sbx-%03d", "i").alias("id"), _at(ROLES, i + 5 * turn).alias("title"), _at(COMPANIES, i).alias("company"), _at(PLACES, i * 3 + F.floor(i / 7)).alias("location"),
    )
    again = spark.createDataFrame([(f"sbx-dup-{k}", title, COMPANIES[c], "Remote (Global)") for k, (c, title) in enumerate(RELISTED)], base.schema)
    rows = base.unionByName(again)
    blurb = F.concat(F.lit("You will own "), _at(AREAS, _draw("area", seed)), F.lit(" end to end: design, ship and operate it. Expect to touch "), _at(STACKS, _draw("stack", seed)), F.lit(" in your first month. This listing is synthetic."))
    tags = F.slice(F.array_sort(F.array(*[F.struct(F.xxhash64("id", F.lit(t), F.lit(seed)).alias("h"), F.lit(t).alias("t")) for t in TAGS])).getField("t"), 1, 3)
    age = F.pmod(_draw("age", seed), F.lit(15)).cast("int")
    return rows.select(
        "*", F.lower("location").startswith("remote").alias("remote"), F.concat(F.lit("https://board.invalid/jobs/"), "id").alias("url"), blurb.alias("description"), _at(SALARIES, _draw("pay", seed)).alias("salary"),
        F.date_format(F.expr(f"TIMESTAMP '{as_of}'") - F.make_interval(days=age), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("posted_at"), tags.alias("tags"),
    )


def _escaped(c: str) -> Column:
    out = F.col(c)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def _listed(rows: DataFrame, item: Column, head: str, tail: str) -> DataFrame:
    """One body with every row's item, in order of id."""
    body = F.array_join(F.array_sort(F.collect_list(F.struct("id", item.alias("x")))).getField("x"), "")
    return rows.agg(F.concat(F.lit(head), body, F.lit(tail)).alias("body"))


# The marks of the three layouts, by version.
LAYOUTS = {
    1: ('<ul class="jobs">', '<li class="job"><h3 class="job-title">{title}</h3><span class="company">{company}</span><span class="location">{location}</span><p class="desc">{description}</p><a class="apply" href="{url}">Apply</a></li>', "</ul>"),
    2: ('<section id="results">', '<article data-testid="posting"><h2 class="posting__title">{title}</h2><div class="posting__meta"><span data-field="company">{company}</span><span data-field="location">{location}</span></div><div class="posting__body">{description}</div><a data-testid="apply-link" href="{url}">Apply now</a></article>', "</section>"),
    3: ('<div id="root"><div class="_grid7">', '<div class="_1x7fq" data-title="{title}" data-co="{company}"><span class="_9kd2v">{title}</span><span class="_bb31a">{company}</span><span class="_c02mn">{location}</span><p class="_zz9pl">{description}</p><a class="_qq4tt" href="{url}">Apply</a></div>', "</div></div>"),
}


def _filled(pattern: str) -> Column:
    parts = [p for chunk in pattern.split("{") for p in chunk.split("}", 1)]
    return F.concat(*[F.lit(p) if i % 2 == 0 else _escaped(p) for i, p in enumerate(parts)]) if len(parts) > 1 else F.lit(pattern)


def render_html(rows: DataFrame, version: int = 1) -> DataFrame:
    """The board's page as one body, in one of three layouts."""
    head, item, tail = LAYOUTS[version]
    return _listed(rows, _filled(item), f"<html><head><title>Synthetic Board</title></head><body><h1>Open roles</h1>{head}", f"{tail}</body></html>")


def render_json(rows: DataFrame) -> DataFrame:
    item = F.to_json(F.struct("id", "title", "company", "location", "remote", "url", "description", "salary", "posted_at", "tags"))
    all_ = F.array_sort(F.collect_list(F.struct("id", item.alias("x")))).getField("x")
    return rows.agg(F.concat(F.lit('{"count":'), F.count(F.lit(1)).cast("string"), F.lit(',"jobs":['), F.array_join(all_, ","), F.lit("]}")).alias("body"))


def render_rss(rows: DataFrame) -> DataFrame:
    item = "<item><title>{company}: {title}</title><link>{url}</link><guid>{id}</guid><region>{location}</region><description>{description}</description><pubDate>{posted_at}</pubDate></item>"
    return _listed(rows, _filled(item), '<?xml version="1.0"?><rss version="2.0"><channel><title>Synthetic</title>', "</channel></rss>")
