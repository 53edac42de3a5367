"""Is a response a block page? Logistic regression over the 21 response features, trained on generated responses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import trust

FEATURES = (
    "is_2xx", "is_3xx", "is_403", "is_429", "is_5xx", "ctype_match", "ctype_html_when_json", "has_challenge_cookie", "has_retry_after", "log_body_len", "n_block_tokens",
    "has_captcha_token", "tag_density", "char_diversity", "title_len", "body_is_tiny", "log_items", "items_vs_median", "latency_vs_median", "n_redirects", "log_median_items",
)

#: Kinds of generated responses: cumulative share, label. The shares are fixed values.
KINDS = (
    ("clean, block words", 0.07, 0), ("clean, small", 0.11, 0), ("clean, quiet source", 0.20, 0), ("blocked, terse", 0.24, 1), ("blocked, long page", 0.28, 1),
    ("clean", 0.64, 0), ("clean, thin", 0.70, 0), ("blocked, challenge", 0.82, 1), ("blocked, silent", 0.92, 1), ("blocked, status", 1.0, 1),
)
_WORDS = ("golang", "platform", "billing", "search", "remote", "senior", "data", "release", "hybrid", "mobile", "support", "network")
_PAGES = (
    "<html><head><title>Just a moment...</title></head><body>Checking your browser. Enable JavaScript. <script src='/challenge-platform/x'></script></body></html>",
    "<html><head><title>Access Denied</title></head><body><h1>Access Denied</h1><p>You lack permission to access this page. Request blocked.</p></body></html>",
    "<html><head><title>Verify</title></head><body>Verify you are human <div class='recaptcha'></div> unusual traffic</body></html>",
    "<html><head><title>Rate limited</title></head><body>Too many requests. Please slow down; please try again later.</body></html>",
    "<html><head><title>Security check</title></head><body>Suspicious activity. Complete the security check.<iframe src='hcaptcha'></iframe></body></html>",
)


def generated(spark: SparkSession, n: int = 1400, seed: int = 20260818) -> DataFrame:
    """``n`` generated responses with label and kind; a row depends on its number and the seed only."""
    u = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    between = lambda salt, a, b: a + u(salt) * (b - a)
    whole = lambda salt, a, b: F.floor(between(salt, a, b + 1)).cast("int")
    pick = lambda salt, values: F.element_at(F.array(*map(F.lit, values)), whole(salt, 1, len(values)))
    cases = lambda of, other: _case(F.col("kind"), of, other)
    kind = None
    for name, upto, _ in KINDS:
        kind = F.when(u("roll") < upto, name) if kind is None else kind.when(u("roll") < upto, name)
    rows = spark.range(n).withColumn("kind", F.coalesce(kind, F.lit(KINDS[-1][0]))).withColumn("fmt", pick("fmt", ("json", "xml", "html")))
    items = cases({"clean, block words": whole("i", 6, 40), "clean, small": whole("i", 2, 5), "clean": whole("i", 8, 60), "clean, thin": whole("i", 1, 4)}, F.lit(0))
    word = lambda i, k: F.element_at(F.array(*map(F.lit, _WORDS)), F.pmod(F.xxhash64("id", i, F.lit(k), F.lit(seed)), F.lit(len(_WORDS))).cast("int") + 1)
    title = lambda i: F.concat_ws(" ", *[word(i, k) for k in range(4)])
    entry = lambda i: F.when(F.col("fmt") == "json", F.format_string('{"id":%d,"title":"%s","company":"Co%d","url":"https://example.test/%d"}', i, title(i), i, i)).when(F.col("fmt") == "xml", F.format_string("<item><title>%s</title><link>https://example.test/%d</link></item>", title(i), i)).otherwise(F.format_string('<li class="job"><h3>%s</h3><a href="/j/%d">apply</a></li>', title(i), i))
    rows = rows.withColumn("fmt", F.when(F.col("kind") == "clean, small", "json").otherwise(F.col("fmt"))).withColumn("items", items)
    entries = F.transform(F.when(F.col("items") > 0, F.sequence(F.lit(1), F.greatest("items", F.lit(1)))).otherwise(F.array().cast("array<int>")), entry)
    list_ = F.when(F.col("fmt") == "json", F.array_join(entries, ",")).otherwise(F.array_join(entries, ""))
    wrap = lambda c: F.when(F.col("fmt") == "json", F.concat(F.lit('{"jobs":['), c, F.lit("]}"))).when(F.col("fmt") == "xml", F.concat(F.lit("<rss><channel>"), c, F.lit("</channel></rss>"))).otherwise(F.concat(F.lit("<html><head><title>Jobs</title></head><body><ul>"), c, F.lit("</ul></body></html>")))
    page = pick("page", _PAGES)
    body = cases({
        "clean, block words": F.concat(wrap(list_), F.lit(" captcha bot detection security check suspicious activity")), "clean, small": F.substring(wrap(list_), 1, 500), "blocked, terse": F.lit("<html><body>Denied.</body></html>"),
        "blocked, long page": F.concat(page, F.repeat(F.lit("<div class='row'><span>Help centre</span></div>"), 120)), "blocked, challenge": page, "blocked, status": page,
    }, wrap(list_))
    html_ = F.col("kind").isin("blocked, terse", "blocked, long page", "blocked, challenge", "blocked, status")
    own_type = F.when(F.col("fmt") == "json", "application/json").when(F.col("fmt") == "xml", "application/rss+xml").otherwise("text/html")
    label = F.lit(0)
    for name, _, y in KINDS:
        label = F.when(F.col("kind") == name, y).otherwise(label)
    return rows.select(
        "id", "kind", label.alias("label"), cases({"blocked, status": pick("status", (403, 429, 503))}, F.lit(200)).alias("status"), body.alias("body"), F.when(html_, "text/html").otherwise(own_type).alias("content_type"),
        F.col("fmt").alias("expected_content"), "items", cases({"blocked, challenge": between("l", 200, 2500), "blocked, terse": between("l", 40, 200), "blocked, long page": between("l", 300, 1200)}, between("l", 80, 800)).alias("latency_ms"),
        cases({"blocked, long page": F.lit(1), "clean": pick("r", (0, 0, 0, 1)), "blocked, challenge": pick("r", (0, 1, 2))}, F.lit(0)).alias("n_redirects"),
        cases({"blocked, challenge": pick("c", ("cf_clearance=z; __cf_bm=q", "datadome=k", "session=abc")), "blocked, long page": F.lit("__cf_bm=q"), "clean, small": F.lit(""), "blocked, silent": F.lit(""), "blocked, terse": F.lit(""), "blocked, status": F.lit("")}, F.lit("session=abc")).alias("set_cookie"),
        F.lit("").alias("retry_after"), cases({"clean, quiet source": between("m", 0.4, 1.6)}, F.lit(25.0)).alias("median_items"), F.lit(400.0).alias("median_latency_ms"),
    ).withColumn("retry_after", F.when(F.col("status") == 429, "60").otherwise(""))


def _case(c: Column, of: dict[str, Column], other: Column) -> Column:
    out = None
    for name, value in of.items():
        out = F.when(c == name, value) if out is None else out.when(c == name, value)
    return out.otherwise(other)


def split(rows: DataFrame, label: str = "label", share: float = 0.25, seed: int = 20260818) -> DataFrame:
    """``rows`` with ``holdout``: the same share of each label, by the order of a hash of the id."""
    r = F.percent_rank().over(Window.partitionBy(label).orderBy(F.xxhash64("id", F.lit(seed)), "id"))
    return rows.withColumn("holdout", r >= 1 - share)


class BlockClassifier:
    """``fit`` makes a ready classifier; before, ``score`` is the plain rule."""

    def __init__(self):
        self.model: PipelineModel | None = None
        self.metrics: dict[str, object] = {}

    def fit(self, spark: SparkSession, n: int = 1400, seed: int = 20260818, c: float = 1.0) -> BlockClassifier:
        rows = split(trust.response_features(generated(spark, n, seed)), seed=seed).cache()
        train, held = rows.where("NOT holdout"), rows.where("holdout")
        count = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
        total = sum(count.values())
        # classes of equal weight, and the penalty of a strength c a row
        weight = F.when(F.col("label") == 1, total / (2 * count[1])).otherwise(total / (2 * count[0]))
        regression = LogisticRegression(featuresCol="z", labelCol="label", weightCol="weight", maxIter=2000, regParam=1 / (c * total), standardization=False)
        stages = [VectorAssembler(inputCols=list(FEATURES), outputCol="x"), StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True), regression]
        self.model = Pipeline(stages=stages).fit(train.withColumn("weight", weight))
        self.metrics = {"n_train": total, "n_holdout": held.count()} | quality(self.score(held)) | {"top_weights": self.top_weights()}
        rows.unpersist()
        return self

    @property
    def weights(self) -> list[float]:
        return self.model.stages[-1].coefficients.toArray().tolist()

    def top_weights(self, n: int = 8) -> dict[str, float]:
        return dict(sorted(((f, round(w, 3)) for f, w in zip(FEATURES, self.weights, strict=True)), key=lambda x: (-abs(x[1]), x[0]))[:n])

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with block_prob; they have the columns of ``trust.response_features``."""
        if self.model is None:
            return rows.withColumn("block_prob", fallback())
        out = self.model.transform(rows).withColumn("block_prob", vector_to_array("probability")[1])
        return out.drop("x", "rawPrediction", "probability", "prediction")

    def explain(self, scored: DataFrame, top: int = 4) -> DataFrame:
        """``scored`` with reasons: the features of the largest part in the decision, by size, with that part."""
        if self.model is None:
            return scored.withColumn("reasons", F.array().cast("array<struct<feature:string,part:double>>"))
        parts = F.zip_with(vector_to_array("z"), F.array(*map(F.lit, self.weights)), lambda a, b: F.round(a * b, 3))
        named = F.zip_with(F.array(*map(F.lit, FEATURES)), parts, lambda f, p: F.struct((-F.abs(p)).alias("k"), f.alias("feature"), p.alias("part")))
        return scored.withColumn("reasons", F.transform(F.slice(F.array_sort(named), 1, top), lambda x: F.struct(x["feature"].alias("feature"), x["part"].alias("part"))))


def fallback() -> Column:
    """The rule for when no model is ready."""
    return F.when(F.col("status").isin(403, 429) | (F.col("items") == 0), 1.0).otherwise(0.0)


def quality(scored: DataFrame, at: float = 0.5) -> dict[str, float]:
    """precision, recall, f1 and avg_precision of rows with label and block_prob."""
    hit, yes = F.col("block_prob") >= at, F.col("label") == 1
    r = scored.agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn")).first()
    p, q = (r.tp / (r.tp + d) if r.tp + d else 0.0 for d in (r.fp, r.fn))
    area = BinaryClassificationEvaluator(rawPredictionCol="block_prob", labelCol="label", metricName="areaUnderPR").evaluate(scored)
    return {"precision": round(p, 3), "recall": round(q, 3), "f1": round(2 * p * q / (p + q), 3) if p + q else 0.0, "avg_precision": round(area, 3)}


def posterior(rows: DataFrame, prior: dict[str, tuple[float, float]], tier: str = "tier") -> DataFrame:
    """mean and n of a Beta posterior (alpha, beta) beyond its tier's prior."""
    known = _case(F.col(tier), {t: F.lit(float(a + b)) for t, (a, b) in prior.items()}, F.lit(2.0))
    total = F.col("alpha") + F.col("beta")
    return rows.select("*", F.round(F.col("alpha") / total, 3).alias("mean"), F.round(total - known, 1).alias("n"))


@F.pandas_udf(T.DoubleType())
def _beta(alpha: pd.Series, beta: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series([float(np.random.default_rng(int(s) & (2**63 - 1)).beta(a, b)) for a, b, s in zip(alpha, beta, seed, strict=True)])


def thompson(rows: DataFrame, source: str = "source", tier: str = "tier", seed: int = 7) -> DataFrame:
    """source, tier: the tier of the highest draw from its Beta posterior. Draws are seeded by source and tier, so they repeat."""
    drawn = rows.select(source, tier, _beta(F.col("alpha").cast("double"), F.col("beta").cast("double"), F.xxhash64(source, tier, F.lit(seed))).alias("x"))
    return drawn.groupBy(source).agg(F.max_by(tier, F.struct("x", tier)).alias(tier))


@F.pandas_udf(T.DoubleType())
def _normal(seed: pd.Series) -> pd.Series:
    return pd.Series([float(np.random.default_rng(int(s) & (2**63 - 1)).normal()) for s in seed])


def next_gap(cadence: Column, pace: Column, hour: Column, key: Column, sigma: float = 0.35) -> Column:
    """Seconds to a source's next poll: cadence, pace and time of day, then lognormal jitter seeded by ``key``; 5 at least."""
    return F.greatest(F.lit(5.0), cadence * pace * trust.circadian(hour) * F.exp(sigma * _normal(F.xxhash64(key))))


def retry_gap(previous: Column, key: Column) -> Column:
    """Seconds before a retry, decorrelated: evenly between 1 and three times the last gap, 30 at most; seeded by ``key``."""
    u = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    return F.least(F.lit(30.0), 1 + u * (3 * previous - 1))
