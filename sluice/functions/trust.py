"""Features of a response and the verdict on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of challenge and refusal pages.
BLOCK_TOKENS = (
    "captcha", "recaptcha", "hcaptcha", "verify you are human", "are you a robot", "unusual traffic", "automated queries", "access denied", "permission to access",
    "too many requests", "rate limit", "slow down", "temporarily blocked", "just a moment", "checking your browser", "enable javascript", "challenge-platform",
    "cf-chl", "ddos protection", "security check", "bot detection", "suspicious activity", "please try again later", "request blocked", "perimeterx", "incapsula", "datadome",
)
CAPTCHA_TOKENS = BLOCK_TOKENS[:5]
# Cookies of challenges; patterns, ratios and caps of the features below.
CHALLENGE_COOKIES = ("cf_clearance", "__cf_bm", "datadome", "incap_ses", "_px", "bm_sz")


def count_tokens(text: Column, tokens: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for t in tokens:
        out = out + text.contains(t).cast("int")
    return out


def body_features(body: Column | str) -> dict[str, Column]:
    """What the body alone says; only its head is searched."""
    b = F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit(""))
    head = F.lower(F.substring(b, 1, 8192))
    n = F.length(b)
    return {
        "log_body_len": F.log1p(n.cast("double")),
        "n_block_tokens": count_tokens(head, BLOCK_TOKENS),
        "has_captcha_token": (count_tokens(head, CAPTCHA_TOKENS) > 0).cast("int"),
        "tag_density": F.size(F.regexp_extract_all(F.substring(b, 1, 16384), F.lit("<[a-zA-Z/!][^>]{0,80}>"), F.lit(0))) / F.greatest(n, F.lit(1)) * 1000.0,
        "char_diversity": F.when(n > 0, F.size(F.array_distinct(F.split(F.substring(b, 1, 4096), "")))).otherwise(0) / 96.0,
        "title_len": F.length(F.regexp_extract(head, "(?s)<title[^>]*>(.{0,200}?)</title>", 1)) / 100.0,
        "body_is_tiny": (n < 512).cast("int"),
    }


def response_features(df: DataFrame) -> DataFrame:
    """All 21 features for rows of status, body, content_type, expected_content, items, latency_ms, n_redirects, set_cookie, retry_after, median_items, median_latency_ms."""
    ct, want, num = F.lower(F.coalesce("content_type", F.lit(""))), F.col("expected_content"), lambda c: c.cast("double")
    status = F.col("status")
    own = {
        "is_2xx": num(status.between(200, 299)), "is_3xx": num(status.between(300, 399)), "is_403": num(status == 403), "is_429": num(status == 429), "is_5xx": num(status >= 500),
        "ctype_match": num(((want == "json") & ct.contains("json")) | ((want == "xml") & (ct.contains("xml") | ct.contains("rss"))) | ((want == "html") & ct.contains("html")) | (ct == "")),
        "ctype_html_when_json": num((want == "json") & ct.contains("html")),
        "has_challenge_cookie": num(count_tokens(F.lower(F.coalesce("set_cookie", F.lit(""))), CHALLENGE_COOKIES) > 0),
        "has_retry_after": num(F.coalesce("retry_after", F.lit("")) != ""),
        "log_items": F.log1p(num(F.greatest("items", F.lit(0)))),
        "items_vs_median": F.least(F.col("items") / F.greatest("median_items", F.lit(0.25)), F.lit(3.0)),
        "latency_vs_median": F.least(F.col("latency_ms") / F.greatest("median_latency_ms", F.lit(1.0)), F.lit(5.0)),
        "n_redirects": num(F.col("n_redirects")), "log_median_items": F.log1p(F.greatest("median_items", F.lit(0.0))),
    }
    body = {k: num(v) for k, v in body_features("body").items()}
    return df.withColumns(own | body)


def verdict(p: Column | str, threshold: float = 0.5) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p >= max(threshold + 0.25, 0.75), "blocked").when(p >= threshold, "suspect").otherwise("clean")


def circadian(hour: Column) -> Column:
    """Weight of an hour of the day: least at 14, most twelve hours from it."""
    return 1.5 - 0.5 * F.cos((hour - 14) / 24.0 * 2 * F.pi())
