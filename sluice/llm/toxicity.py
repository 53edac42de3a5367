"""Operator 4: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of labelled rows (MAX_LABELLED, those of the smallest hash of the id) fits the model:
a lexicon of words and word beginnings that are far commoner in toxic than in clean documents, then
trees on logistic loss over features of whole texts (lexicon densities, closeness of second-person
words to lexicon words, capitals, punctuation and obfuscation rates), then isotonic regression
of out-of-fold scores, whose lexicon and trees both come from the other folds. The model has a fixed size bound and goes to the tasks with the function; documents
are scored in one pass without a shuffle.

Null text: scored as empty; empty texts get the score of their features, all 0. Null label, or null id: not
learned from. Labels that repeat or contradict: each counts. No labels of both kinds: the score is the
share of label 1, or 0. Empty table: no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, held_out, map_texts, slices, texts_of

MAX_LABELLED = 20_000
#: Lexicon entries at most, documents that an entry needs, and how many times commoner it must be.
MAX_LEXICON, LEAST_DOCS, LEAST_RATIO = 2_000, 5, 8.0
#: Parts of the labelled rows that are scored in turn by a model of the others, for the calibration.
FOLDS = 5
#: Lengths of the word beginnings that may be entries; words from NEAR words away count as near.
STEMS, NEAR = (4, 5), 6

# Second-person words of the languages in scope.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo tuya vosotros usted ustedes".split())

WORDS = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[!?]{2,}")
_HIDDEN = re.compile(r"[^\W\d_][*@$#%0-9][^\W\d_]")
_DRAWN = re.compile(r"([^\W\d_])\1\1")
_CAPS = re.compile(r"\b[A-ZÄÖÜÉÈÑ]{3,}\b")

FEATURES = (
    "lex_log", "lex_density", "lex_distinct", "lex_max", "lex_sum", "lex_first", "lex_run", "you_density", "you_near", "you_near_density",
    "capitals", "caps_words", "exclaims", "questions", "marks", "punctuation", "digits", "hidden", "drawn", "words_log", "word_length", "distinct_share",
)


class Lexicon(dict):
    """Weight of a word, found once: the largest of its entries, 0 for none."""

    def __init__(self, entries: dict[str, float]):
        super().__init__()
        self.entries = entries

    def __missing__(self, word: str) -> float:
        found = [self.entries.get(word + "$", 0.0), *(self.entries.get(word[:k], 0.0) for k in STEMS if len(word) >= k)]
        if len(self) >= 300_000:
            self.clear()
        self[word] = w = max(found)
        return w


def features(text: str, lexicons: list[Lexicon]) -> list[list[float]]:
    """The features of a text by each lexicon; what doesn't depend on one is made once."""
    lower = text.lower()
    words = WORDS.findall(lower)
    n, chars = max(1, len(words)), max(1, len(text))
    you = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
    exclaims, questions = text.count("!"), text.count("?")
    rest = [
        sum(map(str.isupper, text)) / chars if not lower == text else 0.0, len(_CAPS.findall(text)) / n, exclaims / n, questions / n,
        len(_MARKS.findall(text)) / n if exclaims + questions > 1 else 0.0, sum(map(text.count, ".,;:!?")) / chars, sum(map(text.count, "0123456789")) / chars,
        len(_HIDDEN.findall(text)) / n, len(_DRAWN.findall(lower)) / n, math.log1p(len(words)), len(lower) / n if words else 0.0, len(set(words)) / n,
    ]
    out = []
    for lexicon in lexicons:
        weights = [lexicon[w] for w in words]
        at = [i for i, w in enumerate(weights) if w]
        near = 0
        if at and len(you):
            k = np.searchsorted(you, at)
            left = np.array(at) - you[np.maximum(k - 1, 0)]
            right = you[np.minimum(k, len(you) - 1)] - np.array(at)
            near = int((np.minimum(np.abs(left), np.abs(right)) <= NEAR).sum())
        hits = [weights[i] for i in at]
        out.append([
            math.log1p(len(at)), len(at) / n, len({words[i] for i in at}), max(hits, default=0.0), math.log1p(sum(hits)), 1 - at[0] / n if at else 0.0,
            sum(b - a <= 3 for a, b in zip(at, at[1:], strict=False)) / n, len(you) / n, near, near / n, *rest,
        ])
    return out


# ---- trees


class Boosted:
    """Gradient-boosted regression trees on logistic loss, by histograms of quantile bins."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 5.0, l2: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base, self.trees = math.log(p / (1 - p)), []
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        coded = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        f = np.full(len(y), self.base)
        for _ in range(self.n):
            q = 1 / (1 + np.exp(-f))
            tree, leaf = self._grow(coded, q - y, q * (1 - q))
            self.trees.append(tree)
            f += leaf
        return self

    def _grow(self, coded: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A tree as (feature, bin, value) by node, children of i at 2i+1 and 2i+2; its value for each row."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        node = np.zeros(len(g), int)
        for i in range(size):
            own = np.flatnonzero(node == i)
            if not len(own):
                continue
            G, H = g[own].sum(), h[own].sum()
            value[i] = -self.rate * G / (H + self.l2)
            if i >= 2**self.depth - 1:
                continue
            best = (1e-6, -1, 0)
            for j in range(coded.shape[1]):
                c = coded[own, j]
                gl = np.cumsum(np.bincount(c, g[own], self.bins + 1))[:-1]
                hl = np.cumsum(np.bincount(c, h[own], self.bins + 1))[:-1]
                nl = np.cumsum(np.bincount(c, minlength=self.bins + 1))[:-1]
                gain = gl**2 / (hl + self.l2) + (G - gl) ** 2 / (H - hl + self.l2) - G**2 / (H + self.l2)
                gain[(nl < self.least) | (len(own) - nl < self.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] >= 0:
                feature[i], cut[i] = best[1:]
                node[own] = np.where(coded[own, best[1]] <= best[2], 2 * i + 1, 2 * i + 2)
        return (feature, cut, value), value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        coded = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (coded[rows, np.maximum(f, 0)] > cut[node]))
            out += value[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability), both ascending."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum, number, lowest and highest score
    for s, v in zip(score[order], y[order], strict=True):
        pools.append([v, 1, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            b = pools.pop()
            a = pools[-1]
            a[0], a[1], a[3] = a[0] + b[0], a[1] + b[1], b[3]
    xs = np.array([v for p in pools for v in (p[2], p[3])])
    ys = np.array([v for p in pools for v in (p[0] / p[1],) * 2])
    return xs, ys


class Model:
    """Lexicon, trees and calibration.

    ``x`` holds a row's features by the lexicon of each fold's other rows, then by the lexicon of all rows; ``fold`` is the row's
    fold. So neither the lexicon nor the trees that score a row for the calibration have seen it.
    """

    def __init__(self, entries: dict[str, float], x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.entries, self.prior, self.trees = entries, float(y.mean()) if len(y) else 0.0, None
        folds = x.shape[1] - 1
        if len(y) < 2 * folds or not 0 < self.prior < 1:
            return
        out = np.zeros(len(y))
        for k in range(folds):
            own = fold == k
            if own.any() and len(np.unique(y[~own])) > 1:
                out[own] = Boosted().fit(x[~own, k], y[~own]).raw(x[own, k])
        self.knots = isotonic(out, y)
        self.trees = Boosted().fit(x[:, -1], y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        raw = self.trees.raw(x)
        # the calibrated level orders documents; within a level the trees do
        level = np.interp(raw, *self.knots)
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-raw)), 0, 1)


# ---- Spark


def _entries(docs: DataFrame) -> DataFrame:
    """Documents that hold each possible lexicon entry, by fold and label: entry, fold, toxic, clean. Counted in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[Counter, Counter]] = {}
        for batch in slices(batches):
            for text, y, k in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = set(WORDS.findall(text.lower()))
                seen.setdefault(k, (Counter(), Counter()))[y].update({w + "$" for w in words} | {w[:j] for w in words for j in STEMS if len(w) >= j})
        for k, (clean, toxic) in seen.items():
            # what no toxic document here holds can be an entry elsewhere, so clean counts go too
            keys = list(toxic | clean)
            for at in range(0, len(keys), 20_000):
                part = keys[at : at + 20_000]
                yield pa.RecordBatch.from_pydict({"entry": part, "fold": pa.array([k] * len(part), pa.int32()), "toxic": [toxic[x] for x in part], "clean": [clean[x] for x in part]})

    return docs.select("text", "toxic", "fold").mapInArrow(run, "entry string, fold int, toxic long, clean long").groupBy("entry", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _lexicon(counts: DataFrame, total: dict[tuple[int, int], int], without: int | None) -> dict[str, float]:
    """Entries and their weights, from the rows outside the fold ``without``; at most MAX_LEXICON."""
    n = lambda y: sum(m for (k, label), m in total.items() if label == y and k != without)
    if without is not None:
        counts = counts.where(F.col("fold") != without)
    c = counts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # two deviations less than counted, so that chance makes no entries
    ratio = ((F.col("toxic") - 2 * F.sqrt("toxic") + 0.5) / (n(1) + 1)) / ((F.col("clean") + 0.5) / (n(0) + 1))
    found = c.where(F.col("toxic") >= LEAST_DOCS).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    return {r["entry"]: math.log(r["ratio"]) for r in found.orderBy(F.desc("ratio"), F.desc("toxic"), "entry").limit(MAX_LEXICON).collect()}


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from at most ``max_labelled`` rows that aren't held out."""
    ws = Workspace(spark, "toxicity")
    some = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(max_labelled)
    )
    # by the text, so that copies stand in one fold
    known = ws.save(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").withColumn("fold", F.pmod(F.xxhash64(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), F.lit(FOLDS)).cast("int")), "labelled")
    total = {(r[0], r[1]): r[2] for r in known.groupBy("fold", "toxic").count().collect()}
    counts = ws.save(_entries(known), "entries")
    lexicons = [_lexicon(counts, total, k) for k in (*range(FOLDS), None)]

    def make():
        own = [Lexicon(x) for x in lexicons]
        return lambda texts: [[[v for part in features(t, own) for v in part] for t in texts]]

    rows = map_texts(known.select(F.struct("doc_id", "toxic", "fold").alias("doc_id"), "text"), make, [("x", T.ArrayType(T.DoubleType()))]).collect()
    rows.sort(key=lambda r: (r[0][0], r[0][1], r[1]))
    ws.drop()
    x = np.array([r[1] for r in rows], dtype=float).reshape(-1, FOLDS + 1, len(FEATURES))
    return Model(lexicons[-1], x, np.array([r[0][1] for r in rows], dtype=float), np.array([r[0][2] for r in rows], dtype=int))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of ``docs``."""

    def make():
        lexicon = [Lexicon(model.entries)]
        return lambda texts: [model.score(np.array([features(t, lexicon)[0] for t in texts], dtype=float).reshape(-1, len(FEATURES))).tolist()]

    return map_texts(docs, make, [("score", T.DoubleType())])


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    return score(docs, fit(spark, docs, labels)).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
