"""Operator 7: language identification by interpolated Kneser-Ney character language models.

For each language, character n-grams of up to ORDER within words (with a mark for a word's start and
end) are counted over all rows that may be learned from: each task counts its distinct words and
then their n-grams, and counts are summed by n-gram. All n-grams make the model. An order is stored as a sorted
array of 64-bit n-gram hashes beside its counts, and a sorted array of contexts beside their totals and
numbers of followers; the arrays are files of the shared folder that workers map, written a range of hashes at a
time, so neither the driver nor a worker holds the model. (Where the shared folder isn't a file system's, they are held and
broadcast.) The top order has raw counts, lower ones have continuation counts, and below all is a uniform distribution.

A text is scored over its letters, each word once a task: the language of the lowest cross-entropy a
character wins. Rejection is calibrated: a text is rejected if its cross-entropy lies far above what training
texts of that language and length have (mean and deviation over all of them, by length class).

A text that is null or has no letter: ``und``, score 0, rejected. Empty training data: every text is ``und``.
Null lang: not learned from. Null id: held out. Rows repeat singly. Ties: the language that sorts first.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, claim, held_out, slices, texts_of

ORDER, DISCOUNT = 4, 0.75
#: Rows of a model that the driver holds at once, about, on their way into the files.
PIECE = 2_000_000
#: A text is rejected over mean + REJECT deviations of its length class, at least SLACK nats over the mean.
REJECT, SLACK = 8.0, 0.6
#: Distinct words that a task counts, or scores it keeps, before they are emptied.
HELD = 150_000
#: Words whose n-grams are counted or scored at once; a word's n-grams take some 600 bytes in that.
AT_ONCE = 40_000
#: Sharpness of the score that is reported.
SHARP = 12.0

_LETTERS = regex.compile(r"\p{L}+")
_START, _END = "\x02", "\x03"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


class Grams:
    """All n-grams that end at each character of words: hash, context hash and suffix hash by order."""

    def __init__(self, words: list[str]):
        codes = np.frombuffer("".join(f"{_START}{w}{_END}" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        first = np.concatenate([[0], np.cumsum([len(w) + 2 for w in words])[:-1]]).astype(np.int64)
        inside = np.arange(len(codes)) - np.repeat(first, [len(w) + 2 for w in words])  # place in the word
        self.ends = np.flatnonzero(inside > 0)  # every character but the start mark is predicted
        self.word = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
        self.room = inside[self.ends] + 1  # the longest n-gram that ends here
        self.hash: list[np.ndarray] = [np.zeros(0, np.uint64)]
        n = len(codes)
        mixed = _mix(codes * _A + _B)
        h = np.zeros(n, np.uint64)
        full = [h]
        for k in range(1, ORDER + 1):  # the k codes up to each place
            shifted = np.concatenate([np.zeros(k - 1, np.uint64), mixed[: n - k + 1]])
            h = h + _mix(shifted * np.uint64(2 * k + 1) + np.uint64(k))
            full.append(_mix(h + np.uint64(k)))
        e = self.ends
        self.hash = [f[e] for f in full]
        # the context of order k is the k - 1 codes before
        self.context = [full[0][e], *(full[k - 1][e - 1] for k in range(1, ORDER + 1))]


def count_grams(words: list[str], weights: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(order, hashes, context hashes, suffix hashes, counts) of weighted words, distinct."""
    g, out = Grams(words), []
    w = weights[g.word]
    for k in range(1, ORDER + 1):
        own = np.flatnonzero(g.room >= k)
        h, at, inverse = np.unique(g.hash[k][own], return_index=True, return_inverse=True)
        out.append((k, h, g.context[k][own][at], g.hash[k - 1][own][at], np.bincount(inverse, w[own]).astype(np.int64)))
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, k, h, context, suffix, n over all rows of ``docs`` that have a text and a language."""
    schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("h", pa.int64()), ("context", pa.int64()), ("suffix", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language_id")
        seen: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, chunks in seen.items():
                words: Counter = Counter()
                for chunk, n in chunks.items():
                    for w in _LETTERS.findall(chunk):
                        words[w] += n
                keys, weights = list(words), np.fromiter(words.values(), float, len(words))
                for at in range(0, len(keys), AT_ONCE):
                    for k, h, c, s, n in count_grams(keys[at : at + AT_ONCE], weights[at : at + AT_ONCE]):
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(np.full(len(h), k, np.int32)), *(pa.array(x.view(np.int64)) for x in (h, c, s)), pa.array(n)], schema=schema)
            seen.clear()

        for batch in slices(batches):
            for text, lang in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, seen.values())) > HELD:
                yield from flush()
        yield from flush()

    return (
        docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
        .mapInArrow(run, "lang string, k int, h long, context long, suffix long, n long")
        .groupBy("lang", "k", "h").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.sum("n").alias("n"))
    )


class KneserNey:
    """One language's model, by order: sorted n-gram hashes and sorted context hashes with what goes with them.

    With a ``folder`` the arrays are its files, mapped at first use; else they are held here.
    """

    KINDS = {"grams": (np.uint64, np.float64), "contexts": (np.uint64, np.float64, np.float64)}

    def __init__(self, letters: int, folder: str | None = None):
        self.folder, self.alphabet = folder, max(2, letters + 1)
        self._held: dict[str, list[tuple[np.ndarray, ...]]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | ({"_held": {}} if self.folder else {})

    def add(self, kind: str, k: int, columns: tuple[np.ndarray, ...]) -> None:
        """Append the next range of hashes, sorted."""
        if self.folder:
            for i, x in enumerate(columns):
                with open(f"{self.folder}-{kind}-{k}-{i}", "ab") as out:
                    x.tofile(out)
        else:
            own = self._arrays(kind)
            own[k] = tuple(np.concatenate(x) for x in zip(own[k], columns, strict=True))

    def _arrays(self, kind: str) -> list[tuple[np.ndarray, ...]]:
        if kind not in self._held:
            name = lambda k, i: f"{self.folder}-{kind}-{k}-{i}"
            there = lambda k, i: self.folder and os.path.exists(name(k, i))
            self._held[kind] = [tuple(np.asarray(np.memmap(name(k, i), t, "r")) if there(k, i) else np.zeros(0, t) for i, t in enumerate(self.KINDS[kind])) for k in range(ORDER + 1)]
        return self._held[kind]

    @property
    def grams(self) -> list[tuple[np.ndarray, ...]]:
        return self._arrays("grams")

    @property
    def contexts(self) -> list[tuple[np.ndarray, ...]]:
        return self._arrays("contexts")

    @staticmethod
    def _find(keys: np.ndarray, values: tuple[np.ndarray, ...], h: np.ndarray) -> list[np.ndarray]:
        if not len(keys):
            return [np.zeros(len(h)) for _ in values]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        return [np.where(hit, v[at], 0.0) for v in values]

    def logp(self, g: Grams, at: np.ndarray) -> np.ndarray:
        """Log probability of the characters of ``g`` at ``at``, each in its longest context."""
        p = np.full(len(at), 1.0 / self.alphabet)
        for k in range(1, ORDER + 1):
            (n,) = self._find(self.grams[k][0], self.grams[k][1:], g.hash[k][at])
            total, followers = self._find(self.contexts[k][0], self.contexts[k][1:], g.context[k][at])
            known = (total > 0) & (g.room[at] >= k)
            safe = np.where(known, total, 1.0)
            p = np.where(known, np.maximum(n - DISCOUNT, 0) / safe + DISCOUNT * followers / safe * p, p)
        return np.log(p)


class Models:
    """All languages' models and, once calibrated, the limits of cross-entropy."""

    def __init__(self, models: dict[str, KneserNey]):
        self.langs = sorted(models)
        self.models = models

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Cross-entropies of texts; keeps what words and n-grams have scored."""

    def __init__(self, models: Models):
        self.m = [models.models[x] for x in models.langs]
        self._empty()

    def _empty(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.m) + 1))  # log probabilities by language, and characters
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(self.m)))

    def _learn(self, chunks: list[str]) -> None:
        words: dict[str, int] = {}
        of = [_LETTERS.findall(c) for c in chunks]
        flat = [words.setdefault(w, len(words)) for own in of for w in own]
        owner = np.repeat(np.arange(len(chunks)), [len(own) for own in of])
        sums = np.zeros((len(words), len(self.m) + 1))
        if words:
            g = Grams(list(words))
            longest = np.minimum(g.room, ORDER)
            h = np.choose(longest - 1, g.hash[1:]) if len(longest) else np.zeros(0, np.uint64)
            unique, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            known = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
            hit = self.keys[known] == unique if len(self.keys) else np.zeros(len(unique), bool)
            p = np.zeros((len(unique), len(self.m)))
            if hit.any():
                p[hit] = self.values[known[hit]]
            new = np.flatnonzero(~hit)
            if len(new):
                p[new] = np.stack([m.logp(g, at[new]) for m in self.m], axis=1)
                keys = np.concatenate([self.keys, unique[new]])
                order = np.argsort(keys)
                self.keys, self.values = keys[order], np.concatenate([self.values, p[new]])[order]
            every = p[inverse]
            for j in range(len(self.m)):
                sums[:, j] = np.bincount(g.word, every[:, j], len(words))
            sums[:, -1] = np.bincount(g.word, minlength=len(words))
        need = len(self.place) + len(chunks)
        if need > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(need, 2 * len(self.table)) - len(self.table), self.table.shape[1]))])
        at = len(self.place)
        for j in range(self.table.shape[1]):
            self.table[at:need, j] = np.bincount(owner, sums[flat, j], len(chunks)) if flat else 0.0
        self.place.update(zip(chunks, range(at, need), strict=True))

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """For each text the nats a character by language, and how many characters were predicted."""
        split = [(t or "").lower().split() for t in texts]
        if len(self.place) > HELD or len(self.keys) > HELD:
            self._empty()
        new = list({c for s in split for c in s if c not in self.place})
        for at in range(0, len(new), AT_ONCE):
            self._learn(new[at : at + AT_ONCE])
        place = self.place
        flat = [place[c] for s in split for c in s]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        rows = self.table[flat] if flat else np.zeros((0, self.table.shape[1]))
        out = np.stack([np.bincount(owner, c, len(texts)) for c in rows.T], axis=1)
        out[:, :-1] = -out[:, :-1] / np.maximum(out[:, -1:], 1)
        return out


def fit(spark: SparkSession, docs: DataFrame) -> Models:
    """Models of all n-grams of the rows of ``docs`` that aren't held out."""
    ws = Workspace(spark, "language-models")
    counts = ws.save(gram_counts(docs.where(~held_out("doc_id"))), "counts")
    # how many different characters stand before; what opens a word has none
    before = counts.where("k > 1").groupBy("lang", (F.col("k") - 1).alias("k"), F.col("suffix").alias("h")).agg(F.count(F.lit(1)).alias("before"))
    top = F.broadcast(counts.groupBy("lang").agg(F.max("k").alias("top")))  # a row a language
    n = F.when(F.col("k") < F.col("top"), F.coalesce("before", F.lit(1))).otherwise(F.col("n")).cast("double")
    grams = ws.save(counts.join(before, ["lang", "k", "h"], "left").join(top, "lang").select("lang", "k", "h", "context", n.alias("n")), "grams")
    contexts = ws.save(grams.groupBy("lang", "k", F.col("context").alias("h")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).cast("double").alias("followers")), "contexts")
    sizes = {(r["lang"], r["k"]): r["m"] for r in grams.groupBy("lang", "k").agg(F.count(F.lit(1)).alias("m")).collect()}
    folder = ws.local("models")
    langs = sorted({lang for lang, _ in sizes})
    models = {lang: KneserNey(sizes.get((lang, 1), 0), folder and f"{folder}/{i}") for i, lang in enumerate(langs)}
    bits = max(0, math.ceil(math.log2(max(1, sum(sizes.values())) / PIECE)))
    for kind, table in (("grams", grams.drop("context")), ("contexts", contexts)):
        for i in range(1 << bits):  # ranges of hashes, as unsigned numbers
            part = table.where(F.shiftrightunsigned("h", 64 - bits) == i) if bits else table
            for (lang, k), own in part.toArrow().to_pandas().groupby(["lang", "k"]):
                h = own["h"].to_numpy().view(np.uint64)
                order = np.argsort(h)
                models[lang].add(kind, k, (h[order], *(own[c].to_numpy(dtype=float)[order] for c in own.columns[3:])))
    for name in ("counts", "grams", "contexts"):
        ws.drop(name)
    return Models(models)


def scores(spark: SparkSession, docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, held_out, lang, best (language), entropy, second (the next entropy), n (characters predicted)."""
    sent = spark.sparkContext.broadcast(models)
    schema = T.StructType([*docs.select("doc_id", "lang").schema.fields, T.StructField("best", T.StringType()), T.StructField("entropy", T.DoubleType()), T.StructField("second", T.DoubleType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language_id")
        m = sent.value
        scorer = m.scorer()
        for batch in slices(batches):
            e = scorer.entropies(batch.column(2).to_pylist())
            n, e = e[:, -1].astype(np.int64), e[:, :-1]
            some = (n > 0) & bool(m.langs)
            order = np.argsort(e, axis=1, kind="stable") if m.langs else np.zeros((len(n), 1), int)
            first = [m.langs[i] if ok else None for i, ok in zip(order[:, 0], some, strict=True)] if m.langs else [None] * len(n)
            low = np.take_along_axis(e, order, 1) if m.langs else np.zeros((len(n), 1))
            second = low[:, 1] if low.shape[1] > 1 else low[:, 0] + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, pa.string()), pa.array(low[:, 0]), pa.array(second), pa.array(n)], names=schema.names)

    return docs.select("doc_id", "lang", "text").mapInArrow(run, schema)


def _size(n: int) -> int:
    """The length class of a text by its predicted characters."""
    return min(n.bit_length() - 1, 12)


def limits(table: DataFrame) -> dict[tuple[str, int], float]:
    """The highest cross-entropy that isn't rejected, by language and length class, from all training rows of ``scores``.

    A class without examples takes its language's widest limit.
    """
    size = F.least(F.floor(F.log2(F.col("n"))), F.lit(12)).cast("int")
    rows = (
        table.where((F.col("best") == F.col("lang")) & ~held_out("doc_id"))
        .groupBy("best", size.alias("size"))
        .agg(F.avg("entropy").alias("mean"), F.stddev_pop("entropy").alias("sd"), F.count(F.lit(1)).alias("m"))
        .collect()
    )
    found = {(r["best"], r["size"]): r["mean"] + max(SLACK, REJECT * (r["sd"] or 0.0) * math.sqrt(1 + 8 / r["m"])) for r in rows}
    for lang in {r["best"] for r in rows}:
        widest = max(v for (x, _), v in found.items() if x == lang)
        for k in range(13):
            found.setdefault((lang, k), widest)
    return found


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of ``docs``: two passes over the texts."""
    ws = Workspace(spark, "language-id")
    table = ws.save(scores(spark, docs, fit(spark, docs)), "scores")
    cases = F.create_map(*[F.lit(x) for (lang, k), v in sorted(limits(table).items()) for x in (f"{lang}\x00{k}", v)] or [F.lit(""), F.lit(0.0)])
    size = F.least(F.floor(F.log2(F.col("n"))), F.lit(12)).cast("int")
    limit = F.try_element_at(cases, F.concat_ws("\x00", "best", size.cast("string")))
    sure = 1 / (1 + F.exp((F.col("entropy") - F.col("second")) * SHARP))
    return table.select(
        "doc_id", held_out("doc_id").alias("held_out"), F.coalesce("best", F.lit("und")).alias("lang_pred"),
        F.when(F.col("best").isNull(), 0.0).otherwise(sure).alias("score"),
        (F.col("best").isNull() | F.coalesce(F.col("entropy") > limit, F.lit(False))).alias("rejected"),
    )


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't rejected. Judged row by row where they are, without a join."""
    ws = Workspace(spark, "language-id")
    models = fit(spark, docs)
    found = limits(ws.save(scores(spark, docs, models), "scores"))
    sent = spark.sparkContext.broadcast((models, found))

    @F.pandas_udf(T.BooleanType())
    def keep(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("language_id")
        m, most = sent.value
        scorer = m.scorer()
        for texts in parts:
            out: list[bool] = []
            for at in range(0, len(texts), 512):
                for row in scorer.entropies(texts.iloc[at : at + 512].tolist()):
                    n, e = int(row[-1]), row[:-1]
                    best = int(e.argmin()) if len(e) else -1
                    out.append(bool(n and best >= 0 and e[best] <= most.get((m.langs[best], _size(n)), math.inf)))
            yield pd.Series(out, dtype=bool)

    return docs.where(keep(F.col("text")))
