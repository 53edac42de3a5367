"""Weak supervision: rules label what they can, and a classifier of their labels fills what it is sure of."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import search, vectors

MIN_ROWS, MIN_CLASS, SURE, FOLDS = 40, 3, 0.60, 3


def _terms() -> Column:
    return vectors.word_terms(X.without_accents(F.lower("_text")), bigrams=True)


def grouped(rows: DataFrame, id_col: str, *by: str) -> DataFrame:
    """Rows that agree in ``by`` as one, under their first id, with their number ``_n``."""
    return rows.groupBy(*by).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("_n"))


class TagModel:
    """One field's classifier over word 1-2-gram TF-IDF, with the vocabulary of the rows it was fitted on.

    A row of ``rows`` (id, _text, label, _n) stands for _n equal ones and counts as these.
    """

    def __init__(self, rows: DataFrame, id_col: str, label: str, classes: list[str], most: int = 20_000, c: float = 2.0):
        self.id_col, self.classes = id_col, sorted(classes)
        count = {r[0]: r[1] for r in rows.groupBy(label).agg(F.sum("_n")).collect()}
        self.n = sum(count.values())
        tf = vectors.term_counts(rows, id_col, _terms(), "_n")
        known = vectors.vocabulary(tf, self.n, most=most).collect()  # at most ``most`` rows
        self.df = rows.sparkSession.createDataFrame([(r["term"], r["df"], i) for i, r in enumerate(sorted(known))], "term string, df long, i int").cache()
        self.size = max(1, len(known))
        y = F.array_position(F.array(*map(F.lit, self.classes)), F.col(label)).cast("double") - 1
        weight = F.element_at(F.create_map(*[F.lit(v) for k in self.classes for v in (k, self.n / (len(self.classes) * count[k]))]), F.col(label)) * F.col("_n")
        x = self._vectors(rows, label, "_n").withColumn("y", y).withColumn("weight", weight)
        regression = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", family="multinomial", maxIter=300, regParam=1 / (c * self.n), standardization=False)
        self.model: LogisticRegressionModel = regression.fit(x)

    def _vectors(self, rows: DataFrame, *keep: str) -> DataFrame:
        size = self.size
        sparse = F.udf(lambda v: Vectors.sparse(size, [(x["i"], x["w"]) for x in v or ()]), VectorUDT())
        w = vectors.weigh(vectors.term_counts(rows, self.id_col, _terms()), self.id_col, F.broadcast(self.df.drop("i")), self.n).join(F.broadcast(self.df.select("term", "i")), "term")  # at most ``most`` terms
        v = w.groupBy(self.id_col).agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("v"))
        return rows.select(self.id_col, *keep).join(vectors.large(v), self.id_col, "left").select(self.id_col, *keep, sparse("v").alias("x"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """id, guess, p: the likeliest class and its probability."""
        p = vector_to_array("probability")
        out = self.model.transform(self._vectors(rows)).select(self.id_col, p.alias("p"))
        return out.select(self.id_col, F.element_at(F.array(*map(F.lit, self.classes)), F.array_position("p", F.array_max("p")).cast("int")).alias("guess"), F.array_max("p").alias("p"))


def coverage(rows: DataFrame, label: str) -> dict[str, object]:
    """Counts by class, classes kept and too rare, and the share of rows with a label, of rows that stand for _n each."""
    count = {r[0]: r[1] for r in rows.groupBy(label).agg(F.sum("_n")).collect()}  # a row a class
    total, none = sum(count.values()), count.pop(None, 0)
    kept = sorted(k for k, n in count.items() if n >= MIN_CLASS)
    return {"count": count, "kept": kept, "too_rare": sorted(set(count) - set(kept)), "coverage": round((total - none) / total, 3) if total else 0.0}


def agreement(rows: DataFrame, id_col: str, label: str, classes: list[str], folds: int) -> float:
    """Mean share of held-out rows for which the model says what the rule says; agreement with rules, not accuracy."""
    dealt = grouped(rows.withColumn("_fold", F.pmod(F.xxhash64(id_col), F.lit(folds))), id_col, "_fold", "_text", label).cache()
    said = []
    for k in range(folds):
        train, held = dealt.where(F.col("_fold") != k), dealt.where(F.col("_fold") == k)
        own = [r[0] for r in train.select(label).distinct().collect()]
        if len(own) > 1 and not held.isEmpty():
            got = TagModel(train, id_col, label, own).predict(held).join(vectors.large(held.select(id_col, label, "_n")), id_col)
            said.append(got.agg(F.sum(F.when(F.col("guess") == F.col(label), F.col("_n")).otherwise(0)) / F.sum("_n")).first()[0])
    return round(sum(said) / len(said), 3) if said else 0.0


def tag(jobs: DataFrame, id_col: str, cross_validate: bool = True) -> tuple[DataFrame | None, dict[str, object]]:
    """(id, role_family, seniority; metrics). A rule's label wins, the model fills in from SURE on, the rest stays null.

    Under MIN_ROWS rows nothing is labelled, by rules neither: (None, metrics).
    """
    n = jobs.count()
    if n < MIN_ROWS:
        return None, {"trained": False, "reason": f"only {n} rows"}
    seen = search.label_text()
    rows = jobs.select(id_col, search.feature_text().alias("_text"), X.label_role(seen).alias("role_family"), X.label_seniority(seen).alias("seniority"))
    # equal rows are learned from as one that weighs as much, and a text is guessed once
    some = grouped(rows, id_col, "_text", "role_family", "seniority").cache()
    texts = some.groupBy("_text").agg(F.min(id_col).alias(id_col)).cache()
    out, metrics = rows, {"trained": True, "n_rows": n}
    for field in ("role_family", "seniority"):
        own = coverage(some, field)
        metrics |= {f"{field}_coverage": own["coverage"], f"{field}_classes_kept": own["kept"], f"{field}_classes_too_rare": own["too_rare"], f"{field}_cv": None}
        if len(own["kept"]) >= 2:
            kept = F.col(field).isin(own["kept"])
            if cross_validate:
                metrics[f"{field}_cv"] = agreement(rows.where(kept), id_col, field, own["kept"], min(FOLDS, min(own["count"][k] for k in own["kept"])))
            train = some.where(kept).groupBy("_text", field).agg(F.min(id_col).alias(id_col), F.sum("_n").alias("_n"))
            guess = TagModel(train, id_col, field, own["kept"]).predict(texts).where(F.col("p") >= SURE)
            guess = texts.join(vectors.large(guess), id_col).select("_text", F.col("guess").alias("_guess"))
            out = out.join(vectors.large(guess), "_text", "left").withColumn(field, F.coalesce(field, "_guess")).drop("_guess")
    return out.select(id_col, "role_family", "seniority"), metrics
