"""The language model has every n-gram, whatever their number."""

import random
from collections import Counter

import numpy as np
import pytest

from sluice.llm import language_id


@pytest.mark.parametrize("piece", [None, 60_000])
def test_all_grams(spark, monkeypatch, piece):
    if piece:
        monkeypatch.setattr(language_id, "PIECE", piece)
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüßéèêçàñ", k=8)) for _ in range(60_000)]
    rows = [(i, " ".join(words[i * 20 : i * 20 + 20]), "xx") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r[0] for r in df.where(~language_id.held_out("doc_id")).select("doc_id").collect()}
    grams: dict[int, Counter] = {k: Counter() for k in range(1, 5)}
    for w in (w for i, t, _ in rows if i in kept for w in t.split()):
        p = f"\x02{w}\x03"
        for k in grams:  # the start mark itself is not predicted
            grams[k].update(p[i - k + 1 : i + 1] for i in range(max(1, k - 1), len(p)))
    m = language_id.fit(spark, df).models["xx"]
    assert len(grams[4]) > 200_000
    for k in grams:
        before = Counter(g[1:] for g in grams[k + 1]) if k < 4 else None
        n = {g: max(1, before[g]) if before is not None else c for g, c in grams[k].items()}
        total, followers = Counter(), Counter()
        for g, c in n.items():
            total[g[:-1]] += c
            followers[g[:-1]] += 1
        assert (np.diff(m.grams[k][0].astype(object)) > 0).all()
        assert sorted(m.grams[k][1]) == sorted(n.values())
        assert sorted(zip(*m.contexts[k][1:], strict=True)) == sorted((total[c], followers[c]) for c in total)
