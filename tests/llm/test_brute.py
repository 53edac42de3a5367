"""Parts of operators against plain versions of the same rules: language models, trees, spans, filters, and the pipeline as a whole."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sluice.llm import common, exact_dedup, language_id, near_dedup, packing, secret_scan, topk_search, toxicity, word_bpe

WORDS = public_tokenizers.path("word_bpe_49k.json")

# ---- language models


class PlainKneserNey:
    """Interpolated Kneser-Ney over dictionaries of strings."""

    def __init__(self, words):
        self.raw = [Counter() for _ in range(language_id.ORDER + 1)]
        for w, m in words.items():
            s = f"\x02{w}\x03"
            for i in range(1, len(s)):
                for k in range(1, min(language_id.ORDER, i + 1) + 1):
                    self.raw[k][s[i - k + 1 : i + 1]] += m
        top = max(k for k in range(1, language_id.ORDER + 1) if self.raw[k])
        before = Counter((k - 1, g[1:]) for k in range(2, language_id.ORDER + 1) for g in self.raw[k])
        self.n = [{g: c if k == top else before.get((k, g), 1) for g, c in self.raw[k].items()} for k in range(language_id.ORDER + 1)]
        self.total, self.followers = Counter(), Counter()
        for k in range(1, language_id.ORDER + 1):
            for g, c in self.n[k].items():
                self.total[k, g[:-1]] += c
                self.followers[k, g[:-1]] += 1
        self.alphabet = max(2, len(self.raw[1]) + 1)

    def logp(self, s, i):
        p = 1 / self.alphabet
        for k in range(1, min(language_id.ORDER, i + 1) + 1):
            c = k, s[i - k + 1 : i]
            if self.total[c]:
                p = max(self.n[k].get(s[i - k + 1 : i + 1], 0) - language_id.DISCOUNT, 0) / self.total[c] + language_id.DISCOUNT * self.followers[c] / self.total[c] * p
        return math.log(p)

    def entropy(self, text):
        nats = n = 0
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            s = f"\x02{w}\x03"
            nats -= sum(self.logp(s, i) for i in range(1, len(s)))
            n += len(s) - 1
        return nats / max(n, 1), n


def test_language_models_against_dictionaries(spark):
    texts = {"de": ["der Hund und die Katze", "ein Haus, ein Baum!", "und der Baum und der Hund"], "en": ["the dog and the cat", "a house, a tree", "and the tree"], "fr": ["le chien"]}
    rows, i = [], 0
    for lang, own in texts.items():
        for t in own:
            while zlib.crc32(str(i).encode()) % 3 == 1:
                i += 1
            rows.append((i, t, lang))
            i += 1
    rows += [(i, "ohne Sprache", None), (None, "no id, held out", "en")]
    models = language_id.fit(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert models.langs == sorted(texts)
    asked = ["der Baum", "the unknown tree", "12 !", "", "Zebra", "und"]
    got = models.scorer().entropies(asked)
    for j, lang in enumerate(models.langs):
        words = Counter(w for t in texts[lang] for w in re.findall(r"[^\W\d_]+", t.lower()))
        plain = PlainKneserNey(words)
        for row, t in zip(got, asked, strict=True):
            want, n = plain.entropy(t)
            assert row[-1] == n and math.isclose(row[j], want, rel_tol=1e-9, abs_tol=1e-12)
        # after any context the probabilities of all characters, known or not, sum to one
        s = "\x02de"
        seen = {g for g in plain.raw[1]}
        p = sum(math.exp(plain.logp(s + c, 3)) for c in seen)
        assert p < 1 + 1e-9 and math.isclose(p + math.exp(plain.logp(s + "\x00", 3)) * (plain.alphabet - len(seen)), 1.0, rel_tol=1e-9)


# ---- toxicity: trees, lexicon, calibration


def walk(tree, coded):
    feature, cut, value = tree
    i = 0
    while feature[i] >= 0:
        i = 2 * i + 1 + (coded[feature[i]] > cut[i])
    return value[i]


def test_trees_against_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    x[:50] = x[50:100]  # ties
    y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(float)
    model = toxicity.Boosted(trees=15).fit(x, y)
    for row, got in zip(x, model.raw(x), strict=True):
        coded = [int((e < v).sum()) for e, v in zip(model.edges, row, strict=True)]
        assert math.isclose(got, model.base + sum(walk(t, coded) for t in model.trees), rel_tol=1e-9, abs_tol=1e-9)
    assert ((model.raw(x) > 0) == (y == 1)).mean() > 0.95


def test_isotonic_against_all_pools():
    rng = np.random.default_rng(2)
    x, y = np.arange(40.0), rng.integers(0, 2, 40).astype(float)
    at, p = toxicity.isotonic(x, y)
    # the minimax formula of isotonic regression
    for i in range(40):
        want = max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1))
        assert math.isclose(float(np.interp(x[i], at, p)), want, abs_tol=1e-9)


def test_toxicity_labels(spark):
    """Contradicting, null and foreign labels, clashing columns, repeated rows; scores follow the planted word."""
    rng = random.Random(4)
    say = lambda: " ".join(rng.choice(("house", "river", "table", "green", "walk", "you")) for _ in range(12))
    docs = [(i, say() + (" vilewordy" if i % 3 == 0 else ""), i % 3, "x") for i in range(400)]
    labels = [(i, int(i % 3 == 0), "y") for i in range(400)] + [(3, 0, "y"), (5, None, "y"), (None, 1, "y"), (9999, 1, "y"), (7, 5, "y")]
    d = spark.createDataFrame([*docs, docs[0], (None, None, None, None)], "doc_id long, text string, toxic int, score string")
    got = toxicity.toxicity(spark, d, spark.createDataFrame(labels, "doc_id long, toxic int, text string")).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None]
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in held) and len(held) > 100


# ---- secrets


def test_spans_against_every_candidate():
    net = secret_scan.trained()
    rng = random.Random(6)
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    full = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    for _ in range(60):
        parts = [rng.choice(("some prose here", "token = " + pick(full, 20), pick("0123456789abcdef", 30), "AKIA" + pick("ABCDEFGH2345", 16), "ghp_" + pick(full, 36), "x" + pick("0123456789abcdef", 18) + "ZQ", pick(full, 24) + "." + pick(full, 30), "a-plain-hyphenated-phrase", "verylongordinarywordinprose")) for _ in range(5)]
        text = " ".join(parts)
        base = secret_scan.base_spans(text)
        want = [(s, k, e) for s, k, e in base]
        for m in re.finditer(r"[A-Za-z0-9+/_=.-]+", text):
            run = m[0].rstrip(".")
            start = m.start() + len(m[0]) - len(m[0].lstrip("."))
            run = run.lstrip(".")
            if len(run) < 16 or not re.search("[A-Za-z]", run) or secret_scan._PROSE.fullmatch(run):
                continue
            if any(s <= start and e >= start + len(run) for s, _, e in base):
                continue
            if max(net.probability(w[None])[0] for w in secret_scan.windows(text, start, start + len(run))) >= net.threshold:
                want.append((start, 3, start + len(run)))
        assert [f[:3] for f in secret_scan.scan_text(text, net)] == sorted(want)


def test_network_finds_what_the_rules_miss():
    """Secrets of forms that no rule has, in prose: the share that the network finds, and prose that it leaves alone."""
    net, rng = secret_scan.trained(), random.Random(8)
    full = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    made = [f"we saw {p}{pick(full, n)} there" for p, n in [("ghp_", 36), ("sk-", 40), ("xoxb-123456789-", 24), ("", 40), ("eyJ", 60)] for _ in range(40)]
    assert np.mean([any(f[1] == 3 for f in secret_scan.scan_text(t, net)) for t in made]) >= 0.95
    clean = ["read https://example.com/a/long/path/to-some-page12 today", "ask kdbfg.12@mail4.example.com now", "Donaudampfschifffahrtsgesellschaft", "version v2.14.3-stable.build.204 is out", "see figure_12_of_the_second_part"]
    assert not any(secret_scan.scan_text(t, net) for t in clean)


# ---- filters, near duplicates in small groups, encodings


@pytest.mark.parametrize("max_ids,max_bits", [(1 << 20, 8), (5, 8), (5, 1 << 15)])
def test_rows_without(spark, max_ids, max_bits):
    ws = common.Workspace(spark, "test")
    rows = [(i if i % 10 else None, f"t{i % 7}", i) for i in range(300)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, h long")
    gone = [(i, "t1") for i in range(0, 300, 3)] + [(None, "t0")]
    got = common.without(ws, docs, spark.createDataFrame(gone, "h long, text string"), [F.col("doc_id"), F.col("text")], max_ids, max_bits)
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter(r for r in [*rows, rows[3]] if (r[0], r[1]) not in set(gone))
    assert common.without(ws, docs, spark.createDataFrame([], "h long, text string"), [F.col("doc_id"), F.col("text")]).count() == 301


def near_rows():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 160))]
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("group,outside,max_ids,max_bits", [(256, 1024, common.MAX_IDS, common.MAX_BITS), (3, 2, 4, 8)])
def test_near_duplicates_in_blocks(spark, monkeypatch, group, outside, max_ids, max_bits):
    monkeypatch.setattr(near_dedup, "GROUP", group)
    monkeypatch.setattr(near_dedup, "OUTSIDE", outside)
    rows = near_rows()
    sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in rows}
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = near_dedup.near_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, max_ids, max_bits).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}


def test_rows_of_one_id_are_one_document(spark):
    words = near_rows()[0][1]
    docs = spark.createDataFrame([(1, words), (5, words + " more"), (5, "something else entirely, on its own here"), (6, "another text that is alone, with an id"), (None, None), (None, words)], "doc_id long, text string")
    got = Counter(map(tuple, near_dedup.keep_heads(spark, docs).collect()))
    assert got == Counter([(1, words), (6, "another text that is alone, with an id"), (None, None), (None, words)])


def test_drop_copies_with_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "ab", "y"), (2, "other", "z"), (None, "a  b", None), (None, None, None), (3, "", None), (3, "", None)], "doc_id long, text string, digest string")
    for most, bits in ((0, 1 << 16), (common.MAX_IDS, common.MAX_BITS)):
        got = sorted(str(tuple(r)) for r in exact_dedup.drop_copies(spark, docs, most, bits).collect())
        assert got == sorted(map(str, [(2, "other", "z"), (None, "a  b", None), (3, "", None), (3, "", None)]))


def test_encoder_of_new_and_rare_characters():
    e, whole = word_bpe.encoder(WORDS), Tokenizer.from_file(WORDS)
    some = [chr(c) for c in (*range(1, 0x3000), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x10000, 0x10400), 0x1C89, 0x323B0, 0x33479, 0x1E5D0, 0xE0001, 0x10FFFF)]
    for at in range(0, len(some), 400):
        text = " ".join(f"a{c}b {c}x ́{c}" for c in some[at : at + 400])
        assert e.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    for text in ("<|endoftext|> x", "<|ENDOFTEXT|> x", "it's we'll 12ab3", "a\tb\rc\x0bd e f", "...!!! a,b;c", "ΣΑΣ İstanbul ß ﬁ"):
        assert e.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_special_token_in_capitals_beside_an_unknown_character():
    e, whole = word_bpe.encoder(WORDS), Tokenizer.from_file(WORDS)
    for text in ("a\U000323b0<|ENDOFTEXT|>b", "é <|EndOfText|>\U000323b0, x", "é <|STARTOFTEXT|> x"):
        assert e.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_many_texts_equal_the_library(monkeypatch):
    whole, rng = Tokenizer.from_file(WORDS), random.Random(5)
    some = [*"abcXYZ019.,;:!?'’\"#%&*()-_|<>/ \n\t\r\x00\x0b\u00a0\u2003éßŒİΣς日本٣½①ªʰ😀", "\u0301", "\u200d", "'s", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "\U000323b0", "word", "word,***", "  "]
    texts = ["", " ", "\n", "...", "a" * 300, "x, " * 1000, *("".join(rng.choices(some, k=rng.randrange(60))) for _ in range(4000))]
    texts += [f"a{c}b, {c}. x{c}'s {c}{c}!" for c in map(chr, (*range(1, 0xD800, 7), *range(0xF900, 0x11000, 5)))]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for room, size in ((24 << 20, len(texts)), (1 << 10, 97), (0, 1)):  # the last forgets all words that the next text doesn't use
        monkeypatch.setattr(word_bpe, "KNOWN_BYTES", room)
        e = word_bpe.WordEncoder(WORDS)
        own = texts if size > 1 else texts[:300]
        assert [x for at in range(0, len(own), size) for x in e.encode_all(own[at : at + size])] == want[: len(own)]
    assert e.encode_all([]) == [] and e.encode_all([""]) == [b""] and e.encode_all(["<|endoftext|>"]) == [e.encode("<|endoftext|>")]


def test_words_of_a_long_tail_are_coded_once(monkeypatch):
    """More words than the cache of chunks holds come again, with other marks: the shards' encoder codes each of them once."""
    rng = random.Random(7)
    words = ["".join(rng.choices("aeioulnrst", k=9)) for _ in range(3000)]
    texts = [" ".join(w + mark for w in rng.sample(words, 1000)) for mark in ("", ",", ".", "!!", ",***", ")") for _ in range(3)]
    monkeypatch.setattr(word_bpe, "CACHE", 500)
    counts = []
    for encode in (lambda e: [e.encode(t) for t in texts], lambda e: [x for t in texts for x in e.encode_all([t])]):
        e, n = word_bpe.WordEncoder(WORDS), Counter()
        plain = e.model
        e.model = type("Model", (), {"tokenize": lambda _, w, n=n, plain=plain: n.update([w]) or plain.tokenize(w)})()
        counts.append((encode(e), n))
    (want, before), (got, after) = counts
    assert got == want and max(after[w] for w in words) == 1
    assert sum(before.values()) > 3 * sum(after.values())  # the way of single texts, which the shards took before


def test_packing_codes_words_of_a_long_tail_once(spark, monkeypatch):
    """A packing task over more words than the cache of chunks holds, in many batches: each word goes once through the model."""
    rng = random.Random(9)
    words = ["".join(rng.choices("aeioulnrst", k=9)) for _ in range(3000)]
    texts = [" ".join(w + mark for w in rng.sample(words, 1000)) for mark in ("", ",", ".", "!!", ",***", ")") for _ in range(3)] + [None, ""]
    monkeypatch.setattr(word_bpe, "CACHE", 500)
    e, n = word_bpe.WordEncoder(WORDS), Counter()
    plain = e.model
    e.model = type("Model", (), {"tokenize": lambda _, w: n.update([w]) or plain.tokenize(w)})()
    monkeypatch.setattr(packing, "encoder", lambda path: e)
    monkeypatch.setattr(packing, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": lambda _: 3})())}))
    docs = type("Docs", (), {"select": lambda self, *_: self, "mapInArrow": lambda _, run, schema: run})()  # hands out what a task runs
    run = packing.pieces(docs, WORDS, 0, 2048)
    batches = [pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([t], pa.string())], names=["doc_id", "text"]) for i, t in enumerate(texts)]
    got = [tuple(r.values()) for b in run(iter(batches)) for r in b.to_pylist()]
    whole, want, seen = Tokenizer.from_file(WORDS), [], Counter()
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[at : at + 2048], "<u4")
            want.append((i, k, at, len(own), zlib.crc32(own.tobytes()), 3, seen[len(own)]))
            seen[len(own)] += 1
    assert got == want
    assert max(n[w] for w in words) == 1


def test_search_takes_every_finite_vector(spark):
    rows = [(0, [1.0, 0.0]), (1, [300000.0, 0.0]), (2, [0.5, 0.0]), (3, [-1e300, 1.0]), (4, [1e300, 0.0]), (5, [float("inf"), 0.0]), (6, []), (50, []), (50, [0.0, 2.0]), (50, [0.0, 1.0])]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=3, query_block=1).collect()}
    assert [got.get((0, k)) for k in range(1, 7)] == [(4, 2**63 - 1), (1, 256 * 256 * 300000), (2, 128 * 256), (50, 0), (50, 0), None]
    # the query 50 is asked once, by the vector that sorts first
    assert got[50, 1] == (6, 0) and (50, 2) not in got


# ---- the pipeline


def shingle_set(text, size):
    w = text.lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 4000").limit(90).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in d]
    top = max(r[0] for r in rows) + 1
    for k in range(15):
        base = rng.choice(rows[:90])
        words = base[1].split(" ")
        if k % 2 and len(words) > 60:
            words[rng.randrange(len(words))] = "changedword"
        rows.append((top + k, " ".join(words) + " " * (k % 3), base[2], "s", None))
    rows += [(top + 90, rows[0][1] + " password = abcdefGHIJKL12345", "en", "s", 1), (top + 91, None, "en", "s", 0), (top + 92, "", None, None, None), rows[1]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # which documents the language models keep is tested above; the rest follows from these
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()
    assert {r.doc_id for r in kept} <= {r[0] for r in rows if r[1]} and len(kept) >= 0.9 * len(rows) - 3
    groups = defaultdict(list)
    for r in kept:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append((-len(r.text), r.doc_id))
    best = {min(g)[1] for g in groups.values()}
    kept = [r for r in kept if r.doc_id in best]
    sets = {r.doc_id: shingle_set(r.text, 5) for r in kept}
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = [r for r in kept if find(r.doc_id) == r.doc_id]
    net, whole, want = secret_scan.trained(), Tokenizer.from_file(WORDS), Counter()
    for r in kept:
        text, gone = r.text, np.zeros(len(r.text), bool)
        runs = []
        for s, _, e, _ in sorted(secret_scan.scan_text(text, net)):
            if runs and s < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        for s, e in reversed(runs):
            text = text[:s] + "[SECRET]" + text[e:]
        del gone
        ids = [*whole.encode(text, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[r.doc_id, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048
    spark.createDataFrame([], docs.schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
