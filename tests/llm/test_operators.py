"""Operators against brute force on a small fixture with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sluice.llm import byte_bpe, exact_dedup, language_id, near_dedup, packing, secret_scan, suffix_dedup, token_store, topk_search, toxicity

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, kept string, block string, key string"


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 7)))
    vocabulary = [word() for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = say(90)
    texts = [say(rng.randint(1, 120)) for _ in range(40)]
    base = say(100).split()
    for k in range(8):
        near = list(base)
        near[k * 11] = word()
        texts.append(" ".join(near))
    texts += [texts[0], texts[0].replace(" ", "\n"), texts[0] + "  ", f"a {passage} b", f"{say(30)} {passage}", passage + "\t" + passage]
    texts += [None, "", "", "   \n", "x", "İstanbul ΣΑΣ é ünïcode 你好 123", "<|endoftext|> it's   we'll", say(6000), "a" * 3000, 'token = "' + "0f3a" * 10 + '" AKIA' + "Q7" * 9 + " password: secret: abcdefghijklmnop"]
    rows = [(i, t, "en" if i % 2 else "de", "s", None, "x", None, "b", "k") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no id at all here", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs():
    return [(r[0], r[1] or "") for r in corpus()]


def as_multiset(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def ids_of(text):
    return Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids


def test_token_index(spark, docs, empty, tmp_path):
    got = token_store.token_index(spark, docs, WORDS).orderBy("start").collect()
    want = sorted(((-1 if i is None else i, t) for i, t in pairs()), key=lambda x: x)
    at = 0
    for r, (i, t) in zip(got, want, strict=True):
        own = np.array([*ids_of(t), 2], "<u4").tobytes()
        assert ((-1 if r.doc_id is None else r.doc_id), r.start, r.n_tokens, r.ids_crc32) == (i, at, len(own) // 4, zlib.crc32(own))
        at += len(own) // 4
    path = str(tmp_path / "shards")
    token_store.write_shards(spark, docs, path, WORDS, 2)
    found = token_store.lookup(spark, path, spark.createDataFrame([(5,), (7,), (10**9,)], "doc_id long")).collect()
    assert Counter(r.doc_id for r in found) == {5: 2, 7: 1}
    assert next(r.ids for r in found if r.doc_id == 7) == [*ids_of(pairs()[7][1]), 2]
    assert token_store.token_index(spark, empty, WORDS).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000))
    p = token_store.PerfectHash.build(keys)
    assert sorted(p.slots(keys)) == list(range(len(keys)))


def linked(a, b):
    return a and b and 100 * len(a & b) >= 80 * len(a | b)


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_dedup(spark, docs, empty):
    own = [(i, shingle_set(t, 4)) for i, t in pairs()]
    root = list(range(len(own)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(own)):
        for j in range(i):
            if own[i][0] is not None and own[j][0] is not None and linked(own[i][1], own[j][1]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    smallest = defaultdict(lambda: 10**9)
    for k, (i, _) in enumerate(own):
        smallest[find(k)] = min(smallest[find(k)], 10**9 if i is None else i)
    want = Counter((i, len(s), None if i is None else smallest[find(k)], i is None or smallest[find(k)] == i) for k, (i, s) in enumerate(own))
    assert as_multiset(near_dedup.near_groups(spark, docs, 4, 80), "doc_id", "n_shingles", "component_id", "kept") == want
    assert near_dedup.near_groups(spark, empty, 4, 80).count() == 0


def test_superminhash_estimates():
    a = np.unique(np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64))
    b = a.copy()
    b[:333] += np.uint64(1)
    s = near_dedup.superminhash([a, b])
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.15


def test_byte_bpe(docs, empty):
    with open(BYTES, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in pairs():
        ids = np.array(e.encode_ordinary(t), "<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert as_multiset(byte_bpe.round_trip(docs, BYTES, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert byte_bpe.round_trip(empty, BYTES, public_tokenizers.PATTERN).count() == 0
    rng = random.Random(1)
    bpe = byte_bpe.codec(BYTES, public_tokenizers.PATTERN)
    for w in ("a" * 4001, "ab" * 900, "".join(rng.choice("aeinrst") for _ in range(30000))):
        assert bpe.merge(w.encode()) == e.encode_ordinary(w)


def test_toxicity(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    p = toxicity.toxicity(spark, d, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = p.score[p.toxic == 1], p.score[p.toxic == 0]
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in bad] for a in good]) > 0.9
    none = labels.limit(0)
    assert {r.score for r in toxicity.toxicity(spark, docs, none).collect()} == {0.0}
    assert toxicity.toxicity(spark, empty, none).count() == 0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    _, y = toxicity.isotonic(x, (rng.random(500) < 1 / (1 + np.exp(-3 * x))).astype(float))
    assert (np.diff(y) >= 0).all() and 0 <= y.min() and y.max() <= 1


def test_secret_scan(docs, empty):
    want = Counter()
    for i, t in pairs():
        a = [m for m in re.finditer(r"(?a)([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 12]
        b = [m for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        h = [m for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        spans = sorted((m.start(), k, m.end()) for k, own in enumerate((a, b, h)) for m in own)
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
        want[i, len(a), len(b), len(h), hashlib.sha256(said.encode()).hexdigest()] += 1
    assert as_multiset(secret_scan.digest(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    assert secret_scan.digest(empty).count() == 0
    x, y = secret_scan.findings(1000, 77)
    net = secret_scan.trained()
    hit = net.probability(x) >= net.threshold
    assert hit[y == 1].mean() > 0.97 and hit[y == 0].mean() < 0.03
    assert [k for _, k, _, _ in secret_scan.scan_text("key ghp_" + "aB3dE6gH9" * 4, net)] == [3]


def test_topk(spark):
    rng = np.random.default_rng(5)
    v = [(i, (rng.normal(size=8) * 0.4).round(3).tolist()) for i in range(230)] + [(i, [0.5] * 8) for i in range(300, 360)] + [(400, None), (450, [None] * 8), (500, [float("nan")] * 8), (None, [0.1] * 8), (50, [0.2] * 3)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(4)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.search(spark, df).collect()}
    ok = [(i, np.floor(256 * np.array(x)).astype(int)) for i, x in v if i is not None and x is not None and None not in x and np.isfinite(x).all()]
    for i, q in ok:
        if i % 50 == 0 and len(q) == 8 and i != 50:
            best = sorted((-int(q @ y), j) for j, y in ok if j != i and len(y) == 8)[:5]
            assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in best]
    assert topk_search.search(spark, df.limit(0)).count() == 0


def test_language(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = language_id.identify(spark, d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (p.lang_pred == p.lang).mean() > 0.97 and p.score.between(0, 1).all() and p.rejected.mean() < 0.02
    und = {r.doc_id for r in language_id.identify(spark, docs).where("lang_pred = 'und'").collect()}
    letters = {i for i, t in pairs() if not any(c.isalpha() for c in t)}
    assert und == letters
    assert language_id.identify(spark, empty).count() == 0


def test_exact_dedup(spark, docs, empty):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    groups = defaultdict(list)
    for i, t in pairs():
        groups[key(t)].append((-len(t), i is None, i))
    want = Counter()
    for i, t in pairs():
        g = groups[key(t)]
        keep = min(g)[2]
        want[i, keep, len(g), keep == i, hashlib.sha256(key(t).encode()).hexdigest()] += 1
    assert as_multiset(exact_dedup.exact_groups(spark, docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.exact_groups(spark, empty).count() == 0


@pytest.mark.parametrize("length", [20, 400])
def test_suffix_dedup(spark, docs, empty, length, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4000)
    own = [(i, t.encode()) for i, t in pairs()]
    seen = Counter(b[k : k + length] for _, b in own for k in range(len(b) - length + 1))
    want = Counter()
    for i, b in own:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    assert as_multiset(suffix_dedup.remove_repeats(spark, docs, length), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.remove_repeats(spark, empty, length).count() == 0


@pytest.mark.parametrize("period", suffix_dedup.COVERS)
def test_difference_covers(period):
    c = suffix_dedup.COVERS[period]
    assert {(a - b) % period for a in c for b in c} == set(range(period))


@pytest.mark.parametrize("capacity", [32, 2048])
def test_packing(spark, docs, empty, capacity):
    got = packing.pack(spark, docs, WORDS, capacity).collect()
    want = Counter()
    for i, t in pairs():
        ids = [*ids_of(t), 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            want[i, k, at, len(ids[at : at + capacity]), zlib.crc32(np.array(ids[at : at + capacity], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    # plain best fit, decreasing
    open_: list[int] = []
    for n in sorted((r.length for r in got), reverse=True):
        fits = [g for g in open_ if g >= n]
        open_.append((open_.pop(open_.index(min(fits))) if fits else capacity) - n)
    assert len(bins) == len(open_)
    assert packing.pack(spark, empty, WORDS, capacity).count() == 0
