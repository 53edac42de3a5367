"""Operator 2: near-duplicates by SuperMinHash, banding, exact verification and connected components.

A document's set is that of its distinct word shingles, as 64-bit hashes. Documents with equal sets are one
class from the start. A class's signature is a SuperMinHash: each element runs through its own random
permutation of the places, one place a round, with rank round + random; a document stops once every place holds
a value below the next round's. Signatures are cut into BANDS bands of ROWS places; at similarity 0.8 a pair shares no band with
a chance of about 5e-8.

Candidates are verified on full sets in two steps, neither of which emits all pairs of a bucket. First each class is
paired with the smallest class of each of its buckets, and links give components. Then, in buckets that still hold several
components, each class outside the largest one is held against the classes of other components, nearest
signatures first and on full sets; a link joins two components at once, so a group sends fewer links than it has
components. What is connected already needs no further pair, so components are those of all links that share a bucket.

Texts never shuffle. The sets of classes that a step asks about are made where the texts are, and travel, once for each candidate
pair, to the pair's pivot; pivots with many partners are split into salted groups.

Null and empty texts, and ones without words: size 0, own component, kept. Null id: as if linked with nothing (component null, kept).
Repeated ids: n_shingles is each row's own; rows of one id are one document, so a link of one of its texts counts for all. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BITS, MAX_IDS, Workspace, among, claim, slices, texts_of, without
from .components import components

BANDS, ROWS = 32, 4
PLACES = BANDS * ROWS
#: Pairs whose estimate is under the threshold by more than this (six deviations) aren't verified; at 0.8 fewer than banding misses.
MARGIN = 0.21
#: Members that meet a pivot, or a block of a bucket, in one group.
GROUP = 256
#: Classes outside the largest component that one group of a bucket holds.
OUTSIDE = 1024
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _B
    z = (z ^ (z >> np.uint64(27))) * _C
    return z ^ (z >> np.uint64(31))


class _Words(dict):
    """64-bit hash of a word, found once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; words are runs without [\\x20\\x09-\\x0D], A-Z in lower case."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    k = min(n, size)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _A + _mix(h[i : n - k + 1 + i] + np.uint64(i))
    return np.unique(_mix(out))


def superminhash(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures of non-empty sets, a row of PLACES values each (as 64-bit patterns)."""
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    sig = np.full((len(sets), PLACES), np.inf)
    flat = sig.reshape(-1)
    perm = np.tile(np.arange(PLACES, dtype=np.uint8), (len(h), 1))
    alive, open_ = np.arange(len(h)), np.arange(len(sets))
    for j in range(PLACES):
        x = _mix(h[alive] + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & (2**64 - 1)))
        rank = (x >> np.uint64(12)).astype(np.float64) * 2.0**-52
        k = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(PLACES - j) >> np.uint64(32)).astype(np.int64)
        place = perm[alive, k]
        perm[alive, k] = perm[alive, j]
        np.minimum.at(flat, doc[alive] * PLACES + place, rank + j)
        more = sig[open_].max(axis=1) >= j + 1
        if not more.all():
            open_ = open_[more]
            if not len(open_):
                break
            going = np.zeros(len(sets), bool)
            going[open_] = True
            alive = alive[going[doc[alive]]]
    return sig.view(np.uint64)


def _bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    out = np.zeros((len(sig), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = _mix(out * _A + sig[:, r::ROWS])
    return out.view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n (set size), digest of the set, bands and sig: a 16-bit signature, the bands' keys and n; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_dedup", _words.clear)
        for batch in slices(batches, 128):
            sets = [shingles(t, size) for t in texts_of(batch.column(2))]
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            sig: list = [None] * len(sets)
            at = 0
            while at < len(full):  # so many elements at once that their permutations fit 16 MB, a document at least
                to, n = at, 0
                while to < len(full) and (to == at or n + len(sets[full[to]]) <= 1 << 17):
                    n += len(sets[full[to]])
                    to += 1
                s = superminhash([sets[i] for i in full[at:to]])
                short = _mix(s).astype(np.uint16)
                for i, b, x in zip(full[at:to], _bands(s), short, strict=True):
                    bands[i], sig[i] = b, x.tobytes() + b.tobytes() + np.int64(len(sets[i])).tobytes()
                at = to
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary()),
                ],
                schema=_SIGNED,
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n long, digest binary, bands array<long>, sig binary")


def _sets(ws: Workspace, docs: DataFrame, wanted: DataFrame, size: int, max_ids: int, max_bits: int) -> DataFrame:
    """id, elements (64 bits each, ascending) of the documents whose id is in ``wanted``, and perhaps of others, which then have no partner.

    The texts don't shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id IS NOT NULL")
    rows, _ = among(ws, rows, "id", wanted, max_ids, max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_dedup", _words.clear)
        for batch in slices(batches, 128):
            own = [shingles(t, size).astype("<u8").tobytes() for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["id", "elements"])

    return rows.select("id", "text").mapInArrow(run, "id long, elements binary")


def _read(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u8")


def _linked(s: np.ndarray, c: np.ndarray, percent: int) -> bool:
    low, high = sorted((len(s), len(c)))
    if not low or 100 * low < percent * high:
        return False
    both = int((c[np.minimum(np.searchsorted(c, s), len(c) - 1)] == s).sum())
    return 100 * both >= percent * (low + high - both)


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes, by id, whose sets have 100 * intersection >= percent * union.

    Sets go to the pair's pivot b, in groups of about GROUP partners.
    """
    degree = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("m")).withColumn("salts", F.ceil(F.col("m") / GROUP).cast("int"))
    salted = pairs.join(degree, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    # where each class's set must go: to its pivots as a partner, and to its own groups as a pivot
    partner = salted.select(F.col("a").alias("id"), F.struct(F.col("b").alias("pivot"), "salt", F.lit(False).alias("own")).alias("to"))
    pivot = degree.select(F.col("b").alias("id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select("id", F.struct(F.col("id").alias("pivot"), "salt", F.lit(True).alias("own")).alias("to"))
    # a repeated id has several texts; each of its sets is held against the pivot's
    placed = sets.join(partner.unionByName(pivot), "id").select("to.pivot", "to.salt", "to.own", "id", "elements")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        centres = [_read(x) for x in pdf["elements"][pdf["own"]]]
        found = []
        for i, x in zip(pdf["id"][~pdf["own"]], pdf["elements"][~pdf["own"]], strict=True):
            s = _read(x)
            for c in centres:
                if _linked(s, c, percent):
                    found.append(i)
                    break
        return pd.DataFrame({"a": np.array(found, np.int64), "b": np.full(len(found), key[0], np.int64)})

    return placed.groupBy("pivot", "salt").applyInPandas(compare, "a long, b long")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """((key, block, sub, band), columns) of each run of rows of one group; the rows come sorted by group."""
    now, rows = None, {}
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if values[:4] != now:
                if now is not None:
                    yield now, rows
                now, rows = values[:4], {n: [] for n in names[4:]}
            for n, x in zip(names[4:], values[4:], strict=True):
                rows[n].append(x)
    if now is not None:
        yield now, rows


def _near(rows: dict[str, list], band: int, least: float, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row outside the largest component, and the rows of other components whose signatures are near, nearest first.

    Sets whose sizes alone rule a link out aren't near.
    """
    minor = np.array(rows["minor"], bool)
    left, right = np.flatnonzero(minor), np.flatnonzero(~minor)
    if not len(left) or not len(right):
        return
    both = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(-1, 2 * PLACES + 8 * BANDS + 8)
    sig, keys, size = (np.ascontiguousarray(x).view(t) for x, t in ((both[:, : 2 * PLACES], np.uint16), (both[:, 2 * PLACES : -8], np.int64), (both[:, -8:], np.int64)))
    size = size[:, 0]
    component = np.array(rows["component"], np.int64)
    for i in left:
        agree = (sig[right] == sig[i]).sum(axis=1)
        low, high = np.minimum(size[right], size[i]), np.maximum(size[right], size[i])
        near = np.flatnonzero((agree >= least) & (component[right] != component[i]) & (100 * low >= percent * high))
        # a pair is looked at in the first bucket that it shares, by the keys that make the buckets
        near = near[(keys[right[near]] == keys[i]).argmax(axis=1) == band]
        if len(near):
            yield i, right[near[np.argsort(-agree[near], kind="stable")]]


_GROUP = ("key", "block", "sub", "band")
_NEAR = pa.schema([("key", pa.int64()), ("block", pa.int32()), ("sub", pa.int32()), ("band", pa.int32()), ("id", pa.int64()), ("component", pa.int64()), ("sig", pa.binary()), ("minor", pa.bool_())])


def _cross(ws: Workspace, buckets: DataFrame, known: DataFrame, sets: Callable[[DataFrame], DataFrame], labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components that share a bucket, enough to join all components that links join.

    ``known`` has id, sig; ``sets`` gives the sets of ids. A bucket is dealt out in blocks of its members by sub-blocks of those outside its largest
    component. Signatures alone travel first; the sets follow only of members that have a near signature in their group,
    which then joins components as it finds links.
    """
    lab = buckets.join(labels, buckets.id == labels.node, "left").select("key", "band", "id", F.coalesce("component", "id").alias("component"))
    sizes = lab.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    mixed = (
        sizes.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("m").alias("members"), F.max(F.struct("m", "component")).alias("top")).where("kinds > 1")
        .select("key", F.col("top.component").alias("main"), F.ceil(F.col("members") / GROUP).cast("int").alias("blocks"), F.ceil((F.col("members") - F.col("top.m")) / OUTSIDE).cast("int").alias("subs"))
    )
    own = lab.join(mixed, "key").join(known, "id")
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = ("band", "id", "component", "sig")
    majors = own.select("key", dealt("blocks").alias("block"), every("subs").alias("sub"), *rest, F.lit(False).alias("minor"))
    minors = own.where("component != main").select("key", every("blocks").alias("block"), dealt("subs").alias("sub"), *rest, F.lit(True).alias("minor"))
    least = PLACES * (percent / 100 - MARGIN)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _grouped(batches):
            use: set[int] = set()
            for i, near in _near(rows, group[3], least, percent):
                use.add(int(i))
                use.update(near.tolist())
            if use:
                at = sorted(use)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), t) for x, t in zip(group, _NEAR.types, strict=False)] + [pa.array([rows[n][i] for i in at], _NEAR.field(n).type) for n in _NEAR.names[4:]], schema=_NEAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _grouped(batches):
            ids, component = rows["id"], rows["component"]
            root = {c: c for c in component}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            parsed: dict[int, np.ndarray] = {}
            found = []
            for i, near in _near(rows, group[3], least, percent):
                for j in near:
                    a, b = find(component[i]), find(component[j])
                    if a == b:
                        continue
                    for k in (i, j):
                        if k not in parsed:
                            parsed[k] = _read(rows["elements"][k])
                    if _linked(parsed[i], parsed[j], percent):
                        root[max(a, b)] = min(a, b)
                        found.append((ids[i], ids[j]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    spread = lambda df: df.repartition(*_GROUP[:3]).sortWithinPartitions(*_GROUP[:3])
    form = "key long, block int, sub int, band int, id long, component long, sig binary, minor boolean"
    near = ws.save(spread(majors.unionByName(minors)).mapInArrow(candidates, form), "candidates")
    return spread(near.join(sets(near.select("id")), "id").select(*near.columns, "elements")).mapInArrow(run, "a long, b long").distinct()


def _components(ws: Workspace, docs: DataFrame, size: int, percent: int, max_ids: int, max_bits: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for each row of ``docs``."""
    signed = ws.save(signatures(docs, size), "signed")
    rows = ws.save(signed.select("doc_id", "text_hash", "n", "digest"), "rows")
    classes = ws.save(rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    # a class is known by its smallest document; of repeated rows of it one is enough
    heads = ws.save(signed.join(classes, (signed.doc_id == classes.id) & (signed.digest == classes.digest), "left_semi").select(F.col("doc_id").alias("id"), "n", "bands", "sig").dropDuplicates(["id", "sig"]), "heads")
    ws.drop("signed")
    buckets = heads.select("id", "n", F.posexplode("bands").alias("band", "key"))
    full = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "n")).alias("b")).where("m > 1").select("key", F.col("b.id").alias("b"), F.col("b.n").alias("bn"))
    shared = ws.save(buckets.join(full, "key"), "buckets")
    # made anew for each use, of the documents that it is about: cheaper than to move the sets of all that share a bucket
    sets = lambda ids: _sets(ws, docs, ids, size, max_ids, max_bits)
    # sizes that rule a link out need no sets
    pairs = ws.save(shared.where(F.col("id") != F.col("b")).where(100 * F.least("n", "bn") >= percent * F.greatest("n", "bn")).select(F.col("id").alias("a"), "b").distinct(), "pairs")
    links = ws.save(_verified(sets(pairs.select("a").union(pairs.select("b"))), pairs, percent), "links")
    labels = components(ws, links, "first")
    more = ws.save(_cross(ws, shared.select("key", "band", "id"), heads.select("id", "sig"), sets, labels, percent), "more-links")
    if not more.isEmpty():
        labels = components(ws, links.unionByName(more), "second")
    ws.drop("heads", "buckets", "pairs", "links", "more-links", "candidates")
    member = classes.join(labels, classes.id == labels.node, "left").select("digest", F.coalesce("component", "id").alias("found"))
    component = F.coalesce("found", "doc_id")
    return rows.join(member, "digest", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def near_groups(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80, max_ids: int = MAX_IDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    return _components(Workspace(spark, "near-dedup"), docs, size, percent, max_ids, max_bits).drop("text_hash")


def keep_heads(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80, max_ids: int = MAX_IDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, that are their component's document. Only rows whose id may be a dropped one's shuffle."""
    ws = Workspace(spark, "near-dedup-dropped")
    gone = ws.save(_components(ws, docs, size, percent, max_ids, max_bits).where("NOT kept").select("doc_id", "text_hash").distinct(), "dropped")
    return without(ws, docs, gone, [F.col("doc_id").cast("long"), F.xxhash64("text")], max_ids, max_bits)
