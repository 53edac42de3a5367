"""Operator 5: secret scanning, rules plus a character convolutional network in numpy.

Three rules find base spans (assign, access, hex). Every candidate, base spans and other long runs of the
alphabet of keys (dots inside too, with digits or without), goes with its surroundings through the network: characters are classed and embedded,
convolved, pooled over the window, and scored; a long candidate is covered by overlapping windows and
gets the highest score. The network is trained on labelled findings that a seeded generator makes
(TRAIN_FINDINGS of them); a held-out part calibrates its probability (Platt) and sets the highest threshold
that keeps LEAST_RECALL of the secrets. Candidates over the threshold are added as ``model`` where they lie outside the base spans or reach
beyond them, so a key of which a rule has only a part is found whole.

Null and empty texts: no spans. Positions are code points. One pass without a shuffle; repeated rows are scanned one by one.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, map_texts, small_batches

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A candidate beside the base spans: a whole run of the alphabet of keys, dots inside it.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=-](?:[A-Za-z0-9+/_=.-]{14,}[A-Za-z0-9+/_=-])")
_LETTER = re.compile(r"[A-Za-z]")
#: Words of prose: letters in one case, or a capital and small letters, joined by hyphens or dots at most; no key looks so.
_PROSE = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-.=_/]+(?:[A-Z]?[a-z]+|[A-Z]+))*[-.=_/]*")

#: Characters before and after a candidate in its window; its own characters in a window; the step between windows.
BEFORE, AFTER, OWN, STEP = 20, 4, 48, 24
TRAIN_FINDINGS, LEAST_RECALL = 6_000, 0.99
WIDTH = BEFORE + OWN + AFTER


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' findings, by start and then kind."""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "key" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of candidates that no base span covers, plain words aside."""
    out, k = [], 0
    ends = sorted((e, s) for s, _, e in base)
    for m in CANDIDATE.finditer(text):
        if _PROSE.fullmatch(m[0]) or not _LETTER.search(m[0]):
            continue
        while k < len(ends) and ends[k][0] <= m.start():
            k += 1
        if not any(s <= m.start() and e >= m.end() for e, s in ends[k : k + 4]):
            out.append(m.span())
    return out


def _classes() -> np.ndarray:
    """A class for each code point below 128: letters by case, digits, each mark of keys, space, other."""
    out = np.full(129, 1, np.int64)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        out[ord(c)], out[ord(c.upper())] = 2 + i, 28 + i // 2
    for c in "0123456789":
        out[ord(c)] = 41 + int(c) // 2
    for i, c in enumerate("+/_=-.:\"'@ \n"):
        out[ord(c)] = 46 + i
    return out


CLASSES = _classes()
N_CLASSES = 58


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Class codes of the windows that cover a candidate; 0 stands for outside and for the rest of a short one."""
    code = lambda s: CLASSES[np.minimum(np.frombuffer(s.encode("utf-32-le"), np.uint32), 128).astype(np.int64)]
    rows = []
    for at in range(start, max(start + 1, end - OWN + STEP), STEP):
        row = np.zeros(WIDTH, np.int64)
        left, own, right = code(text[max(0, at - BEFORE) : at]), code(text[at : min(end, at + OWN)]), code(text[min(end, at + OWN) : min(end, at + OWN) + AFTER])
        row[BEFORE - len(left) : BEFORE] = left
        row[BEFORE : BEFORE + len(own)] = own
        row[WIDTH - AFTER : WIDTH - AFTER + len(right)] = right
        rows.append(row)
    return np.stack(rows)


class Network:
    """Embedding, one convolution with ReLU, max and mean pooling, one dense output."""

    def __init__(self, rng: np.random.Generator, embed: int = 10, filters: int = 32, width: int = 5):
        self.width = width
        n = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"e": rng.normal(0, 0.3, (N_CLASSES, embed)), "w": n(width * embed, filters), "b": np.zeros(filters), "v": n(2 * filters), "c": np.zeros(1)}
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        e = self.p["e"][x]  # rows, places, embed
        cols = np.concatenate([e[:, i : WIDTH - self.width + 1 + i] for i in range(self.width)], axis=2)
        a = np.maximum(cols @ self.p["w"] + self.p["b"], 0)
        top = a.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None, :], 1)[:, 0], a.mean(axis=1)], axis=1)
        return cols, a, top, pooled, pooled @ self.p["v"] + self.p["c"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[4] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.logits(x) + self.shift)))

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 6, rate: float = 0.01, batch: int = 64) -> None:
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                own = order[at : at + batch]
                t += 1
                for k, g in self._gradients(x[own], y[own]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        cols, a, top, pooled, z = self._forward(x)
        dz = (1 / (1 + np.exp(-z)) - y) / len(y)
        f = a.shape[2]
        dp = dz[:, None] * self.p["v"][None]
        da = np.repeat(dp[:, None, f:] / a.shape[1], a.shape[1], axis=1)
        np.put_along_axis(da, top[:, None, :], np.take_along_axis(da, top[:, None, :], 1) + dp[:, None, :f], 1)
        da *= a > 0
        dc = da @ self.p["w"].T
        de, size = np.zeros_like(self.p["e"]), self.p["e"].shape[1]
        for i in range(self.width):
            np.add.at(de, x[:, i : WIDTH - self.width + 1 + i], dc[:, :, i * size : (i + 1) * size])
        return {"c": dz.sum(keepdims=True), "v": pooled.T @ dz, "w": np.einsum("rpc,rpf->cf", cols, da), "b": da.sum((0, 1)), "e": de}


def findings(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of ``n`` generated findings, half of them secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(s[i] for i in rng.integers(0, len(s), k))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, b64 = digits + "abcdef", lower + upper + digits + "+/"
    word = lambda: pick("bcdfghlmnprst", 1) + "".join(pick("aeiou", 1) + pick("bcdfghlmnprst", 1) for _ in range(int(rng.integers(1, 5))))
    prose = lambda k: " ".join(word() for _ in range(k))
    num = lambda k: pick(digits, k)
    size = lambda a, b: int(rng.integers(a, b))
    secret = [
        lambda: ("", pick(hexa, size(16, 64))), lambda: ("", "AKIA" + pick(upper + digits, size(14, 20))), lambda: (pick(["token", "password", "api_key", "secret", "apikey"], 1) + pick([" = ", ": ", "=", " : \""], 1), pick(b64, size(16, 48))),
        lambda: ("", "ghp_" + pick(lower + upper + digits, 36)), lambda: ("", "sk-" + pick(lower + upper + digits, size(24, 48))), lambda: ("", "xoxb-" + num(11) + "-" + pick(lower + upper + digits, 24)),
        lambda: ("", "eyJ" + pick(b64[:62], size(30, 90))), lambda: ("", "eyJ" + pick(b64[:62], size(16, 40)) + ".eyJ" + pick(b64[:62], size(20, 60)) + "." + pick(b64[:62] + "_-", 43)), lambda: ("", pick(lower + upper, size(20, 44))), lambda: ("", pick(b64, 64)), lambda: (pick(["Authorization: Bearer ", "auth ", "key "], 1), pick(b64, size(24, 64))), lambda: ("", "AIza" + pick(lower + upper + digits + "_-", 35)),
    ]
    cap = lambda: word().capitalize()
    consonants = lambda k: pick("bcdfghklmnprst", k)
    clean = [
        lambda: (consonants(size(4, 8)) + "." + num(2) + "@", word() + num(1) + "." + word() + "." + pick(["com", "org", "net"], 1)), lambda: (word() + "@", word() + num(size(1, 3)) + ".example." + pick(["com", "org"], 1)), lambda: ("", consonants(size(4, 8)) + "." + num(2) + "-" + word() + "." + word()),
        lambda: ("", ".".join([word(), word(), word() + num(1), pick(["com", "org", "io"], 1)])), lambda: ("", cap() + cap() + cap() + word()), lambda: ("", word() + cap() + cap() + num(size(1, 3))), lambda: ("", "v" + num(1) + "." + num(2) + "." + num(1) + "-" + word() + "." + num(3)),
        lambda: ("", num(size(16, 20))), lambda: ("", word() + "-" + word() + "-" + word() + num(size(1, 4))), lambda: (word() + num(2) + "@", "mail" + num(1) + "-example-" + word()), lambda: ("https://", word() + num(size(1, 3)) + "/" + word() + "/" + word() + "/" + num(4)),
        lambda: ("", "20" + num(2) + "-" + num(2) + "-" + num(2) + "-" + word() + "-" + word()), lambda: ("", word() + word() + word() + word() + num(size(1, 3))), lambda: ("", "_".join([word(), word(), word(), num(2)])), lambda: ("", "-" * size(16, 30) + num(1) + word()),
        lambda: ("", "=" * size(16, 40) + word() + num(1)), lambda: ("/", "/".join([word(), word(), word() + num(1), word()])), lambda: ("", word().upper() + word().upper() + word().upper() + "-" + num(size(2, 6))), lambda: ("", "+" + num(2) + "-" + num(3) + "-" + num(3) + "-" + num(4) + word()), lambda: ("", num(1) + word() + word() + word() + word() + word()),
    ]
    x, y = [], []
    for i in range(n):
        kinds = secret if i % 2 == 0 else clean
        lead, body = kinds[int(rng.integers(len(kinds)))]()
        left = prose(3) + pick([" ", "\n", ": ", " \""], 1) if rng.random() < 0.9 else ""
        text = left + lead + body + pick([" ", ".", "\n", "\" ", ", "], 1) + prose(1)
        own = windows(text, len(left) + len(lead), len(left) + len(lead) + len(body))
        x.append(own[int(rng.integers(len(own)))])
        y.append(float(i % 2 == 0))
    return np.stack(x), np.array(y)


@functools.lru_cache(maxsize=2)
def trained(n: int = TRAIN_FINDINGS, seed: int = 20250101) -> Network:
    """The network, calibrated on a quarter of the findings that it hasn't seen."""
    x, y = findings(n, seed)
    rng = np.random.default_rng(seed + 1)
    cut = len(x) * 3 // 4
    net = Network(rng)
    net.fit(x[:cut], y[:cut], rng)
    z, v = net.logits(x[cut:]), y[cut:]
    for _ in range(500):  # Platt scaling by gradient descent
        p = 1 / (1 + np.exp(-(net.slope * z + net.shift)))
        net.slope -= 0.5 * float(((p - v) * z).mean()) / max(1.0, float((z * z).mean()))
        net.shift -= 0.5 * float((p - v).mean())
    p = 1 / (1 + np.exp(-(net.slope * z + net.shift)))
    kept = np.sort(p[v == 1])
    # no lower than even odds where recall allows it
    net.threshold = float(min(max(0.5, kept[0]), kept[int((1 - LEAST_RECALL) * len(kept))]))
    return net


def scan_text(text: str, net: Network) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, probability) of all findings, by start and then kind."""
    base = base_spans(text)
    extra = candidates(text, base)
    if not base and not extra:
        return []
    own = [windows(text, s, e) for s, e in [(s, e) for s, _, e in base] + extra]
    p = net.probability(np.concatenate(own))
    at = np.cumsum([0, *map(len, own)])
    best = [float(p[a:b].max()) for a, b in zip(at, at[1:], strict=False)]
    out = [(*b, q) for b, q in zip(base, best, strict=False)]
    out += [(s, 3, e, q) for (s, e), q in zip(extra, best[len(base) :], strict=True) if q >= net.threshold]
    return sorted(out)


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and its findings: an array of (kind, start, end, probability)."""
    net = trained()

    def make():
        return lambda texts: [[[{"kind": KINDS[k], "start": s, "end": e, "probability": q} for s, k, e, q in scan_text(t, net)] for t in texts]]

    return map_texts(docs, make, [("findings", _SPAN)])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    net = trained()

    def make():
        def run(texts: list[str]) -> list:
            out: list[list] = [[], [], [], [], []]
            for t in texts:
                found = scan_text(t, net)
                said = lambda x: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in x)
                row = [*(sum(f[1] == k for f in found) for k in range(3)), hashlib.sha256(said([f for f in found if f[1] < 3]).encode()).hexdigest(), said(found)]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            return out

        return run

    return map_texts(docs, make, [*((f"n_{k}", T.LongType()) for k in KINDS[:3]), ("base_sha256", T.StringType()), ("spans", T.StringType())])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding in its text replaced by ``mark``; other columns and rows stay as they are."""
    net = trained()
    small_batches(docs.sparkSession)

    @F.pandas_udf(T.StringType())
    def clean(text):
        claim("secret_scan")

        def one(t):
            if not t:
                return t
            out, at = [], 0
            for s, _, e, _ in scan_text(t, net):
                if e > at:
                    if s >= at:
                        out += [t[at:s], mark]
                    at = e
            return "".join(out) + t[at:] if at else t

        return text.map(one, na_action="ignore")

    return docs.withColumn("text", clean(F.col("text")))
