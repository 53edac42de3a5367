"""Encoding by a word-level BPE file of the tokenizers library, with caches of what recurs.

The normaliser and the splitter of such a file never join characters over a space, so a text is
encoded as its space-separated chunks; each distinct chunk is split into pre-tokens, and each
distinct pre-token goes once through the library's model. Chunks that hold a character which Python's
Unicode tables don't know take the library's whole path, as the library's tables are others; so do texts that aren't composed
(NFC) or hold a special token's string, and files of another make.

Many texts at once are split in Arrow's memory: each distinct chunk of them is met once, and words without the
marks at their end are kept in flat arrays, which hold several times the words that a dictionary of strings does.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from .common import claim

_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Entries of the cache's young half; the old half is dropped when the young one is full.
CACHE = 100_000
#: Marks that end a chunk and are a pre-token of their own there.
_TAIL = frozenset(".,;:!?")
#: Of many texts: runs of these at a chunk's end are a pre-token of their own behind a letter (an apostrophe may be none).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Ids that are gathered at once, at about which a block ends, and bytes of the table of words that many texts share, at which it is full.
BLOCK, KNOWN_BYTES = 1 << 18, 16 << 20

_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of a file; one for each worker process, with its caches."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    claim("word_bpe", lambda: [e.forget() for e in _encoders.values()])
    return _encoders[path]


def _byte_alphabet() -> list[str]:
    """The printable character by which byte-level BPE files write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [names[b] for b in range(256)]


def _unassigned() -> re.Pattern:
    """Characters without a category in Python's tables, from the tables themselves."""
    runs, start = [], None
    for c in range(sys.maxunicode + 2):
        none = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if none and start is None:
            start = c
        elif not none and start is not None:
            runs.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(runs)}]")


class Recent(dict):
    """Results of ``make`` by key. What was asked for lately stays: a full young half becomes the old one."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out

    def forget(self) -> None:
        self.old = {}
        self.clear()


class WordEncoder:
    """``encode(text)``: the ids as little-endian unsigned 32-bit integers, without special tokens added."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        said = json.loads(self.whole.to_str())
        self.specials = [x["content"] for x in said["added_tokens"]]
        self.fast = self._known(said)
        self.model, self.alphabet, self.unassigned = self.whole.model, _byte_alphabet(), _unassigned()
        self.pieces = regex.compile(_SPLIT)
        # a pre-token that stands as a chunk of its own is split into itself, so one cache serves both
        self.chunks = Recent(self._chunk)
        self.words = Words(self._word)

    def forget(self) -> None:
        self.chunks.forget()
        self.words.forget()

    @staticmethod
    def _known(said: dict) -> bool:
        norm = (said.get("normalizer") or {}).get("normalizers", [])
        pre = (said.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        return (
            [x.get("type") for x in norm] == ["NFC", "Replace", "Lowercase"]
            and norm[1].get("pattern") == {"Regex": r"\s+"}
            and norm[1].get("content") == " "
            and [x.get("type") for x in pre] == ["Split", "ByteLevel"]
            and pre[0].get("pattern") == {"Regex": _SPLIT}
            and not pre[1].get("use_regex")
            and not pre[1].get("add_prefix_space")
            and all(not x["lstrip"] and not x["rstrip"] for x in said["added_tokens"])
        )

    def _slow(self, text: str) -> bytes:
        return _pack(self.whole.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        coded = word if word.isascii() and word.isprintable() else "".join([self.alphabet[b] for b in word.encode()])
        return _pack([t.id for t in self.model.tokenize(coded)])

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            if chunk.isalpha():
                return self._word(chunk)
        elif self.unassigned.search(chunk):
            return self._slow(chunk)
        if chunk.isalpha():  # \p{L} is what isalpha() tells
            return self._word(chunk)
        if chunk[-1:] in _TAIL and chunk[:-1].isalpha():
            return self.chunks[chunk[:-1]] + self.chunks[chunk[-1]]
        pieces = self.pieces.findall(chunk)
        return self._word(chunk) if pieces == [chunk] else b"".join([self.chunks[w] for w in pieces])

    def _normal(self, text: str) -> str | None:
        """The text with spaces between its chunks, None where it takes the library's whole path."""
        if not self.fast or any(s in text for s in self.specials):
            return None
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):  # the library composes by its own tables, which may be older too
                return None
            text = "".join([c.lower() for c in text]) if "Σ" in text or "İ" in text else text.lower()
            if any(s in text for s in self.specials):  # in small letters only now; a chunk on the library's path would have it found
                return None
        else:
            text = text.lower()
        return text.replace("\n", " ")

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        normal = self._normal(text)
        return self._slow(text) if normal is None else b"".join(map(self.chunks.__getitem__, normal.split(" ")))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text."""
        normal = [self._normal(t) for t in texts]
        slow = {i: self._slow(texts[i]) for i, t in enumerate(normal) if t is None}
        split = pc.split_pattern(pa.array(["" if t is None else t for t in normal], pa.large_string()), " ")
        del normal
        bounds, chunks = split.offsets.to_numpy(), split.values.dictionary_encode()
        del split
        runs, at = self._ids_of(chunks.dictionary), chunks.indices.to_numpy()
        out = runs.take(at).tobytes()
        ends = np.concatenate([[0], np.cumsum(runs.sizes[at])])[bounds] * 4
        return [slow[i] if i in slow else out[a:b] for i, (a, b) in enumerate(pairwise(ends.tolist()))]

    def _ids_of(self, chunks: pa.Array) -> Runs:
        """The ids of distinct chunks."""
        stems = pc.utf8_rtrim(chunks, characters=_MARKS)
        tails = _ends(chunks, pc.binary_length(stems).to_numpy()).dictionary_encode()
        stems = stems.dictionary_encode()
        at = self.words.find(stems.dictionary)[stems.indices.to_numpy()]
        # a word of letters alone ends where its marks begin; other chunks are split as they are
        rest = np.flatnonzero(~self.words.own[at])
        more = [self.chunks[t] for t in tails.dictionary.to_pylist()] + [self.chunks[c] for c in chunks.take(pa.array(rest)).to_pylist()] + [b""]
        n, behind = len(self.words.own), tails.indices.to_numpy().astype(np.int64)
        behind[rest] = len(tails.dictionary) + np.arange(len(rest))
        at[rest] = n + len(more) - 1
        pieces = self.words.runs.add(Runs.of(more))
        pairs = np.stack([at, n + behind], 1)
        return Runs(pieces.take(pairs.ravel()), pieces.sizes[pairs].sum(1))


class Runs:
    """Runs of ids, one behind the other."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes, self.starts = ids, sizes, np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, coded: list[bytes]) -> Runs:
        return cls(np.frombuffer(b"".join(coded), "<u4"), np.array([len(x) // 4 for x in coded], np.int64))

    def add(self, other: Runs) -> Runs:
        return Runs(np.concatenate([self.ids, other.ids]), np.concatenate([self.sizes, other.sizes]))

    def take(self, at: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(self.sizes[at])])
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], BLOCK)), len(at)))
        return np.concatenate([self.ids[:0], *(_gather(self.ids, self.starts, self.sizes, at[a:b]) for a, b in pairwise(cuts.tolist()))])


class Words:
    """Words and their ids in flat arrays, a few tens of bytes a word. A full table keeps what the latest texts used."""

    def __init__(self, make):
        self.make = make
        self.forget()

    def forget(self) -> None:
        self.names, self.own, self.runs = pa.array([], pa.large_string()), np.zeros(0, bool), Runs.of([])

    def find(self, names: pa.Array) -> np.ndarray:
        """Where distinct ``names`` stand in the table, which holds them all then; ``own`` tells words of letters, only they have ids."""
        at = pc.index_in(names, self.names)
        if self.names.nbytes + self.runs.ids.nbytes > KNOWN_BYTES:
            used = at.drop_null().to_numpy()
            self.names, self.own, self.runs = self.names.take(pa.array(used)), self.own[used], Runs(self.runs.take(used), self.runs.sizes[used])
            at = pc.index_in(names, self.names)
        new = names.filter(at.is_null())
        words = new.to_pylist()
        own = [not w or w.isalpha() for w in words]
        coded = [self.make(w) if w and ok else b"" for w, ok in zip(words, own, strict=True)]
        out = at.fill_null(-1).to_numpy().astype(np.int64)
        out[out < 0] = len(self.names) + np.arange(len(new))
        self.names, self.own = pa.concat_arrays([self.names, new]), np.concatenate([self.own, np.array(own, bool)])
        self.runs = self.runs.add(Runs.of(coded))
        return out


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of ``values`` whose numbers are ``at``, one behind the other."""
    n = sizes[at]
    ends = np.cumsum(n)
    return values[np.repeat(starts[at] - (ends - n), n) + np.arange(n.sum())]


def _ends(strings: pa.Array, skip: np.ndarray) -> pa.Array:
    """What stands behind the first ``skip`` bytes of each string."""
    _, offsets, data = strings.buffers()
    bounds = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    starts, sizes = bounds[:-1] + skip, bounds[1:] - bounds[:-1] - skip
    found = _gather(np.frombuffer(data or b"", np.uint8), starts, sizes, np.arange(len(strings)))
    return pa.LargeStringArray.from_buffers(len(strings), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(found))


def _pack(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()
