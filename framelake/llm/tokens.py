"""Texts to pre-tokens by array operations, and their ids by the tokenizers library through a table of pre-tokens.

A byte-level pre-tokenizer cuts by the classes of characters (letter, number, white space, other) and a few short
contractions, so all cuts of many texts come from one pass over the array of their code points. The class of a code
point is asked from the library itself, once for each that a worker meets, since it depends on its version of
Unicode. Equal pre-tokens have equal ids: each is known by two 64-bit hashes, a table of bounded size keeps the ids of those
met before, and the library encodes the others, all of a slice in one call.
"""

from __future__ import annotations

import os
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa

from .common import held

#: Pre-tokens that a worker's table holds (some 40 bytes each); of more, those met since it was last full stay.
KEEP = 200_000
# Classes of characters; SEP stands between texts.
LETTER, NUMBER, OTHER, SPACE, SEP, UNKNOWN = range(6)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Classes:
    """The class of every code point, by the way the library's pre-tokenizer cuts it from a neighbour."""

    def __init__(self, pre_tokenizer):
        self.cut = pre_tokenizer.pre_tokenize_str
        self.of = np.full(0x110000, UNKNOWN, np.uint8)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        found = self.of[points]
        if found.max(initial=0) == UNKNOWN:
            for c in np.unique(points[found == UNKNOWN]).tolist():
                self.of[c] = self.ask(chr(c))
            found = self.of[points]
        return found

    def ask(self, c: str) -> int:
        for kind, neighbour in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.cut(neighbour + c)) == 1:
                return kind
        return SPACE


def cut(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point. A run of one class is a pre-token, with the space before it; of
    white space before a word, the last character stands alone unless it is that space."""
    n = len(points)
    kind, points = np.append(kind, [SEP] * 4), np.append(points, np.zeros(4, points.dtype))
    start = np.ones(n + 4, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == SEP)
    last = np.flatnonzero((kind[:n] == SPACE) & (kind[1 : n + 1] < SPACE))
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    # 's 't 'm 'd 're 've 'll where a pre-token would begin with the apostrophe.
    q = np.flatnonzero((points[:n] == 39) & start[:n] & (kind[1 : n + 1] == LETTER))
    a, b = points[q + 1], points[q + 2]
    one = q[np.isin(a, [ord(c) for c in "stmd"])]
    two = q[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]
    start[one + 1] = start[two + 1] = start[two + 2] = False
    start[one + 2] = start[two + 3] = True
    return start[:n]


class Table:
    """Ids of pre-tokens by hash, in sorted arrays."""

    def __init__(self):
        self.key, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.at, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.used = np.empty(0, np.uint32), np.empty(0, bool)

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and whether it is there; rows found count as used."""
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        row = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        there = (self.key[row] == key) & (self.check[row] == check)
        self.used[row[there]] = True
        return row, there

    def add(self, key: np.ndarray, check: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        at = len(self.ids) + np.cumsum(n) - n
        order = np.argsort(both := np.append(self.key, key), kind="stable")
        self.key = both[order]
        self.check, self.at, self.n = (np.append(x, y)[order] for x, y in ((self.check, check), (self.at, at), (self.n, n)))
        self.used = np.append(self.used, np.ones(len(key), bool))[order]
        self.ids = np.append(self.ids, ids)

    def trim(self) -> None:
        if len(self.key) > KEEP:
            keep = self.used if self.used.sum() <= KEEP // 2 else np.zeros(len(self.key), bool)
            self.ids, n = gathered(self.ids, self.at[keep], self.n[keep]), self.n[keep]
            self.key, self.check, self.at, self.n = self.key[keep], self.check[keep], np.cumsum(n) - n, n
            self.used = np.zeros(len(n), bool)


def gathered(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[at : at + n] of each, one after the other."""
    ends = np.cumsum(n)
    return values[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class Chunked:
    """Texts to ids through the table. A subclass has ask(text) for a text of any kind, and learn(points, at, n): the ids
    of new pre-tokens, and how many each has."""

    def __init__(self, pre_tokenizer, special: list[str], plain: bool):
        self.classes, self.special, self.plain = Classes(pre_tokenizer), special, plain
        self.table = Table()
        random = np.random.default_rng(20)
        self.values = random.integers(0, 1 << 64, (2, 0x110000), np.uint64)
        self.steps = random.integers(0, 1 << 64, 2, np.uint64) | np.uint64(1)
        self.powers = np.ones((2, 1), np.uint64)

    def hashes(self, points: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the pre-tokens that begin there."""
        size = np.diff(begin, append=len(points))
        place = np.arange(len(points)) - np.repeat(begin, size)
        if (most := int(size.max())) > self.powers.shape[1]:
            self.powers = np.ones((2, most), np.uint64)
            self.powers[:, 1:] = self.steps[:, None]
            self.powers = np.cumprod(self.powers, axis=1, dtype=np.uint64)
        return tuple(np.add.reduceat(v[points] * p[place], begin) for v, p in zip(self.values, self.powers))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's end (the first is 0)."""
        odd = {i: self.ask(t) for i, t in enumerate(texts) if not self.plain or any(s in t for s in self.special)}
        if odd:
            flat, ends = self._encode([("" if i in odd else t) for i, t in enumerate(texts)])
            parts = [odd.get(i, flat[a:z]) for i, (a, z) in enumerate(pairwise(ends.tolist()))]
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not sizes.sum():
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        stops = np.cumsum(sizes + 1) - 1
        kind = self.classes(points)
        kind[stops] = SEP
        begin = np.flatnonzero(cut(points, kind))
        one, two = self.hashes(points, begin)
        size = np.diff(begin, append=len(points))
        word = kind[begin] != SEP
        begin, size, one, two = begin[word], size[word], one[word], two[word]
        number, distinct = pd.factorize(one)
        # Each distinct pre-token's last place; one with an equal first hash and another second is told by both.
        some = np.empty(len(distinct), np.int64)
        some[number] = np.arange(len(number))
        if (two != two[some][number]).any():
            return self._plainly(texts)
        self.table.trim()
        row, there = self.table.find(distinct, two[some])
        if not there.all():
            if len(self.table.key) and (self.table.key[row[~there]] == distinct[~there]).any():
                return self._plainly(texts)
            new = some[~there]
            ids, n = self.learn(points, begin[new], size[new])
            self.table.add(distinct[~there], two[new], n, ids)
            row, _ = self.table.find(distinct, two[some])
        n = self.table.n[row][number]
        flat = gathered(self.table.ids, self.table.at[row][number], n)
        ends = np.append(0, np.cumsum(n))
        return flat, np.append(0, ends[np.searchsorted(begin, stops)])

    def _plainly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.ask(t) for t in texts]
        return np.concatenate([np.empty(0, np.uint32), *parts]), np.cumsum([0, *map(len, parts)])

    def rows(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with an end id behind each text's."""
        flat, ends = self.encode(texts)
        if end is None:
            return flat, ends
        return np.insert(flat, ends[1:], np.uint32(end)), ends + np.arange(len(ends))


def plain_file(library) -> bool:
    """Whether the file's pre-tokenizer is the byte-level one with its pattern, on texts as they are."""
    import json

    file = json.loads(library.to_str())
    pre = file["pre_tokenizer"] or {}
    return file["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


class Encoder(Chunked):
    """With a byte-level tokenizer file, by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        t.model._resize_cache(0)  # the table does this work
        self.whole, self.alone = t.pre_tokenizer, pre_tokenizers.CharDelimiterSplit(" ")
        super().__init__(self.whole, [a.content for a in t.get_added_tokens_decoder().values()], plain_file(t))
        self.width = np.array([len(t.id_to_token(i) or "") for i in range(t.get_vocab_size())])
        self.written = dict(enumerate(byte_characters()))

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def ask(self, text: str) -> np.ndarray:
        return self.ids(text)

    def learn(self, points: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One call encodes all, written in byte characters with spaces between; the bytes that its tokens stand for tell
        where each pre-token ends."""
        flat = gathered(points, at, n)
        raw = np.frombuffer(flat.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each code point
        begin = lead[np.cumsum(n) - n]
        written = np.insert(raw.astype(np.uint16), begin[1:], 256).tobytes().decode("utf-16-le").translate(self.written | {256: " "})
        self.library.pre_tokenizer = self.alone
        ids = self.ids(written)
        self.library.pre_tokenizer = self.whole
        stops = np.searchsorted(np.cumsum(self.width[ids]), np.append(begin[1:], len(raw))) + 1
        return ids, np.diff(stops, prepend=0)


def encoder(path: str) -> Encoder:
    """One for each worker."""
    return held(f"encoder {path}", lambda: Encoder(path), on=True)


def binaries(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ids of each row as little-endian unsigned 32-bit integers."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(flat.astype("<u4"))])
