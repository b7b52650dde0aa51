"""Byte-pair encoding and decoding by a deterministic automaton over tokens, compiled to tables.

The automaton begins with one state that every byte leaves and enters. Each merge u v -> w, in order, adds a gadget:
u enters a copy of its state without the v arc (so u v can't be read any more), and every state with a u arc gets a w
arc into the state that v entered. Afterwards exactly the correct tokenizations can be read, one for each text.

All arcs of a token enter one state, so the compiled automaton is: the state of each token, the class of its arcs
(tokens that the same states have an arc for), and a bit for each state and class. Gadgets copy a row of bits for a
new state, and a column where an arc class splits; rows and columns that nothing uses any more are taken again. A
second table walks the bytes of tokens. Both are compiled once, on the driver, and have a fixed size.

Pre-split words are encoded together, a byte position at a time: the tokens that begin there are read from the byte
table, those for which the state entered there has an arc are taken, and each names the one token that enters the
position where it ends. The way back from a word's end is its encoding. Decoding emits the arc labels, the bytes of
the tokens. Workers keep the ids of words they have met in a table of bounded size.

Null text is empty and has no ids. Special tokens of the file are cut from the text first, as the library does. Null
and repeated doc_ids are rows like others, an empty table gives no row, and other columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held, map_batches
from .tokens import Chunked, binaries, byte_characters, gathered, plain_file, tokenizer_path


class _Numbers:
    """Row or column numbers with the tokens that use each; those without use are given out again."""

    def __init__(self, first: int):
        self.uses, self.free = [first], []

    def new(self) -> int:
        if self.free:
            k = self.free.pop()
            self.uses[k] = 1
            return k
        self.uses.append(1)
        return len(self.uses) - 1

    def leave(self, k: int) -> None:
        self.uses[k] -= 1
        if not self.uses[k]:
            self.free.append(k)


class Automaton:
    """Tables: state and arc class of each token, permits[state, arc class] as bits, and the walk over token bytes."""

    def __init__(self, symbols: dict[bytes, int], merges: list[tuple[bytes, bytes]], name: dict[bytes, int]):
        """symbols: ids of the single bytes; merges in order; name: a token's id by its bytes."""
        size = max(name.values()) + 1
        self.label = [b""] * size
        for x, i in name.items():
            self.label[i] = x
        self.state, self.arc = np.full(size, -1), np.full(size, -1)
        self.state[list(symbols.values())] = self.arc[list(symbols.values())] = 0
        self._compile([(name[a], name[b], name[a + b]) for a, b in merges], len(symbols))
        self._walk()

    def _compile(self, merges: list[tuple[int, int, int]], symbols: int) -> None:
        state, arc = self.state, self.arc
        rows, columns = _Numbers(symbols + 1), _Numbers(symbols)  # the first state is the one that words begin in
        bits = np.zeros((1024, 1024), np.uint8)
        bits[0, 0] = 1
        for u, v, w in merges:
            old, entered = state[u], state[v]
            if state[w] >= 0:  # a token that an earlier merge, or a byte, has already made
                continue
            rows.uses[entered] += 1  # w enters the state of v
            state[w] = entered
            row = rows.new()
            if row >= len(bits):
                bits = np.concatenate([bits, np.zeros_like(bits[: len(bits) // 2])])
            bits[row] = bits[old]
            rows.leave(old)
            state[u] = row
            if columns.uses[arc[v]] > 1:  # the others of v's class keep their arcs
                column = columns.new()
                if column >> 3 >= bits.shape[1]:
                    bits = np.concatenate([bits, np.zeros_like(bits[:, : bits.shape[1] // 2])], axis=1)
                have = bits[:, arc[v] >> 3] >> (arc[v] & 7) & 1
                at, bit = column >> 3, np.uint8(1 << (column & 7))
                bits[:, at] = bits[:, at] & ~bit | have * bit
                columns.leave(arc[v])
                arc[v] = column
            bits[row, arc[v] >> 3] &= np.uint8(~(1 << (arc[v] & 7)) & 255)
            columns.uses[arc[u]] += 1  # wherever u can be read, w can
            arc[w] = arc[u]
        self.bits = np.ascontiguousarray(bits[: len(rows.uses), : (len(columns.uses) + 7) >> 3])

    def _walk(self) -> None:
        """next[node, byte] and the token that ends at each node; nodes without a way on have the highest numbers."""
        known = [w for w in range(len(self.label)) if self.state[w] >= 0]
        heads = {self.label[w][:k] for w in known for k in range(len(self.label[w]))}
        nodes = {x: i for i, x in enumerate(sorted(heads, key=len))}
        self.inner = len(nodes)
        for w in known:
            nodes.setdefault(self.label[w], len(nodes))
        self.next = np.full((self.inner, 256), -1, np.int32)
        for x, i in nodes.items():
            if x:
                self.next[nodes[x[:-1]], x[-1]] = i
        self.token = np.full(len(nodes), -1)
        for w in known:
            self.token[nodes[self.label[w]]] = w
        self.size = np.array([len(x) for x in self.label])

    def permits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the state that token a enters (-1: a word's beginning) has an arc for token b."""
        arc = self.arc[b]
        return (self.bits[np.where(a < 0, 0, self.state[a]), arc >> 3] >> (arc & 7) & 1).astype(bool)

    def words(self, raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and their number for each; word k is the bytes from begin[k] on."""
        n = np.diff(begin, append=len(raw))
        place = np.arange(len(raw)) - np.repeat(begin, n)
        left = np.repeat(n, n) - place
        at, node, step = np.arange(len(raw)), np.zeros(len(raw), np.int32), 0
        froms, tokens = [], []
        while len(at):  # tokens that begin at each byte, of 1, 2, ... bytes
            node = self.next[node, raw[at + step]]
            step += 1
            on = node >= 0
            at, node = at[on], node[on]
            t = self.token[node]
            froms.append(at[t >= 0])
            tokens.append(t[t >= 0])
            on = (node < self.inner) & (left[at] > step)
            at, node = at[on], node[on]
        at, token = np.concatenate(froms), np.concatenate(tokens)
        order = np.argsort(place[at].astype(np.uint16) if n.max() < 1 << 16 else place[at], kind="stable")
        at, token = at[order], token[order]
        cuts = np.append(0, np.cumsum(np.bincount(place[at])))
        # The token that ends at each place. A word's end is the next one's beginning, where nothing of that one ends.
        last = np.full(len(raw) + 1, -1)
        ends = at + self.size[token]
        for a, z in pairwise(cuts.tolist()):
            before = last[at[a:z]] if a else np.full(z, -1)
            ok = self.permits(before, token[a:z])
            last[ends[a:z][ok]] = token[a:z][ok]
        return self._back(last, begin, begin + n)

    def _back(self, last: np.ndarray, begin: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word, count, ids, owners = np.arange(len(begin)), np.zeros(len(begin), np.int64), [], []
        while len(word):
            t = last[at[word]]
            ids.append(t)
            owners.append(word)
            count[word] += 1
            at[word] -= self.size[t]
            word = word[at[word] > begin[word]]
        out = np.empty(int(count.sum()), np.uint32)
        stop = np.cumsum(count)
        for k, (t, word) in enumerate(zip(ids, owners)):
            out[stop[word] - 1 - k] = t
        return out, count


class Compiled:
    """What the workers get: the automaton, the special tokens, and pools of labels and of ids in decimals."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        raw = lambda s: bytes(byte_of[c] for c in s)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        name = {raw(s): i for s, i in file["model"]["vocab"].items() if s not in self.special}
        merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in file["model"]["merges"]]
        self.automaton = Automaton({bytes([b]): name[bytes([b])] for b in range(256)}, merges, name)
        labels = self.automaton.label + [b""] * (max([0, *self.special.values()]) + 1 - len(self.automaton.label))
        for s, i in self.special.items():
            labels[i] = s.encode()
        self.labels, self.decimals = pooled(labels), pooled([b"%d," % i for i in range(len(labels))])


def pooled(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array(list(map(len, parts)))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(n) - n, n


def emitted(pool: tuple[np.ndarray, np.ndarray, np.ndarray], flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """What the ids of each text stand for in the pool, joined."""
    values, at, n = pool
    out = gathered(values, at[flat], n[flat]).tobytes()
    stops = np.append(0, np.cumsum(n[flat]))[ends].tolist()
    return [out[a:z] for a, z in pairwise(stops)]


class Coder(Chunked):
    """encode and decode by the compiled automaton."""

    def __init__(self, path: str, compiled: Compiled):
        from tokenizers import Tokenizer  # its pre-tokenizer knows the classes of characters

        library = Tokenizer.from_file(path)
        self.compiled, self.pre = compiled, library.pre_tokenizer
        special = sorted(compiled.special, key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, special))) if special else None
        super().__init__(self.pre, special, plain_file(library))

    def ask(self, text: str) -> np.ndarray:
        """Ids of a text of any kind: what stands between special tokens, pre-token by pre-token."""
        out, at = [np.empty(0, np.uint32)], 0
        for m in self.specials.finditer(text) if self.specials else ():
            out += [*self.pieces(text[at : m.start()]), np.array([self.compiled.special[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*out, *self.pieces(text[at:])])

    def pieces(self, text: str) -> list[np.ndarray]:
        if not text:
            return []
        words = [text[a:z].encode() for _, (a, z) in self.pre.pre_tokenize_str(text)]
        n = np.array(list(map(len, words)))
        return [self.compiled.automaton.words(np.frombuffer(b"".join(words), np.uint8), np.cumsum(n) - n)[0]]

    def learn(self, points: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(gathered(points, at, n).astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        return self.compiled.automaton.words(raw, lead[np.cumsum(n) - n])

    def decode(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        return [x.decode("utf-8", "replace") for x in emitted(self.compiled.labels, flat, ends)]


def coder(path: str, shared) -> Coder:
    """One for each worker, from the broadcast tables."""
    return held(f"coder {path}", lambda: Coder(path, shared.value), on=True)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(Compiled(path))

    def run(b):
        return {"doc_id": b.column("doc_id"), "ids": binaries(*coder(path, shared).encode([t or "" for t in b.column("text").to_pylist()]))}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of encode."""
    shared = rows.sparkSession.sparkContext.broadcast(Compiled(path))

    def run(b):
        ids = [np.frombuffer(x or b"", "<u4") for x in b.column("ids").to_pylist()]
        ends = np.cumsum([0, *map(len, ids)])
        return {"doc_id": b.column("doc_id"), "text": coder(path, shared).decode(np.concatenate([np.empty(0, "<u4"), *ids]), ends)}

    return map_batches(rows, run, "doc_id long, text string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes, then decodes its own ids, in one pass over the documents."""
    path = tokenizer_path()
    shared = spark.sparkContext.broadcast(Compiled(path))

    def run(b):
        c = coder(path, shared)
        flat, ends = c.encode([t or "" for t in b.column("text").to_pylist()])
        ids = [hashlib.sha256(x[:-1]).hexdigest() for x in emitted(c.compiled.decimals, flat, ends)]
        decoded = [hashlib.sha256(x.encode()).hexdigest() for x in c.decode(flat, ends)]
        return {"doc_id": b.column("doc_id"), "n_tokens": np.diff(ends), "ids_sha256": ids, "decoded_sha256": decoded}

    return map_batches(documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
