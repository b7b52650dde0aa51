"""Runs of periodic words, by longest common extensions on suffix trees.

Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of consecutive words with smallest period q and at least max(12, 2 q)
words that no neighbouring word extends.

1. Of a run of 12 words every word lies in six words that occur twice in it. So words that no repeated six cover are in no
   run, and what is left of a text falls into stretches, which are looked at alone in the same way until none shrinks. Texts
   without a repetition end here, and of a long text only its repetitions go on.
2. The stretches of a text, with a symbol of its own after each, become a suffix tree (Ukkonen), and their reversal another.
   The leaves of the Euler tour and the turns between them answer a longest common extension as a range minimum in
   constant time: forward from the one tree, backward from the other.
3. The longest Lyndon word at each place, in the usual order of words and in the reverse one, ends at the next smaller
   suffix. Each is a candidate for a run's root, extended in both directions; all candidates are asked at once.

Texts are not shuffled, and a text is one task's: 10 MB of one repeated passage (some 1.5 million words) take about 1 GB in a
worker, other long texts little more than their words. Null text has no words, and no run; so have texts of less than 12
words. Null and repeated doc_ids are rows like others, an empty table gives no row, and other columns travel along in row
whatever they are called.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, packed, with_columns
from .jaccard import _mix, windows, word_hashes

#: Fewest words of a run, and the words that are certain to repeat in it.
LEAST, SEED = 12, 6


def suffix_tree(s: list[int], k: int) -> tuple[np.ndarray, ...]:
    """Ukkonen's tree of s, whose symbols are below k and whose last is 0 and nowhere else: of each edge its parent, symbol
    and child, by parent and symbol, and the length of the edge into each node."""
    n = len(s)
    start, end, link, go = [0], [0], [0], {}
    node = edge = length = rest = 0
    for i, c in enumerate(s):
        rest += 1
        last = 0  # the inner node made before, which links to the next one
        while rest:
            if not length:
                edge = i
            key = node * k + s[edge]
            child = go.get(key)
            if child is None:
                go[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                link[last], last = node, node
            else:
                a = start[child]
                step = (end[child] if end[child] <= i else i + 1) - a
                if length >= step:
                    edge, length, node = edge + step, length - step, child
                    continue
                if s[a + length] == c:
                    length += 1
                    link[last] = node
                    break
                split = len(start)
                go[key], go[split * k + c], go[split * k + s[a + length]] = split, split + 1, child
                start += (a, i)
                end += (a + length, n)
                link += (0, 0)
                start[child] = a + length
                link[last], last = split, split
            rest -= 1
            if not node:
                if length:
                    length, edge = length - 1, i - rest + 1
            else:
                node = link[node]
        link[0] = 0
    edges = np.fromiter(go, np.int64, len(go))
    order = np.argsort(edges)
    edges = edges[order]
    size = np.array(end) - np.array(start)
    return edges // k, edges % k, np.fromiter(go.values(), np.int64, len(go))[order], size


def tour(parent: np.ndarray, child: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the Euler tour that takes edges in the order given: the leaves, as places where their suffixes begin, and the
    string depth of the turn before each (0 before the first), where the way from leaf to leaf is at its highest."""
    nodes = len(size)
    first = np.searchsorted(parent, np.arange(nodes + 1))
    later = np.ones(nodes, bool)
    later[child[first[:-1][first[:-1] < first[1:]]]] = False
    up = np.zeros(nodes, np.int64)
    up[child] = parent
    kids, cut, later, up, size = child[::-1].tolist(), (len(child) - first[::-1]).tolist(), later.tolist(), up.tolist(), size.tolist()
    cut.reverse()  # kids in reverse, so that the first is taken from the stack first: those of v are kids[cut[v + 1] : cut[v]]
    depth, leaves, turns, turn = [0] * nodes, [], [], 0
    stack = kids[cut[1] : cut[0]]
    while stack:
        v = stack.pop()
        above = depth[up[v]]
        if later[v]:
            turn = above
        below = kids[cut[v + 1] : cut[v]]
        if below:
            depth[v] = above + size[v]
            stack += below
        else:
            leaves.append(above + size[v])
            turns.append(turn)
    turns[0] = 0
    return len(leaves) - np.array(leaves), np.array(turns, np.int32)


class Extensions:
    """Longest common extensions of places of s: the least turn between their leaves, from a table of minima of 1, 2, 4,
    ... turns."""

    def __init__(self, leaves: np.ndarray, turns: np.ndarray):
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.least = [turns]
        while 2 << len(self.least) - 1 <= len(turns):
            t, step = self.least[-1], 1 << len(self.least) - 1
            self.least.append(np.minimum(t[:-step], t[step:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i and j, all different."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1  # turns lo .. hi - 1
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            t = self.least[k]
            out[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place of a smaller rank, the end where there is none."""
    r = rank.tolist()
    out, stack = [len(r)] * len(r), []
    for i, x in enumerate(r):
        while stack and r[stack[-1]] > x:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def maximal(s: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """start, length and period of the runs of s (numbers from 1 on) with at least `least` symbols, by start and period."""
    n, k = len(s), int(s.max(initial=0)) + 1
    forward = suffix_tree([*s.tolist(), 0], k)
    parent, symbol, child, size = forward
    leaves, turns = tour(parent, child, size)
    ahead = Extensions(leaves, turns)
    # In the reverse order the end is still less than all symbols: last in the order of a tour that is read backwards.
    order = np.lexsort((np.where(symbol == 0, k, symbol), parent))
    back = np.empty(n + 1, np.int64)
    back[tour(parent, child[order], size)[0]] = np.arange(n, -1, -1)
    i = np.arange(n)
    roots = [(i, np.minimum(next_smaller(r[:n]), n)) for r in (ahead.rank, back)]
    i, j = (np.concatenate(x) for x in zip(*roots))
    i, j = np.divmod(np.unique(i * (n + 1) + j), n + 1)
    p = j - i
    right = ahead.of(i, j)
    del forward, ahead
    behind = Extensions(*tour(*(x for m, x in enumerate(suffix_tree([*s[::-1].tolist(), 0], k)) if m != 1)))
    left = behind.of(n - i, n - j)
    start, length = i - left, p + left + right
    run = length >= np.maximum(least, 2 * p)
    found = np.unique(np.stack([start[run], p[run], length[run]]), axis=1)
    return found[0], found[2], found[1]


def repeating(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words as hashes and their texts' numbers: the places of words that may be in runs, and the number of the stretch
    of each. Stretches have LEAST words or more."""
    at, part = np.arange(len(h)), doc
    while len(at) >= LEAST:
        n = len(at) - SEED + 1
        inside = np.flatnonzero(part[:n] == part[SEED - 1 :])
        key = windows(h[at], SEED)[inside] ^ _mix(part[inside].astype(np.uint64) + np.uint64(1))
        order = np.sort(key)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if not len(twice):
            break
        seen = inside[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
        change = np.zeros(len(at) + 1, np.int32)
        np.add.at(change, seen, 1)
        np.add.at(change, seen + SEED, -1)
        left = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        begin = np.flatnonzero(np.append(True, (np.diff(at[left]) != 1) | (np.diff(part[left]) != 0)))
        size = np.diff(begin, append=len(left))
        keep = np.repeat(size >= LEAST, size)
        stretch = np.repeat(np.arange(len(size)), size)[keep]
        left = left[keep]
        if len(left) == len(at):
            return at, part
        at, part = at[left], stretch
    return (np.empty(0, np.int64),) * 2


def runs(texts: list[list[bytes]]) -> list[tuple[np.ndarray, ...]]:
    """start, length and period of the runs of each text, given as words, by start and period."""
    sizes = np.array([len(w) for w in texts], np.int64)
    none = (np.empty(0, np.int64),) * 3
    out = [none] * len(texts)
    if not sizes.sum():
        return out
    words = list(chain.from_iterable(texts))
    doc = np.repeat(np.arange(len(texts)), sizes)
    at, part = repeating(word_hashes(words), doc)
    begin = np.cumsum(sizes) - sizes
    cuts = np.flatnonzero(np.diff(doc[at], prepend=-1, append=len(texts))) if len(at) else []
    for a, z in zip(cuts[:-1], cuts[1:]):
        number: dict[bytes, int] = {}
        here, ends = at[a:z], np.flatnonzero(np.diff(part[a:z])) + 1  # stretches that are one place apart, or more
        s = np.fromiter((number.setdefault(words[i], len(number) + 1) for i in here.tolist()), np.int64, z - a)
        s = np.insert(s, ends, len(number) + 1 + np.arange(len(ends)))
        start, length, period = maximal(s)
        start -= np.searchsorted(ends + np.arange(len(ends)), start)  # without the symbols between stretches
        d = int(doc[here[0]])
        out[d] = here[start] - begin[d], length, period
    return out


def periodic(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """row (the columns of docs but text), n_words, runs (start, length, period of each, by start and period) and collapsed:
    the words but those that a run contains after its first period, joined by one space. change may give other words for a
    doc_id and its words."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("_text"))

    def found(b: pa.RecordBatch) -> dict:
        texts = [(t or b"").split() for t in b.column("_text").to_pylist()]
        if change:
            texts = [change(i, w) for i, w in zip(b.column("_id").to_pylist(), texts)]
        each = runs(texts)
        kept = [b" ".join(_collapsed(w, *r)).decode("utf-8", "replace") for w, r in zip(texts, each)]
        return {"row": b.column("row"), "n_words": [len(w) for w in texts], "runs": _lists(each), "collapsed": kept}

    return map_batches(rows, found, with_columns(rows, ["row"], "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"))


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    if not len(start):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _lists(each: list[tuple[np.ndarray, ...]]) -> pa.Array:
    ends = np.cumsum([0, *(len(r[0]) for r in each)])
    values = [pa.array(np.concatenate([r[k] for r in each]) if each else np.empty(0, np.int64), pa.int64()) for k in range(3)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(values, ["start", "length", "period"]))


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The edited words of the query: of every tenth document (by crc32 of its id) the end repeats with a period."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (1 + (n - a) // p))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = periodic(documents(spark, sf_dir).select("doc_id", "text"), repeated)
    longest = F.array_max(F.transform("runs", lambda x: F.struct(x["length"], -x["start"], -x["period"])))
    r = r.withColumn("_best", longest)
    start, length, period = -F.col("_best.col2"), F.col("_best.length"), -F.col("_best.col3")
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    return r.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
