"""Substring dedup by repeated-phrase automata.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is 13 consecutive words; every word covered by a window that also
starts in a document with a smaller doc_id is removed. Windows are judged on the input.

1. A window's anchor is the least hash of the 5-word runs in it (the first of equals): equal windows have equal
   anchors, and neighbours mostly share one. Only distinct (anchor, doc_id) pairs are shuffled; a walk over the
   sorted pairs leaves the anchors that several documents have, and tells the hot ones, of over HOT passages.
2. Documents meet their recurring anchors (texts travel compressed) and emit the passages around them. Of a hot
   anchor, a batch of documents marks the windows that a smaller document of the batch has at once; only the
   windows of the batch's smallest are emitted, each alone.
3. Passages are dealt by anchor, HOT at most for each. A task takes runs of anchors in turn: it confirms the phrases
   that several documents share, compiles them to an Aho-Corasick automaton over word numbers, and streams all
   passages through it; each occurrence of a phrase that a smaller document has marks words. Windows of
   hot anchors are dealt by their own hash and stream by in order of doc_id, compared word by word with the first.
4. The marks, a short list for each document, go back to the texts.

Null text has no words. A null doc_id counts as larger than all others; repeated rows with one doc_id don't remove
each other's words. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, documents, give_back, map_batches, slices, text_key, with_columns
from .jaccard import _mix, windows, word_hashes

WINDOW, RUN = 13, 5
#: Passages that one automaton is made for, about; those of one anchor stay together.
SHARD = 10_000
#: Most passages of an anchor that a task gathers; those of more are told apart by window.
HOT = 20_000
LAST = (1 << 63) - 1


def anchors(docs: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """Of texts as lists of words: text number, hash, first window and number of windows of each anchor, in order."""
    sizes = np.array([len(w) for w in docs], np.int64)
    total = int(sizes.sum()) - WINDOW + 1
    if total < 1:
        return (np.empty(0, np.int64),) * 4
    h = windows(word_hashes(list(chain.from_iterable(docs))), RUN)
    doc = np.repeat(np.arange(len(docs)), sizes)
    least, at, wide = h, np.zeros(len(h), np.int64), 1
    while wide < WINDOW - RUN + 1:  # the first of the least hashes of ever longer stretches
        step = min(wide, WINDOW - RUN + 1 - wide)
        lower = least[step:] < least[:-step]
        least, at = np.where(lower, least[step:], least[:-step]), np.where(lower, at[step:] + step, at[:-step])
        wide += step
    start = np.flatnonzero(doc[:total] == doc[WINDOW - 1 :])  # windows inside one text
    place = at[start] + start
    new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(doc[start], prepend=-1) != 0))
    begin = np.cumsum(sizes) - sizes
    first = start[new]
    return doc[first], least[first].view(np.int64), first - begin[doc[first]], np.diff(new, append=len(start))


def _pairs(docs: DataFrame) -> DataFrame:
    """Distinct (anchor, id) pairs of each text, with the number of passages."""

    def run(b):
        doc, h, *_ = anchors([(t or "").encode().split() for t in b.column("text").to_pylist()])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))[: len(doc)])
        return {"h": h[new], "id": b.column("id").to_numpy()[doc[new]], "n": np.diff(new, append=len(doc))}

    return map_batches(docs, run, "h long, id long, n int")


def _recurring(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of pairs sorted by (h, id): those whose h has several ids, and whether it has over `most` passages. Pairs of the
    last h are held until that is known, so `most` of them at most."""
    kinds = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("hot", pa.bool_())])
    h, i, n = (np.empty(0, np.int64),) * 3
    over: int | None = None  # the anchor known to be hot, whose pairs go on
    for b in batches:
        if not b.num_rows:
            continue
        h, i, n = (np.append(x, b.column(c).to_numpy()) for x, c in ((h, "h"), (i, "id"), (n, "n")))
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (i[1:] != i[:-1])))
        h, i, n = h[new], i[new], np.add.reduceat(n, new)
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(start, append=len(h))
        many, hot = size > 1, np.add.reduceat(n, start) > most
        if h[0] == over:
            many[0] = hot[0] = True
        ready = many[-1] and hot[-1]
        over = int(h[-1]) if ready else None
        cut = len(h) if ready else start[-1]
        use = np.repeat(many, size)[:cut]
        if use.any():
            yield columns({"h": h[:cut][use], "id": i[:cut][use], "hot": np.repeat(hot, size)[:cut][use]}, kinds)
        h, i, n = h[cut:], i[cut:], n[cut:]
    if len(h) > 1:
        yield columns({"h": h, "id": i, "hot": np.zeros(len(h), bool)}, kinds)


def _passages(b: pa.RecordBatch) -> dict:
    """The words around the recurring anchors of each document. Windows of hot anchors: n = -1 where the batch's smallest
    document has them, else marks without words."""
    b = b.filter(pa.compute.and_(b.column("known").is_valid(), b.column("_z").is_valid()))
    unzip = zstandard.ZstdDecompressor()
    words = [unzip.decompress(z).split() for z in b.column("_z").to_pylist()]
    known = b.column("known")
    # (text, anchor) pairs are sorted by text already; the known ones of each text are looked up together.
    doc, h, first, n = anchors(words)
    use, heat = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    hot = b.column("hot")
    cuts = np.searchsorted(doc, np.arange(len(words) + 1))
    for i, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if z > a:
            use[a:z] = np.isin(h[a:z], known[i].values.to_numpy())
            if len(x := hot[i].values):
                heat[a:z] = np.isin(h[a:z], x.to_numpy())
    ids, keys = b.column("_id").to_numpy(), b.column("_key").to_numpy()
    apart = _apart(words, ids, keys, *(x[heat].tolist() for x in (doc, first, n)))
    use &= ~heat
    doc, h, first, n = doc[use], h[use], first[use], n[use]
    spans = zip(doc.tolist(), first.tolist(), (first + n + WINDOW - 1).tolist())
    out = {"h": h, "id": ids[doc], "key": keys[doc], "first": first, "n": n, "words": [b" ".join(words[i][a:z]) for i, a, z in spans]}
    return {c: [*x, *(r[k] for r in apart)] for k, (c, x) in enumerate(out.items())} if apart else out


def _apart(words: list[list[bytes]], ids: np.ndarray, keys: np.ndarray, docs: list[int], firsts: list[int], counts: list[int]) -> list[tuple]:
    """Rows of the passages of hot anchors, dealt by window or, where they are marks already, by document."""
    out, least = [], {}
    passages = [(int(ids[d]), int(keys[d]), f, [b" ".join(words[d][j : j + WINDOW]) for j in range(f, f + n)]) for d, f, n in zip(docs, firsts, counts)]
    for i, _, _, ws in passages:
        for w in ws:
            if least.setdefault(w, i) > i:
                least[w] = i
    for i, key, first, ws in passages:
        later = [least[w] < i for w in ws]
        out += [(i ^ key, i, key, first + a, n, None) for a, n in _runs([j for j, x in enumerate(later) if x])]
        out += [(xxhash.xxh3_64_intdigest(w) - (1 << 63), i, key, first + j, -1, w) for j, w in enumerate(ws) if not later[j]]
    return out


def _runs(starts: list[int]) -> Iterator[tuple[int, int]]:
    """First and length of each run of consecutive numbers."""
    k = 0
    while k < len(starts):
        z = k
        while z + 1 < len(starts) and starts[z + 1] == starts[z] + 1:
            z += 1
        yield starts[k], z - k + 1
        k = z + 1


def _located(rows: list[tuple]) -> list[tuple]:
    """Of passages (h, id, key, first, n, words) of whole anchors, by (h, id): (id, key, first window, windows) to be
    removed. Recurring phrases are confirmed and compiled to an automaton over word numbers; each passage runs through
    it, equal ones once, and what it finds is all there is."""
    if not rows:
        return []
    place: dict[bytes, int] = {}
    low: list[int] = []  # of each distinct passage, the smallest id, and another one if it has
    high: list[int] = []
    for _, i, _, _, _, words in rows:  # rising ids within an anchor, and equal passages have one anchor
        k = place.setdefault(words, len(low))
        if k == len(low):
            low.append(i)
            high.append(i)
        else:
            high[k] = i
    number: dict[bytes, int] = {}
    texts = [[number.setdefault(w, len(number)) for w in words.split(b" ")] for words in place]
    phrases = _confirmed(texts, np.array(low), np.array(high))
    if not phrases:
        return []
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase, least in phrases:
        automaton.add_word(phrase, (len(phrase), least))
    automaton.make_automaton()
    found = [[(end - n + 1, n - WINDOW + 1, least) for end, (n, least) in automaton.iter(tuple(t))] for t in texts]
    out = []
    for _, i, key, first, _, words in rows:
        spans = [(a, n) for a, n, least in found[place[words]] if least < i]
        if len(spans) > 1:
            spans = _runs(sorted({a + j for a, n in spans for j in range(n)}))
        out += [(i, key, first + a, n) for a, n in spans]
    return out


def _confirmed(texts: list[list[int]], low: np.ndarray, high: np.ndarray) -> list[tuple[tuple, int]]:
    """Phrases of word numbers that several documents have, with the smallest id: each run of windows that only one of the
    distinct passages has (and several documents have that), and each window that several distinct passages share."""
    sizes = np.array(list(map(len, texts)))
    flat = np.fromiter(chain.from_iterable(texts), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(owner[: len(flat) - WINDOW + 1] == owner[WINDOW - 1 :])  # windows inside one passage
    seed = 1
    while True:
        h = windows(_mix(flat.astype(np.uint64) + np.uint64(seed << 40)), WINDOW)[at]
        _, some, group, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count[group] > 1)
        if all((flat[at[shared] + j] == flat[at[some[group[shared]]] + j]).all() for j in range(WINDOW)):
            break  # equal hashes are equal words
        seed += 1
    own = owner[at]
    least, most = np.full(len(some), LAST), np.full(len(some), -LAST - 1)
    np.minimum.at(least, group, low[own])
    np.maximum.at(most, group, high[own])
    words, out = flat.tolist(), []
    alone = (count[group] == 1) & (least < most)[group]
    k = np.flatnonzero(alone)
    if len(k):
        breaks = np.flatnonzero((np.diff(at[k]) != 1) | (np.diff(own[k]) != 0)) + 1
        begin, end = k[np.append(0, breaks)], k[np.append(breaks, len(k)) - 1]
        out += [(tuple(words[a : z + WINDOW]), i) for a, z, i in zip(at[begin].tolist(), at[end].tolist(), least[group[begin]].tolist())]
    g = np.flatnonzero((count > 1) & (least < most))
    out += [(tuple(words[a : a + WINDOW]), i) for a, i in zip(at[some[g]].tolist(), least[g].tolist())]
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])

    def marks(out):
        return [columns({n: [r[k] for r in out] for k, n in enumerate(kinds.names)}, kinds)] if out else []

    def found(rows):
        return marks(_located(rows))

    held: list[tuple] = []
    at, least = None, {}  # the hash that windows of hot anchors have just now, and the smallest id of each
    for b in slices(batches, 5_000):
        rows = list(zip(*(b.column(c).to_pylist() for c in ("h", "id", "key", "first", "n", "words"))))
        if b.column("words").null_count or -1 in b.column("n").to_numpy():
            known = []
            for h, i, key, first, n, words in rows:
                if words is None:
                    known.append((i, key, first, n))
                elif n < 0:
                    if h != at:
                        at, least = h, {}
                    if least.setdefault(words, i) < i:
                        known.append((i, key, first, 1))
            yield from marks(known)
            rows = [r for r in rows if r[4] > 0 and r[5] is not None]
        held += rows
        if len(held) >= SHARD:
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:  # the last anchor may go on
                cut -= 1
            yield from found(held[:cut])
            held = held[cut:]
    yield from found(held)
    held.clear()
    give_back()


def dealt(rows: DataFrame, texts: DataFrame, hot: int) -> DataFrame:
    """The rows that are dealt by h: passages, windows of hot anchors (n = -1), and marks (no words)."""
    pairs = _pairs(rows.select(F.col("_id").alias("id"), "text")).repartition("h").sortWithinPartitions("h", "id")
    recurring = pairs.mapInArrow(lambda batches: _recurring(batches, hot), "h long, id long, hot boolean")
    known = recurring.groupBy(F.col("id").alias("_id")).agg(F.collect_list("h").alias("known"), F.collect_list(F.when(F.col("hot"), F.col("h"))).alias("hot"))
    return map_batches(texts.join(known, "_id", "left"), _passages, "h long, id long, key long, first int, n int, words binary")


def removed(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """row (the columns of docs but text), text, n_words, n_removed, and kept: the words left, joined by one space. Both
    joins with the texts are on the same exchange of them, compressed, so that they are shuffled once."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    # A row without an id is told by its text; ids of LAST stand last in any order and remove nothing of each other.
    rows = docs.select(F.struct(*others).alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), text_key().alias("_key"))

    def squeeze(b):
        z = zstandard.ZstdCompressor(level=1)
        return {c: b.column(c) for c in ("row", "_id", "_key")} | {"_z": [None if t is None else z.compress(t.encode()) for t in b.column("text").to_pylist()]}

    texts = map_batches(rows, squeeze, with_columns(rows, ["row", "_id", "_key"], "_z binary"))
    found = dealt(rows, texts, hot).repartition("h").sortWithinPartitions("h", "id").mapInArrow(_search, "id long, key long, first int, n int")
    marks = found.groupBy(F.col("id").alias("_id")).agg(F.collect_set(F.struct("key", "first", "n")).alias("_marks"))

    def cut(b):
        unzip = zstandard.ZstdDecompressor()
        texts = [None if z is None else unzip.decompress(z) for z in b.column("_z").to_pylist()]
        n, left, kept = [], [], []
        for t, key, m in zip(texts, b.column("_key").to_pylist(), b.column("_marks").to_pylist()):
            words = (t or b"").split()
            n.append(len(words))
            if m:
                change = np.zeros(len(words) + 1, np.int32)
                for x in m:
                    if x["key"] == key:
                        change[x["first"]] += 1
                        change[x["first"] + x["n"] + WINDOW - 1] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
            left.append(len(words))
            kept.append(b" ".join(words).decode())
        return {"row": b.column("row"), "text": [None if t is None else t.decode() for t in texts], "n_words": n, "n_removed": np.subtract(n, left), "kept": kept}

    return map_batches(texts.join(marks, "_id", "left"), cut, with_columns(rows, ["row"], "text string, n_words long, n_removed long, kept string"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut from text, and n_chars of it; a text without them stays as it is."""
    cut, old = F.col("n_removed") > 0, F.col("row.n_chars") if "n_chars" in docs.columns else None
    new = {"text": F.when(cut, F.col("kept")).otherwise(F.col("text"))}
    if old is not None:
        new["n_chars"] = F.when(cut, F.length("kept")).otherwise(old).cast(docs.schema["n_chars"].dataType)
    return removed(docs).select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op7_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = removed(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
