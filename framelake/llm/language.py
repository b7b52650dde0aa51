"""Language identification of mixed text: script ranges, word scores, Viterbi.

Words are runs of letters, in lower case. A language's model counts, over all its training documents, the byte
n-grams (2 to 4, with the word's ends) of its words in a fixed number of buckets, and the scripts of its words.
A word's script narrows the candidates to the languages that use it; its score for each is the log probability
of its n-grams. Viterbi with a penalty for each switch labels every word, so that a text becomes spans; the
predicted language has most letters, and the score is its share of them.

Training counts come from each task as one table of fixed size for each language; the model is languages x
buckets, 128 KB a language, whatever the corpus. Prediction moves no text.

Training uses text and lang only, of documents whose crc32(doc_id as text) mod 3 isn't 1; a null doc_id has no
remainder, is not held out and not learned from. A text that is null or has no letters is ``und`` with score 0,
as is every text when nothing could be learned. Ties go to the first language by name. Repeated rows count each;
an empty table gives no row.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, documents, give_back, packed, slices, spark_to_arrow, with_columns

BUCKETS, GRAMS = 1 << 15, (2, 3, 4)
#: Log odds that a change of language costs; log odds that a word of a script foreign to a language costs.
SWITCH, FOREIGN = 12.0, 60.0
#: A script counts as a language's own from this share of its words.
OWN = 0.01
#: Words whose scores a worker remembers.
KEEP = 200_000
#: First code points of ranges of letters by script (fixed values); each range goes on to the next.
SCRIPTS = [(0x0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x900, "Indic"), (0xE00, "Thai"), (0xE80, "other"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"), (0x20000, "Han")]
_STARTS = np.array([a for a, _ in SCRIPTS])
_NAMES = list(dict.fromkeys(n for _, n in SCRIPTS))
_NUMBER = np.array([_NAMES.index(n) for _, n in SCRIPTS])
letters = re.compile(r"[^\W\d_]+").findall


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of every n-gram; a word's ends count as a space."""
    raw = np.frombuffer((" " + " ".join(words) + " ").encode(), np.uint8).astype(np.uint64)
    word = np.cumsum(raw == 32) - 1
    gaps = np.cumsum(raw == 32)
    buckets, owners = [], []
    for n in GRAMS:
        if len(raw) < n:
            continue
        h = np.full(len(raw) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + raw[j : j + len(h)]
            h ^= h >> np.uint64(29)
        # Spaces may stand at the ends of an n-gram only.
        inner = gaps[n - 2 : n - 2 + len(h)] - gaps[: len(h)] == 0
        buckets.append((h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49))[inner].astype(np.int64))
        owners.append(word[: len(h)][inner])
    return np.concatenate(buckets), np.concatenate(owners)


def scripts(words: list[str]) -> np.ndarray:
    return _NUMBER[np.searchsorted(_STARTS, [ord(w[0]) for w in words], side="right") - 1]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # log probability by bucket and language
    own: np.ndarray  # whether a language uses a script

    def scores(self, words: list[str]) -> np.ndarray:
        """Words x languages; the best is 0."""
        bucket, word = grams(words)
        order = np.argsort(word, kind="stable")
        begin = np.searchsorted(word[order], np.arange(len(words)))
        out = np.add.reduceat(self.weights[bucket[order]], begin, axis=0)
        own = self.own[:, scripts(words)].T
        out -= FOREIGN * (~own & own.any(axis=1)[:, None])
        return out - out.max(axis=1, keepdims=True)


def train(docs: DataFrame) -> Model:
    """Of docs with text and lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict = defaultdict(lambda: [np.zeros(BUCKETS, np.int64), np.zeros(len(_NAMES), np.int64)])
        for b in slices(batches):
            words: dict = defaultdict(Counter)
            for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                words[lang].update(letters(t.lower()))
            for lang, c in words.items():
                if c:
                    n = np.array(list(c.values()))
                    bucket, word = grams(list(c))
                    tables[lang][0] += np.bincount(bucket, n[word], BUCKETS).astype(np.int64)
                    tables[lang][1] += np.bincount(scripts(list(c)), n, len(_NAMES)).astype(np.int64)
        if tables:
            words = c = n = bucket = word = None
            give_back()
            yield columns({"lang": list(tables), "counts": [t[0].tobytes() for t in tables.values()], "scripts": [t[1].tobytes() for t in tables.values()]}, kinds)

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = lambda c: sum(np.frombuffer(x, np.int64) for x in part[c]).tobytes()
        return pd.DataFrame({"lang": part["lang"].iloc[:1], "counts": [total("counts")], "scripts": [total("scripts")]})

    schema = "lang string, counts binary, scripts binary"
    kinds = spark_to_arrow(docs.sparkSession, schema)
    known = docs.where("text is not null and lang is not null").select("text", "lang")
    rows = sorted(known.mapInArrow(count, schema).groupBy("lang").applyInPandas(add, schema).collect())  # a row for each language
    counts = np.array([np.frombuffer(r.counts, np.int64) for r in rows], float).reshape(len(rows), BUCKETS)
    used = np.array([np.frombuffer(r.scripts, np.int64) for r in rows], float).reshape(len(rows), len(_NAMES))
    weights = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    return Model([r.lang for r in rows], np.ascontiguousarray(weights.T.astype(np.float32)), used >= OWN * used.sum(axis=1, keepdims=True))


def viterbi(numbers: list[np.ndarray], table: np.ndarray) -> list[np.ndarray]:
    """Labels of sequences of word numbers (rows of table), all sequences a step at a time, the longest first."""
    order = sorted(range(len(numbers)), key=lambda i: -len(numbers[i]))
    sizes = np.array([len(numbers[i]) for i in order])
    flat = np.concatenate([numbers[i] for i in order]) if order else np.empty(0, int)
    begin = np.cumsum(sizes) - sizes
    steps = int(sizes[0]) if order else 0
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # sequences longer than t
    best = np.zeros((len(order), table.shape[1]), np.float32)
    back = []
    for t in range(steps):
        k = active[t]
        now = best[:k]
        top = now.argmax(axis=1)
        most = now[np.arange(k), top][:, None] - SWITCH
        switch = now < most
        back.append(np.where(switch, top[:, None], -1).astype(np.int16))
        best[:k] = np.maximum(now, most) + table[flat[begin[:k] + t]]
    out = np.empty(len(flat), np.int16)
    label = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        out[begin[:k] + t] = label[:k]
        came = back[t][np.arange(k), label[:k]]
        label[:k] = np.where(came >= 0, came, label[:k])
    result: list = [None] * len(order)
    for i, a, n in zip(order, begin.tolist(), sizes.tolist()):
        result[i] = out[a : a + n]
    return result


def label(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """docs with lang_pred and score, and spans (language and number of words of each) if asked for. Columns of docs with
    such names are a clash; ``packed`` keeps them apart."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    more = "lang_pred string, score double" + ", spans array<struct<lang:string,words:int>>" * spans
    schema, names = with_columns(docs, docs.columns, more), docs.columns
    kinds = spark_to_arrow(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        number: dict[str, int] = {}
        table = np.empty((0, len(m.langs)), np.float32)
        for b in slices(batches, 3_000, 4 << 20):
            words = [letters(t.lower()) if t and m.langs else [] for t in b.column("text").to_pylist()]
            if len(number) > KEEP:
                number, table = {}, table[:0]
            if new := [w for w in set().union(*words) if w not in number]:
                number.update(zip(new, range(len(number), len(number) + len(new))))
                table = np.concatenate([table, m.scores(new).astype(np.float32)])
            labels = viterbi([np.array(list(map(number.__getitem__, w)), np.int64) for w in words], table) if m.langs else [[]] * len(words)
            langs, scores, runs = [], [], []
            for w, x in zip(words, labels):
                share = np.bincount(x, [len(y) for y in w], len(m.langs)) if w else np.zeros(1)
                langs.append(m.langs[int(share.argmax())] if w else "und")
                scores.append(float(share.max() / share.sum()) if w else 0.0)
                if spans:
                    cuts = np.flatnonzero(np.diff(x, prepend=-1, append=-1)) if w else []
                    runs.append([{"lang": m.langs[x[a]], "words": int(z - a)} for a, z in zip(cuts[:-1], cuts[1:])])
            yield columns({c: b.column(c) for c in names} | {"lang_pred": langs, "score": scores, "spans": runs}, kinds)
        number.clear()
        table = words = labels = None
        give_back()

    return docs.mapInArrow(run, schema)


def fitted(docs: DataFrame) -> Model:
    return train(docs.where(~held_out()))


def identified(docs: DataFrame) -> DataFrame:
    """The documents that get a language, mixed ones too, whatever its share; those without letters go. Of those that have no
    lang, lang becomes the one they got; a lang that is there stays. A label is relative to the others, so texts in a language
    that wasn't learned stay. Where nothing was learned, all texts with letters stay as they are."""
    model, rows = fitted(docs), packed(docs, "text")
    if not model.langs:
        return rows.where(F.col("text").rlike(r"[\p{L}\p{Nl}\p{No}]")).select("row.*")  # what ``letters`` takes
    own = lambda c: F.col(f"row.`{c}`")
    told = label(rows, model).where("lang_pred <> 'und'")
    return told.select(*((F.coalesce(own(c), F.col("lang_pred")) if c == "lang" else own(c)).alias(c) for c in docs.columns))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fitted(docs)
    return label(docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), model).drop("text")
