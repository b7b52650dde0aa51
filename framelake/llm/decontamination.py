"""Benchmark decontamination by a prefix-filtered set join.

Words are letters, digits and characters beyond ASCII in a row, A-Z lower-cased. A window is 10 consecutive words of an
item, or all words of an item with fewer. A word of a document inside an occurrence of a window is hit.

1. A window is the set of its runs of 5 words (shingles), a shorter one the run of all its words. Tasks count the shingles
   of windows in all documents, which orders them by rarity.
2. A document has a window only where it has all its shingles, so one of them is prefix enough: the rarest. Documents are
   scanned once more, and a place that has a prefix shingle goes on with the words around it, no text else.
3. Places meet the windows of their shingle. The shingle's position in the window tells where the window would begin, which
   must leave it inside the document (length and position bounds); the item-sized stretch of words there is compared.
4. What was found is merged to hit words, and to items, by document.

Shingles are told from all others by a bitmap of fixed size; what it lets through wrongly meets no window. Items are told by
item_id, those without one as one item with an empty id; windows that items share are compared once. Null texts have no words,
neither has an item without words any window. Null and repeated doc_ids are rows like others, other columns travel along in row
whatever they are called, and very long texts send the places found only. Without documents there is no row, and without items
nothing is hit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, documents, give_back, map_batches, saved, slices, small, spark_to_arrow, with_columns, workspace
from .jaccard import windows, word_hashes

WINDOW, RUN = 10, 5
#: Bits of the bitmap of shingles: 2 MB, whatever the input.
BITS = 24
#: Different shingles that a task counts before it sends them.
HELD = 200_000
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, told from those of other lengths."""
    return (windows(h, k) ^ np.uint64(k)).view(np.int64) if len(h) >= k else np.empty(0, np.int64)


def item_windows(items: DataFrame, size: int = WINDOW, run: int = RUN) -> DataFrame:
    """item_id (string), window (its words, joined by one space), length, shingles (of each place in the window)."""

    def cut(b: pa.RecordBatch) -> dict:
        out = {c: [] for c in ("item_id", "window", "length", "shingles")}
        for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
            w = words(t)
            n = min(size, len(w))
            k = min(run, n)
            h = shingles(word_hashes(w), k) if n else None
            for a in range(len(w) - n + 1 if n else 0):
                for c, x in zip(out, (i, b" ".join(w[a : a + n]).decode("utf-8", "replace"), n, h[a : a + n - k + 1])):
                    out[c].append(x)
        return out

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    return map_batches(rows, cut, "item_id string, window string, length int, shingles array<long>")


def bitmap(hashes: DataFrame, bits: int = BITS) -> bytes:
    """Which values the low bits of the hashes h take: tasks send compressed blocks, 64 each, merged block by block."""
    schema = "block int, bits binary"
    kinds = spark_to_arrow(hashes.sparkSession, schema)

    def pack(seen: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return columns({"block": at, "bits": [pa.compress(np.packbits(x).tobytes(), codec="zstd", asbytes=True) for x in seen]}, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for b in batches:
            seen[b.column("h").to_numpy() & (1 << bits) - 1] = True
        yield pack(seen.reshape(64, -1), np.arange(64))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {}
        for b in batches:
            for k, z in zip(b.column("block").to_pylist(), b.column("bits").to_pylist()):
                x = np.frombuffer(pa.decompress(z, 1 << bits - 9, codec="zstd", asbytes=True), np.uint8)
                of[k] = of[k] | x if k in of else x
        if of:
            yield columns({"block": list(of), "bits": [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in of.values()]}, kinds)

    blocks = hashes.select("h").mapInArrow(run, schema).repartition("block").mapInArrow(merge, schema)
    out = np.zeros((64, 1 << bits - 9), np.uint8)
    for r in blocks.collect():  # 64 rows, 2 MB at most
        out[r["block"]] = np.frombuffer(pa.decompress(r["bits"], 1 << bits - 9, codec="zstd", asbytes=True), np.uint8)
    return out.tobytes()


def _probe(texts: list[bytes | None], ks: list[int], seen: np.ndarray) -> tuple[np.ndarray, list[list[bytes]], list[tuple]]:
    """Words of each text, and the shingles that the bitmap has: (text number, place, hash) for each length."""
    each = [words(t) for t in texts]
    sizes = np.array([len(w) for w in each], np.int64)
    h = word_hashes([w for ws in each for w in ws])
    doc, begin = np.repeat(np.arange(len(each)), sizes), np.cumsum(sizes) - sizes
    found = []
    for k in ks:
        x = shingles(h, k)
        at = np.flatnonzero(seen[x & len(seen) - 1])
        at = at[doc[at] == doc[at + k - 1]] if len(at) else at
        found.append((doc[at], at - begin[doc[at]], x[at]))
    return sizes, each, found


def _counted(docs: DataFrame, ks: list[int], bits: bytes) -> DataFrame:
    """h, n: how often documents have the shingles that the bitmap has."""
    schema = "h long, n long"
    kinds, sent = spark_to_arrow(docs.sparkSession, schema), docs.sparkSession.sparkContext.broadcast(bits)

    def rows(n: Counter) -> pa.RecordBatch:
        return columns({"h": list(n), "n": list(n.values())}, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = Counter(), np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        for b in slices(batches):
            for _, _, h in _probe(b.column("text").to_pylist(), ks, seen)[2]:
                n.update(h.tolist())
            if len(n) > HELD:
                yield rows(n)
                n.clear()
        yield rows(n)
        del n, seen
        give_back()

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _scanned(docs: DataFrame, ks: list[int], bits: bytes, size: int) -> DataFrame:
    """row (the columns of docs but text), rid, n_words and places: h, at, lo and the words from lo on around each place that
    has a shingle of the bitmap."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), F.monotonically_increasing_id().alias("rid"), F.col("text").cast("binary").alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64()), ("lo", pa.int64()), ("words", pa.string())]))

    def run(b: pa.RecordBatch) -> dict:
        seen = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        sizes, each, found = _probe(b.column("_text").to_pylist(), ks, seen)
        places: list[list] = [[] for _ in each]
        for doc, at, h in found:
            for d, i, x in zip(doc.tolist(), at.tolist(), h.tolist()):
                lo = max(0, i - size)
                places[d].append({"h": x, "at": i, "lo": lo, "words": b" ".join(each[d][lo : i + size]).decode("utf-8", "replace")})
        return {"row": b.column("row"), "rid": b.column("rid"), "n_words": sizes, "places": pa.array(places, kind)}

    return map_batches(rows, run, with_columns(rows, ["row", "rid"], "n_words long, places array<struct<h: long, at: long, lo: long, words: string>>"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """A row for each document: row (its columns but text), n_words, n_hit and items (the sorted ids of those that it has
    windows of); and a row for each occurrence found: rid of the document's row, start, length and window."""
    path = workspace(docs.sparkSession)
    of = saved(item_windows(items, size, run), f"{path}/windows")
    unique = of.groupBy("window").agg(F.first("length").alias("length"), F.first("shingles").alias("shingles"))
    each = saved(unique.select("window", "length", F.posexplode("shingles").alias("offset", "h")), f"{path}/shingles")
    ks = sorted({min(run, r["length"]) for r in each.select("length").distinct().collect()})  # `size` rows at most
    counts = _counted(docs, ks, bitmap(each)).groupBy("h").agg(F.sum("n").alias("n"))
    known = each.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = F.min(F.struct("n", "h", "offset")).alias("r")
    prefix = saved(known.groupBy("window", "length").agg(rarest).where("r.n > 0").select("window", "length", "r.h", "r.offset"), f"{path}/prefix")
    scan = saved(_scanned(docs, ks, bitmap(prefix), size), f"{path}/scan")
    place = scan.select("rid", "n_words", F.inline("places"))
    met = place.join(small(prefix, prefix.count()), "h").withColumn("start", F.col("at") - F.col("offset")).where("start >= 0 AND start + length <= n_words")
    there = F.array_join(F.slice(F.split("words", " "), (F.col("start") - F.col("lo") + 1).cast("int"), F.col("length")), " ")
    hits = saved(met.where(there == F.col("window")).select("rid", "start", "length", "window").distinct(), f"{path}/hits")
    # Words up to the farthest end so far are counted already.
    before = Window.partitionBy("rid").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    new = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    n_hit = hits.withColumn("new", new).groupBy("rid").agg(F.sum("new").alias("n_hit"))
    pairs = hits.select("rid", "window").distinct().join(of.select("window", "item_id"), "window").select("rid", "item_id").distinct()
    found = n_hit.join(pairs.groupBy("rid").agg(F.sort_array(F.collect_list("item_id")).alias("items")), "rid")
    out = scan.drop("places").join(found, "rid", "left")
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "items": F.coalesce("items", F.array().cast("array<string>"))}), hits


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    r, _ = contamination(documents(spark, sf_dir).select("doc_id", "text"), items)
    return r.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP13_SQL = r"""
WITH fold AS (SELECT 'd' AS kind, row_number() OVER () AS rid, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'i', row_number() OVER (), coalesce(CAST(item_id AS VARCHAR), ''), text FROM benchmark),
ws AS (SELECT kind, rid, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM fold),
it AS (SELECT DISTINCT id, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i : array_to_string(w[i : i + 9], ' '))) AS win FROM ws WHERE kind = 'i' AND len(w) > 0),
sz AS (SELECT DISTINCT n FROM it),
dw AS (SELECT rid, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i : struct_pack(i := i, win := array_to_string(w[i : i + n - 1], ' ')))) AS x FROM ws, sz WHERE kind = 'd' AND len(w) >= n),
hit AS (SELECT DISTINCT rid, x.i AS i, dw.n, x.win AS win FROM dw WHERE x.win IN (SELECT win FROM it)),
nh AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY 1),
ni AS (SELECT rid, list_sort(list(DISTINCT id)) AS items FROM hit JOIN it ON hit.win = it.win GROUP BY 1)
SELECT CAST(ws.id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM ws LEFT JOIN nh USING (rid) LEFT JOIN ni USING (rid) WHERE kind = 'd'
"""
