"""Exact dedup by a Golomb-coded exchange of fingerprints.

Texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]`` became one space; a null text
counts as empty. The steps:

1. one native scan writes the small fingerprint table (doc_id, 64-bit hash, SHA-256, partition, row number);
2. each partition sends its sorted distinct hashes, Golomb-Rice coded and cut by owner (a hash range), and marks
   the ones it holds more than once;
3. each owner answers every message with a bitmap of the hashes that occur elsewhere too;
4. the partitions read the bitmaps; a scan with a table of marks lets the texts with a suspect's hash through, and by
   chance one of 16 others (more beyond 2^26 suspects), which are shuffled, pre-aggregated by (hash, text), so that
   whole texts are compared byte by byte;
5. small tables carry (kept row, group size) back to the suspects.

Ties: of rows with equal text the smallest doc_id stays, a null doc_id last, and of repeated rows with one doc_id
the first read. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, marked, packed, same, saved, small, with_or_without, workspace

#: Documents whose hashes one owner receives, at least; with the root of the input it grows to some million.
OWNER_ROWS = 200_000
#: Messages between senders and owners, at most about; with more scan partitions, several send as one.
MESSAGES = 10**8


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def rice_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Golomb-Rice code of the gaps of sorted distinct uint64 values: quotients in unary, remainders in k bits."""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, float(gaps.astype(np.float64).mean())) * 0.6931)))
    q = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(q + 1) - 1  # the zero bit that ends each unary part
    unary = np.ones(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 0
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    return k, np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def rice_decode(code: bytes, k: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    rest_bytes = (n * k + 7) // 8
    unary = bits[: len(bits) - 8 * rest_bytes]
    ends = np.flatnonzero(unary == 0)[:n]
    q = np.diff(ends, prepend=-1) - 1
    rest = bits[len(bits) - 8 * rest_bytes :][: n * k].reshape(n, k).astype(np.uint64)
    gaps = (q.astype(np.uint64) << np.uint64(k)) + (rest << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _owners(hashes: np.ndarray, owners: int) -> np.ndarray:
    """Owner of each hash: equal ranges of the top 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _encoder(owners: int):
    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        values, counts = np.unique(rows["h"].to_numpy(np.int64).view(np.uint64), return_counts=True)
        own = _owners(values, owners)
        cuts = np.flatnonzero(np.diff(own, prepend=-1, append=owners))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            k, code = rice_encode(values[a:b])
            out.append((int(rows["part"].iloc[0]), int(own[a]), b - a, k, code, np.packbits(counts[a:b] > 1).tobytes()))
        return pd.DataFrame(out, columns=["part", "owner", "n", "k", "code", "own"])

    return encode


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    lists = [rice_decode(m.code, m.k, m.n) for m in messages.itertuples()]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    out = []
    for m, x in zip(messages.itertuples(), lists):
        twice = np.unpackbits(np.frombuffer(m.own, np.uint8))[: m.n].astype(bool) | (counts[np.searchsorted(values, x)] > 1)
        out.append((m.part, m.owner, np.packbits(twice).tobytes()))
    return pd.DataFrame(out, columns=["part", "owner", "bitmap"])


def _marker(owners: int):
    def mark(rows: pd.DataFrame, bitmaps: pd.DataFrame) -> pd.DataFrame:
        h = rows["h"].to_numpy(np.int64).view(np.uint64)
        values, at = np.unique(h, return_inverse=True)
        own = _owners(values, owners)
        twice = np.zeros(len(values), bool)
        for m in bitmaps.itertuples():  # an owner's hashes are a range
            a, z = np.searchsorted(own, [m.owner, m.owner + 1])
            twice[a:z] = np.unpackbits(np.frombuffer(m.bitmap, np.uint8))[: z - a].astype(bool)
        return rows.assign(suspect=twice[at.ravel()])[["doc_id", "rid", "h", "sha", "suspect"]]

    return mark


def exact_groups(docs: DataFrame, path: str) -> DataFrame:
    """A row per document: doc_id, rid (row number), h, sha, keep_id, keep_rid, group_size, kept."""
    spark = docs.sparkSession
    numbered = docs.select(F.col("doc_id").cast("long"), normalised().alias("norm")).withColumns({"rid": F.monotonically_increasing_id(), "h": F.xxhash64("norm"), "sha": F.sha2("norm", 256)})
    prints = saved(numbered.select("doc_id", "rid", "h", "sha", F.spark_partition_id().alias("part")), f"{path}/prints")
    n, parts = prints.count(), (prints.agg(F.max("part")).first()[0] or 0) + 1
    owners = max(1, -(-n // max(OWNER_ROWS, math.isqrt(100 * n))))
    prints = prints.withColumn("part", F.floor(F.col("part") / -(-parts * owners // MESSAGES)).cast("int"))
    messages = prints.select("part", "h").groupBy("part").applyInPandas(_encoder(owners), "part int, owner long, n int, k int, code binary, own binary")
    bitmaps = messages.groupBy("owner").applyInPandas(_answer, "part int, owner long, bitmap binary")
    told = saved(prints.groupBy("part").cogroup(bitmaps.groupBy("part")).applyInPandas(_marker(owners), "doc_id long, rid long, h long, sha string, suspect boolean"), f"{path}/marked")
    suspects = told.where("suspect")
    n = suspects.count()
    # Byte verification: only texts with a suspect's hash move, and equal texts of a task have become one row before.
    texts = docs.select(normalised().alias("norm")).withColumn("h", F.xxhash64("norm"))
    texts = marked(texts, "h", suspects, "h", n).where("_marked")
    sets = texts.groupBy("h", F.sha2("norm", 256).alias("sha"), "norm").agg(F.count("*").alias("copies"))
    verified = saved(sets.groupBy("h", "sha").agg(F.count("*").alias("texts")), f"{path}/verified")
    part = suspects.withColumn("part", F.lit(0).cast("long"))
    clashing = verified.where("texts > 1").select("h", "sha")
    if not clashing.isEmpty():  # different texts with both hashes: told apart by their bytes
        mixed = numbered.join(small(clashing, clashing.count()), ["h", "sha"], "left_semi")
        mixed = mixed.select("rid", F.dense_rank().over(Window.partitionBy("h", "sha").orderBy("norm")).cast("long").alias("part"))
        part = suspects.join(mixed, "rid", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    same_text = ["h", "sha", "part"]
    first = part.groupBy(*same_text).agg(F.count("*").alias("group_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first"))
    first = saved(first.select(*same_text, "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid")), f"{path}/first")
    groups = part.join(small(first, first.count()), same_text).select("doc_id", "rid", "h", "sha", "keep_id", "keep_rid", "group_size")
    single = told.where("not suspect").select("doc_id", "rid", "h", "sha", F.col("doc_id").alias("keep_id"), F.col("rid").alias("keep_rid"), F.lit(1).cast("long").alias("group_size"))
    return single.unionByName(groups).withColumn("kept", F.col("rid") == F.col("keep_rid"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of repeated rows one stays."""
    path = workspace(docs.sparkSession)
    groups = saved(exact_groups(docs, path), f"{path}/groups")
    kept = groups.where("kept").select("doc_id", "h")
    drop = saved(groups.where("not kept").select("doc_id", "h").distinct(), f"{path}/drop")
    both = saved(drop.join(kept, same(drop, kept, "doc_id", "h"), "left_semi"), f"{path}/both")  # repeated rows
    keyed = packed(docs).withColumns({"id": F.col("row.doc_id").cast("long"), "k": F.xxhash64(normalised("row.text"))})

    pairs = {"id": "doc_id", "k": "h"}
    out = with_or_without(keyed, drop, drop.count(), pairs, "k", "left_anti")
    if n := both.count():
        out = out.unionByName(with_or_without(keyed, both, n, pairs, "k", "left_semi").dropDuplicates(["id", "k"]))
    return out.select("row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir), workspace(spark)).select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


OP10_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS n FROM t)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
