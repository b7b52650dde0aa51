"""Packing by concatenate and cut: two-pass prefix sums give global offsets, then fixed windows.

Pass 1 encodes each document once (its ids, then the end id) and writes the ids with the running offset inside
its scan partition. The totals of the partitions, a row each, are summed to global offsets. Pass 2 reads the ids
and cuts each document at the multiples of the sequence length: the pieces that end or begin a window are its
boundary records, and no other document is needed for them. No text or id is shuffled.

All sequences are full but the last, which is short by less than one sequence and needs the only padding. Null
text is empty and still has its end id. Repeated rows are packed each. An empty table gives no piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, documents, map_batches, saved, slices, small, spark_to_arrow, workspace
from .tokens import binaries, encoder, tokenizer_path

LENGTH, END = 2048, 1


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, part, at (tokens of the partition before it), n, ids (little-endian 32-bit, with the end id)."""
    schema = "doc_id long, part int, at long, n long, ids binary"
    kinds = spark_to_arrow(docs.sparkSession, schema)

    def run(batches):
        at = 0
        for b in slices(batches):
            flat, ends = encoder(path).rows([t or "" for t in b.column("text").to_pylist()], end)
            yield columns({"doc_id": b.column("doc_id"), "part": b.column("part"), "at": at + ends[:-1], "n": np.diff(ends), "ids": binaries(flat, ends)}, kinds)
            at += len(flat)

    return docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("part")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32, and ids (binary) if asked for."""
    work = workspace(docs.sparkSession)
    rows = saved(encoded(docs, path, end), f"{work}/ids")
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))  # one row for each scan partition
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    placed = rows.join(small(before, before.count()), "part").select("doc_id", "n", (F.col("before") + F.col("at")).alias("at"), "ids")

    def cut(b):
        at, n = (b.column(c).to_numpy() for c in ("at", "n"))
        first, last = at // length, (at + n - 1) // length
        k = last - first + 1
        row = np.repeat(np.arange(len(n)), k)
        seq = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + first[row]
        lo, hi = np.maximum(at[row], seq * length), np.minimum(at[row] + n[row], (seq + 1) * length)
        start = lo - at[row]
        codes, views = b.column("ids"), zip(row.tolist(), (4 * start).tolist(), (4 * (hi - lo)).tolist())
        pieces = [codes[r].as_buffer()[s : s + m] for r, s, m in views]
        return {"doc_id": b.column("doc_id").take(pa.array(row)), "start": start, "length": hi - lo, "doc_tokens": n[row], "sequence_id": seq, "offset": lo - seq * length, "ids_crc32": [zlib.crc32(x) for x in pieces]} | ({"ids": [x.to_pybytes() for x in pieces]} if ids else {})

    return map_batches(placed, cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long" + ", ids binary" * ids)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path(), ids=False)
