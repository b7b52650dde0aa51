"""Token ids as ORC files: integer run-length encoded stripes, row indexes and Bloom filters on the document id.

Documents are range-partitioned by doc_id, so the files, their stripes and the row groups in them hold disjoint
rising ranges: a search by id reads the footers, then the row group that the Bloom filter and the index leave.
Texts travel compressed. Reading back is split by stripes; ``tokens_of`` pushes an id filter to the reader.

Ascending doc_id, null ids last, ties by the text's hash. Null text is empty and has the end id alone. An
empty table writes no row and reads back as an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_batches, saved, small, text_key, workspace
from .tokens import encoder, tokenizer_path

END = 0
#: Rows of a row group, which has its own index entry and Bloom filter; bytes of a stripe.
STRIDE, STRIPE = 2_000, 16 << 20


def squeezed(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), z (the text, zstd), for a shuffle of whole texts."""

    def squeeze(b):
        z = zstandard.ZstdCompressor(level=1)
        return {"doc_id": b.column("doc_id"), "key": b.column("key"), "z": [z.compress((t or "").encode()) for t in b.column("text").to_pylist()]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), "text"), squeeze, "doc_id long, key long, z binary")


def by_id(docs: DataFrame, parts: int) -> DataFrame:
    order = [F.col("doc_id").asc_nulls_last(), F.col("key")]
    return squeezed(docs).repartitionByRange(parts, *order).sortWithinPartitions(*order)


def write_orc(docs: DataFrame, path: str, out: str, parts: int, end: int = END) -> None:
    """Writes doc_id, part (rank of its range) and ids (the text's, then the end id)."""

    def run(b):
        unzip = zstandard.ZstdDecompressor()
        flat, ends = encoder(path).rows([unzip.decompress(x).decode() for x in b.column("z").to_pylist()], end)
        return {"doc_id": b.column("doc_id"), "part": b.column("part"), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int32)))}

    rows = by_id(docs, parts).select("doc_id", F.spark_partition_id().alias("part"), "z")
    (map_batches(rows, run, "doc_id long, part int, ids array<int>").write
        .option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", STRIDE).option("orc.stripe.size", STRIPE).orc(out))


def read_orc(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("doc_id long, part int, ids array<int>").orc(out)


def tokens_of(spark: SparkSession, out: str, doc_ids: list[int]) -> DataFrame:
    """The rows of the given ids; files, stripes and row groups without them aren't read."""
    return read_orc(spark, out).where(F.col("doc_id").isin(doc_ids))


def token_table(rows: DataFrame, index: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row of the files; writes the table of the rows' sizes to index."""

    def crc(b):
        lists = b.column("ids")
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return {"doc_id": b.column("doc_id"), "part": b.column("part"), "row": b.column("row"), "n_tokens": np.diff(ends), "ids_crc32": [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(ends[:-1], ends[1:])]}

    # The row's place in its file keeps the order of rows with one doc_id.
    read = saved(map_batches(rows.withColumn("row", F.monotonically_increasing_id()), crc, "doc_id long, part int, row long, n_tokens long, ids_crc32 long"), index)
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    placed = read.withColumn("at", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    totals = read.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return placed.join(small(before, before.count()), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def parts_for(docs: DataFrame) -> int:
    """As many ranges as the scan has partitions: what a task writes is about what a task reads."""
    return max(1, docs.rdd.getNumPartitions())


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), workspace(spark)
    write_orc(docs, tokenizer_path(), f"{out}/ids", parts_for(docs))
    return token_table(read_orc(spark, f"{out}/ids"), f"{out}/index")
