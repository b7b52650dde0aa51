"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a document's hash. A bucket whose bytes exceed the limit splits on
the next bit, and only it; the others stay. The hash is that of the doc_id (and the text, for repeated ids), so a
hot source or a large group of copies spreads over all buckets. A bucket that holds one document or only
repeated rows can't split and may exceed the limit.

Sizes are summed per prefix of a few more bits than an even split needs, and the levels above are summed from
that table. The documents are shuffled once, to write the shards; if the directory is too large to broadcast, their
hashes alone look it up by shuffles, and the documents are joined to them first.

Null text has no bytes, null doc_ids hash like any other value, an empty table has no shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BROADCAST_ROWS, documents, packed, saved, small, workspace

#: Bytes of text in a shard.
LIMIT = 32 << 20
BITS = 62
#: Levels below that of an even split which are summed at once.
SPARE = 4


def _prefix(depth: int) -> Column:
    """The leading bits of a 62-bit hash, with a one before them, so that prefixes of all depths differ."""
    return F.shiftright("h", BITS - depth) + F.lit(1 << depth)


def hashed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), h and bytes."""
    h = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.xxhash64("text")), 64 - BITS)
    rows = packed(docs, "doc_id", "text")
    return rows.select("row", h.alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))


def folder(columns: list[str]) -> str:
    """The name of the column that tells a document's shard: shard_id, with a _ for each such name that the documents have."""
    name = "shard_id"
    while name in columns:
        name += "_"
    return name


def directory(rows: DataFrame, limit: int, path: str) -> DataFrame:
    """Of rows (h, bytes): bucket, depth, bytes and documents of every bucket of the final directory.

    A bucket belongs to it when its parent is full and it isn't; a parent's sizes are those of its two halves, so
    a level needs no other. Levels down to SPARE below the even one are summed from one table; what is full at
    the last of them goes on, SPARE levels at a time."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, high, left, done = 0, min(BITS, max(1, total // limit).bit_length() + SPARE), rows, None
    sizes = [F.sum("bytes").alias("bytes"), F.sum("documents").alias("documents"), F.min("first").alias("first"), F.max("last").alias("last")]
    while True:
        fine = left.groupBy(_prefix(high).alias("bucket")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("documents"), F.min("h").alias("first"), F.max("h").alias("last"))
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
        levels = levels.groupBy("depth", F.expr(f"shiftright(bucket, {high} - depth)").alias("bucket")).agg(*sizes)
        halves = Window.partitionBy("depth", F.shiftright("bucket", 1))
        parent = (F.sum("bytes").over(halves) > limit) & (F.min("first").over(halves) < F.max("last").over(halves))
        full = (F.col("bytes") > limit) & (F.col("first") < F.col("last"))
        levels = saved(levels.select("bucket", "depth", "bytes", "documents", full.alias("full"), parent.alias("split")), f"{path}/levels-{high}")
        ready = levels.where(~F.col("full") & (F.col("split") | F.lit(low == 0) & (F.col("depth") == 0))).drop("full", "split")
        done = ready if done is None else done.unionByName(ready)
        deep = levels.where(F.col("full") & (F.col("depth") == high)).select(F.col("bucket").alias("_full"))
        n = deep.count()
        if not n or high == BITS:
            return done
        left = left.join(small(deep, n), _prefix(high) == F.col("_full"), "left_semi")
        low, high = high, min(BITS, high + SPARE)


def shard(docs: DataFrame, out: str, limit: int = LIMIT) -> DataFrame:
    """Writes the documents with their shard, a folder for each, and returns the directory (a table as well)."""
    rows = hashed(docs)
    keys = saved(rows.select("h", "bytes"), f"{out}/keys")
    buckets = saved(directory(keys, limit, out), f"{out}/directory")
    depths = [r.depth for r in buckets.select("depth").distinct().collect()]  # 63 at most
    # A document's bucket is the one of its prefixes that is in the directory.
    own = F.explode(F.array(*(_prefix(d) for d in sorted(depths)))) if depths else F.lit(0).cast("long")
    names, name = buckets.select(F.col("bucket").alias("shard")), folder(docs.columns)
    if buckets.count() <= BROADCAST_ROWS:
        placed = rows.withColumn("shard", own).join(F.broadcast(names), "shard")
    else:  # a row for each prefix: of hashes, not of texts
        found = saved(keys.select("h").distinct().withColumn("shard", own).join(names, "shard"), f"{out}/found")
        placed = rows.join(found, "h")
    placed.select("row.*", F.col("shard").alias(name)).repartition(name).write.option("compression", "zstd").partitionBy(name).parquet(f"{out}/shards")
    return buckets


def read_shards(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The documents with shard_id, or as ``folder`` names it."""
    return spark.read.schema(f"{schema}, {folder(StructType.fromDDL(schema).names)} long").parquet(f"{out}/shards")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, shard_id, depth, shard_bytes and shard_documents of each document, from the shards as written."""
    out = workspace(spark)
    buckets = shard(documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text"), out)
    shards = read_shards(spark, out, "doc_id long").withColumnRenamed("shard_id", "bucket")
    return shards.join(buckets, "bucket").select("doc_id", F.col("bucket").alias("shard_id"), "depth", F.col("bytes").alias("shard_bytes"), F.col("documents").alias("shard_documents"))
