"""What the text operators share: the working folder, size-checked semi joins, Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..storage import BATCH_BYTES, saved, workspace  # noqa: F401 (the operators take them from here)

#: Most rows of ids or hashes (8 to 24 bytes each) that a join may broadcast; beyond it Spark shuffles.
BROADCAST_ROWS = 1_000_000
#: Bits of a table of marks, at most: 128 MB as broadcast.
MARK_BITS = 30
_held: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any], on: bool = False) -> Any:
    """What a worker keeps between batches and, if it is to last on, from task to task, such as a tokenizer. Of one operator
    at a time: a worker that serves the next one lets go of the last one's."""
    if name not in _held:
        _held.clear()
        _held[name] = on, make()
    return _held[name][1]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns, so that rows without an id join as well."""
    out = a[names[0]].eqNullSafe(b[names[0]])
    for n in names[1:]:
        out &= a[n].eqNullSafe(b[n])
    return out


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only what has been counted and is within the bound; else AQE joins by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def marked(rows: DataFrame, h: str, keys: DataFrame, key: str, n: int) -> DataFrame:
    """rows with _marked: false where their hash h is none of the n hashes key of keys; true where it is, and by chance in one
    of 16 others. A table of bits tells, 16 for each key but 128 MB at most (beyond 2^26 keys more rows are true by chance), so
    that a scan can hold it whatever the input, and texts that aren't marked need no shuffle."""
    bits = max(20, min(MARK_BITS, (16 * n).bit_length()))
    place = lambda c: F.col(c).bitwiseAND((1 << bits) - 1)
    block = keys.groupBy(F.shiftright(place(key), 15).alias("_block")).agg(F.bitmap_construct_agg(place(key).bitwiseAND(32767)).alias("_bits"))
    out = rows.withColumns({"_at": place(h).bitwiseAND(32767), "_block": F.shiftright(place(h), 15)}).join(F.broadcast(block), "_block", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright("_at", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, F.col("_at").bitwiseAND(7).cast("int")) == 1
    return out.withColumn("_marked", F.coalesce(bit, F.lit(False))).drop("_at", "_block", "_bits")


def with_or_without(rows: DataFrame, keys: DataFrame, n: int, pairs: dict[str, str], h: str, kind: str) -> DataFrame:
    """rows that keys (n rows) have (left_semi), or don't have (left_anti), by null-safe pairs of columns of which h is a hash:
    by a broadcast of the keys within the bound; beyond it, of the rows only those that are marked are shuffled."""
    on = lambda left, right: functools.reduce(lambda a, b: a & b, (left[x].eqNullSafe(right[y]) for x, y in pairs.items()))
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), on(rows, keys), kind)
    rows = marked(rows, h, keys, pairs[h], n)
    some = rows.where("_marked")
    out = some.join(keys, on(some, keys), kind)
    return (out if kind == "left_semi" else out.unionByName(rows.where("not _marked"))).drop("_marked")


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def packed(df: DataFrame, *beside: str) -> DataFrame:
    """All columns in one named row, and copies of some of them beside it: whatever they are called, they don't clash with
    an operator's own."""
    return df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), *(F.col(c) for c in beside))


def with_columns(df: DataFrame, names: list[str], more: str) -> StructType:
    """The schema of some columns of df and of others (as DDL)."""
    return StructType([df.schema[n] for n in names] + _parse_datatype_string(more).fields)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], dict | None], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function from a batch to columns by name."""
    kinds = spark_to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if (out := f(b)) is not None:
                yield columns(out, kinds)

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """At the end of a task, returns freed memory to the system: workers idle between tasks, several to an executor."""
    for name in [n for n, (on, _) in _held.items() if not on]:
        del _held[name]
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library of Linux has it
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of few rows and, but for single longer ones, few bytes of texts, so that a worker holds the results of
    few long texts at once."""
    b = None
    for b in batches:
        length = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                length += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(length)
        lo = 0
        while lo < b.num_rows:
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, before + size, side="right"))))
            yield b.slice(lo, hi - lo)
            lo = hi
    del b
    give_back()


def spark_to_arrow(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    """The schema that a function on batches returns. The session sends it batches of bounded size from here on."""
    name, size = BATCH_BYTES
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, size)
    return to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)


def columns(out: dict, kinds: pa.Schema) -> pa.RecordBatch:
    arrays = [x if isinstance(x := out[k.name], pa.Array) else pa.array(x, k.type) for k in kinds]
    return pa.RecordBatch.from_arrays([x if x.type == k.type else x.cast(k.type) for x, k in zip(arrays, kinds)], schema=kinds)
