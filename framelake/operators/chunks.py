"""Running values over long sequences: chunks of a key are worked out alone, and a scan over the chunks, a row each, tells
every chunk what was before it. So no task holds more of a key than a chunk, however many rows the key has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Numbers of seq, so rows at most, of a chunk.
CHUNK = 100_000
PART = "_chunk"


def chunked(rows: DataFrame, size: int = CHUNK, seq: str = "seq") -> DataFrame:
    return rows.withColumn(PART, F.expr(f"CAST({seq} AS BIGINT) DIV {size}"))


def running(keys: list[str], seq: str = "seq") -> WindowSpec:
    """The rows of a chunk up to each one."""
    return Window.partitionBy(*keys, PART).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)


def earlier(keys: list[str]) -> WindowSpec:
    """The chunks before each one."""
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def carried(rows: DataFrame, keys: list[str], **of: tuple[Callable[[str], Column], str]) -> DataFrame:
    """rows with, by name, an aggregate (F.sum, F.min, F.max or F.bit_xor) of a column over the earlier chunks of their key;
    null in the first."""
    totals = rows.groupBy(*keys, PART).agg(*(f(c).alias(n) for n, (f, c) in of.items()))
    before = totals.select(*keys, PART, *(f(n).over(earlier(keys)).alias(n) for n, (f, _) in of.items()))
    return rows.join(before, [*keys, PART])
