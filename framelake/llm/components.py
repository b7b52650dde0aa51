"""Connected components of an edge table, by alternating stars, without links or labels at the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, give_back, saved, spark_to_arrow


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (node, smallest node of its component) of the graph with edges a, b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def contracted(edges: DataFrame) -> DataFrame:
    """The same components in fewer edges: each task replaces the edges of a batch by a forest."""
    kinds = spark_to_arrow(edges.sparkSession, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = forest(batch.column("a").to_numpy(), batch.column("b").to_numpy())
            yield columns({"a": a, "b": b}, kinds)
        give_back()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, path: str) -> DataFrame:
    """node and component (the smallest node reachable) of every node of edges (a long, b long) that isn't its
    component itself. A star is grouped with partial sums only, so a node with very many edges is no hot task."""
    now, k = saved(contracted(edges).where("a <> b").distinct(), f"{path}/edges-0"), 0
    mark = None
    while True:
        both = now.select("a", "b").union(now.select("b", "a"))
        # Large star: a node's larger neighbours move to its smallest; small star: its smaller ones do.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        k += 1
        now = saved(small, f"{path}/edges-{k}")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = new
