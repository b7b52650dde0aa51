"""Document fingerprints: a canonical exact digest.

A text is canonical after NFKC, case folding, NFKC again, and folding of white space (runs become one space, none
at the ends). Its fingerprint is the 128-bit xxhash of that, as hex. Two fingerprints are alike 1.0 when they are
equal and the canonical texts are equal byte by byte, else 0.0: an exact digest knows nothing between.

For the edited texts documents are range-partitioned by doc_id (texts travel compressed) and each partition is
walked once in order; a last row, whose next document is in another partition, is finished from a table with the
first and last rows of the partitions. Grouping shuffles 40 bytes a document, then only the canonical texts of
buckets with several rows, pre-aggregated.

Null text is empty. Null doc_ids come last, ties by the text's hash; an empty table gives no row. A single document
is its own next.
"""

from __future__ import annotations

import hashlib
import unicodedata

import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, documents, map_batches, marked, saved, small, spark_to_arrow, workspace
from .orc_tokens import by_id, parts_for

DIGEST = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def canonical(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def fingerprint(canon: str) -> str:
    return xxhash.xxh3_128_hexdigest(canon.encode())


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


class _Row:
    """A text with what the digests need of it, computed once."""

    def __init__(self, doc_id, z: bytes, unzip):
        self.doc_id, self.z = doc_id, z
        self.text = unzip.decompress(z).decode()
        self.canon = canonical(self.text)
        self.print = fingerprint(self.canon)

    def digest(self, after: "_Row") -> tuple:
        change = edited(self.text, after.text)
        canon = canonical(change)
        mark = fingerprint(canon)
        alike = lambda p, c: float(p == self.print and c == self.canon)
        return (self.doc_id, len(self.text), hashlib.sha256(change.encode()).hexdigest(), self.print, mark, alike(mark, canon), alike(after.print, after.canon))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and DIGEST of every document and its edited text."""
    spark = docs.sparkSession
    schema = f"doc_id long, {DIGEST}, part int, first binary, last_id long, last binary"
    kinds = spark_to_arrow(spark, schema)
    names = [k.name for k in kinds]

    def emit(rows: list[tuple]):
        return columns({n: [r[i] for r in rows] for i, n in enumerate(names)}, kinds)

    def walk(batches):
        unzip, head, row = zstandard.ZstdDecompressor(), None, None
        for b in batches:
            out = []
            for part, doc_id, z in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "z"))):
                now = _Row(doc_id, z, unzip)
                if row:
                    out.append((*row.digest(now), None, None, None, None))
                else:
                    head = part, z
                row = now
            if out:
                yield emit(out)
        if row:
            yield emit([(None,) * 7 + (head[0], head[1], row.doc_id, row.z)])

    rows = by_id(docs, parts_for(docs)).select(F.spark_partition_id().alias("part"), "doc_id", "z")
    table = saved(rows.mapInArrow(walk, schema), f"{path}/digests")
    edges = table.where("part is not null")
    # A partition's next one, the first after the last: numbers only are ordered in one task, texts meet by a join.
    order = saved(edges.select("part", (F.row_number().over(Window.orderBy("part")) - 1).alias("k")), f"{path}/order")
    n = order.count()
    after = order.select("k", F.col("part").alias("own")).join(order.select(F.expr(f"pmod(k - 1, {max(n, 1)})").alias("k"), F.col("part").alias("next")), "k")
    firsts = edges.join(after, F.col("part") == F.col("next")).select(F.col("own").alias("part"), F.col("first").alias("after"))
    ring = edges.select("part", "last_id", "last").join(firsts, "part")

    def close(b):
        unzip, out = zstandard.ZstdDecompressor(), []
        for i, z, after in zip(*(b.column(c).to_pylist() for c in ("last_id", "last", "after"))):
            out.append(_Row(i, z, unzip).digest(_Row(None, after, unzip)))
        return {n: [r[i] for r in out] for i, n in enumerate(names[:7])}

    ends = map_batches(ring.select("last_id", "last", "after"), close, f"doc_id long, {DIGEST}")
    return table.where("part is null").select(*names[:7]).unionByName(ends)


def groups(docs: DataFrame, prints: DataFrame, path: str) -> DataFrame:
    """Of prints (doc_id, fingerprint): each fingerprint's group_id (smallest doc_id) and group_size where several
    rows share it, once their canonical texts proved equal. member is null, or the document that the row is for."""
    many = prints.groupBy("fingerprint").agg(F.count("*").alias("group_size"), F.min("doc_id").alias("group_id")).where("group_size > 1")
    many = saved(many, f"{path}/many")
    ids = prints.join(small(many, many.count()), "fingerprint", "left_semi").select(F.xxhash64("doc_id").alias("h")).distinct()
    ids = saved(ids, f"{path}/suspects")
    # Texts that are marked by chance have a fingerprint of their own.
    suspects = docs.select(F.col("doc_id").cast("long"), "text").withColumn("h", F.xxhash64("doc_id"))
    suspects = marked(suspects, "h", ids, "h", ids.count()).where("_marked").select("doc_id", "text")

    def fold(b):
        canon = [canonical(t or "") for t in b.column("text").to_pylist()]
        return {"doc_id": b.column("doc_id"), "fingerprint": [fingerprint(c) for c in canon], "canon": [c.encode() for c in canon]}

    texts = map_batches(suspects, fold, "doc_id long, fingerprint string, canon binary")
    sets = texts.groupBy("fingerprint", "canon").agg(F.count("*").alias("copies"))
    proved = saved(sets.groupBy("fingerprint").agg(F.count("*").alias("texts")), f"{path}/proved")
    clear = many.join(proved.where("texts = 1"), "fingerprint").select("fingerprint", "group_id", "group_size", F.lit(None).cast("long").alias("member"))
    clashing = proved.where("texts > 1").select("fingerprint")
    if clashing.isEmpty():
        return clear
    # Different texts with one fingerprint are told apart by their bytes: a row for each document of them.
    w = Window.partitionBy("fingerprint", "canon")
    apart = texts.join(small(clashing, clashing.count()), "fingerprint", "left_semi")
    return clear.unionByName(apart.select("fingerprint", F.min("doc_id").over(w).alias("group_id"), F.count("*").over(w).alias("group_size"), F.col("doc_id").alias("member")).distinct())


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir), workspace(spark)
    table = digests(docs, path)
    same_text = saved(groups(docs, table.select("doc_id", "fingerprint"), path), f"{path}/groups")
    own = (table["fingerprint"] == same_text["fingerprint"]) & (F.col("member").isNull() | F.col("member").eqNullSafe(table["doc_id"]))
    out = table.join(small(same_text, same_text.count()), own, "left").drop(same_text["fingerprint"])
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
