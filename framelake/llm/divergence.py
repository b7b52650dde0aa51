"""Source divergence audit by ranking of count cells.

How differently the sources of a language use its words. Null text, lang and source count as empty. Terms are ``[A-Za-z]`` and
characters beyond ASCII in a row, A-Z lower-cased; a language keeps those in at least 10 of its documents. A group is a
language and a source, with or without terms. Each group, and each language, gives a kept term that it has count times, out
of N occurrences of V kept terms, p = 1 + floor(1000000000 (count + 2) / (N + 2 V)); two of them diverge in a term by
f = floor((p - q)^2 / (p + q)).

1. Tasks count terms by group, and the documents that have them, and send sums; texts don't move. A kept term becomes
   one row with the counts of its sources.
2. A cell is a pair (count in the group, count in the language) and the number of its terms: f is worked out for each cell,
   not for each term. Cells of equal value are merged; those with fewer than 10 terms before them are the ranks to 10. Only
   then are terms joined to their cells, and ranked in UTF-8 order among equals.
3. Between two sources, f is summed over the cells of terms that both have. Of all others one of the counts is 0, so that
   their sums come from each source's own cells. Terms of equal counts in all sources are one row before they are paired.

Counts may be of any size: products are decimals. A document is a row, repeated ones too; ids and other columns aren't read. A
very long text is one list of words in a worker. An empty table gives no row.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, documents, give_back, saved, slices, small, spark_to_arrow, workspace

#: Fewest documents of a language that a kept term is in, and the terms ranked of each group.
DOCUMENTS, TOP = 10, 10
#: Different terms by group that a task counts before it sends them.
HELD = 200_000
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
GROUP = ["lang", "source"]


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LETTERS).split()


def _counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: sums of a part of the documents; term is null in a row for each group."""
    schema = "lang string, source string, term binary, n long, docs long"
    kinds = spark_to_arrow(docs.sparkSession, schema)

    def rows(n: dict[tuple, Counter], d: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, source), count in n.items():
            words, has = list(count), d[lang, source]
            m = len(words) + 1
            yield columns({"lang": [lang] * m, "source": [source] * m, "term": [None, *words], "n": [0, *count.values()], "docs": [0, *map(has.__getitem__, words)]}, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, d = defaultdict(Counter), defaultdict(Counter)
        for b in slices(batches):
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                words = terms(text)
                n[lang, source].update(words)
                d[lang, source].update(set(words))
            if sum(map(len, n.values())) > HELD:
                yield from rows(n, d)
                n.clear()
                d.clear()
        yield from rows(n, d)
        del n, d
        give_back()

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP]
    return docs.select(*blank, F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def share(count: str, total: str, kept: str = "v") -> Column:
    """A term's p from its count, the sum of counts and the number of kept terms; null where none is kept."""
    big = "CAST({} AS DECIMAL(20, 0))"
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10, 0)) * ({big.format(count)} + 2)) DIV nullif({big.format(total)} + 2 * {kept}, 0)")


def diverge(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


def divergence(docs: DataFrame, least: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank. Part pair: each other source of the language, by the sum of f over all kept
    terms. Part term: the first ranks of the terms that the group has more often than its language."""
    path = workspace(docs.sparkSession)
    sums = _counts(docs).groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = saved(sums.withColumn("term", F.col("term").cast("string")), f"{path}/counts")
    groups = counts.where("term is null").select(*GROUP)
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("has"))
    kept = saved(kept.where(F.col("docs") >= least).drop("docs"), f"{path}/kept")
    each = kept.select("lang", "term", "total", F.inline("has"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    own = each.groupBy(*GROUP).agg(F.sum("n").alias("own"))
    totals = groups.join(own, GROUP, "left").join(langs, "lang", "left").fillna(0)
    totals = saved(totals.withColumn("zero", share("0", "own")), f"{path}/totals")
    n = totals.count()
    return _pairs(kept, each, totals, n).unionByName(_terms(each, totals, n, top, path))


def _terms(each: DataFrame, totals: DataFrame, n: int, top: int, path: str) -> DataFrame:
    cells = each.groupBy(*GROUP, "n", "total").agg(F.count("*").alias("terms"))
    cells = cells.join(small(totals, n), GROUP).withColumns({"p": share("n", "own"), "q": share("total", "all")}).where("p > q")
    cells = saved(cells.select(*GROUP, "n", "total", "terms", diverge("p", "q").alias("value")), f"{path}/cells")
    # A value has a term at least, so the first `top` values hold all ranks to top.
    by_value = Window.partitionBy(*GROUP).orderBy(F.desc("value"))
    first = cells.groupBy(*GROUP, "value").agg(F.sum("terms").alias("terms")).withColumn("_r", F.row_number().over(by_value)).where(F.col("_r") <= top)
    first = first.withColumn("before", F.sum("terms").over(by_value) - F.col("terms")).where(F.col("before") < top).select(*GROUP, "value", "before")
    chosen = saved(cells.join(small(first, top * n), [*GROUP, "value"]).select(*GROUP, "n", "total", "value", "before"), f"{path}/chosen")
    found = each.join(small(chosen, chosen.count()), [*GROUP, "n", "total"])
    among = F.row_number().over(Window.partitionBy(*GROUP, "value").orderBy("term"))
    found = found.withColumn("_r", among).where(F.col("_r") <= top).withColumn("rank", (F.col("before") + F.col("_r")).cast("int")).where(F.col("rank") <= top)
    return found.select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(kept: DataFrame, each: DataFrame, totals: DataFrame, n: int) -> DataFrame:
    t = totals.select(*GROUP, "v", "own", "zero")
    one, two = (t.select("lang", *(F.col(c).alias(f"{c}_{k}") for c in ("source", "own", "zero", "v"))) for k in (1, 2))
    two = two.drop("v_2")
    pair = ["lang", "source_1", "source_2"]
    # Terms that both have: f, less what the sums over each one's cells count of them.
    equal = kept.where(F.size("has") > 1).groupBy("lang", "has").agg(F.count("*").alias("terms"))
    both = equal.select("lang", "has", "terms", F.posexplode("has").alias("at", "a")).select("lang", "terms", "a", F.explode(F.expr("slice(has, at + 2, size(has))")).alias("b"))
    both = both.select("lang", "terms", F.col("a.source").alias("source_1"), F.col("a.n").alias("n_1"), F.col("b.source").alias("source_2"), F.col("b.n").alias("n_2"))
    both = both.groupBy(*pair, "n_1", "n_2").agg(F.sum("terms").alias("terms")).join(small(one, n), ["lang", "source_1"]).join(small(two, n), ["lang", "source_2"])
    both = both.withColumns({"p": share("n_1", "own_1", "v_1"), "q": share("n_2", "own_2", "v_1")})
    more = diverge("p", "q") - diverge("p", "zero_2") - diverge("zero_1", "q") + diverge("zero_1", "zero_2")
    both = both.groupBy(*pair).agg(F.sum(F.col("terms") * more).alias("x"))
    both = both.unionByName(both.select("lang", F.col("source_1").alias("source_2"), F.col("source_2").alias("source_1"), "x"))
    # A source's cells against the other's p of no occurrence, from both sides.
    cells = each.groupBy(*GROUP, "n").agg(F.count("*").alias("terms")).select("lang", F.col("source").alias("source_1"), "n", "terms")
    cells = cells.join(small(one, n), ["lang", "source_1"]).join(small(two, n), "lang").where("source_1 <> source_2").withColumn("p", share("n", "own_1", "v_1"))
    alone = cells.groupBy(*pair).agg(F.sum(F.col("terms") * (diverge("p", "zero_2") - diverge("zero_1", "zero_2"))).alias("x"))
    alone = alone.unionByName(alone.select("lang", F.col("source_1").alias("source_2"), F.col("source_2").alias("source_1"), "x"))
    none = one.join(small(two, n), "lang").where("source_1 <> source_2").select(*pair, F.coalesce(F.col("v_1") * diverge("zero_1", "zero_2"), F.lit(0)).alias("x"))
    out = both.unionByName(alone).unionByName(none).groupBy(*pair).agg(F.sum("x").cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source_1").orderBy(F.desc("value"), "source_2"))
    return out.select("lang", F.col("source_1").alias("source"), F.lit("pair").alias("part"), F.col("source_2").alias("item"), "value", rank.alias("rank"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS own FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (g.own + 2 * l.v) AS p, 1 + (1000000000 * (k.n + 2)::HUGEINT) // (l.n + 2 * l.v) AS q FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM f WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms QUALIFY rank <= 10
"""
