"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and the groups they form.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set holds its distinct k-word shingles as 64-bit
hashes, or its whole word sequence if it has fewer than k words. Documents without words link with nothing.

1. One scan writes a row per document with its set's size and 64-bit set id, and adds all shingles to a sketch of
   fixed size; equal sets are one node from here on.
2. Shingles are ordered rare first by the sketch (any order is right; this one keeps the lists short). Two sets
   that link share one of the first n - ceil(t n) + 1, and e of the first n - ceil(t n) + e: these prefixes alone are
   shuffled, and a walk over each list in order of size gives the pairs of sizes that can link. Pairs that share e
   shingles of their prefixes stay; sets that share fewer, by chance, don't, so that clumps don't fuse as the corpus
   grows. Where a list has more than HOT sets for one to pair with, these are joined by an edge each instead.
3. Components of these pairs are clumps: every link lies in one. The sets of clumps are gathered, and each clump is
   searched by T-occurrence with DivideSkip: a set asks the sets before it; its short inverted lists are merged by a
   heap that skips what can't reach T less the number of long lists, the others are looked up in the long lists by
   binary search, and a set already in the component of the asking one is skipped. Sets that share too little with all
   others are left out first. A clump beyond a size is cut into chunks, and pairs of chunks whose sizes can link are
   searched apart.
4. The links kept (a spanning forest of each search) are joined to components.

No pairs are emitted but those of rows near in a list, HOT for a row at most, and the forests' edges. Null text is empty; null doc_ids are rows without a number: they are
found by their sets and never are the smallest. Repeated rows have equal sets; an empty table gives no row.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, documents, give_back, held, map_batches, marked, packed, saved, slices, small, spark_to_arrow, text_key, with_or_without, workspace
from .components import components

#: Counters of the sketch: 64 MB in a task, 16 MB as broadcast, whatever the input.
SKETCH_BITS = 24
#: Shingles of a clump, and of a chunk of a larger one, that one task holds (8 bytes each).
CHUNK = 1_000_000
#: Rows of a list, of sizes that can link with one before them, that make pairs with it; of more each makes one edge.
HOT = 50
#: DivideSkip's price of looking a list up; lists are looked up all at once, so most are long ones.
MU = 0.002


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; a worker remembers those of a bounded number of words."""
    known = held("word hashes", _Hashes)
    if len(known) > 200_000:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    n = len(h) - k + 1
    x = np.zeros(n, np.uint64)
    for j in range(k):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return x


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct shingles as int64."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the white space of the definition
    if not words:
        return np.empty(0, np.int64)
    return np.unique(windows(word_hashes(words), min(k, len(words))) ^ np.uint64(min(k, len(words)))).view(np.int64)


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def needed(n: int, top: int, of: int) -> int:
    """Fewest shingles of a set of n that a linked set shares: ceil(t n), t = top / of."""
    return -(-top * n // of)


def _scan(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """Rows of doc_id, n, sid; at the end of a partition rows of the sketch (block, counts)."""
    schema = "doc_id long, key long, n long, sid long, block int, counts binary"
    kinds = spark_to_arrow(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        for b in slices(batches):
            sets = [shingles(t, k) for t in b.column("text").to_pylist()]
            if b.num_rows:
                np.add.at(counts, np.concatenate(sets) & (1 << bits) - 1, 1)
            yield columns({"doc_id": b.column("doc_id"), "key": b.column("key"), "n": [len(s) for s in sets], "sid": [set_id(s) for s in sets], "block": pa.nulls(b.num_rows, pa.int32()), "counts": pa.nulls(b.num_rows, pa.binary())}, kinds)
        blocks = counts.reshape(64, -1)
        none = pa.nulls(64, pa.int64())
        yield columns({"doc_id": none, "key": none, "n": none, "sid": none, "block": np.arange(64, dtype=np.int32), "counts": [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in blocks]}, kinds)

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), "text").mapInArrow(run, schema)


def _sketch(rows: DataFrame, bits: int) -> np.ndarray:
    """The counters summed block by block; 2^bits of them come to the driver, as bytes of a logarithmic scale."""
    size = 4 * (1 << bits) // 64

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(pa.decompress(x, size, codec="zstd", asbytes=True), np.int32).astype(np.int64) for x in part["counts"])
        return pd.DataFrame({"block": part["block"].iloc[:1], "counts": [(np.log2(total + 1.0) * 4).astype(np.uint8).tobytes()]})

    blocks = rows.where("block is not null").select("block", "counts").groupBy("block").applyInPandas(add, "block int, counts binary").collect()
    return np.frombuffer(b"".join(r.counts for r in sorted(blocks)), np.uint8) if blocks else np.zeros(1 << bits, np.uint8)


def common(n, top: int, of: int):
    """How many shingles of their prefixes two sets that link share, the smaller of which has n: a tenth of its prefix and two. A
    prefix is longer by so many, less one, than one in which they share a single shingle."""
    least = needed(n, top, of)
    return np.minimum(least, 2 + (n - least + 1) // 10)


def _candidates(docs: DataFrame, k: int, top: int, of: int, bits: int, sketch) -> DataFrame:
    """Edges (a, b) between set ids such that sets that link are joined by a path: pairs whose prefixes share enough
    shingles, counted over the lists, and for sets that are followed by more than HOT sets of sizes that can link in one list, one edge for
    each of these."""
    spark = docs.sparkSession
    kind, pairs = "h long, n long, sid long", "a long, b long, c long, least long"
    rows, kinds = spark_to_arrow(spark, kind), spark_to_arrow(spark, pairs)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = sketch.value, set()
        for b in slices(batches):
            hs, ns, ids = [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, k)
                if len(s) and (i := set_id(s)) not in seen:  # once for each set and task
                    seen.add(i)
                    m = len(s) - needed(len(s), top, of) + int(common(len(s), top, of))
                    hs.append(s[np.lexsort((s, order[s & (1 << bits) - 1]))[:m]])
                    ns.append(np.full(m, len(s)))
                    ids.append(np.full(m, i))
            if hs:
                yield columns({"h": np.concatenate(hs), "n": np.concatenate(ns), "sid": np.concatenate(ids)}, rows)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, c, least in walked(([b.column(c).to_numpy() for c in ("h", "n", "sid")] for b in batches), top, of):
            yield columns({"a": a, "b": b, "c": c, "least": least}, kinds)
        give_back()

    lists = docs.select("text").mapInArrow(prefixes, kind).repartition("h").sortWithinPartitions("h", "n", "sid")
    counted = lists.mapInArrow(walk, pairs).groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("least").alias("least"))
    return counted.where("c >= least").select("a", "b")


def walked(batches: Iterator[list[np.ndarray]], top: int, of: int, hot: int = HOT) -> Iterator[tuple[np.ndarray, ...]]:
    """Of rows (h, n, sid) in this order: pairs a < b of a list and of sizes that can link, how many lists of a batch have them, and
    how many must in all; none for edges of rows that have more than hot such rows behind them."""
    tail = [np.empty(0, np.int64)] * 3  # the last list's last rows
    for batch in batches:
        old = len(tail[0])
        h, n, s = (np.concatenate(x) for x in zip(tail, batch))
        if len(h) == old:
            continue
        again = np.append(False, (h[1:] == h[:-1]) & (s[1:] == s[:-1]))  # a set that several tasks have
        h, n, s = h[~again], n[~again], s[~again]
        x, y, head, rest = neighbours(h, n, old, top, of, hot)
        if len(x):
            _, at, i = np.unique(s, return_index=True, return_inverse=True)
            both, c = np.unique(np.minimum(i[x], i[y]) * len(at) + np.maximum(i[x], i[y]), return_counts=True)
            u, v = at[both // len(at)], at[both % len(at)]
            yield s[u], s[v], c, common(np.minimum(n[u], n[v]), top, of)
        if len(rest):
            zero = np.zeros(len(rest), np.int64)
            yield np.minimum(s[head], s[rest]), np.maximum(s[head], s[rest]), zero, zero
        tail = [c[max(int(np.searchsorted(h, h[-1])), len(h) - hot - 2) :] for c in (h, n, s)]


def neighbours(h: np.ndarray, n: np.ndarray, old: int, top: int, of: int, most: int) -> tuple[np.ndarray, ...]:
    """Of rows in order of list h and size n, the first old of which were in the batch before: pairs (x, y), y not of these, of a list
    and of sizes that can link; and of rows that have more than most such rows behind them, all that they reach (rest) and the
    first of these (head)."""
    i, hot = np.arange(len(h)), np.zeros(len(h), bool)
    at, xs, ys = i, [i[:0]], [i[:0]]
    for d in range(1, most + 2):
        at = at[at < len(h) - d]
        at = at[(h[at + d] == h[at]) & (top * n[at + d] <= of * n[at])]
        if not len(at):
            break
        xs.append(at)
        ys.append(at + d)
    hot[at] = True
    x, y = np.concatenate(xs), np.concatenate(ys)
    keep = ~hot[x] & (y >= old)
    # A hot row reaches as many rows and one; where it could reach further, the next one is hot too.
    reach = np.maximum.accumulate(np.where(hot, i + most + 1, -1))
    inside = reach >= i
    begins = inside & ~np.append(False, reach[:-1] >= i[1:])
    rest = np.flatnonzero(inside & ~begins)
    return x[keep], y[keep], np.maximum.accumulate(np.where(begins, i, 0))[rest], rest


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        return int(self.roots(np.array([i]))[0])

    def roots(self, of: np.ndarray) -> np.ndarray:
        out = self.up[of]
        while (out != (more := self.up[out])).any():
            out = more
        self.up[of] = out
        return out


def merge_skip(postings: array, at: list[int], stop: list[int], t: int) -> Iterator[tuple[int, int]]:
    """Members of at least t of the sorted lists postings[at : stop], and of how many, by a heap of the lists' heads. What
    stands at fewer heads is passed over: t - 1 heads are popped together, and their lists go on by binary search at
    the head that is left, which is the least that can still be in t lists."""
    heap = [(postings[i], k) for k, i in enumerate(at)]
    heapify(heap)
    while len(heap) >= t:
        least, popped = heap[0][0], []
        while heap and heap[0][0] == least:
            popped.append(heappop(heap)[1])
        if (n := len(popped)) >= t:
            yield least, n
            after = least + 1
        else:
            while heap and len(popped) < t - 1:
                popped.append(heappop(heap)[1])
            if not heap:
                return
            after = heap[0][0]
        for k in popped:
            at[k] = i = bisect_left(postings, after, at[k], stop[k])
            if i < stop[k]:
                heappush(heap, (postings[i], k))


def able(sizes: np.ndarray, side: np.ndarray, owner: np.ndarray, terms: np.ndarray, top: int, of: int) -> np.ndarray:
    """How many shingles each set (in rising order of size) shares with others beyond those that a link with the smallest of
    these needs. Below 0 it can't link: such sets don't count for the rest, until none goes."""
    spare = np.zeros(len(sizes), np.int64)
    while True:
        left = np.flatnonzero(spare >= 0)
        n = sizes[left]
        least = np.empty(len(left), np.int64)  # the smallest partner's size; none: beyond all
        for s in np.unique(side[left]):
            mine, others = side[left] == s, n[(side[left] != s) | (side[left] == 2)]
            least[mine] = np.append(others, 1 << 40)[np.searchsorted(others, -(-top * n[mine] // of))]
        live = spare[owner] >= 0
        count = np.bincount(terms[live], minlength=int(terms.max(initial=-1)) + 1)
        shared = np.bincount(owner[live & (count[terms] > 1)], minlength=len(sizes))
        spare[left] = shared[left] + (top * (n + least) // -(top + of))
        if (spare[left] >= 0).all():
            return spare


def divide_skip(sets: list[np.ndarray], side: np.ndarray, top: int, of: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets, which are in rising order of size; side 2 asks for pairs of all, sides 0
    and 1 for pairs across. Sets of one side that link are joined by another search.

    Each set asks those before it for the least overlap that a link needs. The longest of its inverted lists are set apart,
    the short ones merged by a heap; what occurs in enough of these is looked up in the long ones by binary search.
    Sets that can link with none are left out beforehand, and those that share most with others come first: most sets link
    with these, and then what is in their component leaves the lists."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, terms = np.unique(np.concatenate(sets), return_inverse=True)
    terms = terms.ravel()
    spare = able(sizes, side, owner, terms, top, of)
    # By size class, so that sets that can link are near, and in a class those with most to spare first.
    edges = [1]
    while edges[-1] <= sizes[-1]:
        edges.append(edges[-1] * of // top + 1)
    kind = np.searchsorted(edges, sizes, side="right")
    names = np.lexsort((-spare, kind))
    names = names[spare[names] >= 0]
    if (n := len(names)) < 2:
        return []
    place = np.full(len(sets), -1)
    place[names] = np.arange(n)
    by = np.argsort(place[owner], kind="stable")[int((spare[owner] < 0).sum()) :]
    owner, (_, terms, count) = place[owner[by]], np.unique(terms[by], return_inverse=True, return_counts=True)
    terms, by_size = terms.ravel(), np.sort(sizes[names])
    sizes, side, kind = sizes[names], side[names], kind[names]
    # The inverted lists one after the other, each in order of the sets.
    keys = np.sort(terms * n + owner)
    ends, both = np.cumsum(sizes), bool((side == 2).all())
    joined, out = _Forest(n), []
    for q in range(1, n):
        low = int(np.searchsorted(kind, kind[q] - 1))  # the first set that can be large enough
        size = int(sizes[q])
        t = -(-top * (size + int(by_size[np.searchsorted(by_size, needed(size, top, of))])) // (top + of))  # for the smallest of these
        mine = terms[ends[q] - size : ends[q]]
        mine = mine[count[mine] > 1]
        if len(mine) < t or low == q:
            continue
        mine = mine[np.argsort(count[mine], kind="stable")]
        n_long = min(t - 1, int(t / (MU * np.log2(int(count[mine[-1]]) + 1) + 1)))
        cut = len(mine) - n_long
        long = mine[cut:] * n
        first, last = np.searchsorted(keys, mine[:cut] * n + low), np.searchsorted(keys, mine[:cut] * n + q)
        which = np.repeat(np.arange(cut), last - first)
        short = keys[np.arange(len(which)) + np.repeat(first - (np.cumsum(last - first) - (last - first)), last - first)] % n
        keep = (top * sizes[short] <= of * size) & (top * size <= of * sizes[short])
        if not both:
            keep &= side[short] != side[q]
        while True:
            keep &= joined.roots(short) != joined.find(q)
            which, short = which[keep], short[keep]
            at = np.searchsorted(which, np.arange(cut + 1))
            lists = np.flatnonzero(at[1:] > at[:-1])
            for r, got in merge_skip(array("q", short.tobytes()), at[lists].tolist(), at[lists + 1].tolist(), t - n_long):
                need = -(-top * (size + int(sizes[r])) // (top + of))  # of * shared >= top * union
                if got + n_long >= need:
                    spot = np.searchsorted(keys, long + r)
                    if got + int((keys[np.minimum(spot, len(keys) - 1)] == long + r).sum()) >= need:
                        break
            else:
                break
            out.append((int(names[q]), int(names[r])))
            joined.up[joined.find(q)] = joined.find(r)
            keep = short > r
    return out


def _searcher(k: int, top: int, of: int):
    def search(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["sid", "side"]).sort_values(["n", "sid"], kind="stable")
        unzip = zstandard.ZstdDecompressor()
        sets = [shingles(unzip.decompress(z).decode(), k) for z in part["z"]]
        ids = part["sid"].to_numpy()
        links = divide_skip(sets, part["side"].to_numpy(), top, of)
        if len(sets) > 1_000:
            sets.clear()
            give_back()
        return pd.DataFrame([(ids[a], ids[b]) for a, b in links], columns=["a", "b"])

    return search


def link_groups(docs: DataFrame, path: str, k: int, top: int, of: int, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, sid (its set), node (its component of sets) and component_id (the smallest
    doc_id of that) of each document; documents link at Jaccard >= top / of."""
    spark = docs.sparkSession
    scan = saved(_scan(docs, k, bits), f"{path}/scan")
    table = scan.where("block is null").select("doc_id", "key", "n", "sid")
    sketch = spark.sparkContext.broadcast(_sketch(scan, bits))  # 2^bits bytes
    pairs = saved(_candidates(docs, k, top, of, bits, sketch), f"{path}/candidates")  # its own stage: one worker for each task
    clumps = saved(components(pairs, f"{path}/clumps"), f"{path}/clump-of")
    clumps = saved(clumps.select(F.col("node").alias("sid"), F.col("component").alias("clump")).unionByName(clumps.select(F.col("component").alias("sid"), F.col("component").alias("clump")).distinct()), f"{path}/members")
    n_members = clumps.count()
    # One document for each set of a clump; its text travels to the search and becomes a set there.
    nodes = table.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    nodes = saved(nodes.join(small(clumps, n_members), "sid"), f"{path}/nodes")
    sizes = nodes.groupBy("clump").agg(F.sum("n").alias("total"), F.min("n").alias("least"))
    plan = nodes.join(sizes, "clump").select("clump", "sid", "doc_id", "n", F.ceil(F.col("total") / CHUNK).cast("long").alias("chunks"))
    # Chunks of a large clump by size class, then by hash; pairs of chunks whose sizes can't link are left out.
    step = float(np.log(of / top))
    plan = plan.withColumn("class", F.when(F.col("chunks") == 1, 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / step)).cast("long")).withColumn("salt", F.pmod(F.xxhash64("sid"), "chunks"))
    plan = saved(plan, f"{path}/plan")
    cells = plan.select("clump", "class", "salt").distinct()
    left, right = (cells.select("clump", *(F.col(c).alias(f"{c}{i}") for c in ("class", "salt"))) for i in (1, 2))
    near = (F.col("class2") - F.col("class1")).between(0, 1) & ((F.col("class1") < F.col("class2")) | (F.col("salt1") <= F.col("salt2")))
    searches = left.join(right, "clump").where(near).withColumn("alone", (F.col("class1") == F.col("class2")) & (F.col("salt1") == F.col("salt2")))
    search = F.xxhash64("clump", "class1", "salt1", "class2", "salt2").alias("search")
    one = searches.select("clump", F.col("class1").alias("class"), F.col("salt1").alias("salt"), search, F.when(F.col("alone"), 2).otherwise(0).alias("side"))
    two = searches.where("not alone").select("clump", F.col("class2").alias("class"), F.col("salt2").alias("salt"), search, F.lit(1).alias("side"))
    tasks = saved(plan.join(one.unionByName(two), ["clump", "class", "salt"]).select("sid", F.col("doc_id").alias("_id"), "n", "search", "side"), f"{path}/searches")

    def squeeze(b):
        z = zstandard.ZstdCompressor(level=1)
        texts = [t or "" for t in b.column("text").to_pylist()]
        same = [set_id(shingles(t, k)) == i for t, i in zip(texts, b.column("sid").to_pylist())]  # repeated ids may have other texts
        keep = pa.array(np.flatnonzero(same))
        return {c: b.column(c).take(keep) for c in ("search", "side", "sid", "n")} | {"z": [z.compress(t.encode()) for t, ok in zip(texts, same) if ok]}

    texts = docs.select(F.col("doc_id").cast("long"), "text").withColumn("h", F.xxhash64("doc_id"))
    n_tasks = tasks.count()
    texts = marked(texts, "h", tasks.select(F.xxhash64("_id").alias("h")), "h", n_tasks).where("_marked")  # of sets in no search none is shuffled
    texts = texts.join(small(tasks, n_tasks), texts["doc_id"].eqNullSafe(F.col("_id")))
    held = map_batches(texts.select("search", "side", "sid", "n", "text"), squeeze, "search long, side int, sid long, n long, z binary")
    links = held.groupBy("search").applyInPandas(_searcher(k, top, of), "a long, b long")
    # From set ids to the smallest doc_id of each set, and of each component of sets.
    joined = components(saved(links, f"{path}/links"), f"{path}/joined")
    least = table.groupBy("sid").agg(F.min("doc_id").alias("least"))
    label = least.join(joined.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "least", F.coalesce("component", "sid").alias("component"))
    low = label.groupBy("component").agg(F.min("least").alias("component_id"))
    named = saved(label.join(low, "component").select("sid", "component_id", F.col("component").alias("node")), f"{path}/named")
    out = table.join(small(named, named.count()), "sid")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), "sid", "node", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, top: int = 80, of: int = 100) -> DataFrame:
    """docs with the smallest doc_id of each group of near duplicates, and all that link with none."""
    path = workspace(docs.sparkSession)
    groups = link_groups(docs, path, k, top, of)
    # The first row of a group by id and text; its repeated rows are exact copies and stay with it.
    groups = saved(groups.where("n_shingles > 0").select("doc_id", "key", "node"), f"{path}/groups")
    first = groups.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    first = first.select("node", "first.doc_id", "first.key")
    drop = groups.join(first, (groups["node"] == first["node"]) & groups["doc_id"].eqNullSafe(first["doc_id"]) & (groups["key"] == first["key"]), "left_anti")
    drop = saved(drop.select(F.col("doc_id").alias("id"), "key").distinct(), f"{path}/drop")
    rows = packed(docs).withColumns({"id_": F.col("row.doc_id").cast("long"), "key_": text_key("row.text")})
    return with_or_without(rows, drop, drop.count(), {"id_": "id", "key_": "key"}, "key_", "left_anti").select("row.*")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_groups(documents(spark, sf_dir), workspace(spark), 3, 90, 100).select("doc_id", "n_shingles", "component_id")
