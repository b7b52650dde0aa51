"""Periodic runs, divergence of sources and benchmark decontamination against brute force, on tables with nulls, empties,
ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from framelake.llm import decontamination, divergence, periodic

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACES, WORD, LETTER = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_runs(w, least=12):
    """Every period, every stretch of it."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, 2 * q) and not any(w[i : i + n - r] == w[i + r : i + n] for r in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(count, seed):
    """Texts of few words with repeated stretches, and odd ones."""
    r = random.Random(seed)
    out = [None, "", " \t\n", "a", "é É " * 20, "a " * 11, "a " * 12, "\x85x " * 13]
    while len(out) < count:
        n, k = r.randint(0, 90), r.choice([1, 2, 3, 8])
        w = [f"w{r.randint(0, k)}" for _ in range(n)]
        if n > 5 and r.random() < 0.5:
            a = r.randrange(n)
            p = 1 + r.randrange(1 + (n - a) // 2)
            w = w[:a] + [w[a + i % p] for i in range(n - a)]
        if r.random() < 0.3:
            w += [f"x{i}" for i in range(r.randint(0, 10))] + w[::-1]
        out.append(" ".join(w))
    return out


def test_runs_equal_brute_force():
    words = [[x.encode() for x in SPACES.findall(t or "")] for t in texts(1500, 1)]
    for lo in range(0, len(words), 70):  # many texts at once: a run never goes on in the next one
        for w, found in zip(words[lo : lo + 70], periodic.runs(words[lo : lo + 70])):
            assert list(zip(*(x.tolist() for x in found))) == brute_runs(w), w


def test_all_runs_of_small_words():
    """Without the least length: the runs of all words of two letters to 9."""
    for n in range(1, 10):
        for x in range(1 << n):
            s = np.array([1 + (x >> i & 1) for i in range(n)])
            assert list(zip(*(a.tolist() for a in periodic.maximal(s, 2)))) == brute_runs(s.tolist(), 2)


def test_a_long_text_of_one_passage():
    passage = [b"p%d" % i for i in range(9000)]
    ((start, length, period),) = periodic.runs([[b"a"] + passage * 5 + [b"b"]])
    assert (start.tolist(), length.tolist(), period.tolist()) == ([1], [45_000], [9000])


def test_periodic_query(spark, tmp_path):
    rows = [(i, t, "x", None, 0) for i, t in enumerate(texts(120, 2))]
    rows += [(i, " ".join(f"v{j}" for j in range(i)), None, "s", None) for i in range(1000, 1040)] + [(5, rows[5][1], "again", None, 1), (None, "q r " * 9, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, periodic.op11_periodic_runs(spark, str(tmp_path)).collect()))
    want = Counter()
    for i, t, *_ in rows:
        w = SPACES.findall(t or "")
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
        runs = brute_runs(w)
        drop = {j for s, n, q in runs for j in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        kept = " ".join(x for j, x in enumerate(w) if j not in drop)
        want[i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept)] += 1
    assert got == want and any(k[1] > 1 for k in want)
    clash = spark.createDataFrame([(1, "a b " * 8, "x", 1)], "doc_id long, text string, runs string, n_words int")
    (r,) = periodic.periodic(clash).collect()
    assert (r.row.runs, r.row.n_words, r.n_words, [tuple(x) for x in r.runs], r.collapsed) == ("x", 1, 16, [(0, 16, 2)], "a b")
    assert periodic.periodic(clash.limit(0)).count() == 0


def brute_divergence(rows, least=10, top=10):
    docs = [(t[1] or "", t[2] or "", t[3] or "") for t in rows]
    has, n, all_n = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        w = LETTER.findall(text.translate(UPPER))
        n[lang, source].update(w)
        all_n[lang].update(w)
        has[lang].update(set(w))
    kept = {lang: [w for w, c in has[lang].items() if c >= least] for lang in {d[1] for d in docs}}

    def shares(count, lang):
        total = sum(count[w] for w in kept[lang])
        return {w: 1 + 10**9 * (count[w] + 2) // (total + 2 * len(kept[lang])) for w in kept[lang]}

    f = lambda p, q: (p - q) * (p - q) // (p + q)
    p, out = {g: shares(c, g[0]) for g, c in n.items()}, []
    for (lang, source), mine in p.items():
        whole = shares(all_n[lang], lang)
        parts = {"pair": [(s, sum(f(x, p[k, s][w]) for w, x in mine.items())) for k, s in p if k == lang and s != source], "term": [(w, f(x, whole[w])) for w, x in mine.items() if n[lang, source][w] and x > whole[w]]}
        for part, items in parts.items():
            ranked = sorted(items, key=lambda r: (-r[1], r[0].encode()))
            out += [(lang, source, part, i, v, r) for r, (i, v) in enumerate(ranked, 1) if part == "pair" or r <= top]
    return Counter(out)


@pytest.mark.parametrize("least", [1, 10])
def test_divergence(spark, least):
    r = random.Random(3)
    vocabulary = ["the", "The", "ÉTÉ", "été", "a1b", "zoë", "日本", "x"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 40))), r.choice(["en", "fr", "", None]), r.choice(["s1", "s2", "s2", "s3", None])) for i in range(150)]
    rows += [(7, None, "xx", "empty"), (7, "", "xx", "other"), (8, "one", "yy", "alone"), (None, "12 34", None, "digits")] + rows[:5]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, lang string, source string, term int")
    got = Counter(map(tuple, divergence.divergence(docs, least).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == brute_divergence(rows, least)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_ties_of_cells_are_expanded_in_order(spark):
    """Hundreds of terms in one cell: the first ten in UTF-8 order."""
    rows = [(i, " ".join(f"t{chr(97 + j // 26)}{chr(97 + j % 26)}é" for j in range(400)), "en", "s1") for i in range(12)] + [(99, "other " * 500, "en", "s2")] * 10
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = Counter(map(tuple, divergence.divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == brute_divergence(rows) and sum(k[2] == "term" and k[1] == "s1" for k in got) == 10


def test_counts_beyond_64_bits_are_exact(spark):
    (r,) = spark.range(1).selectExpr("10000000000000L AS n", "30000000000001L AS total", "1000L AS v").select(divergence.share("n", "total").alias("p")).collect()
    assert r.p == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 1 + 2000)


def brute_contamination(docs, items, size=10):
    found = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(UPPER))
        n = min(size, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            found[tuple(w[a : a + n])].add(str(i) if i is not None else "")
    lengths = {len(k) for k in found}
    for d in docs:
        w = WORD.findall((d[1] or "").translate(UPPER))
        hit, ids = set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in found:
                    hit.update(range(a, a + n))
                    ids |= found[k]
        yield d[0], len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)


def contaminated():
    r = random.Random(5)
    word = lambda k=40: r.choice(["Née", "x1", "É"] + [f"w{i}" for i in range(k)])
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 5, 7, 10, 12, 30])))) for i in range(12, 40)]
    items += [(1, None), (2, "?!"), (3, "the the the the the the the the the the the the"), (4, items[0][1]), (4, "two lines of one item"), (None, "an item without an id"), (10, "shared " + items[1][1])]
    docs = [(i, " ".join(word() for _ in range(r.randint(0, 60))), "en", "s", None) for i in range(60)]
    for i in range(60, 160):
        a, t = r.randint(0, 20), r.choice(items)[1] or ""
        cut = t.split()[r.randint(0, 3) :]
        docs.append((i, " ".join([*(word() for _ in range(a)), *cut, "and,", t.upper(), *(word() for _ in range(r.randint(0, 5)))]), "en", None, 1))
    docs += [(7, None, None, None, None), (8, "", "x", "y", 0), (9, "the " * 40, "x", "y", 0), (None, items[3][1], None, None, None)] + docs[60:64]
    docs += [(200 + i, "lead " + items[2][1] + f" w{i}", "hot", "hot", 1) for i in range(300)]
    return docs, items


@pytest.mark.parametrize("rows", [10**6, 0])
def test_decontamination_query(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr("framelake.llm.common.BROADCAST_ROWS", rows)
    docs, items = contaminated()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter(map(tuple, decontamination.op13_decontamination(spark, str(tmp_path)).collect()))
    assert got == Counter(brute_contamination(docs, items))


def test_decontamination_of_odd_tables(spark):
    docs, items = contaminated()
    d, i = spark.createDataFrame([(x, t, "a", 1) for x, t, *_ in docs], "doc_id long, text string, n_hit string, places int"), spark.createDataFrame([(str(x), t, 3) for x, t in items], "item_id string, text string, window int")
    r, hits = decontamination.contamination(d, i)
    assert r.where("row.n_hit = 'a' AND row.places = 1").count() == len(docs) and hits.count() > 100
    assert decontamination.contamination(d, i.limit(0))[0].where("n_hit = 0 AND size(items) = 0").count() == len(docs)
    assert decontamination.contamination(d.limit(0), i)[0].count() == 0
