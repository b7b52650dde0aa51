"""Clumps of the similarity join: small however large the corpus, and every link in one."""

import random

import numpy as np
import pytest

from framelake.llm import jaccard
from framelake.llm.common import workspace
from framelake.llm.components import forest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def links(sets, top, of):
    return {(a, b) for b in range(len(sets)) for a in range(b) if of * (n := len(np.intersect1d(sets[a], sets[b]))) >= top * (len(sets[a]) + len(sets[b]) - n)}


def parts(n, edges):
    """Each node's component, named by its smallest node."""
    out = np.arange(n)
    if len(edges):
        a, b = forest(*np.array(sorted(edges)).T)
        out[a] = b
    return out.tolist()


def sets_of(seed):
    """Near copies of a few sets, with edits of all sizes, in order of size."""
    r = np.random.default_rng(seed)
    base = [r.integers(0, 5_000, n) for n in (8, 30, 60, 200)]
    out = [np.unique(np.where(r.random(len(b)) < r.random() * 0.2, r.integers(0, 60, len(b)), b)[: len(b) - r.integers(0, 4)]) for b in base for _ in range(40)]
    return sorted({x.tobytes(): x for x in out}.values(), key=len)


def test_sets_with_a_shingle_in_common_by_chance_make_no_clump(spark):
    r = random.Random(3)
    texts = [" ".join(f"w{int(r.random() ** 3 * 60)}" for _ in range(80)) for _ in range(1_500)]
    texts += [t.rsplit(" ", 1)[0] + " end" for t in texts[:20]]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], SCHEMA)
    path = workspace(spark)
    got = {x.doc_id: x.component_id for x in jaccard.link_groups(docs, path, 3, 90, 100, bits=12).collect()}
    assert got == {i: i - 1_500 if i >= 1_500 else i for i in range(1_520)}
    assert spark.read.parquet(f"{path}/members").count() < 100  # 40 link; once nearly all were members of one clump


@pytest.mark.parametrize("top", [60, 90])
@pytest.mark.parametrize("hot", [0, 3, 50])
def test_pairs_of_lists_join_all_links(hot, top):
    for seed in range(4):
        sets = sets_of(seed)
        rows = []
        for i, s in enumerate(sets):
            m = len(s) - jaccard.needed(len(s), top, 100) + int(jaccard.common(len(s), top, 100))
            rows += [(int(h), len(s), i) for h in s[np.argsort(s * 7919 % 5_003)][:m]] * (1 + i % 2)  # some twice, as of two tasks
        rows.sort()
        need, c, batches = {}, {}, [rows[i : i + 37] for i in range(0, len(rows), 37)]
        for out in jaccard.walked((list(np.array(b).T) for b in batches), top, 100, hot):
            for a, b, n, least in zip(*(x.tolist() for x in out)):
                c[a, b], need[a, b] = c.get((a, b), 0) + n, min(need.get((a, b), least), least)
        clump = parts(len(sets), [p for p in c if c[p] >= need[p]])
        want = links(sets, top, 100)
        assert want and all(clump[a] == clump[b] for a, b in want)
        if hot == 50:  # no pair is counted twice in the lists
            assert all(c[p] <= len(np.intersect1d(sets[p[0]], sets[p[1]])) for p in c if need[p])


@pytest.mark.parametrize("top", [60, 90])
def test_a_search_finds_a_forest_of_the_links(top):
    for seed in range(6):
        sets = sets_of(seed)
        want = links(sets, top, 100)
        got = jaccard.divide_skip(sets, np.full(len(sets), 2), top, 100)
        assert {tuple(sorted(p)) for p in got} <= want and parts(len(sets), got) == parts(len(sets), want)
        side = np.random.default_rng(seed).integers(0, 2, len(sets))
        across = {(a, b) for a, b in want if side[a] != side[b]}
        got = jaccard.divide_skip(sets, side, top, 100)
        assert across and {tuple(sorted(p)) for p in got} <= across and parts(len(sets), got) == parts(len(sets), across)


def test_a_search_looks_up_no_copy_that_is_joined(monkeypatch):
    """Copies with an edit each that link with the first all: the merge gives each about one of them, not all before it."""
    base = np.arange(400)
    sets = [base, *(np.sort(np.append(np.delete(base, [i, i + 1, i + 2]), [1_000 + 3 * i, 1_001 + 3 * i, 1_002 + 3 * i])) for i in range(0, 300, 3))]
    seen, merge = [], jaccard.merge_skip
    monkeypatch.setattr(jaccard, "merge_skip", lambda *a: (seen.append(x) or x for x in merge(*a)))
    assert len(jaccard.divide_skip(sets, np.full(len(sets), 2), 90, 100)) == len(sets) - 1
    assert len(seen) <= 2 * len(sets)
