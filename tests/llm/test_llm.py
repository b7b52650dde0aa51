"""Each operator against a brute-force version on a small table with nulls, empties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from framelake.llm import bpe, exact, fingerprints, jaccard, language, orc_tokens, packing, phrases, quotes, sharding, tokens
from framelake.llm.common import workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(7)
VOCAB = ["alpha", "Beta", "gamma,", "dé", "<|endoftext|>", "x"]
LONG = " ".join(random.choice(VOCAB) + str(random.randint(0, 9)) for _ in range(3000))
PASSAGE = " ".join(f"p{i}" for i in range(30))
OTHER = "".join(f"q{i} " for i in range(30))
ROWS = [(0, "a b  c\n d", "en"), (1, "a b c d", None), (2, None, "en"), (3, "", "de"), (4, LONG, "en"), (5, LONG + " tail", "en"), (6, OTHER + PASSAGE, "fr"), (7, PASSAGE + " two", "fr"), (8, "¡! 123", None), (9, " \t ", "en"), (11, "x", "en"), (12, "x<|endoftext|> y  z\n\n  q", "en"), (None, "x", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_exact(spark, docs, empty):
    got = {(r.doc_id, r.rid): r for r in exact.exact_groups(docs, workspace(spark)).collect()}
    rows = {r.doc_id: r for r in got.values()}
    assert rows[1].keep_id == 0 and rows[1].group_size == 2 and not rows[1].kept
    assert rows[2].group_size == rows[3].group_size == 2 and rows[3].keep_id == 2
    assert rows[None].keep_id == 11 and not rows[None].kept
    assert rows[0].sha == hashlib.sha256(b"a b c d").hexdigest()
    assert exact.exact_groups(empty, workspace(spark)).count() == 0
    assert exact.exact_dedup(docs.union(docs).withColumn("kept", docs.source)).count() == exact.exact_dedup(docs).count() == len(ROWS) - 3


def test_golomb_round_trip():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    for v in (x, x[:1], np.array([0, 1, 2, 3], np.uint64)):
        k, code = exact.rice_encode(v)
        assert (exact.rice_decode(code, k, len(v)) == v).all()


def test_encoders_equal_the_library():
    lib, path = library(), tokens.tokenizer_path()
    coder, enc = bpe.Coder(path, bpe.Compiled(path)), tokens.Encoder(path)
    parts = [" ", " ", "  ", "\n", "\r", "a", "in", "ing", "1", "'s", "'", "'ll", "'re", "'ve", "l", "e", "S", "é", "\t", "\u3000", "\x85", "\xa0", "!", "====", "中", "<|endoftext|>", "\u0558", "\u0301", "²", "Ⅷ", "\u200b", "😀", "\x00", "ſ"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(4000)] + [t or "" for _, t, _ in ROWS]
    texts += ["z" * 70_000, "ab" * 40_000, " " * 5000 + "x", "word " * 30_000]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    for k in (1, 700):
        for lo in range(0, len(texts), k) if k > 1 else range(0, 300):
            for (flat, ends) in (coder.encode(texts[lo : lo + k]), enc.encode(texts[lo : lo + k])):
                for i, w in enumerate(want[lo : lo + k]):
                    assert flat[ends[i] : ends[i + 1]].tolist() == w, repr(texts[lo + i][:200])
    flat, ends = coder.encode(texts)
    assert coder.decode(flat, ends) == [lib.decode(w, skip_special_tokens=False) for w in want]


def test_automaton_permits_what_merges_leave():
    """Against the merges themselves: two tokens may follow each other when their text is encoded as the two."""
    path = tokens.tokenizer_path()
    a, lib = bpe.Compiled(path).automaton, library()
    lib.pre_tokenizer = __import__("tokenizers").pre_tokenizers.CharDelimiterSplit(" ")
    chars = tokens.byte_characters()
    x, y = np.random.default_rng(3).integers(0, 50_256, (2, 3000))
    x[::3], y[1::3] = np.arange(1000) % 256, np.arange(1000) % 256
    got = a.permits(x, y)
    for i, j, ok in zip(x.tolist(), y.tolist(), got.tolist()):
        text = "".join(chars[b] for b in a.label[i] + a.label[j])
        assert (lib.encode(text).ids == [i, j]) == ok


def test_table_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEEP", 50)
    lib, enc = library(), tokens.Encoder(tokens.tokenizer_path())
    for k in range(40):
        texts = [" ".join(f"w{random.randint(0, 10 + 20 * k)} same" for _ in range(30)) for _ in range(3)]
        flat, ends = enc.encode(texts)
        assert [flat[a:z].tolist() for a, z in zip(ends, ends[1:])] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
        assert len(enc.table.key) <= 50 + 200


def test_packing(spark, docs, empty):
    seen, sequences = {}, {}
    for r in packing.pack(docs.where("doc_id is not null"), tokens.tokenizer_path(), length=64).collect():
        seen.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t, _ in ROWS[:-1]:
        want, at = np.array([*ids_of(t), 1], "<u4"), 0
        for r in sorted(seen[i], key=lambda r: r.start):
            assert r.start == at and r.ids == want[at : at + r.length].tobytes() and r.ids_crc32 == zlib.crc32(r.ids)
            at += r.length
        assert at == len(want)
    for k, pieces in sequences.items():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)])]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and (ends[-1] == 64 or k == max(sequences))
    assert packing.pack(empty, tokens.tokenizer_path()).count() == 0


def test_orc_round_trip(spark, docs):
    out = workspace(spark)
    orc_tokens.write_orc(docs, tokens.tokenizer_path(), f"{out}/ids", 3)
    got = {r.doc_id: r for r in orc_tokens.token_table(orc_tokens.read_orc(spark, f"{out}/ids"), f"{out}/index").collect()}
    at = 0
    for i, t, _ in ROWS:
        want = np.array([*ids_of(t), 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    assert orc_tokens.tokens_of(spark, f"{out}/ids", [4]).first().ids == [*ids_of(LONG), 0]


def test_fingerprints(spark, docs, empty):
    got = {r.doc_id: r for r in fingerprints.digests(docs, workspace(spark)).collect()}
    order = [t or "" for _, t, _ in ROWS]
    for (i, t, _), after in zip(ROWS, [*order[1:], order[0]]):
        t = t or ""
        change = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(change.encode()).hexdigest()
    assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1.0 and got[4].near_next == 0.0
    assert fingerprints.digests(empty, workspace(spark)).count() == 0


def test_jaccard(spark, docs, empty):
    got = {r.doc_id: r for r in jaccard.link_groups(docs, workspace(spark), 3, 90, 100, bits=12).collect()}
    assert got[1].component_id == 0 and got[5].component_id == 4 and got[7].component_id == 7
    assert got[2].n_shingles == 0 and got[2].component_id == 2 and got[None].component_id == 11
    assert jaccard.link_groups(empty, workspace(spark), 3, 90, 100, bits=12).count() == 0


def test_divide_skip_equals_all_pairs():
    base = [np.unique(np.random.default_rng(i).integers(0, 40, 30)) for i in range(60)]
    sets = sorted(base, key=len)
    up = list(range(len(sets)))
    find = lambda i: i if up[i] == i else find(up[i])
    for a in range(len(sets)):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 60 * (len(sets[a]) + len(sets[b]) - n):
                up[find(a)] = find(b)
    links = jaccard.divide_skip(sets, np.full(len(sets), 2), 60, 100)
    mine = jaccard._Forest(len(sets))
    for a, b in links:
        mine.up[mine.find(a)] = mine.find(b)
    assert len({find(i) for i in range(len(sets))}) == len({mine.find(i) for i in range(len(sets))})


def test_phrases(spark, docs, empty):
    got = {r.row.doc_id: r for r in phrases.removed(docs.select("doc_id", "text")).collect()}
    words, first = {i: WORDS.findall(t or "") for i, t, _ in ROWS}, {}
    for i in [r[0] for r in ROWS]:
        for j in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][j : j + 13]), i)
    for i, w in words.items():
        stay = [True] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] != i:
                stay[j : j + 13] = [False] * 13
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), stay.count(False), " ".join(x for x, y in zip(w, stay) if y))
    assert got[7].kept == "two"
    assert phrases.without_repeats(empty).count() == 0


def test_phrases_of_a_hot_anchor(spark):
    """However many documents share a passage, a task gathers `hot` rows of an anchor at most; the result is the same."""
    ends = [" ".join(f"{c}{random.randint(0, 3)}" for _ in range(15)) for c in "ab" for _ in range(6)]
    rows = [(i, f"{random.choice(ends)} {PASSAGE} {random.choice(ends)} {PASSAGE[:60]} {random.choice(ends)}") for i in range(120)]
    rows += [(None, f"z {PASSAGE}"), (None, f"y {PASSAGE}"), (3, rows[7][1]), (200, ends[0])]
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words, first = [t.split() for _, t in rows], {}
    ids = [phrases.LAST if i is None else i for i, _ in rows]
    for i, w in sorted(zip(ids, words), key=lambda x: x[0]):
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    want = []
    for i, w in zip(ids, words):
        stay = [True] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                stay[j : j + 13] = [False] * 13
        want.append((i, stay.count(False), " ".join(x for x, y in zip(w, stay) if y)))
    for hot in (5, 60, phrases.HOT):
        got = [(phrases.LAST if r.row.doc_id is None else r.row.doc_id, r.n_removed, r.kept) for r in phrases.removed(docs, hot).collect()]
        assert sorted(got) == sorted(want)
    keyed = docs.selectExpr("*", f"coalesce(doc_id, {phrases.LAST}) AS _id", "xxhash64(text) AS _key")
    squeezed = phrases.map_batches(keyed, lambda b: {"_id": b.column("_id"), "_key": b.column("_key"), "_z": [phrases.zstandard.compress(t.encode()) for t in b.column("text").to_pylist()]}, "_id long, _key long, _z binary")
    for hot in (5, 60):
        rows = phrases.dealt(keyed, squeezed, hot)
        assert (rows.where("n > 0 AND words IS NOT NULL").groupBy("h").count().agg({"count": "max"}).first()[0] or 0) <= hot
        assert rows.where("n = -1").count() > 0


def test_recurring_holds_few_pairs():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"h": np.full(10, 5), "id": np.arange(10) + 10 * k, "n": np.ones(10, np.int32)}) for k in range(20)]
    seen = 0

    def counted():
        nonlocal seen
        for b in batches:
            seen += 1
            yield b

    out = phrases._recurring(counted(), 25)
    head = next(out)
    assert seen == 3 and head.num_rows == 30 and all(head.column("hot").to_pylist())
    assert sum(b.num_rows for b in out) == 170


def test_language(spark, empty):
    de, en = "der die und nicht ein ist das mit", "the and that of with this from have"
    rows = [(i, " ".join(random.choices(t.split(), k=30)), lang, "s", None) for i in range(60) for t, lang in [((de, "de"), (en, "en"))[i % 2]]]
    train = spark.createDataFrame(rows, SCHEMA)
    model = language.fitted(train)
    mixed = spark.createDataFrame([(1, f"{de} {de} {de} {en} {en}"), (2, None), (3, "12 !?")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.label(mixed, model, spans=True).collect()}
    assert [s.lang for s in got[1].spans] == ["de", "en"] and got[1].lang_pred == "de" and 0.5 < got[1].score < 0.7
    assert got[2].lang_pred == got[3].lang_pred == "und"
    assert all(r.lang_pred == r.lang for r in language.label(train, model).collect())
    assert language.label(mixed, language.fitted(empty)).where("lang_pred <> 'und'").count() == 0


def test_language_stage(spark, empty):
    """Texts of three languages with no half stay, texts without letters go; without labels all with letters stay."""
    words = {"de": "schule wasser baum", "en": "walk light under", "fr": "mais vous dans"}
    rows = [(i, f"{words[k]} {words[k]}", k) for i in range(60) for k in [list(words)[i % 3]]]
    rows += [(100, "schule wasser baum wasser walk light under light walk mais vous dans vous", None), (101, "12 !?_", None), (102, None, "de"), (103, "", None), (104, "\u2167", None), (None, "qx zvj", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixed = language.label(docs.where("doc_id = 100"), language.fitted(docs)).first()
    assert mixed.score < 0.5 and mixed.lang_pred in words
    want = [*range(60), 100, 104, None]
    for d in (docs, docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")):
        assert sorted((r.doc_id for r in language.identified(d).collect()), key=lambda i: (i is None, i)) == want
    assert language.identified(empty).count() == 0


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there\nall"), (1, 1, "assistant", "> hello  THERE\nHi"), (1, 2, "user", "> > Hello there\n> Hi\nBye"), (1, 3, "user", "other"), (2, 0, "user", None)]
    got = {(r.conv_id, r.turn): r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), workspace(spark)).collect()}
    assert (got[1, 1].own, got[1, 1].reply_to, got[1, 1].thread) == ("Hi", 0, 0)
    assert (got[1, 2].own, got[1, 2].reply_to, got[1, 2].n_linked, got[1, 2].thread) == ("Bye", 1, 2, 0)
    assert got[1, 3].thread == 3 and got[2, 0].own == ""


def test_quotes_of_several_lines(spark):
    origin = "One a\ntwo b\nthree c\n\nP two\nwrapped\n\nP three"
    rows = [(1, 0, "user", origin), (1, 1, "user", "other"), (1, 2, "assistant", "> two b\n> Three  C\nA"), (1, 3, "user", "> P two wrapped\n>\n> P three\nB"), (1, 4, "user", "> one a\n> three c\nC"), (1, 5, "user", "> > two b\n> > three c\n> A\nD"), (2, 0, "user", "> two b\n> three c\nE")]
    linked = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), workspace(spark))
    got = {(r.conv_id, r.turn): r for r in quotes.chats(linked).collect()}
    assert [got[1, t].reply_to for t in range(6)] == [None, None, 0, 0, None, 2] and got[2, 0].reply_to is None
    assert got[1, 5].n_linked == 2 and got[1, 4].n_linked == 0
    assert [t for _, t in sorted((r.position, r.turn) for (c, _), r in got.items() if c == 1)] == [0, 2, 3, 5, 1, 4]
    assert got[1, 2].line == "assistant: A"


def test_sharding(spark, docs, empty):
    many = spark.range(500).selectExpr("id AS doc_id", "repeat('x', 100) AS text")
    out = workspace(spark)
    buckets = sharding.shard(many, out, limit=3000).collect()
    assert sum(b.documents for b in buckets) == 500 and all(b.bytes <= 3000 for b in buckets)
    sizes = sharding.read_shards(spark, out, "doc_id long, text string").groupBy("shard_id").count().collect()
    assert {r.shard_id: 100 * r["count"] for r in sizes} == {b.bucket: b.bytes for b in buckets}
    assert len(sharding.shard(empty.select("doc_id", "text"), workspace(spark)).collect()) == 0


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def grouped(sets, top, of):
    """Least number of each set's component, by all pairs."""
    up = list(range(len(sets)))
    find = lambda i: i if up[i] == i else find(up[i])
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and of * len(sets[a] & sets[b]) >= top * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return [find(i) for i in range(len(sets))]


def cut_repeats(texts):
    """What stays of texts in order of id, by a dictionary of all windows."""
    words, first, out = [WORDS.findall(t or "") for t in texts], {}, []
    for i, w in enumerate(words):
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for i, w in enumerate(words):
        stay = [True] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] != i:
                stay[j : j + 13] = [False] * 13
        out.append(texts[i] if all(stay) else " ".join(x for x, y in zip(w, stay) if y))
    return out


def corpus(n=90, seed=5):
    """Documents in two languages with copies, near copies and shared passages."""
    r = random.Random(seed)
    de, en = ([f"{a}{b}" for a in s.split() for b in e.split()] for s, e in (("der schul wass bau frei gross", "ung heit lich en keit schaft"), ("the walk light bright under play", "ing ness ed ly ful ment")))
    text = lambda k: " ".join(r.choices((de, en)[k], k=r.randint(30, 80)))
    passage, rows = text(1), []
    for i in range(n):
        k = i % 2
        t = text(k)
        if i > 20 and i % 7 == 0:
            t = rows[r.randint(0, 20)][1].replace(" ", "  ", 3)
        elif i > 20 and i % 5 == 0:
            w = rows[r.randint(0, 20)][1].split()
            w[r.randint(0, len(w) - 1)] = "changed"
            t = " ".join(w)
        elif i % 4 == 1:
            t = f"{t} {passage} {text(k)}"
        rows.append((i, t, ("de", "en")[k], "s", len(t)))
    return rows + [(n, None, "de", "s", None), (n + 1, "", None, "s", 0), (n + 2, "123 !", "en", "s", 5)]


def test_jaccard_equals_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    for k, top in ((3, 90), (5, 80)):
        got = {r.doc_id: r for r in jaccard.link_groups(docs, workspace(spark), k, top, 100, bits=12).collect()}
        sets = [shingle_set(t, k) for _, t, *_ in rows]
        assert [got[i].component_id for i in range(len(rows))] == grouped(sets, top, 100)
        assert [got[i].n_shingles for i in range(len(rows))] == [len(s) for s in sets]


def test_pipeline_equals_brute_force(spark):
    """Each stage on what the one before kept, with the documents as they come."""
    import corpus_pipeline as c

    docs = spark.createDataFrame(corpus(), SCHEMA)
    (_, language_id), (_, exact_stage), (_, near), (_, cut), (_, pack) = c.STAGES
    rows = sorted(map(tuple, language_id(spark, docs, "").collect()))
    assert [r[0] for r in rows] == list(range(90))  # with a language each; the other three have no letters
    kept = {}
    for r in rows:
        kept.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    docs = exact_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    rows = sorted(kept.values())
    assert sorted(map(tuple, docs.collect())) == rows
    component = grouped([shingle_set(r[1], 5) for r in rows], 80, 100)
    rows = [r for i, r in enumerate(rows) if component[i] == i]
    docs = near(spark, docs, "")
    assert sorted(map(tuple, docs.collect())) == rows
    texts = cut_repeats([r[1] for r in rows])
    assert texts != [r[1] for r in rows]
    rows = [(r[0], t, *r[2:4], len(t)) for r, t in zip(rows, texts)]
    docs = cut(spark, docs, "")
    assert sorted(map(tuple, docs.collect())) == rows
    pieces = sorted(map(tuple, pack(spark, docs, "").select("doc_id", "start", "length", "doc_tokens", "ids_crc32").collect()))
    want = [(i, np.array([*ids_of(t), 1], "<u4")) for i, t, *_ in rows]
    for i, ids in want:
        mine = [p for p in pieces if p[0] == i]
        assert [p[1] for p in mine] == [0, *np.cumsum([p[2] for p in mine])[:-1]] and sum(p[2] for p in mine) == mine[0][3] == len(ids)
        assert all(p[4] == zlib.crc32(ids[p[1] : p[1] + p[2]].tobytes()) for p in mine)
    assert {p[0] for p in pieces} == {i for i, _ in want}


#: Names that operators have for columns of their own.
CLASHES = ["_id", "_key", "id", "key", "row", "h", "k", "n", "kept", "marks", "n_words", "score", "lang_pred", "part", "shard_id", "bytes", "norm", "rid", "sid", "component", "z", "_z", "id_"]


def hostile(spark, rows):
    more = ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, *CLASHES) for r in rows], f"{SCHEMA}, {more}")


@pytest.mark.parametrize("stage", range(5))
@pytest.mark.parametrize("kind", ["filled", "empty"])
def test_stages_with_hostile_tables(spark, stage, kind):
    """Clashing names, null and repeated ids, repeated rows, a very long text, an empty table."""
    import corpus_pipeline as c

    long = " ".join(f"wort{i % 4001}" for i in range(40_000))
    rows = [(1, "the same text of eight words stands here", "en", "s", 40)] * 3 + [(1, "another text of the same id", "en", "s", 27), (None, "no id but a text", "en", None, None), (None, None, None, None, None), (7, long, "en", "s", len(long)), (8, long + " end", "en", "s", len(long) + 4), (9, "x" * 50_000, "en", "s", 50_000)]
    docs = hostile(spark, rows if kind == "filled" else [])
    name, apply = c.STAGES[stage]
    out = apply(spark, docs, "")
    got = out.collect()
    if name == "packing":
        assert sum(r.length for r in got) == sum(len(ids_of(r[1])) + 1 for r in rows if kind == "filled")
        return
    assert out.columns == docs.columns
    ids = sorted((r.doc_id for r in got), key=str)
    if kind == "empty":
        assert not got
    else:
        assert all(tuple(r)[5:] == tuple(CLASHES) for r in got)
        want = {"language_id": [1, 1, 1, 1, 7, 8, 9, None], "exact_dedup": [1, 1, 7, 8, 9, None, None], "near_dedup": [1, 1, 1, 1, 7, 9, None, None], "substring_dedup": [1, 1, 1, 1, 7, 8, 9, None, None]}
        assert ids == want[name]


@pytest.mark.parametrize("kind", ["filled", "empty"])
def test_operators_with_hostile_tables(spark, kind):
    long = " ".join(f"wort{i % 4001}" for i in range(40_000))
    rows = [(1, "a b c", "en", "s", 1)] * 2 + [(1, "other", None, None, None), (None, "a b c", "en", "s", 1), (None, None, None, None, None), (5, "", "de", "s", 0), (6, long, "en", "s", 1)]
    rows = rows if kind == "filled" else []
    docs, n, out = hostile(spark, rows), len(rows), workspace(spark)
    texts = sorted(t or "" for _, t, *_ in rows)
    assert fingerprints.digests(docs, f"{out}/1").count() == n
    groups = fingerprints.groups(docs, fingerprints.digests(docs, f"{out}/1b").select("doc_id", "fingerprint"), f"{out}/1c").collect()
    assert sorted((r.group_size, r.group_id) for r in groups) == ([(2, 5), (3, 1)] if n else [])
    encoded = bpe.encode(docs, tokens.tokenizer_path())
    assert sorted(r.text for r in bpe.decode(encoded, tokens.tokenizer_path()).collect()) == texts
    assert jaccard.link_groups(docs, f"{out}/4", 3, 90, 100, bits=12).count() == n
    orc_tokens.write_orc(docs, tokens.tokenizer_path(), f"{out}/ids", 2)
    table = orc_tokens.token_table(orc_tokens.read_orc(spark, f"{out}/ids"), f"{out}/index")
    assert sorted(r.n_tokens for r in table.collect()) == sorted(len(ids_of(t)) + 1 for t in texts)
    assert sorted(r.text or "" for r in phrases.removed(docs).collect()) == texts
    assert {r.sequence_id for r in packing.pack(docs, tokens.tokenizer_path()).collect()} == set(range(-(-sum(len(ids_of(t)) + 1 for t in texts) // packing.LENGTH)))
    buckets = sharding.shard(docs.select("doc_id", "text"), f"{out}/9", limit=50_000).collect()
    assert sum(b.documents for b in buckets) == n
    exacts = exact.exact_groups(docs, f"{out}/10").collect()
    assert sorted((r.group_size, r.kept) for r in exacts) == ([(1, True), (1, True), (2, False), (2, True), (3, False), (3, False), (3, True)] if n else [])
    assert language.label(docs.select("doc_id", "text"), language.fitted(docs)).count() == n
    chat = spark.createDataFrame([(1, 0, "u", "a"), (1, 0, "u", "a"), (None, 1, "u", "> a"), (1, None, None, "> a"), (1, 2, "u", None)][: 5 if n else 0], "conv_id long, turn long, role string, text string")
    assert quotes.chats(quotes.link(chat, f"{out}/5")).count() == (5 if n else 0)


def test_colliding_buckets_are_split(spark, monkeypatch):
    """Texts whose hashes are equal are told apart by their bytes."""
    monkeypatch.setattr(fingerprints, "fingerprint", lambda canon: "f" if canon[:1] == "a" else "g")
    docs = spark.createDataFrame([(1, "a x"), (2, "a  X"), (3, "a y"), (4, "b"), (5, "b ")], "doc_id long, text string")
    prints = spark.createDataFrame([(i, "f" if i < 4 else "g") for i in range(1, 6)], "doc_id long, fingerprint string")
    got = {(r.fingerprint, r.group_id, r.group_size, r.member) for r in fingerprints.groups(docs, prints, workspace(spark)).collect()}
    assert got == {("f", 1, 2, 1), ("f", 1, 2, 2), ("f", 3, 1, 3), ("g", 4, 2, None)}


def test_sharding_equals_a_directory_by_hand(spark):
    rows = [(i, "x" * (i * 37 % 400)) for i in range(400)] + [(5, "y")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = [(r.h, r.bytes) for r in sharding.hashed(docs).collect()]

    def split(part, depth):
        if sum(b for _, b in part) > 2000 and len({h for h, _ in part}) > 1:
            bit = sharding.BITS - depth - 1
            return [x for side in (0, 1) for x in split([p for p in part if p[0] >> bit & 1 == side], depth + 1)]
        return [(depth, sum(b for _, b in part), len(part))] if part else []

    got = sharding.shard(docs, workspace(spark), limit=2000).collect()
    assert sorted((r.depth, r.bytes, r.documents) for r in got) == sorted(split(keyed, 0))


def test_sharding_beyond_a_broadcast(spark, monkeypatch):
    """With more buckets than may be broadcast the same documents come to the same shards, repeated rows included."""
    rows = [(i, "x" * (i * 37 % 400)) for i in range(300)] + [(5, "y")] * 3 + [(None, "z" * 50), (None, None)]
    docs, got = spark.createDataFrame(rows, "doc_id long, text string"), []
    for most in (sharding.BROADCAST_ROWS, 0):
        monkeypatch.setattr(sharding, "BROADCAST_ROWS", most)
        out = workspace(spark)
        sharding.shard(docs, out, limit=2000)
        got.append(sorted(map(str, sharding.read_shards(spark, out, "doc_id long, text string").collect())))
    assert got[0] == got[1] and len(got[0]) == len(rows)


def test_pipeline(spark, docs):
    import corpus_pipeline as c

    kept = docs.where("doc_id is not null")
    for name, stage in c.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert 1 not in rows and 2 not in rows and 8 not in rows and 5 not in rows and rows[7] == "two"
    assert {r.doc_id for r in c.STAGES[-1][1](spark, kept, "").collect()} == set(rows)


def test_located_equals_brute_force():
    """Passages of mixed, shared and repeated windows, whose anchors several ids have."""
    r = random.Random(11)
    for _ in range(60):
        base = [r.choice("abc") + str(r.randint(0, 2)) for _ in range(60)]
        rows = []
        for i in range(r.randint(2, 12)):
            for _ in range(r.randint(1, 3)):
                n, a = r.randint(1, 9), r.randint(0, 12)
                w = base[a : a + n + 12]
                if r.random() < 0.3:
                    w[r.randint(0, len(w) - 1)] = "z"
                rows.append((1, i, 5, a, n, " ".join(w).encode()))
        first = {}
        for _, i, _, _, n, w in rows:
            for j in range(n):
                first.setdefault(tuple(w.split()[j : j + 13]), i)
        want = sorted({(i, key, a + j) for _, i, key, a, n, w in rows for j in range(n) if first[tuple(w.split()[j : j + 13])] < i})
        got = sorted({(i, key, a + j) for i, key, a, n in phrases._located(rows) for j in range(n)})
        assert got == want
