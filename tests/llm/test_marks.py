"""Marks by a table of bits, and the operators that use them on both sides of what a join may broadcast."""

import random
from collections import Counter

import pytest

from framelake.llm import common, exact, fingerprints, jaccard, language, quotes, sharding
from framelake.llm.common import marked, with_or_without, workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_marks_leave_no_key_out(spark, monkeypatch):
    keys = spark.range(0, 60_000, 3).selectExpr("xxhash64(id) AS h")
    rows = spark.range(60_000).selectExpr("id", "xxhash64(id) AS h")
    for bits, most in ((30, 4_000), (14, 40_000)):
        monkeypatch.setattr(common, "MARK_BITS", bits)
        got = {r.id: r._marked for r in marked(rows, "h", keys, "h", 20_000).collect()}
        assert all(got[i] for i in range(0, 60_000, 3)) and sum(got.values()) - 20_000 <= most
    assert marked(rows, "h", keys.limit(0), "h", 0).where("_marked").count() == 0 and marked(rows.limit(0), "h", keys, "h", 1).count() == 0


@pytest.mark.parametrize("bound", [0, 10**6])
def test_rows_with_and_without_keys(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
    rows = spark.createDataFrame([(None, 1), (1, 1), (1, 2), (2, 1), (2, 1)], "id long, k long")
    keys = spark.createDataFrame([(None, 1), (2, 1), (9, 9)], "doc_id long, h long")
    got = {kind: sorted(map(str, map(tuple, with_or_without(rows, keys, 3, {"id": "doc_id", "k": "h"}, "k", kind).collect()))) for kind in ("left_semi", "left_anti")}
    assert got == {"left_semi": ["(2, 1)", "(2, 1)", "(None, 1)"], "left_anti": ["(1, 1)", "(1, 2)"]}


def corpus():
    """Exact copies, near copies, repeated rows, rows without ids, and others."""
    r, out = random.Random(12), []
    for i in range(60):
        words = [f"w{r.randint(0, 5000)}" for _ in range(60)]
        out.append((i, " ".join(words), "en", "s", None))
        if i % 3 == 0:
            out += [(100 + i + 300 * j, "  ".join(words), "en", None, 1) for j in range(1 + i % 4)]
        if i % 5 == 0:
            words[30] = "other"
            out.append((1500 + i, " ".join(words), None, "t", 2))
    return out + out[:4] + [(None, out[0][1], "en", "s", 0), (None, None, None, None, None), (7000, "", "x", "y", 0), (7001, "Ａ b", "x", "y", 0), (7002, "a B", "x", "y", 0)]


def test_operators_beyond_a_broadcast(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    runs = {
        "op10": lambda: exact.op10_exact_dedup(spark, str(tmp_path)),
        "op1": lambda: fingerprints.op1_fingerprints(spark, str(tmp_path)),
        "op4": lambda: jaccard.op4_jaccard_join(spark, str(tmp_path)),
        "exact_dedup": lambda: exact.exact_dedup(docs),
        "near_dedup": lambda: jaccard.one_of_each(docs),
    }
    both = []
    for bound in (10**6, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
        both.append({n: Counter(map(str, map(tuple, f().collect()))) for n, f in runs.items()})
    assert both[0] == both[1]
    assert sum(both[0]["exact_dedup"].values()) < docs.count() and sum(both[0]["near_dedup"].values()) < docs.count()


def test_only_marked_texts_are_shuffled_to_be_compared(spark, monkeypatch):
    """Between the scan and the exchange of whole texts stands the filter, and no join shuffles them."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    plans = []
    monkeypatch.setattr(exact, "saved", lambda df, path, save=exact.saved: plans.append((path, df._jdf.queryExecution().executedPlan().toString())) or save(df, path))
    exact.exact_groups(spark.createDataFrame(corpus(), SCHEMA), workspace(spark)).count()
    (plan,) = [p for path, p in plans if path.endswith("verified")]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "getbit" in plan


def test_documents_without_a_language_get_theirs(spark):
    words = {"de": "schule wasser baum", "en": "walk light under", "fr": "mais vous dans"}
    rows = [(i, f"{words[k]} {words[k]}", k) for i in range(60) for k in [list(words)[i % 3]]]
    rows += [(100 + i, f"{words[k]} 12 {words[k]} {other}", None) for i, (k, other) in enumerate((("de", "walk"), ("en", "vous"), ("fr", "")))]
    rows += [(200, words["de"], "en"), (201, "12", None)]
    got = {r.doc_id: r.lang for r in language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {i: k for i, _, k in rows if k} | {100: "de", 101: "en", 102: "fr"}


def test_shards_of_documents_with_the_same_names(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('x', 50) AS text", "'mine' AS h", "id AS bytes", "concat('s', id) AS shard_id", "1 AS row")
    out = workspace(spark)
    buckets = sharding.shard(docs, out, limit=2000)
    got = sharding.read_shards(spark, out, "doc_id long, text string, h string, bytes long, shard_id string, row int")
    assert got.columns[-1] == "shard_id_" and sorted(map(tuple, got.drop("shard_id_").collect())) == sorted(map(tuple, docs.collect()))
    sizes = {r["shard_id_"]: 50 * r["count"] for r in got.groupBy("shard_id_").count().collect()}
    assert sizes == {b.bucket: b.bytes for b in buckets.collect()} and len(sizes) > 5


def brute_links(rows):
    """Every quoted passage against every earlier turn of its conversation: all its text, its paragraphs and lines, and their
    runs."""
    out = []
    for conv, turn, _, text in rows:
        own, quoted = quotes.parse(text or "")
        hits = []
        for level, passage in quoted:
            want, at = quotes.normal(passage), None
            for conv2, turn2, _, text2 in rows:
                if conv is None or conv2 != conv or turn is None or turn2 is None or turn2 >= turn or not want:
                    continue
                whole = quotes.parse(text2 or "")[0]
                parts = [quotes._lines(whole), quotes._paragraphs(whole)]
                runs = {quotes.normal(whole)} | {" ".join(p[i:j]) for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
                sizes = [len(quotes._lines(passage)), len(quotes._paragraphs(passage))]
                allowed = {quotes.normal(whole)} | {x for p in parts for x in p} | {" ".join(p[i : i + n]) for p, n in zip(parts, sizes) for i in range(len(p) - n + 1)}
                if want in runs & allowed:
                    at = max(at or 0, turn2)
            hits.append((level, want, at))
        hits = {h for h in hits if h[1]}
        first = [at for level, _, at in hits if level == 1 and at is not None]
        deep = [at for _, _, at in hits if at is not None]
        out.append((conv, turn, own, sum(quotes.normal(q) != "" for _, q in quoted), len(deep), max(first or deep, default=None)))
    return sorted(out, key=str)


def test_links_of_generated_quotes(spark):
    r, rows = random.Random(9), []
    for conv in range(12):
        texts = []
        for turn in range(9):
            lines = [f"Line {r.randint(0, 30)} of  {r.choice('abc')}" if r.random() < 0.85 else "" for _ in range(r.randint(1, 7))]
            if texts and r.random() < 0.8:
                source = r.choice(texts).split("\n")
                a = r.randint(0, len(source) - 1)
                mark = r.choice(["> ", ">", "> > "])
                lines = [mark + x.upper() for x in source[a : a + r.randint(1, 4)]] + lines
            texts.append("\n".join(lines))
            rows.append((conv if conv else None, turn, "user", texts[-1]))
    rows += [(1, None, "user", "> x"), (1, 3, "user", rows[12][3]), (2, 20, None, None), (2, 21, "a", "")]
    chat = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    linked = quotes.link(chat, workspace(spark))
    got = sorted(((x.conv_id, x.turn, x.own, x.n_quotes, x.n_linked, x.reply_to) for x in linked.collect()), key=str)
    assert got == brute_links(rows) and sum(x[5] is not None for x in got) > 30
    assert {x.position for x in quotes.chats(linked).where("conv_id is null").collect()} == {1}


def test_a_long_message_in_a_conversation_of_long_quotes(spark):
    lines = [f"line {i} of a long message" for i in range(3000)]
    rows = [(1, 0, "user", "\n".join(lines)), (1, 1, "user", "\n".join("> " + x for x in lines[500:2000]) + "\nyes"), (1, 2, "user", "\n".join("> " + x for x in lines[1:4]))]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), workspace(spark)).collect()
    assert {x.turn: x.reply_to for x in got} == {0: None, 1: 0, 2: 0}
