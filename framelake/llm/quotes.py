"""Chat formatting by quotation linking.

A line's quote level is the number of ``>`` at its start (spaces between them allowed). A run of lines of one level
is a passage. Quoted passages and the units of a message's own text (the whole of it, its paragraphs, its lines)
are normalised (NFKC, case and white space folded) and hashed; so are the runs of consecutive lines and paragraphs
that are as long as a passage quoted in the conversation. A quoted passage is linked to the latest earlier turn of its
conversation that has such a unit or run. A message answers the latest origin of its level-1 passages, or of
deeper ones if those have none. Messages ordered by (thread, turn), the thread being the turn at the root of the
replies, make reply-ordered conversations: what is answered stands before its answer, and threads stay together.

Passages and units of one hash and conversation meet in one sorted window, without pairs; threads are found by
pointer doubling. A very long conversation is spread by hash for all that; only for the positions of its messages in the
reply order it is sorted in one task, which spills.

Null text is empty; a null conv_id or turn is an own conversation or turn that nothing links to. Rows with the same
conv_id and turn are kept each and share their links. Columns other than conv_id, turn, role and text are left out. Of a very long
message a run of lines is hashed at a time. An empty table gives no row.
"""

from __future__ import annotations

import re
import unicodedata

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, saved, small, workspace

_LEVEL = re.compile(r"((?:>[ \t]?)*)(.*)", re.S)
MESSAGE = "conv_id long, turn long, role string, own string, units array<long>, quotes array<struct<level:int,h:long,lines:int,paragraphs:int>>"


def normal(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its quoted passages with their levels, in order."""
    own, quoted, last = [], [], 0
    for line in text.split("\n"):
        mark, rest = _LEVEL.match(line).groups()
        level = mark.count(">")
        if not level:
            own.append(rest)
        elif level == last:
            quoted[-1][1].append(rest)
        else:
            quoted.append((level, [rest]))
        last = level
    return "\n".join(own).strip(), [(n, "\n".join(x)) for n, x in quoted]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def _paragraphs(text: str) -> list[str]:
    return [x for p in re.split(r"\n\s*\n", text) if (x := normal(p))]


def _lines(text: str) -> list[str]:
    return [x for line in text.split("\n") if (x := normal(line))]


def messages(conversations: DataFrame) -> DataFrame:
    def run(b):
        out = []
        for t in b.column("text").to_pylist():
            own, quoted = parse(t or "")
            units = {normal(own), *_paragraphs(own), *_lines(own)} - {""}
            quotes = [{"level": n, "h": _hash(q), "lines": len(_lines(x)), "paragraphs": len(_paragraphs(x))} for n, x in quoted if (q := normal(x))]
            out.append((own, [_hash(u) for u in sorted(units)], quotes))
        return {c: b.column(c) for c in ("conv_id", "turn", "role")} | {n: [r[k] for r in out] for k, n in enumerate(("own", "units", "quotes"))}

    return map_batches(conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), "text"), run, MESSAGE)


def _runs(rows: DataFrame) -> DataFrame:
    """conv_id, turn, h of each run of consecutive lines or paragraphs of a message, of the lengths that passages quoted in
    its conversation have."""
    q = rows.where("conv_id is not null").select("conv_id", F.explode("quotes").alias("q"))
    sizes = q.groupBy("conv_id").agg(*(F.collect_set(F.when(F.col(f"q.{n}") > 1, F.col(f"q.{n}"))).alias(n) for n in ("lines", "paragraphs")))
    sizes = sizes.where(F.size("lines") + F.size("paragraphs") > 0)
    asked = rows.select("conv_id", "turn", "own").join(small(sizes, sizes.count()), "conv_id")

    def run(b):
        conv, turn, out = [], [], []
        for c, t, own, *sizes in zip(*(b.column(n).to_pylist() for n in ("conv_id", "turn", "own", "lines", "paragraphs"))):
            # One run's text at a time: only hashes are kept.
            found = {_hash(" ".join(x[i : i + n])) for x, many in zip((_lines(own), _paragraphs(own)), sizes) for n in many for i in range(len(x) - n + 1)}
            conv += [c] * len(found)
            turn += [t] * len(found)
            out += found
        return {"conv_id": conv, "turn": turn, "h": out}

    return map_batches(asked, run, "conv_id long, turn long, h long")


def link(conversations: DataFrame, path: str) -> DataFrame:
    """conv_id, turn, role, own (text without quotes), n_quotes, n_linked, reply_to, thread of each message."""
    rows = saved(messages(conversations), f"{path}/messages")
    units = rows.select("conv_id", "turn", F.explode("units").alias("h")).unionByName(_runs(rows)).distinct().select("*", F.col("turn").alias("origin"), F.lit(None).cast("int").alias("level"))
    asked = rows.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", F.col("q.h").alias("h"), F.lit(None).cast("long").alias("origin"), F.col("q.level").alias("level")).distinct()
    units = units.join(asked.select("h").distinct(), "h", "left_semi").select(asked.columns)
    earlier = Window.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = units.unionByName(asked).withColumn("origin", F.max("origin").over(earlier)).where("level is not null")
    # Level 1 first; a deeper passage counts where no level-1 passage has an origin.
    reply = found.groupBy("conv_id", "turn").agg(F.count("origin").alias("n_linked"), F.coalesce(F.max(F.when(F.col("level") == 1, F.col("origin"))), F.max("origin")).alias("reply_to"))
    reply = saved(reply.where("conv_id is not null and turn is not null"), f"{path}/replies")
    threads = saved(_threads(reply.where("reply_to is not null").select("conv_id", "turn", "reply_to"), path), f"{path}/threads")
    out = rows.join(reply, ["conv_id", "turn"], "left").join(threads, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "own", F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("int").alias("n_linked"), "reply_to", F.coalesce("thread", "turn").alias("thread"))


def _threads(replies: DataFrame, path: str) -> DataFrame:
    """conv_id, turn and thread of each reply: the ancestor's ancestor, until none has one."""
    now, k = replies.withColumnRenamed("reply_to", "thread"), 0
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"))
        step = saved(now.join(up, ["conv_id", "thread"], "left").select("conv_id", "turn", "thread", "above"), f"{path}/step-{k}")
        now = step.select("conv_id", "turn", F.coalesce("above", "thread").alias("thread"))
        if step.where("above is not null").isEmpty():
            return now
        k += 1


def chats(linked: DataFrame) -> DataFrame:
    """linked with position, that of the message in the reply order of its conversation from 1 on, and line: the role, then
    the text without quotes. A conversation is sorted, which spills, and numbered row by row. A null conv_id or turn is on
    its own: position 1, or behind the others."""
    order = Window.partitionBy("conv_id").orderBy(F.col("thread").asc_nulls_last(), F.col("turn").asc_nulls_last(), "role", "own")
    told = linked.where("conv_id is not null").withColumn("position", F.row_number().over(order).cast("long"))
    out = told.unionByName(linked.where("conv_id is null").withColumn("position", F.lit(1).cast("long")))  # in no window, however many they are
    return out.withColumn("line", F.concat_ws(": ", "role", "own"))


def op5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link(spark.read.parquet(f"{sf_dir}/conversations.parquet"), workspace(spark))
    return chats(linked).select("conv_id", "turn", "role", "n_quotes", "n_linked", "reply_to", "thread", "position", F.sha2("own", 256).alias("own_sha256"))
