"""Trace tables derived from the star schema's tables, with times in microseconds since the start of 2024."""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import bounded

EPOCH_US = 1_704_067_200_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t_us = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)
    return e.select((F.col("user_id") / 10).cast("long").alias("trace_id"), F.col("user_id").alias("thread_id"), F.col("event_id").alias("seq"), t_us.alias("t_us"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("spec_id"))


def scope_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type <> 'signup'")
    return e.select("trace_id", "thread_id", "seq", "t_us", F.col("event_type").isin("click", "view").alias("is_begin"), "spec_id")


def frame_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type IN ('signup', 'error')")
    return e.select("trace_id", F.lit("Game").alias("frame_type"), "seq", "t_us", (F.col("event_type") == "signup").alias("is_begin"))


def timer_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of part; every fifth id has no spec."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("seq"), F.floor(F.col("p_partkey") * 5 / 4).cast("long").alias("spec_id"), F.col("p_brand").alias("name"), F.col("p_type").alias("source_file"), F.col("p_size").cast("long").alias("source_line"))


def trace_timer_specs(spark: SparkSession, sf_dir: str, each: int = 100) -> DataFrame:
    """All of part, so many specs to a trace."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    return p.select(F.floor(k / each).cast("long").alias("trace_id"), k.alias("seq"), (k % each).cast("long").alias("spec_id"), F.col("p_brand").alias("name"), F.col("p_type").alias("source_file"), F.col("p_size").cast("long").alias("source_line"))


def thread_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    group = F.create_map(*map(F.lit, ("BUILDING", "Render", "AUTOMOBILE", "ThreadPool", "MACHINERY", "TaskGraphHigh", "HOUSEHOLD", "TaskGraphNormal")))[F.col("c_mktsegment")]
    name = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("Thread"), F.pmod("o_orderkey", F.lit(97))))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("thread_id"), name.alias("name"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.coalesce(group, F.col("c_mktsegment")).alias("group_name"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), F.col("text").alias("payload"))


_LOG = "trace_id, thread_id, seq, logger, event_name, scope_phase, ts_seconds, cycle, seconds_per_cycle, fields, binary_fields, attachment".split(", ")


def _log(rows: DataFrame, **columns) -> DataFrame:
    """rows with the columns of an event log: those given, and empty ones."""
    none = {"scope_phase": F.lit("None"), "ts_seconds": F.lit(0.0), "cycle": F.lit(None).cast("long"), "seconds_per_cycle": F.lit(1e-6), "fields": F.create_map().cast("map<string,string>"), "binary_fields": F.create_map().cast("map<string,binary>"), "attachment": F.lit(None).cast("binary")}
    out = rows.withColumns(none | columns)
    return out.select(F.col("trace_id").cast("string"), *_LOG[1:])


def _varint(v: int) -> bytes:
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes(out) + bytes([v])


def batches(events: DataFrame, version: int, size: int = 32) -> DataFrame:
    """Begins and ends of each thread as a log of batches of so many records; a batch comes with its last record."""
    order = Window.partitionBy("trace_id", "thread_id").orderBy("seq")
    rows = events.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size))
    rows = bounded(rows).groupBy("trace_id", "thread_id", "batch").agg(F.max("seq").alias("seq"), F.sort_array(F.collect_list(F.struct("seq", "t_us", "is_begin", "spec_id"))).alias("records"))

    @F.pandas_udf("binary")
    def encode(lists: pd.Series) -> pd.Series:
        def one(records):
            out, last = b"", 0
            for r in records:
                t, begin = int(r["t_us"]), bool(r["is_begin"])
                out += _varint((t - last if t - last < last else t) << (1 if version == 1 else 2) | begin) + (_varint(int(r["spec_id"]) << (version == 3)) if begin else b"")
                last = t
            return out

        return lists.map(one)

    return _log(rows, logger=F.lit("CpuProfiler"), event_name=F.lit("EventBatch" + ("" if version == 1 else f"V{version}")), cycle=F.col("records")[0]["t_us"], attachment=encode("records"))


def logged_scopes(events: DataFrame) -> DataFrame:
    """Begins and ends as events of a log, with their spec as type."""
    return _log(events, logger=F.lit("Cpu"), event_name=F.lit("Scope"), scope_phase=F.when(F.col("is_begin"), "Enter").otherwise("Leave"), ts_seconds=F.col("t_us") / 1e6, cycle=F.col("t_us"), fields=F.create_map(F.lit("TypeId"), F.col("spec_id").cast("string")))


def frame_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup and error as begins and ends of frames: of the type by a field, by none, or by the event's name; the time is the
    event's own or that of its cycle."""
    e = _events(spark, sf_dir).where("event_type IN ('signup', 'error')")
    begin, k = F.when(F.col("event_type") == "signup", "Begin").otherwise("End"), F.col("spec_id")
    name = F.concat(begin, F.when(k % 3 == 2, "RenderFrame").otherwise("Frame"))
    own = k % 2 == 0
    field = F.create_map(F.lit("FrameType"), F.when(k % 3 == 0, F.lit("1")), F.lit("Cycle"), F.when(~own, F.col("t_us").cast("string")))
    return _log(e, logger=F.lit("Misc"), event_name=name, ts_seconds=F.when(own, F.col("t_us") / 1e6).otherwise(0.0), fields=field)


def thread_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as group scopes (begun, ended) and created threads of seven threads a trace."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.when(F.col("o_orderstatus") == "F", "BeginThreadGroupScope").when(F.col("o_orderstatus") == "P", "EndThreadGroupScope").otherwise("CreateThread")
    rows = o.select(F.floor(F.col("o_custkey") / 100).alias("trace_id"), (F.col("o_custkey") % 7).alias("thread_id"), F.col("o_orderkey").alias("seq"), "o_custkey", "o_orderpriority", name.alias("event_name"))
    field = F.when(F.col("event_name") == "BeginThreadGroupScope", F.create_map(F.lit("GroupName"), F.col("o_orderpriority"))).when(F.col("event_name") == "CreateThread", F.create_map(F.lit("CreatedThreadId"), F.col("o_custkey").cast("string"), F.lit("Priority"), F.substring("o_orderpriority", 1, 1))).otherwise(F.create_map().cast("map<string,string>"))
    return _log(rows, logger=F.lit("Misc"), fields=field)


def metadata_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as metadata instances of traces of a hundred conversations, with a spec each."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.floor(F.col("conv_id") / 100).cast("long").alias("trace_id"), (F.col("conv_id") % 100).cast("long").alias("id"), F.col("turn").cast("long").alias("seq"), F.col("text").alias("payload"), ((F.col("conv_id") + F.col("turn")) % 100).cast("long").alias("spec_id"))


def metadata_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.floor(F.col("p_partkey") / 100).cast("long").alias("trace_id"), F.col("p_partkey").alias("seq"), F.col("p_type").alias("format"), F.array("p_brand").alias("field_names"))


def discarded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events in batches, even ones as logged scopes, of which every thirteenth is far ahead: the next one goes back, and
    the thread does without logged scopes from there on."""
    e = scope_events(spark, sf_dir)
    own = e.where("seq % 2 = 0").withColumn("t_us", F.col("t_us") + F.when(F.col("seq") % 13 == 0, F.lit(10**12)).otherwise(0))
    return batches(e.where("seq % 2 = 1"), 2).unionByName(logged_scopes(own))


def clamped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope events whose times go back by up to four days."""
    return scope_events(spark, sf_dir).withColumn("t_us", F.col("t_us") - F.col("seq") % 5 * F.lit(86_400_000_000))


def cycle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup and error as frame events of which some have their time, and the others, in an attachment, the cycles since the
    last one of the same kind that has one."""
    e = _events(spark, sf_dir).where("event_type IN ('signup', 'error')")
    begin, k = F.when(F.col("event_type") == "signup", "Begin").otherwise("End"), F.col("spec_id")
    e = e.withColumns({"event_name": F.concat(begin, F.when(k % 3 == 2, "RenderFrame").otherwise("Frame")), "_own": k % 2 == 0, "_kind": k % 3 == 2})
    last = F.lag("t_us", 1, 0).over(Window.partitionBy("trace_id", "_own", "_kind").orderBy("seq"))
    e = e.withColumn("_delta", F.when(~F.col("_own"), F.col("t_us") - last))
    encode = F.pandas_udf(lambda v: v.map(lambda x: None if pd.isna(x) else _varint(int(x))), "binary")
    return _log(e, logger=F.lit("Misc"), ts_seconds=F.when(F.col("_own"), F.col("t_us") / 1e6).otherwise(0.0), attachment=encode("_delta"))


def redefined_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of part, a hundred to a trace, as events of forty specs each: definitions by name, definitions of a spec's own, and
    uses, some without a file."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    rule = F.when(k % 7 == 0, "unique").when(k % 7 == 3, "use").otherwise("merged")
    named = rule != "use"
    return p.select(F.floor(k / 100).cast("long").alias("trace_id"), k.alias("seq"), rule.alias("rule"), (k % 100 % 40).cast("long").alias("spec_id"), F.when(named, F.col("p_brand")).alias("name"), F.when(named & (k % 5 != 0), F.col("p_type")).alias("source_file"), F.when(named, F.col("p_size").cast("long")).otherwise(0).alias("source_line"))


def _packet(thread: int, body: bytes, squeezed: bool = False, trailed: bool = False) -> bytes:
    flags = thread | (0x8000 if squeezed else 0) | (0x4000 if trailed else 0)
    z = struct.pack("<H", len(body)) + pa.compress(body, codec="lz4_raw", asbytes=True) if squeezed else body
    return struct.pack("<HH", 4 + len(z), flags) + z + bytes(8 if trailed else 0)


def _head(port: int, guid: bytes) -> bytes:
    tags = struct.pack("<HH", 2, port) + struct.pack("<H", 16 | 2 << 8) + guid
    return struct.pack("<IH", 0x54524332, len(tags)) + tags + bytes([4, 7])


def capture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as captures: a text is the packets of a thread, of 20,000 bytes each, some compressed and some with a
    trailer."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text <> ''")
    rows = bounded(c).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("text").cast("binary").alias("text")))).alias("turns"))

    @F.pandas_udf("binary")
    def write(conv: pd.Series, guid: pd.Series, turns: pd.Series) -> pd.Series:
        def one(i, g, rows):
            parts = ((int(r["turn"]), r["text"][a : a + 20_000]) for r in rows for a in range(0, len(r["text"]), 20_000))
            return _head(i % 65536, bytes(g)) + b"".join(_packet(t + 2, bytes(x), t % 3 == 0, t % 5 == 0) for t, x in parts)

        return pd.Series([one(int(i), g, r) for i, g, r in zip(conv, guid, turns)])

    guid = F.unhex(F.md5(F.col("conv_id").cast("string")))
    return rows.select(F.col("conv_id").cast("string").alias("trace_id"), write("conv_id", guid, "turns").alias("content"))


#: Event types of events.parquet, and what they are in capture_logs: uid, flags, logger, name and fields (name, offset, size, kind).
CAPTURED = {
    "click": (21, 4, "Stat", "Click", (("Id", 0, 8, 3), ("K", 8, 2, 1))),
    "view": (22, 6, "Cpu", "View", (("Id", 0, 8, 3), ("Text", 0, 0, 0x88))),
    "signup": (23, 4, "$Trace", "ThreadTiming", (("BaseTimestamp", 0, 8, 3), ("Id", 8, 8, 3))),
    "error": (24, 0, "Misc", "BeginFrame", (("Cycle", 0, 8, 3), ("Id", 8, 8, 3))),
}


def _definition(uid: int, flags: int, logger: str, name: str, fields: tuple) -> bytes:
    body = struct.pack("<HBBBB", uid, len(fields), flags, len(logger), len(name)) + b"".join(struct.pack("<BBHHBB", 0, 0, at, n, kind, len(f)) for f, at, n, kind in fields)
    body += (logger + name + "".join(f for f, *_ in fields)).encode()
    return struct.pack("<HH", 0, len(body)) + body


def _captured(kind: str, i: int, t: int, k: int) -> bytes:
    """An event's bytes: a click, the begin of a scope (from the thread's base time, with a text), the base time, a frame of
    its own cycle, or the end of a scope (stamped)."""
    if kind == "purchase":
        return struct.pack("<Q", t << 8 | 7 << 1)
    head = struct.pack("<H", CAPTURED[kind][0] << 1 | 1)
    if kind == "click":
        return head + struct.pack("<QH", i, k)
    if kind == "view":
        text = f"text {i}".encode()
        return struct.pack("<Q", 17 << 8 | 8 << 1) + head + struct.pack("<Q", i) + struct.pack("<I", len(text) << 13 | 1 << 8 | 1) + text + b"\x03"
    return head + (b"" if kind == "signup" else bytes(3)) + struct.pack("<QQ", t, i)


def capture_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as captures: a trace's definitions and clock, then a packet for each event of its ten threads."""
    e = _events(spark, sf_dir)
    rows = bounded(e).groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("seq", "thread_id", "event_type", "t_us", "spec_id"))).alias("events"))

    @F.arrow_udf("binary")  # a trace's events become Python's one trace at a time
    def write(trace: pa.Array, events: pa.Array) -> pa.Array:
        def one(i, rows):
            clock = (10, 1, "$Trace", "NewTrace", (("StartCycle", 0, 8, 3), ("CycleFrequency", 8, 8, 3)))
            shared = _packet(0, _definition(*clock) + struct.pack("<HHQQ", 10, 16, 100 + i, 1_000_000)) + _packet(1, b"".join(_definition(*d) for d in CAPTURED.values()), True)
            return _head(i % 65536, bytes(16)) + shared + b"".join(_packet(2 + int(r["thread_id"]) % 10, _captured(r["event_type"], int(r["seq"]), int(r["t_us"]), int(r["spec_id"]))) for r in rows)

        return pa.array((one(i.as_py(), r.as_py()) for i, r in zip(trace, events)), pa.binary())

    return rows.select(F.col("trace_id").cast("string"), write("trace_id", "events").alias("content"))


def definition_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as captures of a hundred event definitions each."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = bounded(p).groupBy(F.floor(F.col("p_partkey") / 100).alias("trace")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_brand", "p_type", "p_size"))).alias("parts"))

    @F.arrow_udf("binary")
    def write(parts: pa.Array) -> pa.Array:
        def one(rows):
            return _head(1, bytes(16)) + b"".join(_packet(int(r["p_partkey"]) % 2, _definition(20 + int(r["p_partkey"]) % 70, 4, r["p_brand"], r["p_type"], tuple((f"f{j}", 4 * j, 4, 2) for j in range(int(r["p_size"]) % 9)))) for r in rows)

        return pa.array((one(r.as_py()) for r in parts), pa.binary())

    return rows.select(F.col("trace").cast("string").alias("trace_id"), write("parts").alias("content"))


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of capture_logs as a decoder leaves them, with threads by user."""
    e = _events(spark, sf_dir).where("event_type <> 'purchase'")
    kind, text = F.col("event_type"), lambda c: F.col(c).cast("string")
    fields = F.when(kind == "signup", F.create_map(F.lit("BaseTimestamp"), text("t_us"), F.lit("Id"), text("seq"))).when(kind == "error", F.create_map(F.lit("Cycle"), text("t_us"), F.lit("Id"), text("seq"))).otherwise(F.create_map(F.lit("Id"), text("seq")))
    named = lambda k: F.create_map(*(F.lit(x) for n, d in CAPTURED.items() for x in (n, d[k])))[kind]
    rows = e.select(F.col("trace_id").cast("string"), (F.col("seq") + 1).alias("seq"), (F.col("thread_id") % 10 + 2).cast("int").alias("thread_id"), named(2).alias("logger"), named(3).alias("event_name"), F.when(kind == "view", "Enter").otherwise("None").alias("scope_phase"), F.when(kind == "view", F.lit(17).cast("long")).alias("stamp"), (kind == "view").alias("from_base"), (named(1).bitwiseAND(4) > 0).alias("unsynced"), fields.alias("fields"))
    clock = e.select("trace_id").distinct().select(F.col("trace_id").cast("string"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("thread_id"), F.lit("$Trace").alias("logger"), F.lit("NewTrace").alias("event_name"), F.lit("None").alias("scope_phase"), F.lit(None).cast("long").alias("stamp"), F.lit(False).alias("from_base"), F.lit(False).alias("unsynced"), F.create_map(F.lit("StartCycle"), (F.col("trace_id") + 100).cast("string"), F.lit("CycleFrequency"), F.lit("1000000")).alias("fields"))
    return rows.unionByName(clock).withColumns({"binary_fields": F.create_map().cast("map<string,binary>"), "attachment": F.lit(None).cast("binary")})


def attached_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as created threads whose names, and groups of threads, are attachments."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.floor(F.col("c_custkey") / 100).alias("trace_id"), F.col("c_custkey").alias("thread_id"), F.col("c_custkey").alias("seq"), "c_name", "c_mktsegment")
    made = _log(c, logger=F.lit("Misc"), event_name=F.lit("CreateThread"), attachment=F.encode(F.concat("c_name", F.lit("\0")), "UTF-16LE"))
    grouped = c.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 1_000_000_000)
    return made.unionByName(_log(grouped, logger=F.lit("Misc"), event_name=F.lit("SetThreadGroup"), attachment=F.encode(F.concat("c_mktsegment", F.lit("\0\0")), "UTF-8")))
