"""Capture files to tables: handshakes, packets and the event log.

A file is one row of Spark's binaryFile source, so it is read whole by one task (2 GB at most, the bound of that
source); everything after the packets is dealt by trace and thread. Python takes bytes apart only, to events as they stand;
clocks, base times and the order of all are joins and windows on the events. The two threads that carry definitions are taken
apart for each trace; their definitions, a row for each trace, go to the trace's other threads by a co-group. A damaged file gives an error row; a damaged packet loses its own rest only.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.fields import long_field
from ..operators.chunks import CHUNK, PART, carried, chunked
from ..storage import bounded, saved, workspace

# Fixed values of the format.
MAGIC = 0x54524332
ENCODED, TRAILER, THREAD_BITS = 0x8000, 0x4000, 0x3FFF
SHARED_THREADS, SYNC_THREAD = (0, 1), 0x3FFF
HAS_AUX, UNSYNCED = 2, 4
STRING, ARRAY = 0x08, 0x80
NUMBERS = {0x00: "<B", 0x01: "<H", 0x02: "<I", 0x03: "<Q", 0x10: "<b", 0x11: "<h", 0x12: "<i", 0x13: "<q", 0x42: "<f", 0x43: "<d"}
BATCHES = ("EventBatch", "EventBatchV2", "EventBatchV3")

HANDSHAKE = "trace_id string, control_port int, session_guid binary, trace_guid binary, transport int, protocol int, error string"
PACKETS = "trace_id string, packet_index long, thread_id int, payload binary, error string"
RAW = "trace_id string, seq long, thread_id int, logger string, event_name string, scope_phase string, stamp long, from_base boolean, unsynced boolean, fields map<string,string>, binary_fields map<string,binary>, attachment binary"
EVENTS = "trace_id string, seq long, thread_id int, logger string, event_name string, scope_phase string, ts_seconds double, cycle long, seconds_per_cycle double, fields map<string,string>, binary_fields map<string,binary>, attachment binary"
DEFINITIONS = "trace_id string, uid int, logger string, event_name string, flags int, fixed_size int, fields array<struct<name:string,offset:int,size:int,kind:int>>"
SHARED = "bodies array<binary>"


class Damaged(ValueError):
    pass


def take(data: bytes, at: int, n: int, what: str) -> bytes:
    if at + n > len(data):
        raise Damaged(f"{what} is truncated")
    return data[at : at + n]


def number(data: bytes, at: int, form: str, what: str) -> int:
    return struct.unpack(form, take(data, at, struct.calcsize(form), what))[0]


def handshake(data: bytes) -> tuple[dict, int]:
    """What stands before the packets, and where they begin."""
    if (magic := number(data, 0, "<I", "handshake")) != MAGIC:
        raise Damaged(f"Unexpected trace magic 0x{magic:08X}")
    size = number(data, 4, "<H", "handshake")
    tags, meta, at = {}, take(data, 6, size, "metadata"), 0
    while at < size:
        tag = number(meta, at, "<H", "metadata field header")
        tags[tag >> 8] = take(meta, at + 2, tag & 0xFF, "metadata field")
        at += 2 + (tag & 0xFF)
    port = tags.get(0, b"")
    versions = take(data, 6 + size, 2, "versions")
    return {"control_port": int.from_bytes(port, "little") if len(port) == 2 else 0, "session_guid": tags.get(1, b""), "trace_guid": tags.get(2, b""), "transport": versions[0], "protocol": versions[1]}, 8 + size


def split_packets(data: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    """Thread and payload of each packet, decompressed."""
    while at < len(data):
        size, word = number(data, at, "<H", "packet header"), number(data, at + 2, "<H", "packet header")
        body, at = take(data, at + 4, size - 4, "packet") if size >= 4 else b"", at + size
        if size < 4:
            raise Damaged("packet size below its header")
        if word & TRAILER:  # eight bytes that the size doesn't count
            take(data, at, 8, "packet trailer")
            at += 8
        if word & ENCODED:
            full = number(body, 0, "<H", "decoded size")
            try:
                body = pa.decompress(body[2:], full, codec="lz4_raw", asbytes=True)
            except Exception as e:
                raise Damaged(f"packet cannot be decompressed to {full} bytes") from e
        yield word & THREAD_BITS, body


def files(spark: SparkSession, path: str, pattern: str = "*.utrace") -> DataFrame:
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.select(F.col("path").alias("trace_id"), "content")


def handshakes(captures: DataFrame) -> DataFrame:
    """A row for each file; error tells why one can't be read."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, data in zip(part["trace_id"], part["content"]):
                try:
                    out.append({"trace_id": name, **handshake(bytes(data))[0], "error": None})
                except Damaged as e:
                    out.append({"trace_id": name, "error": str(e)})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in HANDSHAKE.split(", ")])

    return bounded(captures).mapInPandas(run, HANDSHAKE)


def packets(captures: DataFrame) -> DataFrame:
    """A row for each packet in order; a damaged file ends with a row that has only an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["trace_id"], part["content"]):
                data, out = bytes(data), []
                try:
                    for i, (thread, body) in enumerate(split_packets(data, handshake(data)[1])):
                        out.append((name, i, thread, body, None))
                        if len(out) == 256:
                            yield pd.DataFrame(out, columns=[c.split()[0] for c in PACKETS.split(", ")])
                            out = []
                except Damaged as e:
                    out.append((name, None, None, None, str(e)))
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in PACKETS.split(", ")])

    return bounded(captures).mapInPandas(run, PACKETS)


@dataclass
class Definition:
    """Layout of an event, from the body of a definition event."""

    uid: int
    flags: int
    logger: str
    name: str
    fields: list[tuple[str, int, int, int]]  # name, offset, size (0: auxiliary), kind

    @property
    def size(self) -> int:
        return max((at + n for _, at, n, _ in self.fields if n), default=0)

    @classmethod
    def parse(cls, body: bytes) -> Definition:
        uid, count, flags, *lengths = struct.unpack("<HBBBB", take(body, 0, 6, "definition"))
        rows = list(struct.iter_unpack("<BxHHBB", take(body, 6, 8 * count, "definition fields")))
        lengths += [0 if family == 2 else n for family, *_, n in rows]
        names, at = [], 6 + 8 * count
        for n in lengths:
            names.append(take(body, at, n, "definition name").decode("ascii", "replace"))
            at += n
        wide = lambda kind: 0 if kind & (STRING | ARRAY) else 1 << (kind & 3)
        sizes = [size if family == 0 else wide(kind) if family in (1, 2) else 0 for family, _, size, kind, _ in rows]
        return cls(uid, flags, names[0], names[1], [(name, r[1], n, r[3]) for name, r, n in zip(names[2:], rows, sizes)])


@dataclass
class Event:
    definition: Definition
    phase: str
    stamp: int | None = None
    from_base: bool = False
    fields: dict = field(default_factory=dict)
    attachment: bytes = b""


class Decoder:
    """Bytes of one thread to events, without their times: the threads of a trace share definitions."""

    def __init__(self, definitions: dict[int, Definition]):
        self.definitions = definitions
        self.bodies: dict[int, bytes] = {}
        self.open, self.enter, self.stack, self.rows = None, None, [], []

    def begin(self, d: Definition, body: bytes) -> Event:
        (phase, *stamp), self.enter = self.enter or ("None", None, False), None
        e = Event(d, phase, *stamp)
        for name, at, n, kind in d.fields:
            if n and at + n <= len(body) and name:
                raw, form = body[at : at + n], NUMBERS.get(kind)
                e.fields[name] = struct.unpack_from(form, raw)[0] if form and struct.calcsize(form) <= n else raw
        if phase == "Enter":
            e.fields = {"TypeId": d.uid, "TypeName": d.name} | e.fields
        return e

    def aux(self, e: Event, data: bytes, at: int) -> tuple[int, bool]:
        """Adds auxiliary data from at on; where they end, and whether the event has ended."""
        d = e.definition
        holds = ("Data",) if d.logger == "CpuProfiler" and d.name in BATCHES else ("Data", "Metadata")
        while at < len(data):
            if data[at] not in (1, 2):
                return at + (data[at] in (3, 6)), True
            head = number(data, at, "<I", "aux header")
            raw, at = take(data, at + 4, head >> 13, "aux data"), at + 4 + (head >> 13)
            k = head >> 8 & 31
            name, kind = (d.fields[k][0], d.fields[k][3]) if k < len(d.fields) else ("", 0)
            if not name or name in holds:
                e.attachment = raw
            else:
                e.fields[name] = raw.decode("utf-16-le" if kind & 3 == 1 else "utf-8", "replace").rstrip("\0") if kind & STRING else raw
        return at, False

    def emit(self, e: Event) -> None:
        if e.phase == "Enter":
            self.stack.append(e.definition)
        self.add(e.definition, e.phase, e.stamp, e.from_base, e.fields, e.attachment)

    def add(self, d, phase, stamp, from_base, fields, attachment) -> None:
        text = {k: str(v) for k, v in fields.items() if not isinstance(v, bytes)}
        self.rows.append((d.logger, d.name, phase, stamp, from_base, bool(d.flags & UNSYNCED), text, {k: v for k, v in fields.items() if isinstance(v, bytes)}, attachment))

    def shared(self, data: bytes) -> None:
        """A packet of the shared threads: each event has its size, and event 0 defines another."""
        at = 0
        while at < len(data):
            uid, n = number(data, at, "<H", "event header"), number(data, at + 2, "<H", "event header")
            body, at = take(data, at + 4, n, "event"), at + 4 + n
            if uid == 0:
                d = Definition.parse(body)
                self.definitions[d.uid], self.bodies[d.uid] = d, body
            elif d := self.definitions.get(uid):
                e = self.begin(d, body)
                if d.flags & HAS_AUX:
                    self.aux(e, body, d.size)
                self.emit(e)

    def packet(self, data: bytes) -> None:
        """A packet of another thread; an event may go on in the thread's next packet."""
        at = 0
        while at < len(data):
            if self.open:
                at, ended = self.aux(self.open, data, at)
                if ended:
                    self.emit(self.open)
                    self.open = None
            elif data[at] & 1:
                uid = number(data, at, "<H", "event uid") >> 1
                if (d := self.definitions.get(uid)) is None:
                    raise Damaged(f"unknown event {uid}")
                at += 2 if d.flags & UNSYNCED else 5
                e, at = self.begin(d, take(data, at, d.size, "event")), at + d.size
                if d.flags & HAS_AUX:
                    self.open = e
                else:
                    self.emit(e)
            else:
                at = self.mark(data, at)

    def mark(self, data: bytes, at: int) -> int:
        """Scope markers: 4 and 5 enter and leave, 6 and 7 with a stamp, 8 and 9 with one from the thread's base."""
        kind = data[at] >> 1
        if kind in (1, 3) or data[at : at + 2] == b"\0\0":
            raise Damaged(f"unexpected marker {kind}")
        if not 4 <= kind <= 9:
            return at + 1
        stamp = number(data, at, "<Q", "stamp") >> 8 if kind > 5 else None
        if kind % 2 == 0:
            self.enter = ("Enter", stamp, kind > 7)
        elif self.stack:
            self.add(self.stack.pop(), "Leave", stamp, kind > 7, {}, b"")
        return at + (8 if kind > 5 else 1)

    def run(self, trace, thread, rows, read, phase: int) -> list[tuple]:
        """Event rows of packets (index, payload); seq orders the events of a trace as the file does."""
        out = []
        for index, data in rows:
            try:
                read(bytes(data))
            except Damaged:
                pass
            out += [(trace, phase << 60 | int(index) << 20 | i, thread, *r) for i, r in enumerate(self.rows)]
            self.rows = []
        if self.open:
            self.emit(self.open)
            out.append((trace, 2 << 60 | int(index) << 20, thread, *self.rows[0]))
        return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in RAW.split(", ")])
    return out.assign(stamp=out["stamp"].astype("Int64"))


def decoded(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The event log of packets, with times by the clock of the shared threads, and a row for each event definition, the last
    of a uid: its size and its fields. Every packet is decoded once: the shared threads of a trace become one written table of
    tagged rows, their events and what the other threads need to know of them. Events of the shared threads come before
    those of the others, and what a trace ends with after them."""
    good = bounded(parts).where("error is null")
    tagged = StructType.fromDDL(f"tag string, {RAW}, {SHARED}").add("definitions", ArrayType(StructType.fromDDL(DEFINITIONS)))

    def shared_threads(part: pd.DataFrame) -> pd.DataFrame:
        d, rows, trace = Decoder({}), [], part["trace_id"].iloc[0]
        for index, thread, data in part.sort_values("packet_index")[["packet_index", "thread_id", "payload"]].itertuples(index=False):
            rows += d.run(trace, thread, [(index, data)], d.shared, 0)
        fields = [c.split()[0] for c in DEFINITIONS.split(", ")]
        known = [dict(zip(fields, (trace, x.uid, x.logger, x.name, x.flags, x.size, [(n, at, size, kind) for n, at, size, kind in x.fields]))) for x in d.definitions.values()]
        head = pd.DataFrame({"tag": ["shared"], "trace_id": [trace], "bodies": [list(d.bodies.values())], "definitions": [known]})
        out = pd.concat([head, _frame(rows).assign(tag="event")]) if rows else head
        out = out.reindex(columns=tagged.names).astype(object)
        return out.where(out.notna(), None).astype({c: "Int64" for c in ("seq", "thread_id", "stamp")})

    def rest(part: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return _frame([])
        known = [Definition.parse(bytes(b)) for b in ([] if shared.empty else shared["bodies"].iloc[0])]
        d, part = Decoder({x.uid: x for x in known}), part.sort_values("packet_index")
        return _frame(d.run(part["trace_id"].iloc[0], part["thread_id"].iloc[0], zip(part["packet_index"], part["payload"]), d.packet, 1))

    first = good.where(F.col("thread_id").isin(*SHARED_THREADS)).groupBy("trace_id").applyInPandas(shared_threads, tagged)
    first = saved(first, f"{workspace(parts.sparkSession)}/shared")
    others = good.where(~F.col("thread_id").isin(*SHARED_THREADS, SYNC_THREAD))
    shared = first.where("tag = 'shared'").select(F.col("trace_id").alias("_trace"), "bodies")
    each = others.select("trace_id", F.col("thread_id").alias("_thread")).distinct().join(shared, F.col("trace_id") == F.col("_trace")).drop("trace_id")
    later = others.groupBy("trace_id", "thread_id").cogroup(each.groupBy("_trace", "_thread")).applyInPandas(rest, RAW)
    raw = saved(first.where("tag = 'event'").select(*later.columns).unionByName(later), f"{workspace(parts.sparkSession)}/raw")
    return timed(raw), first.where("tag = 'shared'").select(F.inline("definitions"))


def clocks(raw: DataFrame) -> DataFrame:
    """trace_id, start and frequency (null or above 0) that the shared threads of a trace end with."""
    e = raw.where(_is("$Trace", "NewTrace") & F.col("thread_id").isin(*SHARED_THREADS))
    return e.groupBy("trace_id").agg(*(F.max_by(c, F.when(c.isNotNull(), F.col("seq"))).alias(n) for n, c in _clock().items()))


def _is(logger: str, *names: str) -> Column:
    return (F.col("logger") == logger) & F.col("event_name").isin(*names)


def _clock() -> dict[str, Column]:
    return {n: F.when(F.nullif(long_field(k), F.lit(0).cast("long")).isNotNull(), long_field(k)) for n, k in (("start", "StartCycle"), ("frequency", "CycleFrequency"))}


def _latest(rows: DataFrame, keys: list[str], values: dict[str, Column], size: int) -> DataFrame:
    """rows with the last value, of those that aren't null, before each row by seq: chunk by chunk, and from earlier chunks."""
    run = Window.partitionBy(*keys, PART).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    r = chunked(rows, size).withColumns({f"_{n}": F.when(c.isNotNull(), F.struct("seq", c.alias("v"))) for n, c in values.items()})
    r = carried(r, keys, **{f"_{n}_before": (F.max, f"_{n}") for n in values})
    return r.withColumns({n: F.coalesce(F.max(f"_{n}").over(run), f"_{n}_before")["v"] for n in values}).drop(PART, *(x for n in values for x in (f"_{n}", f"_{n}_before")))


def timed(raw: DataFrame, size: int = CHUNK) -> DataFrame:
    """The event log from events without times. The clock is the last one before an event in its thread (the shared threads
    have one together), else that of its trace; a thread's base time, from its timing events, stamps the later events that
    are out of sync and have no time, and the scope markers that count from it."""
    path = workspace(raw.sparkSession)
    e = raw.withColumn("_of", F.when(F.col("thread_id").isin(*SHARED_THREADS), F.lit(-1)).otherwise(F.col("thread_id")))
    e = _latest(e, ["trace_id", "_of"], {n: F.when(_is("$Trace", "NewTrace"), c) for n, c in _clock().items()}, size)
    known = clocks(raw).select("trace_id", F.col("start").alias("_start"), F.col("frequency").alias("_frequency"))
    e = e.join(known, "trace_id", "left")
    own = F.col("_of") == -1
    e = e.withColumns({"start": F.coalesce("start", F.when(~own, F.col("_start")), F.lit(0)), "frequency": F.coalesce("frequency", F.when(~own, F.col("_frequency")))})
    e = saved(e.drop("_of", "_start", "_frequency"), f"{path}/clock")
    e = _latest(e, ["trace_id", "thread_id"], {"base": F.when(_is("$Trace", "ThreadTiming"), F.greatest(F.lit(0), F.col("start") + long_field("BaseTimestamp")))}, size)
    base, rate = F.nullif(F.col("base"), F.lit(0).cast("long")), F.lit(1.0) / F.col("frequency")
    marked = F.col("stamp") + F.when(F.col("from_base"), F.coalesce(base, F.col("start"))).otherwise(0)
    plain = F.when(rate.isNotNull(), F.coalesce(long_field("Cycle"), F.when(F.col("unsynced"), base)))
    cycle = F.when(F.col("scope_phase").isin("Enter", "Leave"), marked).otherwise(plain)
    # Batches and ends of threads have their own cycles and rates, which are no fields of theirs any more.
    batch, end = _is("CpuProfiler", *BATCHES), _is("CpuProfiler", "EndThread")
    cycles = F.coalesce(F.when(batch, long_field("BaseCycle")).when(end, long_field("Cycle")), cycle)
    rates = F.coalesce(F.when(batch | end, F.element_at("fields", "SecondsPerCycle").try_cast("double")), rate)
    seconds = F.coalesce(cycle * rate, F.lit(0.0))
    seconds = F.when(batch & (seconds == 0), F.coalesce(cycles * rates, seconds)).otherwise(seconds)
    left = F.when(batch | end, F.map_filter("fields", lambda k, _: ~(k.isin("SecondsPerCycle") | (batch & (k == "BaseCycle")) | (end & (k == "Cycle"))))).otherwise(F.col("fields"))
    names = [c.split()[0] for c in EVENTS.split(", ")]
    return e.select(*names[:6], seconds.alias("ts_seconds"), cycles.alias("cycle"), rates.alias("seconds_per_cycle"), left.alias("fields"), *names[-2:])


def trace_events(parts: DataFrame) -> DataFrame:
    return decoded(parts)[0]


def event_definitions(parts: DataFrame) -> DataFrame:
    return decoded(parts)[1]
