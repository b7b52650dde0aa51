"""Batches of scope records to the begins and ends of each thread, merged with logged scopes in order of cycles.

A batch is a stream of 7-bit varints. A record's number holds its cycle above one flag (first version) or two: whether
it begins a scope, then the scope's id follows, and whether it is a coroutine's, which is skipped. In the third
version the id tells metadata from timers. A cycle below the thread's last one counts from that, and one still below
the batch's base from the base. So a thread is a chain, and its batches stream by in order through one small state:
rows are dealt by trace and thread and sorted, nothing of a thread is gathered but the logged scopes that wait for
the next batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import bytes_field, long_field

#: Seconds that a record may lie behind its batch's time; the batch ends there.
LEAD = 3600.0
TIMER, METADATA, LOGGED = 0, 1, 2
RECORDS = "trace_id string, thread_id long, seq long, event_seq long, kind string, t_us long, is_begin boolean, ref_kind int, ref_id long, instance long"


def numbers(data: bytes) -> list[int]:
    """All whole varints of a batch."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    if not len(ends):
        return []
    raw = raw[: ends[-1] + 1]
    begin = np.append(0, ends[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw))))
    parts = (raw & 127).astype(np.uint64) << np.minimum(7 * place, 63).astype(np.uint64)
    return np.add.reduceat(parts, begin).tolist()


class _Thread:
    """State of a thread between its events; out collects (kind, t_us, is_begin, ref_kind, ref_id, instance)."""

    def __init__(self):
        self.last, self.ended, self.late, self.latest = 0, False, False, float("-inf")
        self.waiting: list[tuple] = []
        self.out: list[tuple] = []

    def logged(self, cycle, seconds, begin, type_id, seq) -> None:
        """A logged scope waits for the batches; one that goes back in time makes the thread do without them."""
        if self.late or cycle is None or (not cycle and not seconds):
            return
        if seconds < self.latest:
            self.give_up()
            return
        self.latest = seconds
        self.waiting.append((cycle, seconds, begin, 4294967295 - (type_id or 0), seq))

    def give_up(self) -> None:
        """What waits is left out from here on, but its times have counted: the latest one tells."""
        self.late = True
        self.out.append(("time", round(self.latest * 1e6), False, None, None, None))
        self.waiting.clear()

    def release(self, until: float, begin: bool) -> None:
        """What waits from before a record; at its cycle too if the record begins a scope."""
        n = 0
        for cycle, seconds, is_begin, spec, seq in self.waiting:
            if cycle > until or (cycle == until and not begin):
                break
            if cycle < self.last:
                self.give_up()
                return
            self.last = cycle
            self.out.append(("scope", round(seconds * 1e6), is_begin, *((LOGGED, spec, seq) if is_begin else (None,) * 3)))
            n += 1
        del self.waiting[:n]

    def batch(self, version, data, base, rate, context) -> None:
        if self.ended:
            return
        shift, values = (1 if version == 1 else 2), iter(numbers(data))
        for v in values:
            cycle, begin = v >> shift, bool(v & 1)
            if cycle < self.last:
                cycle += self.last
            if cycle < base:
                cycle += base
            if self.waiting:
                self.release(cycle, begin)
            seconds = cycle * rate
            if context > 0 and seconds > context + LEAD:
                return
            kind, ref = "scope", (None, None)
            if version > 1 and v & 2:
                kind = "time"
                if next(values, None) is None or (begin and next(values, None) is None):
                    return
            elif begin:
                if (i := next(values, None)) is None:
                    return
                ref = (i & 1, i >> 1) if version == 3 else (TIMER, i)
            self.out.append((kind, round(seconds * 1e6), begin and kind == "scope", *ref, None))
            self.last = cycle

    def end(self, cycle, rate) -> None:
        if self.ended:
            return
        t = round((self.last if cycle is None else cycle) * rate * 1e6)
        self.release(float("inf"), True)
        self.out.append(("end", t, False, None, None, None))
        self.ended, self.waiting = True, []


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["trace_id", "thread_id", "seq", "event_seq", "kind", "t_us", "is_begin", "ref_kind", "ref_id", "instance"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64()]
    at, n, state = None, 0, None

    def flush(event_seq):
        nonlocal n
        rows = [(*at, n + k, event_seq, *r) for k, r in enumerate(state.out)]
        n += len(rows)
        state.out.clear()
        return rows

    for b in batches:
        out = []
        for trace, thread, seq, what, cycle, rate, seconds, data, type_id in zip(*(b.column(c).to_pylist() for c in ("trace_id", "thread_id", "seq", "what", "cycle", "rate", "seconds", "data", "type_id"))):
            if (trace, thread) != at:
                if state and not state.ended:
                    state.release(float("inf"), True)
                    out += flush(last_seq)
                at, n, state = (trace, thread), 0, _Thread()
            last_seq = seq
            if what == "end":
                state.end(cycle, rate or 0.0)
            elif what in ("enter", "leave"):
                state.logged(cycle, seconds or 0.0, what == "enter", type_id, seq)
            elif data:
                state.batch(int(what), data, cycle or 0, rate or 0.0, seconds or 0.0)
            out += flush(seq)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
    if state and not state.ended:
        state.release(float("inf"), True)
        if out := flush(last_seq):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def records(events: DataFrame) -> DataFrame:
    """RECORDS of an event log: kind scope (a begin or an end), time (only its time counts) or end (of the thread). seq
    orders a thread's rows; event_seq is that of the event they come from; ref tells a begin's timer or metadata, and
    instance a logged begin's own event.

    Events without a cycle or a rate count as cycle 0, empty batches as none; a batch cut in a record stops there."""
    version = F.when(F.col("event_name") == "EventBatch", "1").when(F.col("event_name") == "EventBatchV2", "2").when(F.col("event_name") == "EventBatchV3", "3").when(F.col("event_name") == "EndThread", "end")
    what = F.when(F.col("logger") == "Cpu", F.lower("scope_phase")).when(F.col("logger") == "CpuProfiler", version)
    rows = events.withColumn("what", what).where("what IN ('1', '2', '3', 'end', 'enter', 'leave')")
    base = F.coalesce(F.col("cycle"), F.when(F.col("what") == "end", long_field("Cycle")).otherwise(long_field("BaseCycle")), F.when(F.col("what").isin("enter", "leave"), long_field("Cycle")))
    rate = F.coalesce("seconds_per_cycle", F.element_at("fields", "SecondsPerCycle").try_cast("double"))
    type_id = F.coalesce(long_field("TypeId"), long_field("Id", 0))
    rows = rows.select("trace_id", F.col("thread_id").cast("long"), "seq", "what", base.alias("cycle"), rate.alias("rate"), F.col("ts_seconds").alias("seconds"), bytes_field("Data").alias("data"), type_id.alias("type_id"))
    return rows.repartition("trace_id", "thread_id").sortWithinPartitions("trace_id", "thread_id", "seq").mapInArrow(_replay, RECORDS)
