"""Frames, threads, timers and scopes of an event log, on cases worked out by hand."""

import struct

import pytest
from test_captures import CLOCK, HEAD, SPECS, packet, stamp

from framelake.functions import fields
from framelake.operators import batches, modules, scopes
from framelake.sources import captures, sessions

LOG = "trace_id string, seq long, thread_id int, logger string, event_name string, scope_phase string, ts_seconds double, cycle long, seconds_per_cycle double, fields map<string,string>, field_arrays map<string,array<string>>, binary_fields map<string,binary>, attachment binary"


def varint(v):
    out = bytearray()
    while v >= 128:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes(out) + bytes([v])


def batch(version, *records):
    """Records (cycle, spec or None for an end, metadata or not)."""
    out = b""
    for cycle, spec, *meta in records:
        out += varint(cycle << (1 if version == 1 else 2) | (spec is not None))
        if spec is not None:
            out += varint(spec << 1 | bool(meta)) if version == 3 else varint(spec)
    return out


class Log:
    def __init__(self, spark):
        self.spark, self.rows = spark, []

    def add(self, name, logger="CpuProfiler", thread=7, phase="None", ts=0.0, cycle=None, rate=None, data=b"", arrays=None, **fields):
        self.rows.append(("t", len(self.rows), thread, logger, name, phase, ts, cycle, rate, {k: str(v) for k, v in fields.items()}, arrays or {}, {}, data))
        return self

    def frame(self):
        return self.spark.createDataFrame(self.rows, LOG)


def timeline(log):
    return [(r.kind, r.t_us, r.is_begin, r.ref_kind, r.ref_id) for r in batches.records(log.frame()).orderBy("thread_id", "seq").collect()]


@pytest.mark.parametrize("version,rate,times", [(1, 0.001, (10, 16)), (2, 0.002, (4, 9)), (3, 0.002, (4, 9))])
def test_batches(spark, version, rate, times):
    log = Log(spark).add("EventSpec", Id=100, Name="Tick", File="GameThread.cpp", Line=42)
    log.add("EventBatch" + ("" if version == 1 else f"V{version}"), rate=rate, data=batch(version, (times[0], 100), (times[1], None)))
    assert timeline(log) == [("scope", round(times[0] * rate * 1e6), True, 0, 100), ("scope", round(times[1] * rate * 1e6), False, None, None)]
    got = modules.analyze(log.frame())
    s = got["scopes"].collect()
    assert [(r.name, r.start_us, r.end_us) for r in s] == [("Tick", round(times[0] * rate * 1e6), round(times[1] * rate * 1e6))]
    t = got["timers"].first()
    assert (t.timer_id, t.name, t.source_file, t.source_line) == (1, "Tick", "GameThread.cpp", 42)


def test_cycles_count_from_the_last_one_or_the_base(spark):
    log = Log(spark).add("EventBatchV2", cycle=1000, rate=1e-6, data=batch(2, (5, 1), (7, None)))
    log.add("EventBatchV2", cycle=1000, rate=1e-6, data=batch(2, (3000, 1), (10, None)) + varint(20 << 2 | 3) + varint(1) + varint(2) + varint(1 << 2 | 2) + varint(9) + batch(2, (4, 2)) + b"\x80")
    assert [(k, t) for k, t, *_ in timeline(log)] == [("scope", 1005), ("scope", 1012), ("scope", 3000), ("scope", 3010), ("time", 3030), ("time", 3031), ("scope", 3035)]
    late = Log(spark).add("EventBatch", rate=1.0, ts=10.0, data=batch(1, (20, 1), (3700, None), (3701, 1)))
    assert len(timeline(late)) == 1


def test_late_spec_and_metadata(spark):
    log = Log(spark).add("EventBatch", rate=0.001, data=batch(1, (1, 200), (2, None))).add("EventSpec", Id=200, Name="LateResolved")
    got = modules.analyze(log.frame())
    assert [(r.timer_id, r.name) for r in got["timers"].collect()] == [(1, "LateResolved")] and got["scopes"].first().name == "LateResolved"
    log = Log(spark).add("MetadataSpec", Id=401, Name="Task", NameFormat="Task %s", arrays={"FieldNames": ["Name"]}).add("MetadataSpec", Id=402, NameFormat="Job (x)")
    log.add("EventBatchV3", rate=0.002, data=batch(3, (5, 7, True), (9, None), (1, 8, True), (2, None), (3, 9), (4, None)))
    log.add("Metadata", Id=7, SpecId=401, data=bytes([1, 2, 3, 4]))
    got = modules.analyze(log.frame())
    instances = {r.id: (r.spec_id, bytes(r.payload)) for r in got["metadata_instances"].collect()}
    assert instances == {7: (401, bytes([1, 2, 3, 4])), 8: (None, b"")}
    assert [(r.id, r.format, r.field_names) for r in got["metadata_specs"].orderBy("id").collect()] == [(0, "Task %s", ["Name"]), (1, "Job (x)", [])]
    assert [r.name for r in got["scopes"].orderBy("start_us").collect()] == ["Task", "<unknown metadata>", "<unknown 9>"]
    assert {r.spec_id: r.name for r in got["timers"].collect()} == {401: "Task", 402: "Job", 9: "<unknown 9>"}


def test_logged_scopes_stand_between_records(spark):
    log = Log(spark).add("WaitScope", "Cpu", phase="Enter", ts=0.012, cycle=12, TypeId=3, TypeName="Wait").add("WaitScope", "Cpu", phase="Leave", ts=0.018, cycle=18)
    log.add("EventBatch", rate=0.001, data=batch(1, (10, 1), (20, None)))
    assert [(t, b, k, i) for _, t, b, k, i in timeline(log)] == [(10_000, True, 0, 1), (12_000, True, 2, 4294967292), (18_000, False, None, None), (20_000, False, None, None)]
    assert {r.name for r in modules.analyze(log.frame())["scopes"].collect()} == {"<unknown 1>", "Wait"}
    back = Log(spark).add("A", "Cpu", phase="Enter", ts=0.2, cycle=200).add("A", "Cpu", phase="Leave", ts=0.1, cycle=100).add("EventBatch", rate=0.001, data=batch(1, (300, 1)))
    assert [(k, t, b) for k, t, b, *_ in timeline(back)] == [("time", 200_000, False), ("scope", 300_000, True)]


def test_end_of_thread_closes_its_scopes(spark):
    log = Log(spark).add("A", "Cpu", phase="Enter", ts=0.005, cycle=5).add("EndThread", rate=0.001, cycle=6).add("EventBatch", rate=0.001, data=batch(1, (9, 1)))
    log.add("EventBatch", rate=0.001, thread=8, data=batch(1, (1, 1), (50, None), (2, 1)))
    got = modules.analyze(log.frame())
    assert {(r.thread_id, r.start_us, r.end_us, r.is_open) for r in got["scopes"].collect()} == {(7, 5000, 6000, True), (8, 1000, 50_000, False), (8, 52_000, 52_000, True)}


def test_frames_of_both_types(spark):
    log = Log(spark).add("BeginFrame", "Misc", ts=1.0, FrameType=0).add("EndFrame", "Misc", ts=4.0, FrameType=0).add("BeginRenderFrame", "Misc", ts=1.5).add("EndRenderFrame", "Misc", ts=3.5)
    log.add("BeginFrame", "Misc", rate=0.001, FrameType="rendering", Cycle=6000).add("BeginGameFrame", "Misc", rate=0.001, data=varint(7000)).add("EndGameFrame", "Misc", rate=0.001, data=varint(300)).add("BeginFrame", "Misc")
    got = modules.analyze(log.frame())
    rows = {(r.frame_type, r.frame_index): (r.start_us, r.end_us) for r in got["frames"].collect()}
    assert rows == {("Game", 0): (1_000_000, 4_000_000), ("Rendering", 0): (1_500_000, 3_500_000), ("Rendering", 1): (6_000_000, None), ("Game", 1): (7_000_000, 7_300_000)}
    assert got["durations"].first().duration_us == 7_300_000


def test_threads_of_the_log(spark):
    log = Log(spark).add("RegisterGameThread", "$Trace", 10).add("BeginThreadGroupScope", "Misc", 10, GroupName="TaskGraphHigh").add("CreateThread", "Misc", 10, CreatedThreadId=20, Name="Worker20", Priority=0)
    log.add("EndThreadGroupScope", "Misc", 10).add("EndThreadGroupScope", "Misc", 10).add("CreateThread", "Misc", 10, CreatedThreadId=21, Name="Alone").add("ThreadInfo", "$Trace", 10, ThreadId=30, Name="RHIThread")
    log.add("SetThreadGroup", "Misc", 11, data=b"LargeThreadPool\0").add("CreateThread", "Misc", 10, CreatedThreadId=11, data="WorkerUtf16\0".encode("utf-16-le"))
    got = {r.thread_id: (r.name, r.group_name, r.priority) for r in modules.analyze(log.frame())["threads"].collect()}
    none = fields.NO_PRIORITY
    assert got == {10: ("GameThread", None, -2), 20: ("Worker20", "TaskGraphHigh", 0), 21: ("Alone", None, none), 30: ("RHIThread", "Render", none), 11: ("WorkerUtf16", "LargeThreadPool", none)}
    log = Log(spark).add("EndThread", thread=2, rate=1.0, cycle=1)
    assert [(r.name, r.priority) for r in modules.analyze(log.frame())["threads"].collect()] == [("GameThread", -2)]


def test_empty_log(spark):
    got = modules.analyze(spark.createDataFrame([], LOG))
    assert all(t.count() == 0 for t in got.values())


def test_import_write_and_read(spark, tmp_path):
    frame = struct.pack("<HQB", 11 << 1 | 1, 500, 1)
    scope = stamp(200, 8) + struct.pack("<H", 13 << 1 | 1) + struct.pack("<I", 3 << 13 | 0 << 8 | 2) + bytes([9, 8, 7]) + b"\x06" + stamp(260, 9)
    for name in "ab":
        (tmp_path / f"{name}.utrace").write_bytes(HEAD + packet(0, CLOCK) + packet(1, SPECS) + packet(5, frame) + packet(6, scope))
    tables = sessions.import_traces(spark, str(tmp_path))
    assert {r.packets for r in tables["packet_counts"].collect()} == {4}
    assert {r.event_name for r in tables["event_definitions"].collect()} == {"NewTrace", "BeginFrame", "EventSpec", "WaitScope", "ThreadTiming"}
    assert {(r.name, r.start_us, r.end_us) for r in tables["scopes"].collect()} == {("WaitScope", 300_000, 360_000)}
    assert {(r.rendering_frames, r.timelines) for r in tables["summary"].collect()} == {(1, 1)}
    kept = {n: tables[n] for n in ("scopes", "frames", "events", "summary")}
    sessions.write_tables(kept, f"{tmp_path}/out")
    again = sessions.read_tables(spark, f"{tmp_path}/out", list(kept))
    assert {n: t.count() for n, t in again.items()} == {n: t.count() for n, t in kept.items()}
    one = again["scopes"].first().trace_id
    assert sessions.read_tables(spark, f"{tmp_path}/out", ["scopes"], one)["scopes"].count() == 1
    assert {(r.kind, r.events) for r in modules.coverage(tables["events"]).where("rank <= 2").collect()} >= {("Cpu.WaitScope", 2)}


def test_open_scope_lasts_to_the_last_frame(spark):
    frames = spark.createDataFrame([(1, "Game", i, 10 * i, 10 * i + 10) for i in range(5)], "trace_id long, frame_type string, frame_index long, start_us long, end_us long")
    s = spark.createDataFrame([(1, 1, 1, 1, None, 25, None)], "trace_id long, thread_id long, scope_id long, depth long, parent_scope_id long, start_us long, end_us long")
    assert [(r.frame_index, r.inclusive_us, r.ended_after) for r in scopes.in_frames(s, frames).orderBy("frame_index").collect()] == [(2, 5, True), (3, 10, True), (4, 10, True)]


def test_display_texts(spark):
    r = spark.sql("SELECT 1234567L AS us, 5L AS small").select(fields.milliseconds("us"), fields.seconds("us"), fields.milliseconds("small")).first()
    assert tuple(r) == ("1234.567 ms", "1.234567", "0.005 ms")
