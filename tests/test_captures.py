"""Capture files written here, read back through Spark."""

import struct

import pyarrow as pa
import pytest

from framelake.sources import captures


def definition(uid, flags, logger, name, *fields):
    body = struct.pack("<HBBBB", uid, len(fields), flags, len(logger), len(name))
    body += b"".join(struct.pack("<BBHHBB", 0, 0, at, n, kind, len(f)) for f, at, n, kind in fields)
    body += (logger + name + "".join(f for f, *_ in fields)).encode()
    return struct.pack("<HH", 0, len(body)) + body


def important(uid, body):
    return struct.pack("<HH", uid, len(body)) + body


def packet(thread, body, squeeze=False):
    if squeeze:
        z = pa.compress(body, codec="lz4_raw", asbytes=True)
        return struct.pack("<HHH", 6 + len(z), thread | 0x8000, len(body)) + z
    return struct.pack("<HH", 4 + len(body), thread) + body


HEAD = struct.pack("<IH", 0x54524332, 40) + struct.pack("<HH", 2, 1981) + struct.pack("<H", 16 | 1 << 8) + bytes(range(1, 17)) + struct.pack("<H", 16 | 2 << 8) + bytes(range(17, 33)) + bytes([4, 7])
CLOCK = definition(10, 1, "$Trace", "NewTrace", ("StartCycle", 0, 8, 3), ("CycleFrequency", 8, 8, 3)) + important(10, struct.pack("<QQ", 100, 1000))
SPECS = definition(11, 4, "Misc", "BeginFrame", ("Cycle", 0, 8, 3), ("FrameType", 8, 1, 0)) + definition(12, 3, "CpuProfiler", "EventSpec", ("Id", 0, 4, 2), ("Name", 0, 0, 0x88)) + definition(13, 6, "Cpu", "WaitScope", ("Data", 0, 0, 0x80)) + definition(14, 4, "$Trace", "ThreadTiming", ("BaseTimestamp", 0, 8, 3))


def stamp(cycle, marker):
    return struct.pack("<Q", cycle << 8 | marker << 1)


def test_files_to_events(spark, tmp_path):
    named = important(12, struct.pack("<II", 123, 11 << 13 | 1 << 8 | 1) + b"GameThread\0" + b"\x03")
    frame = struct.pack("<HQB", 11 << 1 | 1, 500, 1)
    scope = stamp(200, 8) + struct.pack("<H", 13 << 1 | 1) + struct.pack("<I", 3 << 13 | 0 << 8 | 2)
    timing = struct.pack("<Hq", 14 << 1 | 1, 400)
    (tmp_path / "a.utrace").write_bytes(HEAD + packet(0, CLOCK) + packet(1, SPECS + named, True) + packet(5, frame) + packet(6, b"\xff\xff") + packet(6, scope + bytes([9, 8, 7])) + packet(6, b"\x06" + stamp(260, 9) + timing + stamp(25, 8) + frame))
    (tmp_path / "b.utrace").write_bytes(struct.pack("<I", 0x12345678))
    (tmp_path / "c.utrace").write_bytes(HEAD + packet(5, b"abc")[:-1])
    files = captures.files(spark, str(tmp_path))
    heads = {r.trace_id[-8:-7]: r for r in captures.handshakes(files).collect()}
    assert (heads["a"].control_port, heads["a"].transport, heads["a"].protocol, bytes(heads["a"].trace_guid)) == (1981, 4, 7, bytes(range(17, 33)))
    assert "Unexpected trace magic 0x12345678" in heads["b"].error and heads["c"].error is None
    parts = captures.packets(files)
    assert {r.trace_id[-8:-7] for r in parts.where("error is not null").collect()} == {"b", "c"}
    got = captures.trace_events(parts).orderBy("seq").collect()
    one = {(r.event_name, r.scope_phase): r for r in got}
    assert [r.event_name for r in got][:2] == ["NewTrace", "EventSpec"] and [r.seq for r in got] == sorted({r.seq for r in got})
    assert one["EventSpec", "None"].fields == {"Id": "123", "Name": "GameThread"}
    f = one["BeginFrame", "None"]
    assert (f.ts_seconds, f.seconds_per_cycle, f.fields["FrameType"], f.thread_id) == (0.5, 0.001, "1", 5)
    enter, leave = one["WaitScope", "Enter"], one["WaitScope", "Leave"]
    assert (enter.cycle, leave.cycle, bytes(enter.attachment), enter.fields["TypeId"]) == (300, 360, bytes([9, 8, 7]), "13")
    assert one["BeginFrame", "Enter"].cycle == 525 and one["ThreadTiming", "None"].seconds_per_cycle == 0.001


def test_trailer_and_sizes():
    trailed = struct.pack("<HH", 7, 5 | 0x4000) + b"abc" + bytes(8)
    assert list(captures.split_packets(trailed + packet(6, b"de", True), 0)) == [(5, b"abc"), (6, b"de")]
    for broken in (trailed[:-1], struct.pack("<HH", 3, 5), packet(5, b"x")[:3]):
        with pytest.raises(captures.Damaged):
            list(captures.split_packets(broken, 0))


def test_no_files(spark, tmp_path):
    assert captures.trace_events(captures.packets(captures.files(spark, str(tmp_path)))).count() == 0
