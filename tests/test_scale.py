"""Operators on long threads, deep stacks, bursts and many ranges: results equal to plain Python, and no step that grows with
the size of one key."""

import random
import struct

import pytest
from test_captures import CLOCK, HEAD, SPECS, packet
from test_modules import Log, batch

from framelake.operators import batches, dimensions, frames, modules, scopes
from framelake.operators.chunks import PART, chunked
from framelake.sources import captures, sessions

EVENTS = "trace_id long, thread_id long, seq long, t_us long, is_begin boolean, spec_id long"
FRAMES = "trace_id long, frame_type string, frame_index long, start_us long, end_us long"


def paired(rows):
    """The stack machine: (trace, thread, scope) to (depth, start, end, end_seq, parent)."""
    out, stacks, last = {}, {}, {}
    for trace, thread, seq, t, begin, _ in sorted(rows, key=lambda r: r[:3]):
        stack = stacks.setdefault((trace, thread), [])
        if not begin and not stack:
            continue
        t = last[trace, thread] = max(t, last.get((trace, thread), t))
        if begin:
            out[trace, thread, seq] = [len(stack) + 1, t, None, None, stack[-1] if stack else None]
            stack.append(seq)
        else:
            out[trace, thread, stack.pop()][2:4] = t, seq
    return {k: tuple(v) for k, v in out.items()}


def events_of(count, seed, share=0.9):
    """One thread has most of the rows; times go back now and then, and many ends have no begin."""
    r, rows, t = random.Random(seed), [], 0
    for i in range(count):
        t += r.randint(-3, 5)
        thread = 1 if r.random() < share else r.randint(2, 6)
        rows.append((1, thread, i, t, r.random() < (0.35 if i % 400 < 200 else 0.65), i % 7))
    return rows


@pytest.mark.parametrize("size", [1, 13, 100, 10**6])
def test_pairing_by_chunks(spark, size):
    rows = events_of(1500, size)
    got = {(r.trace_id, r.thread_id, r.scope_id): (r.depth, r.start_us, r.end_us, r.end_seq, r.parent_scope_id) for r in scopes.pair_scopes(spark.createDataFrame(rows, EVENTS), size).collect()}
    assert got == paired(rows)


def test_no_task_holds_more_than_a_chunk(spark):
    """One thread of 18,000 rows of 20,000: what is partitioned by has at most a chunk of rows, or a row for each chunk and
    level."""
    rows, size = events_of(20_000, 5), 500
    e = spark.createDataFrame(rows, EVENTS)
    parts = chunked(e, size).groupBy("trace_id", "thread_id", PART).count()
    assert parts.agg({"count": "max"}).first()[0] <= size
    got = scopes.pair_scopes(e, size)
    keys = [line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in scopes.leveled(e, size)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "windowspecdefinition(" in line]
    assert keys and all(PART in k for k in keys)
    assert got.count() == len(paired(rows))


@pytest.mark.parametrize("size", [1, 7, 10**6])
def test_frames_by_chunks(spark, size):
    r = random.Random(size)
    rows = [(k, kind, i, 10 * i, r.random() < 0.5) for k in (1, 2) for kind in ("Game", "Rendering") for i in range(200)]
    want, open_ = {}, {}
    for k, kind, _, t, begin in rows:
        if begin:
            open_[k, kind] = open_.get((k, kind), -1) + 1
            want[k, kind, open_[k, kind]] = [t, None]
        elif (k, kind) in open_:
            want[k, kind, open_[k, kind]][1] = t
    f = frames.pair_frames(spark.createDataFrame(rows, "trace_id long, frame_type string, seq long, t_us long, is_begin boolean"), size)
    assert {(x.trace_id, x.frame_type, x.frame_index): [x.start_us, x.end_us] for x in f.collect()} == want
    pos = {(x.trace_id, x.frame_type, x.frame_index): x.pos for x in frames.completed(f, size).collect()}
    done = {}
    for key in sorted(k for k, v in want.items() if v[1] is not None):
        done[key] = sum(1 for x in done if x[:2] == key[:2])
    assert pos == done


def deep(spark, n):
    rows = [(1, 1, i, i, True, 0) for i in range(n)] + [(1, 1, n + i, n + i, False, 0) for i in range(n)]
    s = scopes.pair_scopes(spark.createDataFrame(rows, EVENTS), 500).selectExpr("*", "concat('s', scope_id) AS name")
    return scopes.with_paths(s, "name", text=False, size=500)


def test_paths_of_3000_levels(spark):
    """The hash of a path is a running value: the rows don't grow with the depth, and the text comes in 12 rounds."""
    s = deep(spark, 3000)
    assert {n for n in s.schema.names if n.startswith("path")} == {"path_hash"} and s.select("path_hash").distinct().count() == 3000
    got = {r.scope_id: r for r in s.collect()}
    assert all(got[i].parent_path_hash == (got[i - 1].path_hash if i else 0) for i in range(3000))
    frame = spark.createDataFrame([(1, "Game", 0, 0, 10_000)], FRAMES)
    tree = scopes.with_text(scopes.call_tree(scopes.with_children(scopes.in_frames(s, frame))))
    assert {r.depth: r.path for r in tree.collect()} == {d: "/".join(f"s{i}" for i in range(d)) for d in range(1, 3001)}


def test_chain_of_3000_in_13_saves(spark, monkeypatch):
    nodes = spark.range(1, 3001).selectExpr("1L AS trace_id", "0L AS frame_index", "1L AS thread_id", "id AS path_hash", "id - 1 AS parent_path_hash", "concat('n', id) AS name", "id AS depth", "id > 1 AS hidden")
    saves = []
    monkeypatch.setattr(scopes, "saved", lambda df, path, save=scopes.saved: saves.append(path) or save(df, path))
    (r,) = scopes.hidden_chains(nodes).collect()
    assert r.hidden_names == [f"n{i}" for i in range(2, 3001)] and len(saves) <= 13


def test_chains_of_several_lengths(spark):
    """Chains below one node, beside each other and in another frame."""
    rows, want = [], {}
    for frame, lengths in ((0, (1, 2, 5, 17)), (1, (3,))):
        rows.append((1, frame, 1, 1, 0, "root", 1, False))
        for c, n in enumerate(lengths):
            top = 100 * (c + 1)
            rows.append((1, frame, 1, top, 1, f"top{c}", 2, False))
            rows += [(1, frame, 1, top + i, top + i - 1, f"h{c}.{i}", 2 + i, True) for i in range(1, n + 1)]
            want[frame, top] = [f"h{c}.{i}" for i in range(1, n + 1)]
        want[frame, 1] = []
    got = scopes.hidden_chains(spark.createDataFrame(rows, "trace_id long, frame_index long, thread_id long, path_hash long, parent_path_hash long, name string, depth long, hidden boolean"))
    assert {(r.frame_index, r.path_hash): r.hidden_names for r in got.collect()} == want


def test_preorder_of_random_trees(spark):
    r, rows, want = random.Random(11), [], {}
    for frame, n in ((0, 1), (1, 60), (2, 200)):
        kids, size = {0: []}, {}
        for i in range(1, n + 1):
            up = i - 1 if frame == 2 and i % 5 else r.randint(0, i - 1)
            kids.setdefault(up, []).append(i)
            kids[i] = []
        us = {i: r.randint(0, 3) for i in kids}  # many ties, told apart by name
        depth = {0: 0}

        def walk(v, frame=frame, kids=kids, us=us, depth=depth, size=size):
            at = len(size)
            size[v] = at
            for k in sorted(kids[v], key=lambda k: (-us[k], f"n{k:03}")):
                depth[k] = depth[v] + 1
                walk(k)
            if v:
                want[frame, v] = (at - 1, len(size) - at)

        walk(0)
        rows += [(1, frame, 1, k, v, f"n{k:03}", f"n{k:03}", depth[k], us[k]) for v in kids for k in kids[v]]
    t = spark.createDataFrame(rows, "trace_id long, frame_index long, thread_id long, path_hash long, parent_path_hash long, name string, step string, depth long, inclusive_us long")
    got = {(x.frame_index, x.path_hash): (x.preorder, x.descendants) for x in scopes.in_preorder(t).collect()}
    assert got == want


def bursty(n=900):
    """Frames of which most begin in one instant's neighbourhood, some at the same time."""
    r = random.Random(4)
    at = sorted([r.randint(0, 10**9) for _ in range(n // 9)] + [5 * 10**8 + r.randint(0, 300) for _ in range(n - n // 9)])
    return [(k, "Game", i, a, None if i % 50 == 7 else a + r.randint(0, 10**6)) for k in (1, 2) for i, a in enumerate(at)]


@pytest.mark.parametrize("size", [1, 20, 1000])
def test_lookup_in_a_burst(spark, size):
    rows, r = bursty(), random.Random(8)
    f = spark.createDataFrame(rows, FRAMES)
    probes = [(k, r.choice([r.randint(-5, 10**9), 5 * 10**8 + r.randint(-5, 310)])) for k in (1, 2, 3) for _ in range(300)]
    got = frames.frame_at(spark.createDataFrame(probes, "trace_id long, t long"), f, ["trace_id"], "t", "frame_index", size=size)
    of = {k: [x for x in rows if x[0] == k] for k in (1, 2, 3)}
    assert sorted(map(tuple, got.select("trace_id", "t", "frame_index").collect()), key=repr) == sorted(((k, t, max((x[2] for x in of[k] if x[3] < t), default=None)) for k, t in probes), key=repr)
    _, starts = frames.sliced(f, ["trace_id"], "frame_index", size)
    assert starts.groupBy("trace_id", "_slice").count().agg({"count": "max"}).first()[0] <= size + 5  # equal starts and the carried one


def test_ten_thousand_ranges_of_a_burst(spark):
    rows, r = bursty(), random.Random(2)
    ranges = [(1, i, a, a + r.choice([-3, 0, 20, 10**6])) for i, a in enumerate(r.choice([r.randint(0, 10**9), 5 * 10**8 + r.randint(-50, 350)]) for _ in range(10_000))]
    got = frames.intersecting(spark.createDataFrame(rows, FRAMES), spark.createDataFrame(ranges, "trace_id long, id long, lo_us long, hi_us long"), 20)
    mine, want = [x for x in rows if x[0] == 1], set()
    for _, i, lo, hi in ranges:
        before = [x for x in mine if x[3] < lo]
        last = before[-1:] if before and (before[-1][4] is None or before[-1][4] > lo) and before[-1][3] <= hi else []
        want |= {(i, x[2]) for x in [*last, *(x for x in mine if lo <= x[3] <= hi)]}
    assert {(x.id, x.frame_index) for x in got.select("id", "frame_index").collect()} == want and len(want) > 10_000


@pytest.mark.parametrize("width,size", [(0, 10_000), (100, 7), (100, 3), (2_000, 10)])
def test_every_viewport(spark, width, size):
    r = random.Random(1)
    rows = [(k, "Game", i, 100 * i, None if i % 9 == 4 else 100 * i + r.randint(0, 5)) for k, n in ((1, 60), (2, 1)) for i in range(n)]
    m, want = frames.bars_shown(width), {}
    for k in (1, 2):
        done = [x for x in rows if x[0] == k and x[4] is not None]
        for p, x in enumerate(done):
            d = sorted(y[4] - y[3] for y in done[p : p + m])
            want[k, x[2]] = (p, len(d), d[0], d[-1], (d[(len(d) - 1) // 2] + d[len(d) // 2]) / 2)
    got = frames.every_viewport(spark.createDataFrame(rows, FRAMES), width, size=size)
    assert {(x.trace_id, x.frame_index): (x.pos, x.bars, x.min_us, x.max_us, x.median_us) for x in got.collect()} == want
    assert frames.every_viewport(spark.createDataFrame([], FRAMES), width).count() == 0


def test_only_candidate_frames_are_made_rows(spark):
    f = spark.createDataFrame([(1, "Game", i, 10 * i, 10 * i + 10) for i in range(2000)], FRAMES)
    s = spark.createDataFrame([(1, 1, 1, 1, None, 5, 19_990), (1, 2, 2, 1, None, 41, 49)], "trace_id long, thread_id long, scope_id long, depth long, parent_scope_id long, start_us long, end_us long")
    tried = frames.candidates(f)
    all_ = scopes.in_frames(s, f).join(tried.select("frame_index"), "frame_index")
    cut = scopes.in_frames(s, f, only=tried)
    rows = lambda t: sorted((r.scope_id, r.frame_index, r.inclusive_us) for r in t.collect())
    assert rows(all_) == rows(cut) and cut.count() == 30 + 2 + 1 and "slice(" in cut._jdf.queryExecution().optimizedPlan().toString()


def test_write_replaces_a_trace_only(spark, tmp_path):
    path = f"{tmp_path}/out"
    of = lambda trace, n: {"scopes": spark.createDataFrame([(trace, i) for i in range(n)], "trace_id string, seq long"), "threads": spark.createDataFrame([(trace, "t")], "trace_id string, name string")}
    counts = lambda: {(r.trace_id, r["count"]) for r in sessions.read_tables(spark, path, ["scopes"])["scopes"].groupBy("trace_id").count().collect()}
    with pytest.raises(FileNotFoundError):
        sessions.read_tables(spark, path, ["scopes"])
    sessions.write_tables(of("a", 3), path)
    sessions.write_tables(of("b", 5), path)
    assert counts() == {("a", 3), ("b", 5)}
    sessions.write_tables(of("a", 2), path)
    assert counts() == {("a", 2), ("b", 5)}
    # A run that is killed after its first table: readers see what was there.
    broken = of("a", 9) | {"threads": spark.createDataFrame([("a", "x")], "trace_id string, name string").selectExpr("trace_id", "cast(raise_error('killed') AS string) AS name")}
    with pytest.raises(Exception, match="killed"):
        sessions.write_tables(broken, path)
    assert counts() == {("a", 2), ("b", 5)}
    one = sessions.read_tables(spark, path, ["scopes", "threads"], "a")
    assert one["scopes"].count() == 2 and one["threads"].columns == ["trace_id", "name"] and sessions.read_tables(spark, path, ["scopes"], "c")["scopes"].count() == 0
    assert sessions.superseded(spark, path, ["scopes", "threads"]).groupBy("table").count().collect() and {r.table for r in sessions.superseded(spark, path, ["scopes"]).collect()} == {"scopes"}


def test_large_traces_are_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sessions, "SPLIT", 100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sessions.write_tables({"scopes": spark.range(1000).selectExpr("'a' AS trace_id", "id AS seq")}, f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    t = sessions.read_tables(spark, f"{tmp_path}/out", ["scopes"])["scopes"]
    assert t.count() == 1000 and len(t.inputFiles()) > 2


def decoders(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_records_are_decoded_once(spark):
    log = Log(spark).add("EventBatch", rate=0.001, data=batch(1, (1, 200), (2, None))).add("BeginFrame", "Misc", ts=1.0)
    got = modules.analyze(log.frame())
    assert sum(decoders(t) for t in got.values()) == 0 and got["scopes"].count() == 1


def test_given_up_scopes_count_for_the_duration(spark):
    """Enter at 5 s, leave at 0.1 s, a batch at 1 ms."""
    log = Log(spark).add("A", "Cpu", phase="Enter", ts=5.0, cycle=5000).add("A", "Cpu", phase="Leave", ts=0.1, cycle=100).add("EventBatch", rate=0.001, data=batch(1, (1, 1), (2, None)))
    assert modules.analyze(log.frame())["durations"].first().duration_us == 5_000_000
    # A logged scope of a cycle that has gone by is given up at the next record, with all that wait.
    late = Log(spark).add("EventBatch", rate=0.001, data=batch(1, (50, 1), (60, None))).add("A", "Cpu", phase="Enter", ts=9.0, cycle=40).add("EventBatch", rate=0.001, data=batch(1, (70, 1), (80, None)))
    r = batches.records(late.frame()).orderBy("seq").collect()
    assert [(x.kind, x.t_us) for x in r] == [("scope", 50_000), ("scope", 60_000), ("time", 9_000_000), ("scope", 70_000), ("scope", 80_000)]


def test_logged_scopes_are_instances(spark):
    """Two logged scopes of one name under one parent stay apart; merged by name they are one."""
    log = Log(spark).add("BeginFrame", "Misc", ts=0.001).add("EndFrame", "Misc", ts=0.1)
    for a in (20, 30):
        log.add("Wait", "Cpu", phase="Enter", ts=a / 1000, cycle=a, TypeId=3, TypeName="Wait", data=bytes([a])).add("Wait", "Cpu", phase="Leave", ts=(a + 5) / 1000, cycle=a + 5)
    log.add("EventBatch", rate=0.001, data=batch(1, (10, 1), (60, None)))
    got = modules.analyze(log.frame())
    assert [(r.id, r.seq, bytes(r.payload), r.spec_id) for r in got["metadata_instances"].orderBy("seq").collect()] == [(None, 2, b"\x14", 4294967292), (None, 4, b"\x1e", 4294967292)]
    for by, nodes in (("ref", 3), ("name", 2)):
        tree = scopes.call_tree(scopes.with_children(scopes.in_frames(scopes.with_paths(got["scopes"], by, text=False), got["frames"])))
        assert tree.count() == nodes


def test_timers_lead_to_their_formats(spark):
    log = Log(spark).add("MetadataSpec", Id=401, Name="Task", NameFormat="Task %s", arrays={"FieldNames": ["Name"]}).add("MetadataSpec", Id=402, NameFormat="Job (x)").add("MetadataSpec", Id=402, NameFormat="Job %d")
    got = modules.analyze(log.add("EventSpec", Id=1, Name="Tick").frame())
    rows = {r.spec_id: (r.name, r.metadata_spec_id, r.format, r.field_names) for r in got["timers"].collect()}
    assert rows == {401: ("Task", 0, "Task %s", ["Name"]), 402: ("Job", 2, "Job %d", []), 1: ("Tick", None, None, None)}
    assert {(r.timer_id, r.name, tuple(r.spec_ids)) for r in got["timer_definitions"].collect()} == {(0, "<default>", ()), (1, "Task", (401,)), (2, "Job", (402,)), (3, "Tick", (1,))}


def test_unknown_groups_have_one_rule(spark):
    rows = [(1, 1, "Zoo"), (2, 1, "Zoo"), (2, 2, "Render"), (2, 3, None), (3, 1, "zoo"), (3, 2, "Ape")]
    t = spark.createDataFrame(rows, "trace_id long, thread_id long, group_name string").withColumn("group_rank", dimensions.group_rank())
    assert sorted((r.trace_id, r.thread_id, r.group_rank) for r in t.collect()) == [(1, 1, 10), (2, 1, 10), (2, 2, 0), (2, 3, 4294967295), (3, 1, 11), (3, 2, 10)]


@pytest.mark.parametrize("size", [1, 9, 10**6])
def test_times_by_chunks(spark, size):
    """Clock and base times as a reader that goes through the events one by one would set them."""
    r, rows = random.Random(6), []
    for i in range(400):
        thread = r.choice([0, 1, 5, 5, 6])
        kind = r.choice(["NewTrace", "ThreadTiming", "X", "X", "X"]) if thread < 2 or r.random() < 0.9 else "X"
        f = {"NewTrace": {"StartCycle": r.choice(["0", "50"]), "CycleFrequency": r.choice(["0", "1000", "250"])}, "ThreadTiming": {"BaseTimestamp": str(r.randint(-80, 90))}, "X": r.choice([{}, {"Cycle": "77"}])}[kind]
        phase = r.choice(["None", "None", "Enter", "Leave"]) if kind == "X" else "None"
        stamp = r.choice([None, 5, 1000]) if phase != "None" else None
        rows.append(("t", (0 if thread < 2 else 1 << 60) | i, thread, "$Trace" if kind != "X" else "L", kind, phase, stamp, stamp is not None and r.random() < 0.5, r.random() < 0.5, {} if phase == "Leave" else f, {}, None))
    want, clock, base, last = {}, {}, {}, {}
    for _, seq, thread, _, kind, phase, stamp, from_base, unsynced, f, *_ in sorted(rows, key=lambda x: x[1]):
        of = -1 if thread < 2 else thread
        start, rate = clock.setdefault(of, list(clock.get(-1, [0, 0])))
        cycle = None
        if phase != "None":
            cycle = None if stamp is None else stamp + ((base.get(thread) or start) if from_base else 0)
        elif rate:
            cycle = int(f["Cycle"]) if "Cycle" in f else base.get(thread) or None if unsynced else None
        want[seq] = (cycle, round(cycle / rate, 9) if cycle is not None and rate else 0.0)
        if kind == "NewTrace":
            clock[of] = [int(f["StartCycle"]) or start, int(f["CycleFrequency"]) or rate]
        elif kind == "ThreadTiming":
            base[thread] = max(0, start + int(f["BaseTimestamp"]))
    got = captures.timed(spark.createDataFrame(rows, captures.RAW), size)
    assert {x.seq: (x.cycle, round(x.ts_seconds, 9)) for x in got.collect()} == want


def test_a_whole_import_decodes_once(spark, tmp_path):
    """Files, packets, shared threads, other threads and records: a stage of Python each, and none when tables are written."""
    (tmp_path / "a.utrace").write_bytes(HEAD + packet(0, CLOCK) + packet(1, SPECS) + packet(5, struct.pack("<HQB", 11 << 1 | 1, 500, 1)))
    tables = sessions.import_traces(spark, str(tmp_path))
    plans = {n: t._jdf.queryExecution().optimizedPlan().toString() for n, t in tables.items()}
    assert {n for n, p in plans.items() if "InPandas" in p or "InArrow" in p} == {"handshakes"}
    sessions.write_tables(tables, f"{tmp_path}/out")
    again = sessions.read_tables(spark, f"{tmp_path}/out", list(tables))
    assert {n: t.count() for n, t in again.items()} == {n: t.count() for n, t in tables.items()}


def replayed(events):
    """The timers of a trace, an event at a time."""
    timers, by_name, of = [], {}, {}
    for _, _, spec, name, file, line, rule in sorted(events, key=lambda x: x[1]):
        new, known = spec not in of, rule == "merged" and name in by_name
        if new:
            of[spec] = by_name[name] if known else len(timers)
            if not known:
                timers.append([f"<unknown {spec}>", None, 0])
        if rule != "use" and not (new and known):
            timers[of[spec]] = [name, file or timers[of[spec]][1], line]
        if rule == "merged":
            by_name.setdefault(name, of[spec])
    return {s: (t + 1, *timers[t]) for s, t in of.items()}


@pytest.mark.parametrize("names", [4, 40])
def test_timers_of_random_logs(spark, names):
    r, rows = random.Random(names), []
    for trace in range(12):
        for seq in range(120):
            rule = r.choice(["merged", "merged", "merged", "unique", "use"])
            named = rule != "use"
            rows.append((trace, seq, r.randint(0, 35), f"n{r.randint(0, names)}" if named else None, r.choice([None, "a.cpp", "b.cpp"]) if named else None, r.randint(1, 9) if named else 0, rule))
    got = dimensions.replay_timers(spark.createDataFrame(rows, "trace_id long, seq long, spec_id long, name string, source_file string, source_line long, rule string"))
    assert {(x.trace_id, x.spec_id): (x.timer_id, x.name, x.source_file, x.source_line) for x in got.collect()} == {(t, s): v for t in range(12) for s, v in replayed([x for x in rows if x[0] == t]).items()}
    assert "Pandas" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_chain_of_joined_specs_takes_few_rounds(spark, monkeypatch):
    """Each spec takes the name that the one before got later on."""
    rows = []
    for i in range(300):
        rows += [(1, 2 * i, i, f"n{i}", None, 1, "merged"), (1, 2 * i + 1, i, f"n{i + 1}", None, 1, "merged")]
    saves = []
    monkeypatch.setattr(dimensions, "saved", lambda df, path, save=dimensions.saved: saves.append(path) or save(df, path))
    got = dimensions.replay_timers(spark.createDataFrame(rows, "trace_id long, seq long, spec_id long, name string, source_file string, source_line long, rule string"))
    assert {x.timer_id for x in got.collect()} == {1} and len(saves) <= 13


@pytest.mark.parametrize("size", [1, 5, 10**6])
def test_running_cycles_by_chunks(spark, size):
    from test_modules import varint

    r, log, at, want = random.Random(3), Log(spark), {}, []
    for i in range(120):
        name, own, step = r.choice(["BeginFrame", "EndFrame", "BeginRenderFrame"]), r.random() < 0.3, r.randint(0, 400)
        log.add(name, "Misc", ts=i / 10 + 1 if own else 0.0, rate=0.001, data=varint(step))
        kind = name.endswith("RenderFrame")
        if not own:
            at[kind] = at.get(kind, 0) + step
        want.append(100_000 * i + 1_000_000 if own else 1000 * at[kind])
    assert [x.t_us for x in modules.frame_log(log.frame(), size).orderBy("seq").collect()] == want
