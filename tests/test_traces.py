"""The frame, scope and dimension operators on small cases, and every SQL query against DuckDB."""

import random

import duckdb
import pytest

from framelake.operators import dimensions, frames, scopes
from framelake.plans import queries

SF = "/root/testdata/sf0.001"


def frame_rows(spark, *ends):
    return spark.createDataFrame([(1, "Game", i, a, b) for i, (a, b) in enumerate(ends)], "trace_id long, frame_type string, frame_index long, start_us long, end_us long")


def test_frame_lookup_is_strict(spark):
    f = frame_rows(spark, (10, 16), (16, 33))
    probes = spark.createDataFrame([(1, 10), (1, 11), (1, 16), (1, 20)], "trace_id long, t long")
    got = {r.t: r.frame_index for r in frames.frame_at(probes, f, ["trace_id"], "t", "frame_index").collect()}
    assert got == {10: None, 11: 0, 16: 0, 20: 1}


def test_lookup_by_slices(spark):
    """However finely time is cut, with gaps, equal starts and probes outside, the same frame is found."""
    rng, rows, probes = random.Random(9), [], []
    for trace in (1, 2):
        at = sorted(rng.choice([rng.randint(0, 50), rng.randint(900, 1000)]) for _ in range(40))
        rows += [(trace, "Game", i, a, a + 3) for i, a in enumerate(at)]
        probes += [(trace, t) for t in range(-3, 1010, 7)] + [(trace, t) for t in at[::3]]
    f = spark.createDataFrame([*rows, (4, "Game", 0, 5, 8)], "trace_id long, frame_type string, frame_index long, start_us long, end_us long")
    probes += [(1, None), (3, 5), (4, 5), (4, 6)]
    want = sorted((k, t, max((i for trace, _, i, a, _ in [*rows, (4, "", 0, 5, 8)] if trace == k and t is not None and a < t), default=None)) for k, t in probes if t is not None)
    p = spark.createDataFrame(probes, "trace_id long, t long")
    for size in (1, 7, 1000):
        got = [tuple(r) for r in frames.frame_at(p, f, ["trace_id"], "t", "frame_index", size=size).select("trace_id", "t", "frame_index").collect()]
        assert sorted(r for r in got if r[1] is not None) == want and (1, None, None) in got
    s = spark.createDataFrame([(k, 1, i, 1, "s", a, a + rng.randint(0, 400), None) for i, (k, a) in enumerate((k, rng.randint(-5, 1000)) for k in (1, 2, 3) for _ in range(60))], "trace_id long, thread_id long, scope_id long, depth long, name string, start_us long, end_us long, parent_scope_id long")
    one, fine = (sorted(map(str, scopes.in_frames(s, f, size).collect())) for size in (1000, 3))
    assert one == fine and len(one) > 60


def test_intersecting_takes_the_frame_before(spark):
    f = frame_rows(spark, (100, 200), (200, 300))
    r = spark.createDataFrame([(1, 195, 250)], "trace_id long, lo_us long, hi_us long")
    assert sorted(x.frame_index for x in frames.intersecting(f, r).collect()) == [0, 1]


def test_clip_children_and_flags(spark):
    rows = [(1, 1, 1, 8, True), (1, 1, 2, 12, True), (1, 1, 3, 18, False), (1, 1, 4, 22, False), (1, 2, 5, 11, True), (1, 2, 6, 13, False)]
    events = spark.createDataFrame([(*r, 0) for r in rows], "trace_id long, thread_id long, seq long, t_us long, is_begin boolean, spec_id long")
    s = scopes.pair_scopes(events).selectExpr("*", "concat('s', scope_id) AS name")
    v = {r.scope_id: r for r in scopes.with_children(scopes.in_frames(s, frame_rows(spark, (10, 20)))).collect()}
    assert (v[1].inclusive_us, v[1].exclusive_us, v[1].children_us, v[1].started_before, v[1].ended_after) == (10, 4, 6, True, True)
    assert (v[2].inclusive_us, v[2].parent_scope_id) == (6, 1) and v[5].inclusive_us == 2


def test_deep_paths(spark):
    n = 3000
    rows = [(1, 1, i, i, True, 0) for i in range(n)] + [(1, 1, n + i, n + i, False, 0) for i in range(n)]
    events = spark.createDataFrame(rows, "trace_id long, thread_id long, seq long, t_us long, is_begin boolean, spec_id long")
    s = scopes.with_paths(scopes.pair_scopes(events).selectExpr("*", "'x' AS name"))
    assert s.agg({"depth": "max"}).first()[0] == n and s.select("path_hash").distinct().count() == n


def test_paths_gather_no_thread(spark):
    """A root scope that stays open: all of the thread lies under it."""
    rng, rows, stack, want = random.Random(3), [(1, 1, 0, 0, True, 0)], ["n0"], {0: "n0"}
    for i in range(1, 600):
        if begin := rng.random() < 0.5 or len(stack) == 1:
            stack.append(f"n{i % 3}")
            want[i] = "/".join(stack)
        else:
            stack.pop()
        rows.append((1, 1, i, i, begin, i % 3))
    events = spark.createDataFrame(rows, "trace_id long, thread_id long, seq long, t_us long, is_begin boolean, spec_id long")
    s = scopes.with_paths(scopes.pair_scopes(events).selectExpr("*", "concat('n', spec_id) AS name"))
    assert "InPandas" not in s._jdf.queryExecution().toString()
    got = {r.scope_id: r for r in s.collect()}
    assert {i: r.path for i, r in got.items()} == want
    assert all(r.parent_path_hash == (got[r.parent_scope_id].path_hash if r.parent_scope_id is not None else 0) for r in got.values())
    assert len({r.path_hash for r in got.values()}) == len(set(want.values()))


def test_thread_order_and_rhi_rule(spark):
    rows = [(1, 11, 1, "WorkerA", 3, "ThreadPool"), (1, 12, 2, "RHIThread", 3, None), (1, 1, 3, "GameThread", -2, None)]
    t = dimensions.ordered_threads(dimensions.fold_threads(spark.createDataFrame(rows, "trace_id long, thread_id long, seq long, name string, priority int, group_name string")))
    assert [r.thread_id for r in t.orderBy("position").collect()] == [1, 12, 11]


def test_timer_rename_and_alias(spark):
    rows = [(1, 1, 7, "A", "a", 1), (1, 2, 7, "B", "b", 2), (1, 3, 8, "B", "c", 3)]
    got = dimensions.replay_timers(spark.createDataFrame(rows, "trace_id long, seq long, spec_id long, name string, source_file string, source_line long")).collect()
    assert {(r.spec_id, r.timer_id, r.name, r.source_file) for r in got} == {(7, 1, "B", "b"), (8, 1, "B", "b")}


def test_timers_of_all_parts(spark):
    got = queries.QUERIES["ag10_trace_timers"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/part.parquet").count() > 80
    assert got.select("trace_id").distinct().count() > 1


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "customer", "events", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    key = lambda rows: sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows], key=repr)
    assert key(map(tuple, df.select(*names).collect())) == key(want.fetchall())
