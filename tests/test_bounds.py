"""What must not grow with the number of traces: batches that go to workers, folders of a write, and what a summary works out."""

import os

from test_captures import CLOCK, HEAD, SPECS, packet
from test_modules import Log, batch

from framelake.operators import modules
from framelake.sources import captures, sessions
from framelake.storage import BATCH_BYTES


def test_captures_come_in_batches_of_bounded_size(spark):
    """Twelve captures of 1 MB each: a worker gets no more than the bound and a row at once."""
    old = spark.conf.get(BATCH_BYTES[0], None)
    spark.conf.unset(BATCH_BYTES[0])
    try:
        data = HEAD + packet(0, CLOCK) + packet(1, SPECS)
        files = spark.createDataFrame([("a", bytearray(data))], "trace_id string, content binary")
        assert captures.packets(files).where("error is null").count() == 2
        assert int(spark.conf.get(BATCH_BYTES[0])) == BATCH_BYTES[1]
        sizes = spark.range(0, 12, 1, 1).selectExpr("repeat('x', 1 << 20) AS x").mapInArrow(lambda bs: (b.select([]).from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
        assert max(r.n for r in sizes.collect()) <= 9
    finally:
        spark.conf.set(BATCH_BYTES[0], old) if old else spark.conf.unset(BATCH_BYTES[0])


def test_folders_do_not_grow_with_traces(spark, tmp_path):
    path = f"{tmp_path}/out"
    table = spark.range(3000).selectExpr("concat('t', id) AS trace_id", "id AS seq")
    sessions.write_tables({"scopes": table}, path)
    (run,) = [r for r in os.listdir(f"{path}/scopes") if r.startswith("run=")]
    assert len([x for x in os.listdir(f"{path}/scopes/{run}") if x.startswith("trace=")]) <= sessions.FOLDERS
    sessions.write_tables({"scopes": table.where("seq % 2 = 0").selectExpr("trace_id", "seq + 10000 AS seq")}, path)
    read = lambda *of: sessions.read_tables(spark, path, ["scopes"], *of)["scopes"]
    assert read().agg({"seq": "sum"}).first()[0] == sum(range(3000)) + 1500 * 10_000 and read().count() == 3000
    assert [r.seq for r in read("t8").collect()] == [10_008] and [r.seq for r in read("t7").collect()] == [7]


def test_a_summary_pairs_no_scopes(spark, monkeypatch):
    log = Log(spark).add("BeginFrame", "Misc", ts=0.001).add("EndFrame", "Misc", ts=0.1).add("EventBatch", rate=0.001, data=batch(1, (10, 1), (60, None))).frame()
    want = modules.analyze(log)["summary"].collect()
    monkeypatch.setattr(modules.scopes, "pair_scopes", None)
    monkeypatch.setattr(modules.dimensions, "replay_timers", None)
    assert modules.import_summary(log).collect() == want and want[0].timelines == 1
