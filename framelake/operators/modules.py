"""Analysis of an event log: the events of frames, threads and scopes to the tables that the other operators work on.

A module is a condition on events and a function from the events that meet it to named tables. ``analyze`` runs them
all over the log of many traces at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as f
from ..storage import saved, workspace
from . import batches, dimensions, frames, scopes
from .chunks import CHUNK, carried, chunked, running

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Module:
    name: str
    handles: Callable[[], Column]
    tables: Callable[[DataFrame], Tables]


def micros(seconds: Column) -> Column:
    return F.round(seconds * 1_000_000).cast("long")


def frame_log(events: DataFrame, size: int = CHUNK) -> DataFrame:
    """trace_id, frame_type, seq, t_us, is_begin of frame events. The time is the event's own, else that of its cycle, else of
    the running sum of the cycles in attachments (one sum for the render events by name, one for all others); events
    without any are left out."""
    e = events.where(f.of_frames())
    cycle, rate = f.long_field("Cycle"), F.col("seconds_per_cycle")
    e = e.withColumn("_own", F.when(F.col("ts_seconds") > 0, F.col("ts_seconds")).otherwise(cycle * rate))
    runs = F.col("_own").isNull() & rate.isNotNull() & (F.length("attachment") > 0)
    # Sums run chunk by chunk, so that a trace's frame events fall to many tasks.
    kind = ["trace_id", "_kind"]
    e = chunked(e, size).withColumns({"_kind": F.col("event_name").endswith("RenderFrame"), "_runs": runs, "_step": F.when(runs, f.varint("attachment"))})
    e = carried(e.withColumn("_run", F.sum("_step").over(running(kind))), kind, _before=(F.sum, "_step"))
    e = e.withColumn("_sum", F.coalesce("_run", F.lit(0).cast("long")) + F.coalesce("_before", F.lit(0).cast("long")))
    runs = F.col("_runs")
    time = F.coalesce(F.col("_own"), F.when(runs, F.col("_sum") * rate))
    e = e.select("trace_id", f.frame_type().alias("frame_type"), "seq", micros(time).alias("t_us"), F.col("event_name").startswith("Begin").alias("is_begin"))
    return e.where("t_us is not null")


def thread_log(events: DataFrame) -> DataFrame:
    """Updates for fold_threads. A created thread takes the group on top of its creator's stack of group scopes; seq is the
    event's and a step, since an event may update a thread and then set its group."""
    e = events.where(f.of_threads())
    kind, own = F.col("event_name"), F.col("thread_id").cast("long")
    thread = F.when(kind == "CreateThread", f.long_field("CreatedThreadId", own)).when(kind.isin("ThreadInfo", "SetThreadGroup"), f.long_field("ThreadId", own)).otherwise(own)
    name = F.when(kind == "RegisterGameThread", "GameThread").when(kind == "CreateThread", F.coalesce(f.text_field("Name"), f.attached("UTF-16LE"))).when(kind == "ThreadInfo", f.text_field("Name"))
    priority = F.when(kind == "RegisterGameThread", F.lit(f.GAME_PRIORITY).cast("long")).when(kind == "CreateThread", f.long_field("Priority", f.NO_PRIORITY)).when(kind == "ThreadInfo", f.long_field("SortHint", f.NO_PRIORITY))
    group = F.coalesce(f.text_field("GroupName"), f.attached("UTF-8"))
    sets = F.when(kind == "ThreadInfo", f.filled(f.text_field("GroupName"))).when(kind == "SetThreadGroup", F.coalesce(group, F.lit("")))
    pushed = F.when(kind == "ThreadGroupBegin", f.filled(f.text_field("Name"))).when(kind == "BeginThreadGroupScope", f.filled(group))
    current = F.when(kind.isin("CreateThread", "BeginThreadGroupScope", "EndThreadGroupScope"), f.long_field("CurrentThreadId", own)).otherwise(own)
    e = e.select("trace_id", "seq", kind.alias("kind"), thread.alias("thread_id"), current.alias("current"), name.alias("name"), priority.cast("int").alias("priority"), sets.alias("sets"), pushed.alias("pushed"))
    e = top_of_stack(e, ["trace_id", "current"], F.when(F.col("pushed").isNotNull(), 1).when(F.col("kind").isin("ThreadGroupEnd", "EndThreadGroupScope"), -1).otherwise(0), "pushed", "top")
    e = e.where("kind IN ('ThreadInfo', 'RegisterGameThread', 'CreateThread', 'SetThreadGroup')")
    step = lambda n: F.struct(F.col("seq").alias("event"), F.lit(n).alias("step"))
    update = e.where("kind <> 'SetThreadGroup'").select("trace_id", "thread_id", step(0).alias("seq"), "name", "priority", F.lit(None).cast("string").alias("group_name"), F.lit(True).alias("is_update"))
    grouped = e.withColumn("group_name", F.when(F.col("kind") == "CreateThread", F.col("top")).otherwise(F.col("sets"))).where("group_name is not null")
    grouped = grouped.select("trace_id", "thread_id", step(1).alias("seq"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("priority"), "group_name", F.lit(False).alias("is_update"))
    return update.unionByName(grouped)


def top_of_stack(rows: DataFrame, key: list[str], move: Column, value: str, name: str) -> DataFrame:
    """rows with the value pushed last and not popped at each row, by seq. move is 1 where a row pushes its value, -1 where
    it pops (an empty stack stays empty), else 0."""
    run = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("_s", F.sum(move).over(run))
    r = r.withColumn("_depth", F.col("_s") - F.least(F.lit(0), F.min("_s").over(run)))
    # What was pushed last to a level is on it whenever the stack ends there.
    at = Window.partitionBy(*key, "_depth").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn(name, F.when(F.col("_depth") > 0, F.last(value, ignorenulls=True).over(at))).drop("_s", "_depth")


def inferred_game_thread(threads: DataFrame) -> DataFrame:
    """Where no thread of a trace is named GameThread, thread 2 is it if it has no name."""
    known = F.max(F.when(F.col("name") == "GameThread", 1).otherwise(0)).over(Window.partitionBy("trace_id"))
    is_it = (known == 0) & (F.col("thread_id") == f.MAIN_THREAD) & (F.col("name") == "UnnamedThread")
    t = threads.withColumn("_it", is_it)
    return t.withColumn("name", F.when(F.col("_it"), "GameThread").otherwise(F.col("name"))).withColumn("priority", F.when(F.col("_it"), f.GAME_PRIORITY).otherwise(F.col("priority"))).drop("_it")


def spec_log(events: DataFrame, records: DataFrame) -> DataFrame:
    """Events of timer specs for replay_timers: definitions, and the first use of each spec by a record or by metadata."""
    e = events.where(f.of_cpu())
    spec = f.long_field("Id", 0)
    merged = e.where("event_name = 'EventSpec'").withColumn("spec_id", spec)
    merged = merged.select("trace_id", "seq", F.lit("merged").alias("rule"), "spec_id", f.named(f.text_field("Name"), "<noname %d>", "spec_id").alias("name"), f.text_field("File").alias("source_file"), f.long_field("Line", 0).alias("source_line"))
    unique = e.where("event_name = 'MetadataSpec'").withColumn("spec_id", spec).withColumn("_format", f.text_field("NameFormat"))
    unique = unique.select("trace_id", "seq", F.lit("unique").alias("rule"), "spec_id", F.coalesce(f.filled(f.text_field("Name")), dimensions.inferred_name("_format"), F.format_string("<metadata %d>", "spec_id")).alias("name"), F.lit(None).cast("string").alias("source_file"), F.lit(0).cast("long").alias("source_line"))
    logged = e.where("logger = 'Cpu' AND lower(scope_phase) = 'enter'").withColumn("spec_id", 4294967295 - F.coalesce(f.long_field("TypeId"), f.long_field("Id", 0)))
    logged = logged.groupBy("trace_id", "spec_id").agg(F.min("seq").alias("seq"), F.max_by(F.coalesce(f.text_field("TypeName"), F.col("event_name")), "seq").alias("name"))
    logged = logged.select("trace_id", "seq", F.lit("unique").alias("rule"), "spec_id", "name", F.lit(None).cast("string").alias("source_file"), F.lit(0).cast("long").alias("source_line"))
    used = records.where(f"ref_kind = {batches.TIMER}").select("trace_id", F.col("ref_id").alias("spec_id"), F.col("event_seq").alias("seq"))
    used = used.unionByName(e.where("event_name = 'Metadata'").select("trace_id", f.long_field("SpecId", 0).alias("spec_id"), "seq"))
    used = used.groupBy("trace_id", "spec_id").agg(F.min("seq").alias("seq"))
    used = used.select("trace_id", "seq", F.lit("use").alias("rule"), "spec_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("source_file"), F.lit(0).cast("long").alias("source_line"))
    return merged.unionByName(unique).unionByName(logged).unionByName(used)


def metadata_rows(events: DataFrame) -> DataFrame:
    """Metadata specs of the log, for metadata_specs and with_formats."""
    names = F.element_at("field_arrays", "FieldNames") if "field_arrays" in events.columns else F.lit(None).cast("array<string>")
    e = events.where(f.of_cpu()).where("event_name = 'MetadataSpec'")
    return e.select("trace_id", "seq", f.long_field("Id", 0).alias("spec_id"), f.text_field("NameFormat").alias("format"), F.coalesce(names, F.array().cast("array<string>")).alias("field_names"))


def metadata_log(events: DataFrame, records: DataFrame) -> DataFrame:
    """Metadata instances: trace_id, id, seq, payload, spec_id. An instance that is used but never defined has no spec and
    an empty payload; each logged scope that begins is an instance without an id, told by its event (seq)."""
    e = events.where(f.of_cpu())
    rows = e.where("event_name = 'Metadata'").select("trace_id", f.long_field("Id", 0).alias("id"), "seq", f.bytes_field("Metadata").alias("payload"), f.long_field("SpecId", 0).alias("spec_id"))
    uses = records.where(f"ref_kind = {batches.METADATA}").groupBy("trace_id", F.col("ref_id").alias("id")).agg(F.min("event_seq").alias("seq"))
    uses = uses.join(rows.select("trace_id", "id").distinct(), ["trace_id", "id"], "left_anti").select("*", F.lit(b"").alias("payload"), F.lit(None).cast("long").alias("spec_id"))
    begun = records.where(f"ref_kind = {batches.LOGGED}").select("trace_id", F.col("instance").alias("seq"), F.col("ref_id").alias("spec_id"))
    logged = e.where("logger = 'Cpu'").select("trace_id", "seq", F.coalesce(f.bytes_field("Payload"), F.lit(b"")).alias("payload")).join(begun, ["trace_id", "seq"])
    return dimensions.fold_metadata(rows).unionByName(uses).unionByName(logged.withColumn("id", F.lit(None).cast("long")))


def _frames(events: DataFrame) -> Tables:
    log = frame_log(events)
    return {"frame_events": log, "frames": frames.pair_frames(log)}


def _threads(events: DataFrame) -> Tables:
    return {"thread_updates": thread_log(events)}


def _cpu(events: DataFrame) -> Tables:
    """Records are decoded once and saved: all other tables read them from there."""
    path = workspace(events.sparkSession)
    records = saved(batches.records(events), f"{path}/records")
    rows = metadata_rows(events)
    timers = saved(dimensions.with_formats(dimensions.replay_timers(spec_log(events, records)), rows), f"{path}/timers")
    return {"records": records, "timers": timers, "timer_definitions": dimensions.registry(timers, events), "metadata_instances": metadata_log(events, records), "metadata_specs": dimensions.metadata_specs(rows)}


MODULES = (Module("frames", f.of_frames, _frames), Module("threads", f.of_threads, _threads), Module("cpu", f.of_cpu, _cpu))


def analyze(events: DataFrame, modules: tuple[Module, ...] = MODULES) -> Tables:
    """The tables of all modules, and those that need several: threads, scopes (closed, with names) and durations. events
    are read once for each module: hand over a saved table. A scope's ref_kind, ref_id and instance tell what it is merged by
    (scopes.with_paths)."""
    out: Tables = {}
    for m in modules:
        out |= m.tables(events.where(m.handles()))
    if {"records", "thread_updates", "frame_events"} <= out.keys():
        out |= overview(events, out)
        r = out["records"]
        timers = out["timers"].select("trace_id", "spec_id", "name")
        pairs = scopes.pair_scopes(r.where("kind = 'scope'").withColumn("spec_id", F.struct("ref_kind", "ref_id", "instance")))
        ends = r.where("kind = 'end'").groupBy("trace_id", "thread_id").agg(F.min("t_us").alias("thread_end_us"))
        closed = scopes.close_open(pairs, out["durations"], ends).select("*", "spec_id.*").drop("spec_id")
        out["scopes"] = dimensions.resolved(closed, timers, out["metadata_instances"])
    return out


def overview(events: DataFrame, tables: Tables) -> Tables:
    """threads, durations and the summary of a log's frames, thread updates and records."""
    r = tables["records"]
    seen = r.groupBy("trace_id", "thread_id").agg(F.min("event_seq").alias("_seq"))
    seen = seen.select("trace_id", "thread_id", F.struct(F.col("_seq").alias("event"), F.lit(2).alias("step")).alias("seq"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("priority"), F.lit(None).cast("string").alias("group_name"), F.lit(False).alias("is_update"))
    threads = inferred_game_thread(dimensions.fold_threads(tables["thread_updates"].unionByName(seen)))
    out = {"threads": threads, "durations": scopes.durations(r, tables["frame_events"])}
    return out | {"summary": summary(events, tables | out)}


def import_summary(events: DataFrame) -> DataFrame:
    """The summary of ``analyze``, without the timers, pairs of scopes and metadata that it doesn't tell of."""
    records = saved(batches.records(events.where(f.of_cpu())), f"{workspace(events.sparkSession)}/records")
    tables = _frames(events.where(f.of_frames())) | _threads(events.where(f.of_threads())) | {"records": records}
    return overview(events, tables)["summary"]


def summary(events: DataFrame, tables: Tables) -> DataFrame:
    """Of each trace: events, frames by type and how many have ended, threads, threads with scopes, duration."""
    count = lambda t, **aggs: t.groupBy("trace_id").agg(*(c.alias(n) for n, c in aggs.items()))
    fr = tables["frames"]
    game = F.col("frame_type") == "Game"
    out = count(events, events=F.count("*"))
    for t in (
        count(fr, game_frames=F.count(F.when(game, 1)), rendering_frames=F.count(F.when(~game, 1)), completed_game_frames=F.count(F.when(game, F.col("end_us")))),
        count(tables["threads"], threads=F.count("*")),
        count(tables["records"], timelines=F.count_distinct("thread_id")),
        tables["durations"],
    ):
        out = out.join(t, "trace_id", "left")
    return out.fillna(0)


def coverage(events: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent kinds of events of each trace."""
    n = events.groupBy("trace_id", F.concat_ws(".", "logger", "event_name").alias("kind")).agg(F.count("*").alias("events"))
    rank = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("events"), "kind"))
    return n.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
