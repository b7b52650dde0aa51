"""Threads, timers and metadata: folds of update events into dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved, workspace

# The display order of the known thread groups.
GROUPS = ["Render", "AsyncLoading", "TaskGraphHigh", "TaskGraphNormal", "TaskGraphLow", "LargeThreadPool", "ThreadPool", "BackgroundThreadPool", "IOThreadPool"]
NO_GROUP, NO_PRIORITY = 4294967295, 2147483647


def fold_threads(updates: DataFrame) -> DataFrame:
    """Of updates (trace_id, thread_id, seq, name, priority, group_name): the last non-blank name, the last priority
    and group of each thread; null sets nothing, a blank group is none. An update of a thread named RHIThread puts it into
    Render, but not a row that has a false is_update. first_seen orders threads."""
    run = Window.partitionBy("trace_id", "thread_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(F.trim("name") != "", F.col("name"))
    u = updates.withColumn("name", F.last(name, ignorenulls=True).over(run))
    u = u.withColumn("group_name", F.when((F.col("name") == "RHIThread") & (F.col("is_update") if "is_update" in updates.columns else F.lit(True)), "Render").otherwise(F.col("group_name")))
    t = u.groupBy("trace_id", "thread_id").agg(F.coalesce(F.max_by("name", "seq"), F.lit("UnnamedThread")).alias("name"), F.coalesce(F.max_by("priority", F.when(F.col("priority").isNotNull(), F.col("seq"))), F.lit(NO_PRIORITY)).alias("priority"), F.max_by("group_name", F.when(F.col("group_name").isNotNull(), F.col("seq"))).alias("group_name"), F.min("seq").alias("_first"))
    t = t.withColumn("group_name", F.when(F.trim("group_name") != "", F.col("group_name")))
    return t.withColumn("first_seen", F.row_number().over(Window.partitionBy("trace_id").orderBy("_first", "thread_id")).cast("long")).drop("_first")


def group_rank(group: str = "group_name") -> Column:
    """Known groups first, then the others of a trace by name, from 10 on, then none."""
    known = F.create_map(*(x for i, g in enumerate(GROUPS) for x in (F.lit(g), F.lit(i))))[F.col(group)].cast("long")
    unknown = F.col(group).isNotNull() & known.isNull()
    other = F.dense_rank().over(Window.partitionBy("trace_id", unknown).orderBy(F.lower(group)))
    return F.when(F.col(group).isNull(), F.lit(NO_GROUP)).when(unknown, (len(GROUPS) + other).cast("long")).otherwise(known)


def ordered_threads(threads: DataFrame) -> DataFrame:
    """position: negative priorities first, then by group, priority and first sight."""
    special = F.when(F.col("priority") < 0, F.col("priority")).otherwise(NO_PRIORITY)
    usual = F.when(F.col("priority") < 0, NO_PRIORITY).otherwise(F.col("priority"))
    t = threads.withColumn("group_rank", group_rank())
    return t.withColumn("position", F.row_number().over(Window.partitionBy("trace_id").orderBy(special, "group_rank", usual, "first_seen")).cast("long"))


def replay_timers(specs: DataFrame) -> DataFrame:
    """Of spec events (trace_id, seq, spec_id, name, source_file, source_line), the timer that each spec means, with its
    name and place at the end.

    A column rule may tell merged specs (the default; one of a known name joins its timer) from unique ones and from
    uses, which make a timer <unknown N> of a spec that isn't defined yet. A null file keeps the former.

    A spec keeps the timer that its first event gives it: its own, or, if that event merges it under a name that was known
    by then, that of the spec which had the name first. So specs point to specs of earlier events, and pointer doubling
    leads all of them to the ones whose timers they are, a few rounds for any number of specs. A timer's name and place are
    those of the last event that updates it: any but a use and a first event that only joined."""
    path = workspace(specs.sparkSession)
    rule = F.col("rule") if "rule" in specs.columns else F.lit("merged")
    e = saved(specs.select("trace_id", "seq", "spec_id", "name", "source_file", F.col("source_line").cast("long"), rule.alias("rule")), f"{path}/specs")
    spec = ["trace_id", "spec_id"]
    first = e.groupBy(*spec).agg(F.min("seq").alias("first"), F.min_by(F.struct("rule", "name"), "seq").alias("f"))
    known = e.where("rule = 'merged'").groupBy(F.col("trace_id").alias("_trace"), F.col("name").alias("_name")).agg(F.min("seq").alias("_seq"), F.min_by("spec_id", "seq").alias("up"))
    joins = (F.col("trace_id") == F.col("_trace")) & F.col("f.name").eqNullSafe(F.col("_name")) & (F.col("f.rule") == "merged") & (F.col("_seq") < F.col("first"))
    now, k = saved(first.join(known, joins, "left").select(*spec, "first", F.coalesce("up", "spec_id").alias("up"), F.col("up").isNotNull().alias("joined")), f"{path}/root-0"), 0
    while True:
        above = now.select("trace_id", F.col("spec_id").alias("up"), F.col("up").alias("_up"))
        now, k = saved(now.join(above, ["trace_id", "up"]).select(*spec, "first", F.col("_up").alias("up"), "joined", (F.col("_up") != F.col("up")).alias("moved")), f"{path}/root-{k + 1}"), k + 1
        if now.where("moved").isEmpty():
            break
    own = now.where("up = spec_id").select("trace_id", F.col("spec_id").alias("up"), F.row_number().over(Window.partitionBy("trace_id").orderBy("first")).cast("long").alias("timer_id"))
    of = now.select(*spec, "up", "first", "joined").join(own, ["trace_id", "up"])
    updates = e.join(of, spec).where("rule <> 'use' AND NOT (joined AND seq = first)")
    last = updates.groupBy("trace_id", "timer_id").agg(F.max_by(F.struct("name", "source_line"), "seq").alias("l"), F.max_by("source_file", F.when(F.col("source_file").isNotNull(), F.col("seq"))).alias("source_file"))
    out = of.join(last, ["trace_id", "timer_id"], "left")
    # A timer that only uses have made has the number of its spec.
    unknown = F.format_string("<unknown %d>", "up")
    return out.select(*spec, "timer_id", F.when(F.col("l").isNull(), unknown).otherwise(F.col("l.name")).alias("name"), "source_file", F.coalesce("l.source_line", F.lit(0).cast("long")).alias("source_line"))


def fold_metadata(rows: DataFrame) -> DataFrame:
    """The last payload of each metadata instance of rows (id, seq, payload), and its last spec_id where rows have one; of
    each trace where they have a trace_id."""
    key = [c for c in ("trace_id", "id") if c in rows.columns]
    last = [F.max_by(c, "seq").alias(c) for c in ("payload", "spec_id") if c in rows.columns]
    return rows.groupBy(*key).agg(F.max("seq").alias("seq"), *last)


def metadata_specs(rows: DataFrame) -> DataFrame:
    """Of rows (trace_id, seq, format, field_names): one id for each format and list of names, from 0 on in order of first
    sight."""
    first = rows.groupBy("trace_id", "format", "field_names").agg(F.min("seq").alias("first_seq"))
    order = Window.partitionBy("trace_id").orderBy("first_seq")
    return first.withColumn("id", F.row_number().over(order).cast("long") - 1)


def with_formats(timers: DataFrame, rows: DataFrame) -> DataFrame:
    """timers (trace_id, spec_id, timer_id, and others) with metadata_spec_id, format and field_names of the metadata spec
    that defined any of a timer's specs last; null where none did. rows as for metadata_specs, with the spec_id."""
    used = rows.join(timers.select("trace_id", "spec_id", "timer_id"), ["trace_id", "spec_id"])
    last = used.groupBy("trace_id", "timer_id").agg(F.max_by(F.struct("format", "field_names"), "seq").alias("f"))
    ids = metadata_specs(rows).select(F.col("trace_id").alias("_trace"), F.col("id").alias("metadata_spec_id"), F.struct("format", "field_names").alias("_f"))
    last = last.join(ids, (F.col("trace_id") == F.col("_trace")) & F.col("f").eqNullSafe(F.col("_f")))
    return timers.join(last.select("trace_id", "timer_id", "metadata_spec_id", "f.*"), ["trace_id", "timer_id"], "left")


def registry(timers: DataFrame, traces: DataFrame) -> DataFrame:
    """A row for each timer of timers, with its specs in order, and the timer 0 that each of the traces has without any."""
    rest = [c for c in timers.columns if c not in ("trace_id", "timer_id", "spec_id")]
    own = timers.groupBy("trace_id", "timer_id").agg(F.sort_array(F.collect_list("spec_id")).alias("spec_ids"), *(F.first(c).alias(c) for c in rest))
    default = traces.select("trace_id").distinct().select("trace_id", F.lit(0).cast("long").alias("timer_id"), F.array().cast("array<long>").alias("spec_ids"), F.lit("<default>").alias("name"), F.lit(0).cast("long").alias("source_line"))
    return own.unionByName(default, allowMissingColumns=True)


def resolved(refs: DataFrame, timers: DataFrame, instances: DataFrame) -> DataFrame:
    """refs (trace_id, ref_kind, ref_id) with the name of their timer: of the spec itself, or of the metadata instance's
    (ref_kind 1) at the end of the log; <unknown> where there is none. timers: trace_id, spec_id, name; instances:
    trace_id, id, spec_id."""
    i = instances.select("trace_id", F.col("id").alias("ref_id"), F.lit(1).alias("ref_kind"), F.col("spec_id").alias("_spec"))
    r = refs.join(i, ["trace_id", "ref_id", "ref_kind"], "left")
    r = r.withColumn("spec_id", F.when(F.col("ref_kind") == 1, F.col("_spec")).otherwise(F.col("ref_id"))).drop("_spec")
    known = r.join(timers.select("trace_id", "spec_id", F.col("name").alias("_name")), ["trace_id", "spec_id"], "left")
    unknown = F.when((F.col("ref_kind") == 1) & F.col("spec_id").isNull(), "<unknown metadata>").otherwise("<unknown>")
    return known.withColumn("name", F.coalesce("_name", F.when(F.col("ref_kind").isNotNull(), unknown))).drop("_name")


def inferred_name(fmt: str) -> Column:
    """The text before the first of % space ( = in a format; the format itself if it begins with one; blank: null."""
    head = F.regexp_extract(fmt, "^([^% (=]+)", 1)
    return F.when(F.trim(fmt) == "", None).otherwise(F.when(head == "", F.col(fmt)).otherwise(head))
