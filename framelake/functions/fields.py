"""Fields of logged events as typed columns, default names, and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the event log.
NO_PRIORITY, GAME_PRIORITY, MAIN_THREAD = 2147483647, -2, 2
FRAME_EVENTS = ["BeginFrame", "EndFrame", "BeginGameFrame", "EndGameFrame", "BeginRenderFrame", "EndRenderFrame"]
THREAD_EVENTS = ["ThreadInfo", "RegisterGameThread", "ThreadGroupBegin", "ThreadGroupEnd", "CreateThread", "SetThreadGroup", "BeginThreadGroupScope", "EndThreadGroupScope"]
CPU_EVENTS = ["EventSpec", "EventBatch", "EventBatchV2", "EventBatchV3", "MetadataSpec", "Metadata", "EndThread"]


def of_frames() -> Column:
    return (F.col("logger") == "Misc") & F.col("event_name").isin(*FRAME_EVENTS)


def of_threads() -> Column:
    return F.col("logger").isin("Misc", "$Trace", "Trace") & F.col("event_name").isin(*THREAD_EVENTS)


def of_cpu() -> Column:
    return ((F.col("logger") == "CpuProfiler") & F.col("event_name").isin(*CPU_EVENTS)) | ((F.col("logger") == "Cpu") & F.lower("scope_phase").isin("enter", "leave"))


def text_field(name: str) -> Column:
    return F.element_at("fields", name)


def long_field(name: str, default: Column | int | None = None) -> Column:
    """The field as a number; missing or no number: the default."""
    value = F.element_at("fields", name).try_cast("long")
    return value if default is None else F.coalesce(value, default if isinstance(default, Column) else F.lit(default).cast("long"))


def bytes_field(name: str) -> Column:
    """Raw bytes; Data, Metadata and Payload are the attachment where the field is absent."""
    value = F.element_at("binary_fields", name)
    return F.coalesce(value, F.col("attachment")) if name in ("Data", "Metadata", "Payload") else value


def attached(charset: str) -> Column:
    """The attachment as text without trailing NULs; none: null."""
    return F.when(F.length("attachment") > 0, F.regexp_replace(F.decode("attachment", charset), "\\x00+$", ""))


def filled(name: Column) -> Column:
    """Null where a name is blank."""
    return F.when(F.trim(name) != "", name)


def named(name: Column, form: str, number: str) -> Column:
    """A name as it is, or one made of a number where it is blank, such as <noname 7>."""
    return F.coalesce(filled(name), F.format_string(form, F.col(number)))


def frame_type() -> Column:
    """Of a frame event: by its name, else by its field; Game if that is missing or unknown."""
    field = F.lower(F.coalesce(text_field("FrameType"), F.lit("")))
    forced = F.when(F.col("event_name").endswith("RenderFrame"), "Rendering").when(F.col("event_name").endswith("GameFrame"), "Game")
    return F.coalesce(forced, F.when(field.isin("1", "rendering"), "Rendering").otherwise("Game"))


def varint(data: str) -> Column:
    """The number in the first 7-bit groups of bytes, lowest first; the group that ends it has no high bit."""
    byte = lambda i: F.conv(F.hex(F.substring(F.col(data), i, F.lit(1))), 16, 10).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("m"), F.lit(True).alias("on"))
    step = lambda a, i: F.when(a.on, F.struct((a.v + byte(i).bitwiseAND(127) * a.m).alias("v"), (a.m * 128).alias("m"), (byte(i) >= 128).alias("on"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.least(F.length(data), F.lit(9))), start, step, lambda a: a.v)


def milliseconds(us: str) -> Column:
    """Whole microseconds as text in ms with three digits."""
    return F.format_string("%d.%03d ms", F.floor(F.col(us) / 1000).cast("long"), F.pmod(F.col(us), F.lit(1000)).cast("long"))


def seconds(us: str) -> Column:
    return F.format_string("%d.%06d", F.floor(F.col(us) / 1_000_000).cast("long"), F.pmod(F.col(us), F.lit(1_000_000)).cast("long"))


def truth(flag: str) -> Column:
    return F.when(F.col(flag), "true").otherwise("false")


def guide_label(us: Column) -> Column:
    """A duration as text in ms with two digits."""
    return F.concat(F.call_function("format_number", us / 1000, F.lit("0.00")), F.lit(" ms"))


def frame_tooltip(index: str = "frame_index", us: str = "duration_us") -> Column:
    return F.concat(F.lit("Frame "), F.col(index).cast("string"), F.lit(": "), milliseconds(us))
