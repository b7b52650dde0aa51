"""Frames: pairing, lookup by time, intersection with ranges, bars and their statistics."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved, workspace
from .chunks import CHUNK, PART, carried, chunked, running

SERIES = ["trace_id", "frame_type"]
#: Frames of a slice in which frames are looked up together, and the most slices of a key: their bounds are one array.
SLICE, MOST = 1_000, 4_096


def pair_frames(events: DataFrame, size: int = CHUNK) -> DataFrame:
    """trace_id, frame_type, frame_index, start_us, end_us (null while open). A Begin opens a frame; an End sets the end
    of the frame begun last, the last End winning; an End before any Begin is ignored. Begins are counted chunk by chunk of
    seq, so that a series of any length falls to many tasks."""
    e = chunked(events, size).withColumn("_begun", F.col("is_begin").cast("long"))
    e = carried(e.withColumn("_n", F.sum("_begun").over(running(SERIES))), SERIES, _before=(F.sum, "_begun"))
    rows = e.withColumn("frame_index", F.col("_n") + F.coalesce("_before", F.lit(0)) - 1).where("frame_index >= 0")
    return rows.groupBy(*SERIES, "frame_index").agg(F.min(F.when(F.col("is_begin"), F.col("t_us"))).alias("start_us"), F.max_by("t_us", F.when(~F.col("is_begin"), F.col("seq"))).alias("end_us"))


def completed(frames: DataFrame, size: int = CHUNK) -> DataFrame:
    """Frames that have ended, with their position pos among them."""
    f = chunked(frames.where("end_us is not null"), size, "frame_index").withColumn("_one", F.lit(1).cast("long"))
    f = carried(f.withColumn("_n", F.sum("_one").over(running(SERIES, "frame_index"))), SERIES, _before=(F.sum, "_one"))
    return f.withColumn("pos", F.col("_n") + F.coalesce("_before", F.lit(0)) - 1).drop("_n", "_before", "_one", PART)


def duration(start: str = "start_us", end: str = "end_us") -> Column:
    return F.when(F.col(end).isNotNull(), F.greatest(F.lit(0), F.col(end) - F.col(start)))


def frame_bars(frames: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Frames with their durations, of ranges those that intersect each; an open frame has none."""
    return (frames if ranges is None else intersecting(frames, ranges)).withColumn("duration_us", duration())


def count_to(values: Column, x: Column) -> Column:
    """How many of sorted values are at most x, by binary search; of no array: 0."""
    start = F.struct(F.lit(0).alias("lo"), F.coalesce(F.size(values), F.lit(0)).alias("hi"))
    mid = lambda a: F.floor((a.lo + a.hi) / 2).cast("int")
    half = lambda a, _: F.when(a.lo >= a.hi, a).when(F.get(values, mid(a)) <= x, F.struct((mid(a) + 1).alias("lo"), a.hi.alias("hi"))).otherwise(F.struct(a.lo.alias("lo"), mid(a).alias("hi")))
    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1), F.size(values)) + 1)).cast("int")), start, half, lambda a: a.lo)


def sliced(frames: DataFrame, keys: list[str], index: str, size: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """Cuts each key's frames into slices of so many frames each, but for at most MOST slices, however their times are
    spread. Returns the bounds (keys, _bounds: the sorted first starts of the slices), and the starts to look up in each
    slice: keys, _slice, _at, _f (the index; of equal starts the last). A slice also has the last start of those before it,
    so that a slice is looked up alone, however many probes a key has."""
    each = frames.groupBy(*keys).agg(F.greatest(F.lit(size), F.ceil(F.count("*") / MOST)).cast("long").alias("_each"))
    at = frames.groupBy(*keys, F.col("start_us").alias("_at")).agg(F.max(index).alias("_f"))
    first = at.join(each, keys).groupBy(*keys, F.floor(F.col("_f") / F.col("_each"))).agg(F.min("_at").alias("_at"))
    bounds = first.groupBy(*keys).agg(F.sort_array(F.collect_set("_at")).alias("_bounds"))
    starts = at.join(bounds, keys).select(*keys, count_to(F.col("_bounds"), F.col("_at")).alias("_slice"), "_at", "_f")
    last = starts.groupBy(*keys, "_slice").agg(F.max(F.struct("_at", "_f")).alias("_last"))
    slices = bounds.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_bounds"))).alias("_slice"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = slices.join(last, [*keys, "_slice"], "left").withColumn("_last", F.max("_last").over(before)).where("_last is not null")
    return bounds, starts.unionByName(carry.select(*keys, "_slice", "_last.*"))


def slice_of(time: str) -> Column:
    """The slice of a time, from the bounds beside it."""
    return count_to(F.col("_bounds"), F.col(time))


def looked_up(probes: DataFrame, starts: DataFrame, keys: list[str], time: str, at: str, name: str) -> DataFrame:
    """probes and the index of the last start strictly before their time, or null; at has the time's slice. One sorted
    pass over probes and starts together: a probe sorts before a start of its time."""
    rows = probes.withColumn("_f", F.lit(None).cast("long"))
    rows = rows.unionByName(starts.withColumnsRenamed({"_at": time, "_slice": at}), allowMissingColumns=True)
    w = Window.partitionBy(*keys, at).orderBy(time, F.col("_f").isNotNull(), "_f").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last("_f", ignorenulls=True).over(w)).where("_f is null").drop("_f")


def frame_at(probes: DataFrame, frames: DataFrame, keys: list[str], time: str, index: str, name: str = "frame_index", size: int = SLICE) -> DataFrame:
    """probes with the index of the last frame that starts strictly before their time, or null; frames' ends don't
    matter."""
    bounds, starts = sliced(frames, keys, index, size)
    placed = probes.join(bounds, keys, "left").withColumn("_s", slice_of(time)).drop("_bounds")
    return looked_up(placed, starts, keys, time, "_s", name).drop("_s")


def intersecting(frames: DataFrame, ranges: DataFrame, size: int = SLICE) -> DataFrame:
    """Of ranges (trace_id, lo_us, hi_us, and others): the frames that start in them, both ends included, and the last frame
    before them if it is open or ends after lo_us. A range goes to the slices that it crosses, so that it meets the frames
    of its first and last slice that it doesn't take, and no others."""
    path = workspace(frames.sparkSession)
    frames = saved(frames, f"{path}/frames")
    bounds, starts = sliced(frames, SERIES, "frame_index", size)
    bounds = saved(bounds, f"{path}/bounds")
    r = ranges.join(bounds, "trace_id").withColumns({"_s0": slice_of("lo_us"), "_s1": slice_of("hi_us")}).drop("_bounds")
    f = frames.join(bounds, SERIES).withColumn("_slice", slice_of("start_us")).drop("_bounds")
    each = r.where("_s0 <= _s1").withColumn("_slice", F.explode(F.sequence("_s0", "_s1"))).drop("_s0", "_s1")
    inside = each.join(f, [*SERIES, "_slice"]).where("start_us BETWEEN lo_us AND hi_us").drop("_slice")
    before = looked_up(r, starts, SERIES, "lo_us", "_s0", "frame_index").drop("_s0", "_s1")
    last = before.join(frames, [*SERIES, "frame_index"]).where("start_us <= hi_us AND (end_us IS NULL OR end_us > lo_us)")
    return inside.unionByName(last)


def bar_statistics(frames: DataFrame, include_open: bool = False) -> DataFrame:
    """Least, most and exact median duration of the bars of each series; the median is 1/60 s where there is none."""
    bars = frame_bars(frames if include_open else frames.where("end_us is not null"))
    return bars.groupBy(*SERIES).agg(F.count("*").alias("bars"), F.min("duration_us").alias("min_us"), F.max("duration_us").alias("max_us"), F.coalesce(F.median("duration_us"), F.lit(1e6 / 60)).alias("median_us"))


def height(d: Column, least: Column, most: Column, low: float = 4.0, high: float = 150.0) -> Column:
    """A bar's height: durations scaled to low..high; all equal gives high."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (d - least) / (most - least)))
    return F.when(most == least, F.lit(high)).otherwise(low + share * (high - low))


def sized(frames: DataFrame) -> DataFrame:
    """Completed frames with _n, the number of them in their series."""
    f = completed(frames)
    return f.join(f.groupBy(*SERIES).agg(F.count("*").alias("_n")), SERIES)


def bars_shown(width: int, bar_width: int = 8) -> int:
    """Bars that a viewport shows, with the gap of 2 between them."""
    return max(1, -(-width // (bar_width + 2)) + 1)


def viewport(frames: DataFrame, offset: int, width: int, bar_width: int = 8) -> DataFrame:
    """The bars of each series that a viewport shows, with their heights among those shown."""
    first = F.least(F.col("_n") - 1, F.lit(offset // (bar_width + 2)))
    shown = sized(frames).where((F.col("pos") >= first) & (F.col("pos") < first + bars_shown(width, bar_width))).drop("_n")
    w = Window.partitionBy(*SERIES)  # the bars of a viewport
    return frame_bars(shown).withColumn("height", height(F.col("duration_us"), F.min("duration_us").over(w), F.max("duration_us").over(w)))


def guides(frames: DataFrame, offset: int, width: int) -> DataFrame:
    """Heights of the budgets 1/30, 1/60 and 1/120 s and of the median, on the scale of the bars shown."""
    stat = viewport(frames, offset, width).groupBy(*SERIES).agg(F.min("duration_us").alias("min_us"), F.max("duration_us").alias("max_us"), F.median("duration_us").alias("median_us"))
    return _lines(stat, SERIES)


def _lines(stat: DataFrame, keys: list[str]) -> DataFrame:
    line = F.explode(F.array(*(F.struct(F.lit(n).alias("guide"), v.alias("us")) for n, v in (("30", F.lit(1e6 / 30)), ("60", F.lit(1e6 / 60)), ("120", F.lit(1e6 / 120)), ("median", F.col("median_us"))))))
    return stat.withColumn("g", line).select(*keys, F.col("g.guide").alias("guide"), height(F.col("g.us"), F.col("min_us"), F.col("max_us")).alias("height"))


def every_viewport(frames: DataFrame, width: int, bar_width: int = 8, size: int = 10_000) -> DataFrame:
    """For each completed frame as the first one shown: frame_index, pos, bars, and the least, most and exact median duration
    of the bars that the viewport shows. Positions fall into slices that overlap by a viewport; in a slice the durations of
    the window are kept in order, so that a step takes one out and puts one in."""
    m = bars_shown(width, bar_width)
    f = frame_bars(completed(frames)).select(*SERIES, "pos", "frame_index", "duration_us")
    own = F.floor(F.col("pos") / size)
    f = f.withColumn("_slice", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("pos") - (m - 1)) / size)), own)))

    def slide(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        d = part["duration_us"].tolist()
        n = int((part["pos"] // size == part["_slice"]).sum())
        window, out = sorted(d[:m]), []
        for p in range(n):
            k = len(window)
            out.append((k, window[0], window[-1], (window[(k - 1) // 2] + window[k // 2]) / 2))
            del window[bisect_left(window, d[p])]
            if p + m < len(d):
                insort(window, d[p + m])
        return part[[*SERIES, "frame_index", "pos"]].head(n).assign(**dict(zip(("bars", "min_us", "max_us", "median_us"), zip(*out))))

    kinds = ", ".join(f"{k} {f.schema[k].dataType.simpleString()}" for k in (*SERIES, "frame_index", "pos"))
    return f.groupBy(*SERIES, "_slice").applyInPandas(slide, f"{kinds}, bars long, min_us long, max_us long, median_us double")


def every_guide(viewports: DataFrame) -> DataFrame:
    """Of every_viewport: the heights of the guides in each."""
    return _lines(viewports, [*SERIES, "frame_index"])


def candidates(frames: DataFrame) -> DataFrame:
    """The completed frames that are tried as default: every fourth of the first 120, the quarter, half and last."""
    pos, n = F.col("pos"), F.col("_n")
    return sized(frames).where(((pos % 4 == 0) & (pos < 120)) | (pos == F.floor(n / 4)) | (pos == F.floor(n / 2)) | (pos == n - 1)).drop("_n")
