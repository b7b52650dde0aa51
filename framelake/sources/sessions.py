"""One call from capture files to tables, and tables to disk and back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from ..operators import modules
from ..storage import saved, workspace
from . import captures

#: Folders of a run, to which traces are dealt by hash, so that their number doesn't grow with the traces.
FOLDERS = 64
#: Columns that order the rows of a trace, whichever a table has first, and the numbers of a file's range of it.
ORDER, SPLIT = ("seq", "scope_id", "frame_index", "packet_index", "event_seq"), 1_000_000


def import_traces(spark: SparkSession, path: str, pattern: str = "*.utrace") -> dict[str, DataFrame]:
    """All tables of the captures under path: handshakes, packet counts, the event log and what ``analyze`` makes of it.
    Packets, events and records are decoded once each and saved; all tables are read from them."""
    work = workspace(spark)
    files = captures.files(spark, path, pattern)
    packets = saved(captures.packets(files), f"{work}/packets")
    events, definitions = captures.decoded(packets)
    events = saved(events, f"{work}/events")
    counts = packets.groupBy("trace_id").agg(F.count("packet_index").alias("packets"), F.max("error").alias("error"))
    return {"handshakes": captures.handshakes(files), "packet_counts": counts, "event_definitions": definitions, "events": events} | modules.analyze(events)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Adds the traces of the tables to those under path, or puts them in place of what a table had of the same trace.

    Rows go to new folders, by table, run and hash of the trace, files to ranges of a trace's order, with traces in order. The manifest, a row for each table and
    trace, is appended to when all are written, as one file: until then readers see the state before, and what a killed
    run left is never read. No table may be called manifest. Runs at the same time must write different traces."""
    spark = next(iter(tables.values())).sparkSession
    run = f"run-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table = table.withColumn("trace", F.pmod(F.xxhash64("trace_id"), F.lit(FOLDERS)))
        table.repartition("trace", *_range(table)).sortWithinPartitions("trace", "trace_id").write.partitionBy("trace").parquet(f"{path}/{name}/run={run}")
    rows = spark.createDataFrame([(n, None, t.schema.json()) for n, t in tables.items()], "table string, trace_id string, schema string")
    for n, t in tables.items():
        traces = spark.read.schema(t.schema).parquet(f"{path}/{n}/run={run}").select(F.lit(n).alias("table"), "trace_id").distinct()
        rows = rows.unionByName(traces.where("trace_id is not null"), allowMissingColumns=True)
    before = _manifest(spark, path)
    version = 1 + ((before.agg(F.max("version")).first()[0] or 0) if before else 0)
    rows = rows.select("table", "trace_id", "schema", F.lit(run).alias("run"), F.lit(version).cast("long").alias("version"))
    rows.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _range(table: DataFrame) -> list[Column]:
    of = [c for c in ORDER if c in table.columns and isinstance(table.schema[c].dataType, IntegralType)]
    return [F.floor(F.col(of[0]) / SPLIT)] if of else []


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema("table string, trace_id string, schema string, run string, version long").parquet(f"{path}/manifest") if found else None


def current_runs(spark: SparkSession, path: str) -> DataFrame:
    """table, trace_id and the run that wrote it last; a table's own row, without a trace, has its last schema."""
    m = _manifest(spark, path)
    if m is None:
        raise FileNotFoundError(f"nothing has been written to {path}")
    return m.groupBy("table", "trace_id").agg(F.max_by("run", F.struct("version", "run")).alias("run"), F.max_by("schema", F.struct("version", "run")).alias("schema"))


def read_tables(spark: SparkSession, path: str, names: list[str], trace_id: str | None = None) -> dict[str, DataFrame]:
    """The tables as written; of one trace only its folder of a run is read (tables of former versions have one for each trace)."""
    runs, out = current_runs(spark, path), {}
    schemas = {r["table"]: StructType.fromJson(json.loads(r["schema"])) for r in runs.where(F.col("trace_id").isNull() & F.col("table").isin(*names)).collect()}  # a row for each name
    for name in names:
        table = spark.read.schema(schemas[name].add("run", "string").add("trace", "long")).parquet(f"{path}/{name}")
        run = runs.where((F.col("table") == name) & F.col("trace_id").isNotNull()).select("trace_id", "run")
        if trace_id is not None:
            last = run.where(F.col("trace_id") == trace_id).first()
            key = F.xxhash64(F.lit(trace_id))
            folder = F.col("trace").isin(F.pmod(key, F.lit(FOLDERS)), key)
            table = table.where((F.col("run") == (last["run"] if last else "")) & folder & (F.col("trace_id") == trace_id))
        else:
            table = table.join(run, ["trace_id", "run"], "left_semi")
        out[name] = table.drop("run", "trace")
    return out


def superseded(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """table and run of the folders that no reader needs any more: replaced whole, or left by a killed run."""
    there = None
    for name in names:
        runs = spark.read.schema("run string, trace long").parquet(f"{path}/{name}").select(F.lit(name).alias("table"), "run").distinct()
        there = runs if there is None else there.unionByName(runs)
    return there.join(current_runs(spark, path).where("trace_id is not null").select("table", "run").distinct(), ["table", "run"], "left_anti")
