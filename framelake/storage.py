"""Tables that cut lineage: written to a folder that the driver and all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Most bytes of a batch that a session sends to a worker, unless the session sets another bound.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def bounded(df: DataFrame) -> DataFrame:
    """df, of which workers get batches of bounded size from here on: one row may hold a whole capture, or the events of one."""
    name, size = BATCH_BYTES
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, size)
    return df


def workspace(spark: SparkSession, prefix: str = "work") -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary folder if Spark runs in one process, as
    in tests; on a cluster no such folder is shared, so there it is an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(context, "_workspace", None) or "file://" + tempfile.mkdtemp(prefix="spark-work-")
        context._workspace = base
    return f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """The table as written to the shared folder: the lineage is cut, and a lost executor repeats no earlier stage."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
