"""Intermediate tables in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most bytes of a table that an explicit broadcast is made of.
BROADCAST_BYTES = 32 << 20
#: The session's setting by which a query's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder given to setCheckpointDir; a temporary one only in a session of one machine."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if not found:
        jvm = context._jsc.sc().getCheckpointDir()
        found = jvm.get() if jvm.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: later steps start from files that survive the loss of any executor.

    What was shuffled for it goes at once, as nothing reads it again; else it stays on disk until the driver collects garbage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked to be broadcast where its bytes (lengths of texts, 16 for every other column) are few enough.

    df is counted for that, so it should be cheap to read twice; a larger one is joined by a shuffle."""
    widths = [F.coalesce(F.octet_length(c), F.lit(0)) + 16 if t == "string" else F.lit(16) for c, t in df.dtypes]
    held = df.agg(F.coalesce(F.sum(reduce(lambda a, b: a + b, widths).cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= most else df


def discard(spark: SparkSession, *written: DataFrame) -> None:
    """Delete tables of materialise() that no later step reads."""
    for df in written:
        for file in df.inputFiles()[:1]:
            path = file.rpartition("/")[0]
            if re.search(r"-[0-9a-f]{32}$", path):
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
