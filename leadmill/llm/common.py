"""Shared helpers of the corpus operators: reading tables, cutting lineage, measured broadcasts, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word rule: space and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
#: Bytes up to which a table is joined by broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one given to setCheckpointDir.

    Where neither is set a session of one machine takes a temporary folder; a cluster has to name one."""
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


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: later
    stages start from files that survive the loss of any executor."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *written: DataFrame | str) -> None:
    """Delete folders of fresh_folder(), or the tables of materialise() in them, that no later step reads."""
    for x in written:
        for path in [x] if isinstance(x, str) else [f.rpartition("/")[0] for f in x.inputFiles()[:1]]:
            if re.search(r"-[0-9a-f]{32}$", path):
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: the lengths of texts and arrays, and 16 for each column."""
    total = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            each = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 16) if isinstance(f.dataType.elementType, T.StringType) else 16 * F.size(c)
            total = total + F.coalesce(each, F.lit(0))
    return total


def small(df: DataFrame, name: str, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df as a written table, marked for broadcast only if all its rows have at most `most_bytes`."""
    written = materialise(df, name)
    return F.broadcast(written) if (written.agg(F.sum(row_bytes(written))).first()[0] or 0) <= most_bytes else written
