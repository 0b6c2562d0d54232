"""Session helpers: inputs, the shared folder, partition counts, batch sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to a Python worker; texts of a batch are cut further by bytes.
BATCH_ROWS = 1024


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions of an exchange that this subpackage deals out itself."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where it is unset and all runs on this machine (tests)."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if at is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="candlewick-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(at)
    return at


def kept(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read again: cuts lineage, survives lost executors."""
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(frame.schema).parquet(at)


def most(frame: DataFrame, key: str, count: str, rows: int) -> DataFrame:
    """Rows with the highest counts, about ``rows``, decided by a histogram of some hundred classes of counts.

    Whole classes go along while there is room, and of the next one as many as there is room for, by a hash of their keys:
    no partition has to send its own candidates to the driver, and the result is as full at any size of the input.
    """
    level = F.floor(F.log2(F.expr(f"double(greatest({count}, 1))")) * 8).cast("int")
    least, part, room = 0, 1 << 16, rows
    for at, many in sorted(((r["level"], r["count"]) for r in frame.groupBy(level.alias("level")).count().collect()), reverse=True):
        least = at
        if many > room:
            part = (room << 16) // many
            break
        room -= many
    return frame.where((level > least) | (level == least) & (F.pmod(F.xxhash64(key), F.lit(1 << 16)) < part))
