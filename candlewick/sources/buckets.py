"""Fact tables dealt by ticker when they are written, so that joins and windows by ticker read them as they lie.

All tables of a set have the same number of buckets, each one file sorted by ticker and day.  A join of two of them on
ticker and day, and a window over a ticker's days, need no exchange, whatever their size.  The planner is told that rows
dealt by ticker are dealt well enough for a join on ticker and day, in a session of the set's own, so that the caller's
settings stay as they are.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.sources.snapshots import shared_root

KEYS = ["ticker", "date"]


@dataclass(frozen=True)
class Bucketed:
    """Tables of one set, by name, in the catalog, and the session to read them in."""

    spark: SparkSession
    names: dict[str, str]

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name])

    def drop(self) -> None:
        """The catalog's entries; the files stay for whoever still reads them."""
        for name in self.names.values():
            self.spark.sql(f"drop table if exists {name}")


def bucketed(spark: SparkSession, buckets: int | None = None, **frames: DataFrame) -> Bucketed:
    """Writes the frames, which have ticker and date, in so many buckets (as many as shuffle partitions by default)."""
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    mark, names = uuid.uuid4().hex, {}
    for name, frame in frames.items():
        names[name] = f"candlewick_{name}_{mark}"
        # one task a bucket, so one file a bucket
        dealt = frame.repartition(n, "ticker").sortWithinPartitions(*KEYS)
        dealt.write.bucketBy(n, "ticker").sortBy(*KEYS).format("parquet").option("path", f"{shared_root(spark)}/buckets-{mark}/{name}").saveAsTable(names[name])
    reader = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        reader.conf.set(key, spark.conf.get(key))
    reader.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return Bucketed(reader, names)


def chained(tables: Bucketed, first: str, *others: str) -> DataFrame:
    """Every row of the first table with what the others hold of its ticker and day, by merge joins of equal buckets."""
    out = tables.read(first)
    for name in others:
        out = out.join(tables.read(name).hint("merge"), KEYS, "left")
    return out


def newest(frame: DataFrame) -> DataFrame:
    """The last day of each ticker; of bucketed rows without an exchange."""
    return frame.withColumn("_n", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date")))).where("_n = 1").drop("_n")
