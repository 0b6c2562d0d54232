"""A sample of names that is the same on any partitioning, and what a second source says of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.operators.store import refetch_differences


def draw(key: str, seed: int) -> Column:
    """A name's place in the draw: the hash of seed and name, which no order of rows or partitions changes."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256)


def sampled(frame: DataFrame, key: str, k: int, seed: int = 0, by: str | None = None) -> DataFrame:
    """The rows of the k names with the lowest draws, of all or of each value of ``by``.

    Each task keeps its own k before anything moves.
    """
    own = frame.where(F.col(key).isNotNull()).select(key, *[c for c in [by] if c]).distinct().withColumn("_draw", draw(key, seed))
    if by is None:
        chosen = own.orderBy("_draw", key).limit(k)
    else:
        chosen = own.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy("_draw", key))).where(F.col("_n") <= k)
    return frame.join(chosen.select(key).distinct(), key, "left_semi")


def verified(stored: DataFrame, fetched: DataFrame, names: DataFrame, tolerance_pct: float = 0.5) -> DataFrame:
    """Of each sampled name: bars that both sources have, bars whose close differs, whether the second knows it at all."""
    chosen = names.select("ticker").distinct()
    own, other = stored.join(chosen, "ticker", "left_semi"), fetched.join(chosen, "ticker", "left_semi")
    met = own.select("ticker", "date").join(other.select("ticker", "date"), ["ticker", "date"]).groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"))
    differ = refetch_differences(own, other, tolerance_pct).groupBy("ticker").agg(F.count(F.lit(1)).alias("differing"))
    known = other.select("ticker").distinct().withColumn("known", F.lit(True))
    out = chosen.join(met, "ticker", "left").join(differ, "ticker", "left").join(known, "ticker", "left")
    return out.select("ticker", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("bars", F.lit(0)).alias("bars"), F.coalesce("differing", F.lit(0)).alias("differing"))
