"""Dimensions that change: values with the days from which they hold, met by facts as of their day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def intervals(history: DataFrame, keys: list[str], day: str = "as_of") -> DataFrame:
    """The history with ``valid_from`` and ``valid_to`` (the last day of the value, null for the newest)."""
    w = W.partitionBy(*keys).orderBy(day)
    return history.withColumns({"valid_from": F.col(day), "valid_to": F.date_sub(F.lead(day).over(w), 1)})


def as_of(facts: DataFrame, history: DataFrame, keys: list[str], value: str, on: str, day: str = "as_of") -> DataFrame:
    """Facts with the ``value`` that held on their day ``on``; null before the first.

    Facts and history are put in one order by day and the last value is carried on, so a key with many facts and many
    values costs one sort, not a join of all with all.  Of several values of one day the greatest holds.
    """
    older = history.groupBy(*keys, day).agg(F.max(value).alias("_value")).select(*keys, F.col(day).alias("_day"), "_value", F.lit(0).alias("_fact"), F.lit(None).cast(facts.select(F.struct("*")).schema[0].dataType).alias("_row"))
    own = facts.select(*keys, F.col(on).alias("_day"), F.lit(None).cast(dict(older.dtypes)["_value"]).alias("_value"), F.lit(1).alias("_fact"), F.struct("*").alias("_row"))
    w = W.partitionBy(*keys).orderBy("_day", "_fact").rowsBetween(W.unboundedPreceding, 0)
    return older.unionByName(own).withColumn("_value", F.last("_value", ignorenulls=True).over(w)).where("_fact = 1").select("_row.*", F.col("_value").alias(value))


def newest(history: DataFrame, keys: list[str], value: str, day: str = "as_of") -> DataFrame:
    """The value of the last day of each key."""
    return history.groupBy(*keys).agg(F.max_by(value, F.struct(day, value)).alias(value))


def with_market_value(log: DataFrame, shares: DataFrame, last_bars: DataFrame) -> DataFrame:
    """A trade log with ``mcap``: the shares that were listed on the ticker's last bar times its close; null without shares."""
    listed = as_of(last_bars.select("ticker", "last_date"), shares, ["ticker"], "shares", "last_date").select("ticker", "shares")
    return log.join(listed, "ticker", "left").withColumn("mcap", F.col("shares") * F.col("last_close")).drop("shares")
