"""What the labels say about the tiers, against buying anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.operators.quantiles import quantiles
from candlewick.sources.snapshots import spilled


def tiered(labels: DataFrame, signals: DataFrame) -> DataFrame:
    return labels.join(signals.select("ticker", F.col("date").alias("entry_date"), "tier"), ["ticker", "entry_date"])


def _return() -> Column:
    return F.coalesce("return_pct", "gross_return_pct")


def tier_summary(rows: DataFrame) -> DataFrame:
    r = _return()
    own = rows.where(r.isNotNull() & F.col("tier").isNotNull())
    return own.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"), (F.avg((r > 0).cast("double")) * 100).alias("win_pct"), F.avg(r).alias("mean_return"), F.median(r).alias("median_return"), F.avg("mae").alias("mean_mae"), F.median("mae").alias("median_mae"), F.avg("mfe").alias("mean_mfe"), F.avg("bars_held").alias("mean_bars"), (F.avg((F.col("outcome") == "target").cast("double")) * 100).alias("target_pct")
    )


def tier_by_year(rows: DataFrame) -> DataFrame:
    r = _return()
    return rows.where(r.isNotNull() & F.col("tier").isNotNull()).groupBy(F.year("entry_date").alias("yr"), "tier").agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean_return"))


def tier_pivot(rows: DataFrame) -> DataFrame:
    """Years by tiers: means and counts, and the year's count."""
    year = tier_by_year(rows)
    wide = year.groupBy("yr").pivot("tier", ["A", "B", "C", "D"]).agg(F.first("mean_return").alias("mean"), F.first("n").alias("n"))
    return wide.withColumn("total", sum((F.coalesce(F.col(f"{t}_n"), F.lit(0)) for t in "ABCD"), F.lit(0)))


def mae_quantiles(rows: DataFrame) -> DataFrame:
    """Adverse excursions by tier, named by the share of trades that stay inside: p75 is the lower quartile."""
    own = spilled(rows.where(F.col("tier").isNotNull() & (F.col("outcome") != "open")).select("tier", "mae"), "excursions")
    counts = own.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(quantiles(own, ["tier"], {"p50": ("mae", 0.5), "p75": ("mae", 0.25), "p90": ("mae", 0.1), "p99": ("mae", 0.01)}), "tier", "left")


def baseline(bars: DataFrame, horizon: int, keys: list[str], buy_fee: float = 0.0, sell_fee: float = 0.0) -> DataFrame:
    """Buying at the next bar's open and selling at the close ``horizon`` bars on, from every bar; give clean bars only.

    The returns of all bars are one group; its median comes from histograms, not from a task that holds them.
    """
    w = W.partitionBy(*keys).orderBy("date")
    own = bars.withColumns({"_buy": F.lead("open", 1).over(w), "_sell": F.lead("close", horizon).over(w)}).where("_buy > 0 and _sell is not null")
    r = spilled(own.select(((F.col("_sell") * (1 - sell_fee) / (F.col("_buy") * (1 + buy_fee)) - 1) * 100).alias("r")), "returns")
    means = r.agg(F.count(F.lit(1)).alias("n"), (F.avg((F.col("r") > 0).cast("double")) * 100).alias("win_pct"), F.avg("r").alias("mean_return"))
    return means.join(quantiles(r, [], {"median_return": ("r", 0.5)}), how="left")


def index_baseline(index: DataFrame, horizon: int) -> DataFrame:
    """The index alone, close to close, without fees: one short series."""
    own = index.withColumn("series", F.lit("index"))
    w = W.partitionBy("series").orderBy("date")
    r = (F.lead("close", horizon).over(w) / F.col("close") - 1) * 100
    return own.withColumn("r", r).where("r is not null").agg(F.count(F.lit(1)).alias("n"), (F.avg((F.col("r") > 0).cast("double")) * 100).alias("win_pct"), F.avg("r").alias("mean_return"), F.median("r").alias("median_return"))


def ranks_monotonically(tiers: DataFrame, least: int = 30) -> bool | None:
    """Whether means fall from the best tier down; None for fewer than two tiers of enough trades (a handful of rows)."""
    means = [r["mean_return"] for r in tiers.where(F.col("n") >= least).orderBy("tier").collect()]
    return None if len(means) < 2 else all(a > b for a, b in zip(means, means[1:]))
