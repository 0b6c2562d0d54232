"""Data-quality flags of bars.  Bad bars are flagged, never removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.functions.series import by_ticker, lag, position, yes

MIN_HISTORY, STALE_RUN, JUMP_PCT, GAP_DAYS = 200, 5, 35.0, 10


def stale_runs(bars: DataFrame) -> DataFrame:
    """Adds stale_run_length: the bar's place in its run of equal closes."""
    moved = bars.withColumn("_new", F.when(F.col("close").eqNullSafe(lag("close")) & F.col("close").isNotNull(), 0).otherwise(1))
    runs = moved.withColumn("_run", F.sum("_new").over(by_ticker().rowsBetween(W.unboundedPreceding, 0)))
    within = F.sum(F.lit(1)).over(W.partitionBy("ticker", "_run").orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    return runs.withColumn("stale_run_length", within.cast("int")).drop("_new", "_run")


def flagged(bars: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """ticker, date, six flags, their measures and is_clean; columns of the bars to ``keep`` stay."""
    step = F.expr("try_divide(close, _before) - 1") * 100
    own = stale_runs(bars.withColumns({"_before": lag("close"), "gap_days": F.datediff("date", lag("date")), "bars_available": position()}))
    own = own.withColumn("jump_pct", step)
    flags = {
        "insufficient_history": F.col("bars_available") < MIN_HISTORY,
        "stale_price": F.col("stale_run_length") >= STALE_RUN,
        "zero_volume": F.coalesce(F.col("volume"), F.lit(0)) <= 0,
        "suspicious_jump": yes((F.abs("jump_pct") > JUMP_PCT) & (F.coalesce(F.col("split_factor"), F.lit(1.0)) == 1.0)),
        "gap": yes(F.col("gap_days") > GAP_DAYS),
        "impossible_bar": yes(F.col("high") < F.col("low")) | yes(F.col("high") < F.col("open")) | yes(F.col("high") < F.col("close")) | yes(F.col("low") > F.col("open")) | yes(F.col("low") > F.col("close")),
    }
    bad = F.col("stale_price") | F.col("zero_volume") | F.col("suspicious_jump") | F.col("gap") | F.col("impossible_bar")
    return own.withColumns(flags).withColumn("is_clean", ~bad).select("ticker", "date", *flags, "stale_run_length", "jump_pct", "gap_days", "bars_available", "is_clean", *keep)


def summary(quality: DataFrame) -> DataFrame:
    """One row: tickers, bars and how many bars carry each flag."""
    names = ["insufficient_history", "stale_price", "zero_volume", "suspicious_jump", "gap", "impossible_bar"]
    return quality.agg(F.countDistinct("ticker").alias("tickers"), F.count(F.lit(1)).alias("bars"), *[F.count_if(n).alias(n) for n in names], F.count_if("is_clean").alias("clean"))


def summary_rows(quality: DataFrame) -> DataFrame:
    """The flags as rows, from one aggregation."""
    names = ["insufficient_history", "stale_price", "zero_volume", "suspicious_jump", "gap", "impossible_bar"]
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return summary(quality).selectExpr(f"stack({len(names)}, {pairs}) as (flag, bars)")


def integrity_reasons(bars: DataFrame) -> DataFrame:
    """Impossible bars with the first reason that applies."""
    reasons = [("high < low", "high_below_low"), ("high < open", "high_below_open"), ("high < close", "high_below_close"), ("low > open", "low_above_open"), ("low > close", "low_above_close"), ("least(open, high, low, close) <= 0", "non_positive_price")]
    case = F.expr("case " + " ".join(f"when {c} then '{r}'" for c, r in reasons) + " end")
    return bars.withColumn("reason", case).where("reason is not null").select("ticker", "date", "reason")
