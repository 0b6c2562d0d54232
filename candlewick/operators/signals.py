"""Two-axis trend signals: how deep the averages are aligned, and whether momentum agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions import series as S
from candlewick.operators.indicators import moving_averages, recursive
from candlewick.operators.quality import flagged

#: Bars that a depth needs, and how many bars a bad bar taints it.
NEEDS = {5: 200, 4: 100, 3: 50}
TAINT = {5: 200, 4: 100, 3: 50, 0: 5}
COLUMNS = ["ticker", "date", "alignment_depth", "rsi_gate", "above_ma5", "days_since_ma5_cross", "tier", "data_quality", "bars_available"]


def depth_of_averages() -> Column:
    three = S.yes((F.col("ma5") > F.col("ma20")) & (F.col("ma20") > F.col("ma50")))
    four = S.yes(F.col("ma50") > F.col("ma100"))
    five = S.yes(F.col("ma100") > F.col("ma200"))
    return F.when(three & four & five, 5).when(three & four, 4).when(three, 3).otherwise(0)


def tier_of(depth: Column, gate: Column) -> Column:
    passed = S.yes(gate)
    return F.when(depth == 5, F.when(passed, "A").otherwise("B")).when(depth == 4, F.when(passed, "B").otherwise("C")).when(depth == 3, F.when(passed, "C").otherwise("D"))


def days_since_cross() -> Column:
    """Bars since the close last rose over its five-bar average; null below it.  The first bar above counts as a cross."""
    above = S.yes(F.col("close") > F.col("ma5"))
    was = F.coalesce(F.lag(above, 1).over(S.by_ticker()), F.lit(False))
    return F.when(above, S.since(above & ~was))


def signals(bars: DataFrame) -> DataFrame:
    from candlewick.sources.bars import with_actions

    # averages, flags, the recursion and what follows share the partitioning by ticker: one exchange
    averages = ("ma5", "ma20", "ma50", "ma100", "ma200")
    own = flagged(moving_averages(with_actions(bars)), ("high", "low", "close", *averages)).withColumn("_bad", F.col("suspicious_jump") | F.col("impossible_bar"))
    own = recursive(own, ["rsi14"], ("close", *averages, "bars_available", "stale_price", "_bad"))
    deep = F.col("_depth")
    capped = F.when((deep == 5) & (F.col("bars_available") >= NEEDS[5]), 5).when((deep >= 4) & (F.col("bars_available") >= NEEDS[4]), 4).when((deep >= 3) & (F.col("bars_available") >= NEEDS[3]), 3).otherwise(0)
    own = own.withColumns({"_depth": depth_of_averages(), "days_since_ma5_cross": days_since_cross(), "_since": S.since(S.yes(F.col("_bad")))}).withColumn("alignment_depth", capped)
    own = own.withColumns({"rsi_gate": F.col("rsi14") > 50, "above_ma5": F.when(F.col("ma5").isNotNull(), F.col("close") > F.col("ma5"))})
    reach = F.create_map(*[F.lit(x) for pair in TAINT.items() for x in pair])[F.col("alignment_depth")]
    state = F.when(F.col("bars_available") < NEEDS[5], "insufficient_history").when(S.yes(F.col("_since") <= reach), "suspect").when(S.yes(F.col("stale_price")), "stale").otherwise("ok")
    return own.withColumns({"tier": tier_of(F.col("alignment_depth"), F.col("rsi_gate")), "data_quality": state}).select(*COLUMNS)


def criteria(depth: Column, gate: Column) -> Column:
    """Labels that hold: K1 to K3 by depth 5, 4 and 3; K4 to K6 likewise with the gate."""
    passed = S.yes(gate)
    names = [("K1", 5, F.lit(True)), ("K2", 4, F.lit(True)), ("K3", 3, F.lit(True)), ("K4", 5, passed), ("K5", 4, passed), ("K6", 3, passed)]
    return F.concat_ws(", ", *[F.when((depth >= d) & ok, k) for k, d, ok in names])


def latest(signals_: DataFrame) -> DataFrame:
    """The last signal of every ticker, best first."""
    w = S.W.partitionBy("ticker").orderBy(F.desc("date"))
    return signals_.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def screened(rows: DataFrame, min_depth: int = 3, max_days: int = 250, hide_unclean: bool = True, hide_short: bool = True) -> DataFrame:
    """The screener's filters; unknown activity counts as active."""
    keep = S.yes(F.col("rsi_gate")) & S.yes(F.col("above_ma5")) & (F.col("alignment_depth") >= min_depth)
    if "is_active" in rows.columns:
        keep &= F.coalesce("is_active", F.lit(True))
    if max_days < 250:
        keep &= F.coalesce("days_since_ma5_cross", F.lit(9999)) <= max_days
    if hide_unclean:
        keep &= ~F.col("data_quality").isin("stale", "suspect")
    if hide_short:
        keep &= F.col("data_quality") != "insufficient_history"
    return rows.where(keep)


def counts_by_day(signals_: DataFrame, days: int = 60) -> DataFrame:
    """Qualifying tickers of each of the last days."""
    day = signals_.groupBy("date").agg(
        F.count_if((F.col("alignment_depth") == 5) & S.yes(F.col("rsi_gate"))).alias("depth5_gated"),
        F.count_if((F.col("alignment_depth") >= 4) & S.yes(F.col("rsi_gate"))).alias("depth4plus_gated"),
        F.count_if((F.col("alignment_depth") >= 3) & S.yes(F.col("rsi_gate"))).alias("depth3plus_gated"),
        F.count(F.lit(1)).alias("tickers"),
    )
    return day.orderBy(F.desc("date")).limit(days)
