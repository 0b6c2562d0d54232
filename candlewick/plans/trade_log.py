"""The trade log: one shape for the trades of every strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.plans.strategies import STRATEGIES, TURNOVER_BARS, Strategy, category, run_log

COLUMNS = "ticker status signal_date signal_price buy_date pb buy_price last_close fl_pct hi_price hi_date max_fl_pct exit_date exit_price pl_pct entry_code exit_code turnover avg_lots bars_held".split()
BUY_FEE, SELL_FEE = 0.0015, 0.0025


def liquidity(bars: DataFrame, last: int = TURNOVER_BARS) -> DataFrame:
    """Mean value traded and mean lots of 100 shares over each ticker's last bars."""
    w = W.partitionBy("ticker").orderBy(F.desc("date"))
    own = bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    return own.groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("turnover"), (F.avg("volume") / 100).alias("avg_lots"))


def build(bars: DataFrame, *strategies: Strategy) -> DataFrame:
    """A row for each trade, and one for each ticker that is flat with a setup armed: a projection of one map."""
    found = run_log(bars, list(strategies)).where("entry_date is not null or armed or pending")
    trade, done = F.col("entry_date").isNotNull(), F.coalesce("resolved", F.lit(False))
    closed = F.when(category(F.col("exit_code"), F.col("strategy")) == "CUT LOSS", "EXIT").otherwise("CLOSED")
    # a plan of a strategy filled at the next open has its signal only once a buy was decided
    planned = ~trade & (F.col("pending") | ~F.col("strategy").isin([s.key for s in strategies if s.at_next_open]))
    tomorrow = F.date_add("last_date", F.when(F.weekday("last_date") == 4, 3).when(F.weekday("last_date") == 5, 2).otherwise(1))
    shown = {
        "status": F.when(~trade, "WATCHLIST").when(done, closed).otherwise("OPEN"),
        "signal_date": F.when(trade, F.col("signal_date")).when(planned, F.col("last_date")),
        "signal_price": F.when(trade, F.col("signal_price")).when(planned, F.col("last_close")),
        "buy_date": F.when(trade, F.col("entry_date")).when(planned, tomorrow),
        "pb": F.when(trade, "B").otherwise("P"),
        "buy_price": F.col("entry_price"),
        "fl_pct": F.when(trade & ~done, F.col("gross_return_pct")),
        "max_fl_pct": (F.col("hi_price") / F.col("entry_price") - 1) * 100,
        "exit_date": F.when(done, F.col("exit_date")),
        "exit_price": F.when(done, F.col("exit_price")),
        "pl_pct": F.when(done, F.col("gross_return_pct")),
        "exit_code": F.when(done, F.col("exit_code")),
    }
    return found.select(*[shown[c].alias(c) if c in shown else F.col(c) for c in COLUMNS + (["strategy"] if len(strategies) > 1 else [])])


def numbered(log: DataFrame) -> DataFrame:
    """Adds the order inside a ticker: trades by entry, what waits last."""
    keys = [c for c in ("strategy", "ticker") if c in log.columns]
    w = W.partitionBy(*keys).orderBy(F.when(F.col("status") == "WATCHLIST", 1).otherwise(0), "buy_date", F.coalesce("exit_date", F.lit("9999-12-31").cast("date")), "entry_code")
    return log.withColumn("seq", F.row_number().over(w))


def latest(log: DataFrame) -> DataFrame:
    """Where each ticker stands: the last row of its log."""
    return numbered(log).withColumn("_n", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("seq")))).where("_n = 1").drop("_n", "seq")


def published(bars: DataFrame, keys: str = "ABCDEFGHIJK") -> DataFrame:
    """The logs of all strategies in one table, from one map over the bars."""
    return numbered(build(bars, *[STRATEGIES[key] for key in keys]))


def net_pct(gross):
    """After the fees of both sides."""
    return ((1 + gross / 100) * (1 - SELL_FEE) / (1 + BUY_FEE) - 1) * 100


def summary(log: DataFrame) -> DataFrame:
    """Closed trades: number, share of gains, mean and median, net of fees, by kind of exit."""
    done = log.where("pl_pct is not null")
    tp, cl = F.col("status") == "CLOSED", F.col("status") == "EXIT"
    return done.agg(F.count(F.lit(1)).alias("trades"), F.count_if(tp).alias("take_profits"), F.count_if(cl).alias("cut_losses"), (F.avg((F.col("pl_pct") > 0).cast("double")) * 100).alias("win_pct"), F.avg("pl_pct").alias("mean_pl"), F.median("pl_pct").alias("median_pl"), F.avg(net_pct(F.col("pl_pct"))).alias("mean_net"), F.avg(F.when(tp, F.col("pl_pct"))).alias("mean_tp"), F.avg(F.when(cl, F.col("pl_pct"))).alias("mean_cl"))


def between(log: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """A range filter that keeps unknown values."""
    ok = F.lit(True)
    if low is not None:
        ok &= F.col(column) >= low
    if high is not None:
        ok &= F.col(column) <= high
    return log.where(F.col(column).isNull() | ok)


def last_months(log: DataFrame, months: int) -> DataFrame:
    """Rows signalled in the last months before the newest signal; those without a day stay."""
    newest = log.agg(F.max("signal_date").alias("_to"))
    return log.crossJoin(F.broadcast(newest)).where("signal_date is null or signal_date between add_months(_to, %d) and _to" % -months).drop("_to")
