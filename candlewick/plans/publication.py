"""What readers open: a version with the last bars and signals, every strategy's log, and the summaries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.operators import calibration, labels, quality, readers, signals
from candlewick.plans import trade_log
from candlewick.sources.snapshots import Snapshot, spilled
from candlewick.sources.tables import Store, put


def published(store: Store, target: Store, gate: DataFrame | None = None, bars: int = 180, rule: labels.Rule = labels.HOLD_20) -> Snapshot:
    """One version of the target: all of its tables are of one state of the store, and appear at once.

    ``gate`` (date, index_ok) is the market's state a day, for the strategies that ask for it; it is broadcast, a row a day, never the bars.
    """
    own = store.pin()
    prices, found = own.read("prices"), own.read("signals")
    newest = F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date")))
    change = target.versions.change()
    for name, frame in (("prices", prices), ("signals", found)):
        put(change, name, frame.withColumn("_n", newest).where(F.col("_n") <= bars), "whole")
    put(change, "tickers", own.read("tickers"), "whole")
    put(change, "latest_signals", signals.latest(found), "whole")
    walked = prices.select("ticker", "date", "open", "high", "low", "close", "volume")
    put(change, "trade_log", trade_log.published(walked if gate is None else walked.join(F.broadcast(gate), "date")), "whole")
    put(change, "quality_summary", quality.summary_rows(quality.flagged(prices)), "whole")
    measured = labels.labelled(prices, labels.eligible(found), [rule], None, carry=("tier",))
    put(change, "measured_outcomes", readers.measured_outcomes(spilled(measured, "measured"), rule.version), "whole")
    return change.commit()


def strategy_log(target: Store, strategy: str) -> DataFrame:
    """A strategy's log, from its own part of the table alone."""
    return target.read("trade_log", parts=[strategy]).drop("strategy")


def ticker_log(log: DataFrame, ticker: str) -> DataFrame:
    """All of a ticker's rows, those without a signal day first, then the newest."""
    return log.where(F.col("ticker") == ticker).orderBy(F.desc_nulls_first("signal_date"), F.desc("seq"))


def reactivated(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """How many inactive names the source lists again."""
    return known.where(~F.col("is_active")).join(incoming.select("ticker"), "ticker", "left_semi").agg(F.count(F.lit(1)).alias("reactivated"))
