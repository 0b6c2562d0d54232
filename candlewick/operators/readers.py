"""What a reader asks for: one ticker's history, measured outcomes, recent signals, landed lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.plans.strategies import Strategy, category, run

#: Headers of stock lists, in either language, and their column here.
HEADERS = {"kode": "ticker", "kode saham": "ticker", "code": "ticker", "ticker": "ticker", "symbol": "ticker", "nama perusahaan": "name", "nama": "name", "company name": "name", "name": "name", "sektor": "sector", "sector": "sector", "papan pencatatan": "board", "papan": "board", "board": "board", "tanggal pencatatan": "listing_date", "listing date": "listing_date"}
CODE = "^[A-Z0-9]{2,6}$"


def ticker_history(wide: DataFrame, ticker: str, limit: int = 500) -> DataFrame:
    """The last bars of one ticker, oldest first."""
    return wide.where(F.col("ticker") == ticker).orderBy(F.desc("date")).limit(limit).orderBy("date")


def stock_list(landed: DataFrame, suffix: str = ".JK") -> DataFrame:
    """A landed list under known names: codes that look like codes, with the market's suffix, once each."""
    named = {HEADERS[c.strip().lower()]: c for c in reversed(landed.columns) if c.strip().lower() in HEADERS}
    if "ticker" not in named:
        raise ValueError(f"no code column among {landed.columns}")
    own = landed.select(*[F.trim(F.col(f"`{c}`").cast("string")).alias(k) for k, c in named.items()])
    code = F.regexp_replace(F.upper("ticker"), r"\.[A-Z]+$", "")
    return own.withColumn("code", code).where(F.col("code").rlike(CODE)).withColumn("ticker", F.concat("code", F.lit(suffix))).drop("code").dropDuplicates(["ticker"])


def measured_outcomes(tiered: DataFrame, rule_version: str) -> DataFrame:
    """Outcomes of one rule by tier, with the span they come from; no rows if the rule has no labels."""
    r = F.coalesce("return_pct", "gross_return_pct")
    own = tiered.where((F.col("rule_version") == rule_version) & r.isNotNull() & F.col("tier").isNotNull())
    return own.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), (F.avg((r > 0).cast("double")) * 100).alias("win_pct"), F.avg(r).alias("mean_return"), F.median(r).alias("median_return"), F.min("entry_date").alias("first_entry"), F.max("entry_date").alias("last_entry"), F.any_value("rule_version").alias("rule_version"))


def radar(bars: DataFrame, strategy: Strategy) -> DataFrame:
    """Every ticker's state now: holding, armed or waiting, with the last code and its category."""
    found = run(bars, strategy)
    open_ = found.where("entry_date is not null and not resolved").select("ticker").distinct().withColumn("holding", F.lit(True))
    own = found.where("entry_date is null").select("ticker", "armed", "last_code").join(open_, "ticker", "left")
    state = F.when(F.coalesce("holding", F.lit(False)), "holding").when(F.col("armed"), "armed").otherwise("waiting")
    return own.select("ticker", state.alias("state"), "last_code", category(F.col("last_code"), strategy.key).alias("category"))


def recent_entries(bars: DataFrame, strategy: Strategy, lookback: int = 5) -> DataFrame:
    """Tickers whose latest entry lies within the last bars, newest first."""
    trades = run(bars, strategy).where("entry_date is not null")
    last = trades.groupBy("ticker").agg(F.max_by(F.struct("entry_date", "entry_code", "entry_price"), "entry_date").alias("t")).select("ticker", "t.*")
    days = bars.groupBy("ticker").agg(F.sort_array(F.collect_set("date"), False).alias("days"))
    return last.join(days, "ticker").withColumn("bars_ago", (F.array_position("days", F.col("entry_date")) - 1).cast("bigint")).where(F.col("bars_ago") < lookback).drop("days").orderBy("bars_ago", "ticker")


def span_guard(trades: DataFrame, min_years: float = 2.0) -> DataFrame:
    """Years that the trades span and whether that is enough to judge by."""
    own = trades.agg(F.min("entry_date").alias("first"), F.max("exit_date").alias("last"), F.count(F.lit(1)).alias("n"))
    years = F.datediff("last", "first") / 365.25
    return own.withColumn("years", years).withColumn("enough", F.coalesce(years >= min_years, F.lit(False)))
