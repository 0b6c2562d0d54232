"""Walk-forward validation: purged training windows, choice of a candidate, test on what follows."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHORTEST_TEST_DAYS = 28


@dataclass(frozen=True)
class Fold:
    number: int
    train_start: date
    test_start: date
    test_end: date


def add_months(day: date, months: int) -> date:
    year, month = divmod(day.year * 12 + day.month - 1 + months, 12)
    return date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


def folds(first: date, last: date, test_months: int = 6, min_train_months: int = 24, train_months: int | None = None) -> list[Fold]:
    """Test windows one after the other (each starts on the day the one before ends), anchored or rolling training."""
    out, start = [], add_months(first, min_train_months)
    while start < last:
        end = min(add_months(start, test_months), last)
        if (end - start).days < SHORTEST_TEST_DAYS:
            break
        begin = first if train_months is None else max(first, add_months(start, -train_months))
        out.append(Fold(len(out) + 1, begin, start, end))
        start = end
    return out


def fold_table(spark: SparkSession, found: list[Fold]) -> DataFrame:
    return spark.createDataFrame([(f.number, f.train_start, f.test_start, f.test_end) for f in found], "fold int, train_start date, test_start date, test_end date")


def candidates(trades: DataFrame, tier_sets: dict[str, list[str]]) -> DataFrame:
    """Trades of several rules, each under every candidate it belongs to: a rule with one of the sets of tiers."""
    sets = trades.sparkSession.createDataFrame([(name, tier) for name, tiers in tier_sets.items() for tier in tiers], "tiers string, tier string")
    return trades.join(F.broadcast(sets), "tier").withColumn("candidate", F.concat_ws("|", "rule_version", "tiers"))


def training(labels: DataFrame, fold_rows: DataFrame, purge: bool = True) -> DataFrame:
    """Trades entered before a test window, and over before it: one that reaches into it would leak."""
    inside = (F.col("entry_date") >= F.col("train_start")) & (F.col("entry_date") < F.col("test_start"))
    if purge:
        inside &= F.col("exit_date") < F.col("test_start")
    return labels.join(F.broadcast(fold_rows), inside)


def testing(labels: DataFrame, fold_rows: DataFrame) -> DataFrame:
    """Trades entered inside a test window, both ends included: consecutive windows share a day."""
    return labels.join(F.broadcast(fold_rows), F.col("entry_date").between(F.col("test_start"), F.col("test_end")))


def scores(trades: DataFrame, *keys: str) -> DataFrame:
    """n, mean, median, mean per bar, mean per unit of spread; zero spread gives plus or minus infinity."""
    r = F.coalesce("return_pct", "gross_return_pct")
    mean, spread = F.avg(r), F.stddev_samp(r)
    per_risk = F.when(spread > 0, mean / spread).when((spread == 0) & (mean != 0), F.signum(mean) * F.lit(float("inf")))
    held = F.avg(F.greatest("bars_held", F.lit(1)))
    return trades.where(r.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), mean.alias("mean_return"), F.median(r).alias("median_return"), (mean / held).alias("return_per_bar"), per_risk.alias("return_per_risk"))


def chosen(train_scores: DataFrame, by: str = "return_per_bar", least: int = 30) -> DataFrame:
    """The best candidate of each fold; the first of equals in the order of ``candidate``."""
    w = W.partitionBy("fold").orderBy(F.desc(by), "candidate")
    return train_scores.where(F.col("n") >= least).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rolled_up(fold_results: DataFrame) -> DataFrame:
    """Over folds: trade-weighted and plain mean, spread of the plain one, folds, and how often the choice changed."""
    w = W.partitionBy(F.lit(1)).orderBy("fold")
    own = fold_results.withColumn("_switch", (F.lag("candidate").over(w) != F.col("candidate")).cast("int"))
    return own.agg(F.count(F.lit(1)).alias("folds"), F.try_divide(F.sum(F.col("mean_return") * F.col("n")), F.sum("n")).alias("pooled"), F.avg("mean_return").alias("averaged"), (F.stddev_samp("mean_return") / F.sqrt(F.count(F.lit(1)))).alias("std_error"), F.coalesce(F.sum("_switch"), F.lit(0)).alias("switches"), F.countDistinct("candidate").alias("distinct_picks"))


def judged(trades: DataFrame, fold_rows: DataFrame, by: str = "return_per_bar", least: int = 30) -> DataFrame:
    """A row for each fold and candidate, its measures in training (train_*) and testing (test_*), and whether it was picked.

    One pass over the trades: a trade is in a fold's training or testing part, never in both.
    """
    inside = (F.col("entry_date") >= F.col("train_start")) & (F.col("entry_date") < F.col("test_start")) & (F.col("exit_date") < F.col("test_start"))
    outside = F.col("entry_date").between(F.col("test_start"), F.col("test_end"))
    r = F.coalesce("return_pct", "gross_return_pct")
    own = trades.where(r.isNotNull()).join(F.broadcast(fold_rows), inside | outside).withColumns({"_in": inside, "_r": r})
    measures = []
    for part, here in (("train", F.col("_in")), ("test", ~F.col("_in"))):
        x = F.when(here, F.col("_r"))
        held = F.avg(F.when(here, F.greatest("bars_held", F.lit(1))))
        measures += [F.count(x).alias(f"{part}_n"), F.avg(x).alias(f"{part}_mean_return"), F.median(x).alias(f"{part}_median_return"), (F.avg(x) / held).alias(f"{part}_return_per_bar"), F.try_divide(F.avg(x), F.stddev_samp(x)).alias(f"{part}_return_per_risk")]
    wide = own.groupBy("fold", "candidate").agg(*measures)
    enough = F.col("train_n") >= least
    w = W.partitionBy("fold").orderBy(F.desc(enough), F.desc(f"train_{by}"), "candidate")
    return wide.withColumn("picked", (F.row_number().over(w) == 1) & enough)


def contest(found: DataFrame, fixed: str, least: int = 30) -> DataFrame:
    """One row: how much of the picked candidates' past was hindsight, and their gap to a fixed one, fold by fold.

    Folds count that have a pick with ``least`` trades in the test window.
    """
    bench = F.max(F.when((F.col("candidate") == fixed) & (F.col("test_n") > 0), F.col("test_return_per_bar"))).over(W.partitionBy("fold"))
    own = found.withColumn("_gap", F.col("test_return_per_bar") - bench).where(F.col("picked") & (F.col("test_n") >= least))
    many = F.count("_gap")
    return own.agg(
        F.avg(F.col("train_mean_return") - F.col("test_mean_return")).alias("premium"), F.when(many >= 2, F.avg("_gap")).alias("gap"), F.when(many >= 2, F.stddev_samp("_gap") / F.sqrt(many)).alias("gap_error"), many.alias("gap_folds"),
        F.try_divide(F.sum(F.col("test_mean_return") * F.col("test_n")), F.sum("test_n")).alias("pooled"), F.avg("test_mean_return").alias("averaged"),
    )


def universe_by_fold(bars: DataFrame, fold_rows: DataFrame, horizon: int, buy_fee: float = 0.0, sell_fee: float = 0.0) -> DataFrame:
    """The market's mean over each test window; give clean bars only."""
    w = W.partitionBy("ticker").orderBy("date")
    own = bars.withColumns({"_buy": F.lead("open", 1).over(w), "_sell": F.lead("close", horizon).over(w)}).where("_buy > 0 and _sell is not null")
    r = (F.col("_sell") * (1 - sell_fee) / (F.col("_buy") * (1 + buy_fee)) - 1) * 100
    return own.select("date", r.alias("r")).join(F.broadcast(fold_rows), F.col("date").between(F.col("test_start"), F.col("test_end"))).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_return"))
