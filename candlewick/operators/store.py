"""Tables that change: upserts, the listed universe, re-fetch checks, logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.sources.bars import latest_by
from candlewick.sources.fetch import MARKERS, OTHERWISE

#: What a row of the ingest log may say; those of a run as a whole carry no ticker.
STATUSES = ("ok", "rate_limited", "network_error", "empty_response", "parse_error", "circuit_open", "run_started", "run_finished", "run_aborted")
MAX_MISSING = 0.10
#: Fixed value: share of tickers without data that a run may have.
MAX_FAILURE_RATE = 0.05


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Target with incoming rows in place of those of equal keys; new columns are added, none is dropped.

    Of incoming rows of equal keys the one with the greatest ``order`` counts; without an order they fail the job.
    A first load brings all keys at once, and the size of compressed files tells little of that: they are never broadcast.
    """
    new = latest_by(incoming, keys, order) if order else unique(incoming, keys)
    return target.join(new.select(*keys).hint("merge"), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def unique(frame: DataFrame, keys: list[str]) -> DataFrame:
    """The frame; a key that occurs twice fails the job, as nothing says which of its rows counts."""
    said = F.concat(F.lit("rows of one key and no order: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    own = frame.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    return own.where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(said).cast("boolean"))).drop("_n")


def upsert_tickers(known: DataFrame, incoming: DataFrame, seen_on) -> DataFrame:
    """Listed names come (back) to life and keep what incoming leaves open; first_seen stays.

    A name that incoming lists twice fails the job.  Board and listing date are merged where both sides have them.
    """
    a, b = known.alias("a"), unique(incoming, ["ticker"]).alias("b")
    described = ["name", "sector", *[c for c in ("board", "listing_date") if c in known.columns]]
    merged = lambda c: F.coalesce(f"b.{c}", f"a.{c}") if c in incoming.columns else F.col(f"a.{c}")
    seen = F.lit(seen_on).cast("date")
    return a.join(b, F.col("a.ticker") == F.col("b.ticker"), "full").select(
        F.coalesce("b.ticker", "a.ticker").alias("ticker"),
        *[merged(c).alias(c) for c in described],
        F.when(F.col("b.ticker").isNotNull(), True).otherwise(F.col("a.is_active")).alias("is_active"),
        F.coalesce("a.first_seen", seen).alias("first_seen"),
        F.when(F.col("b.ticker").isNotNull(), seen).otherwise(F.col("a.last_seen")).alias("last_seen"),
        F.when(F.col("b.ticker").isNull(), F.col("a.delisted_at")).alias("delisted_at"),
    )


def mark_absent(known: DataFrame, present: DataFrame, seen_on) -> DataFrame:
    """Names that the source no longer lists become inactive; the first day that was noticed stays."""
    here = present.select("ticker").distinct().withColumn("_here", F.lit(True))
    gone = F.col("_here").isNull() & F.col("is_active")
    return known.join(here, "ticker", "left").withColumns({"delisted_at": F.when(gone, F.coalesce("delisted_at", F.lit(seen_on).cast("date"))).otherwise(F.col("delisted_at")), "is_active": F.col("is_active") & ~gone}).drop("_here")


@dataclass
class Sync:
    tickers: DataFrame
    missing: int
    deactivated: bool


def sync_universe(known: DataFrame, incoming: DataFrame, seen_on, allow_large_drop: bool = False) -> Sync:
    """Refuses an empty source; leaves names active if too many of them would go at once."""
    here = incoming.select("ticker").distinct().withColumn("_here", F.lit(True))
    found = known.select("ticker", "is_active").join(here, "ticker", "full").agg(F.count_if("_here").alias("here"), F.count_if("is_active").alias("active"), F.count_if(F.col("is_active") & F.col("_here").isNull()).alias("missing")).first()
    if not found["here"]:
        raise ValueError("the source lists no names")
    active, missing = found["active"], found["missing"]
    merged = upsert_tickers(known, incoming, seen_on)
    if active and missing / active > MAX_MISSING and not allow_large_drop:
        return Sync(merged, missing, False)
    return Sync(mark_absent(merged, incoming, seen_on), missing, True)


def refetch_differences(stored: DataFrame, fetched: DataFrame, tolerance_pct: float = 0.5) -> DataFrame:
    """Bars whose close differs from a fresh copy by more than the tolerance, largest first."""
    own = stored.select("ticker", "date", F.col("close").alias("stored_close")).join(fetched.select("ticker", "date", F.col("close").alias("fetched_close")), ["ticker", "date"])
    diff = F.expr("try_divide(fetched_close - stored_close, stored_close)") * 100
    return own.withColumn("diff_pct", diff).where(F.abs("diff_pct") > tolerance_pct).orderBy(F.abs("diff_pct").desc(), "ticker", "date")


def error_status(message) -> object:
    """Status of a column of error texts; the first match decides."""
    text, out = F.lower(message), None
    for status, parts in MARKERS.items():
        hit = F.greatest(*[text.contains(p) for p in parts])
        out = F.when(hit, status) if out is None else out.when(hit, status)
    return out.otherwise(OTHERWISE)


def failure_rate(log: DataFrame, limit: float = MAX_FAILURE_RATE) -> DataFrame:
    """Share of tickers that returned no data, and the exit code it gives: 1 beyond the limit."""
    own = log.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("status") == "ok", F.lit(False))).alias("failed"))
    rate = F.coalesce(F.expr("try_divide(failed, n)"), F.lit(0.0))
    return own.withColumn("rate", rate).withColumn("exit_code", F.when(F.col("rate") > limit, 1).otherwise(0))


def status_counts(log: DataFrame, run_id: str) -> DataFrame:
    return log.where(F.col("run_id") == run_id).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def latest_run(log: DataFrame, source: str | None = None) -> DataFrame:
    """The run that started last, of one source or of all; no row if there is none."""
    own = log if source is None else log.where(F.col("source") == source)
    return own.agg(F.max_by("run_id", "started_at").alias("run_id"), F.max("started_at").alias("started_at")).where("run_id is not null")


def last_dates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.max("date").alias("last_date"))


def freshness(bars: DataFrame, today) -> DataFrame:
    """Latest day, names, names on that day, and fresh / aging / stale / empty."""
    day = bars.groupBy("date").agg(F.countDistinct("ticker").alias("n"))
    last = day.agg(F.max("date").alias("latest"), F.max_by("n", "date").alias("tickers_at_latest"))
    own = last.crossJoin(bars.agg(F.countDistinct("ticker").alias("tickers")))
    age = F.datediff(F.lit(today).cast("date"), "latest")
    return own.withColumn("state", F.when(F.col("latest").isNull(), "empty").when(age <= 4, "fresh").when(age <= 10, "aging").otherwise("stale"))


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"), F.min("date").alias("first"), F.max("date").alias("last"))


#: Month names of either language, by their first letters.
MONTHS = {"jan": 1, "feb": 2, "peb": 2, "mar": 3, "apr": 4, "mei": 5, "may": 5, "jun": 6, "jul": 7, "agu": 8, "ags": 8, "aug": 8, "sep": 9, "okt": 10, "oct": 10, "nov": 11, "nop": 11, "des": 12, "dec": 12}


def listing_date(text):
    """A day from ISO, d/m/y or 'd month y' texts with month names of either language; null if none fits."""
    t = F.trim(text)
    month = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])[F.lower(F.substring(F.regexp_extract(t, r"^\d{1,2}[ -]([A-Za-z]+)[ -]\d{4}$", 1), 1, 3))]
    parts = F.concat_ws("-", F.regexp_extract(t, r"(\d{4})$", 1), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(t, r"^(\d{1,2})", 1), 2, "0"))
    return F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), F.try_to_date(t, "d/M/yyyy"), F.when(month.isNotNull(), F.try_to_date(parts, "yyyy-MM-dd")))
