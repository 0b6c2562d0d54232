"""A store: one folder of Parquet tables that are created, upserted, logged to and published, in versions.

Fact tables are partitioned by year, so an upsert reads and replaces the years that come in
and no others.  Each call that writes commits one version (`snapshots`): readers that have opened
one keep it, and a publication shows all of its tables or none.  Old files lack columns that were
declared later; they read as null, so adding a column needs no rewrite, and none is ever dropped
or retyped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.operators.store import STATUSES, upsert
from candlewick.sources.snapshots import Change, Snapshot, Versions


@dataclass(frozen=True)
class Table:
    schema: str
    keys: tuple[str, ...]
    day: str | None = None  # the column whose year partitions the table
    by: str | None = None  # the column whose values do


#: The declared tables, their columns and keys.
TABLES = {
    "prices": Table("ticker string, date date, open double, high double, low double, close double, volume bigint, split_factor double, dividend double", ("ticker", "date"), "date"),
    "tickers": Table("ticker string, name string, sector string, board string, listing_date date, is_active boolean, first_seen date, last_seen date, delisted_at date", ("ticker",)),
    "indices": Table("symbol string, name string, date date, open double, high double, low double, close double, volume bigint", ("symbol", "date"), "date"),
    "price_quality": Table("ticker string, date date, insufficient_history boolean, stale_price boolean, zero_volume boolean, suspicious_jump boolean, gap boolean, impossible_bar boolean, stale_run_length int, jump_pct double, gap_days int, bars_available int, is_clean boolean", ("ticker", "date"), "date"),
    "signals": Table("ticker string, date date, alignment_depth int, rsi_gate boolean, above_ma5 boolean, days_since_ma5_cross int, tier string, data_quality string, bars_available int", ("ticker", "date"), "date"),
    "trade_labels": Table("ticker string, entry_date date, rule_version string, fill_date date, fill_price double, exit_date date, exit_price double, outcome string, bars_held int, return_pct double, gross_return_pct double, mae double, mfe double", ("ticker", "entry_date", "rule_version"), "entry_date"),
    # what a night needs of a ticker's past (operators/nightly.py)
    "signal_state": Table("ticker string, bars bigint, last_date date, closes array<double>, rsi_up double, rsi_down double, stale_run bigint, cross_at bigint, bad_at bigint, was_above boolean", ("ticker",)),
    # what is published for readers (plans/publication.py)
    "latest_signals": Table("ticker string, date date, alignment_depth int, rsi_gate boolean, above_ma5 boolean, days_since_ma5_cross int, tier string, data_quality string, bars_available int", ("ticker",)),
    "trade_log": Table("strategy string, ticker string, seq int, status string, signal_date date, signal_price double, buy_date date, pb string, buy_price double, last_close double, fl_pct double, hi_price double, hi_date date, max_fl_pct double, exit_date date, exit_price double, pl_pct double, entry_code string, exit_code string, turnover double, avg_lots double, bars_held int", ("strategy", "ticker", "seq"), None, "strategy"),
    "quality_summary": Table("flag string, bars bigint", ("flag",)),
    "measured_outcomes": Table("tier string, n bigint, win_pct double, mean_return double, median_return double, first_entry date, last_entry date, rule_version string", ("tier",)),
    "ingest_log": Table("run_id string, ticker string, source string, status string, rows_written bigint, error_message string, attempt int, started_at timestamp, finished_at timestamp", ()),
}


class Store:
    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        """The latest version at each call, or a given one for good."""
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, self.root)
        self.pinned = None if version is None else self.versions.at(version)

    def snapshot(self) -> Snapshot:
        return self.pinned or self.versions.latest()

    def pin(self) -> Store:
        """A reader of the latest version, whatever is written later."""
        return Store(self.spark, self.root, self.versions.latest().version)

    def exists(self, name: str) -> bool:
        return name in self.snapshot().tables

    def init(self) -> dict[str, int]:
        """Creates what is missing; rows of every table."""
        missing = [name for name in TABLES if not self.exists(name)]
        if missing:
            change = self.versions.change()
            change.whole.update(missing)
            change.commit()
        return {name: self.read(name).count() for name in TABLES}

    def read(self, name: str, parts: list | None = None) -> DataFrame:
        """A table in its declared columns, or some of its parts (years); fails at once if the store lacks it."""
        return read_from(self.snapshot(), name, parts)

    def write(self, name: str, frame: DataFrame, mode: str = "parts") -> None:
        """Replaces the years that the frame touches (a table without years as a whole), or appends to it."""
        change = self.versions.change()
        put(change, name, frame, mode)
        change.commit()

    def upsert(self, name: str, incoming: DataFrame, order: str | None = None) -> None:
        """Incoming rows in place of those of equal keys; only the years that come in are read and replaced.

        Of incoming rows of equal keys the one with the greatest ``order`` counts; without an order they are refused.
        """
        change = self.versions.change()
        upsert_in(change, name, incoming, order)
        change.commit()

    def log(self, entries: DataFrame) -> None:
        """Appends to the log; a status that is not known fails the write, and no version is made."""
        known = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
        said = F.concat(F.lit("unknown ingest status "), F.coalesce(F.col("status"), F.lit("null")))
        try:
            self.write("ingest_log", entries.withColumn("status", F.when(known, F.col("status")).otherwise(F.raise_error(said))), "append")
        except PySparkException as error:
            if "unknown ingest status" in str(error):
                raise ValueError(f"unknown ingest status; expected one of {sorted(STATUSES)}") from error
            raise

    def publish(self, target: Store, bars: int = 180) -> Snapshot:
        """The dimension, the signals and the last bars of every ticker, for readers: one version, of these rows only."""
        own = self.pin()
        newest = F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date")))
        change = target.versions.change()
        for name in ("prices", "signals"):
            put(change, name, own.read(name).withColumn("_n", newest).where(F.col("_n") <= bars), "whole")
        put(change, "tickers", own.read("tickers"), "whole")
        return change.commit()


def read_from(snapshot: Snapshot, name: str, parts: list | None = None) -> DataFrame:
    if name not in snapshot.tables:
        raise FileNotFoundError(f"no table {name} below {snapshot.root}")
    return snapshot.read(name, TABLES[name].schema, None if parts is None else [str(p) for p in parts])


def declared(schema: str) -> list[tuple[str, str]]:
    return [tuple(x.split(" ", 1)) for x in schema.split(", ")]


def put(change: Change, name: str, frame: DataFrame, mode: str = "parts") -> None:
    """The frame in its declared columns, clustered by key, as part of a change."""
    table = TABLES[name]
    own = frame.select(*[F.col(c).cast(kind).alias(c) if c in frame.columns else F.lit(None).cast(kind).alias(c) for c, kind in declared(table.schema)])
    if table.day is not None:
        first = table.keys[0]
        own = own.withColumn("year", F.year(table.day)).repartition("year", first).sortWithinPartitions("year", first, table.day)
        change.write(name, own, "year", mode)
    elif table.by is not None:
        own = own.withColumn(f"by_{table.by}", F.col(table.by)).repartition(f"by_{table.by}", *table.keys[1:2]).sortWithinPartitions(f"by_{table.by}", *table.keys[1:])
        change.write(name, own, f"by_{table.by}", mode)
    else:
        change.write(name, own, None, mode)


def upsert_in(change: Change, name: str, incoming: DataFrame, order: str | None = None) -> None:
    table, years = TABLES[name], None
    if table.day is not None:
        years = [r[0] for r in incoming.select(F.year(table.day)).distinct().collect()]  # a few dozen at most
    put(change, name, upsert(read_from(change.staged(), name, years), incoming, list(table.keys), order))
