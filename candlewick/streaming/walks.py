"""Strategy K over a stream of bars: each ticker's walk goes on from its state, batch by batch.

A state holds what the next bar needs: the last bars that the windows reach back to, the three averages, whether the
base was quiet, and the order or lot of the desk.  Finished trades are emitted once.  Bars of a ticker are taken in the
order of their days; a bar whose day is not after the last one walked comes too late and is left out, as the walk is
past it.  An event-time timer clears the state of a ticker without bars for ``idle_days`` days, so that delisted names
don't stay; one that comes back starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from candlewick.functions import series as S
from candlewick.plans.desk import Lot
from candlewick.plans.strategies import BASE_I, SniperBracket, crossed, roll, shifted

COLUMNS = ["open", "high", "low", "close", "volume"]
SPANS = (50, 150, 200)
#: Bars that the windows of a bar and of the one before it reach back to.
TAIL = max(BASE_I.bars, BASE_I.ceiling, BASE_I.volume_bars) + 2
MIN_BARS = 201
TRADES = "ticker string, entry_date date, entry_price double, entry_code string, exit_date date, exit_price double, exit_code string, bars_held long"
STATE = "n long, last_day date, bars array<double>, emas array<double>, quiet boolean, buying boolean, entry_price double, entry_day date, entry_n long, live boolean"


@dataclass
class Walk:
    """A ticker between two batches."""

    n: int = 0
    last_day: object = None
    bars: list[float] = field(default_factory=list)  # the last TAIL bars, column after column
    emas: list[float] = field(default_factory=list)
    quiet: bool = False
    buying: bool = False
    entry_price: float | None = None
    entry_day: object = None
    entry_n: int | None = None
    live: bool = False

    def moved_on(self, days: list, new: dict[str, np.ndarray]) -> list[tuple]:
        """The trades that end on these bars."""
        many = len(days)
        past = np.array(self.bars, float).reshape(len(COLUMNS), -1)
        own = {c: np.concatenate([past[k], new[c]]) for k, c in enumerate(COLUMNS)}
        h, l, c, v = (own[k] for k in ("high", "low", "close", "volume"))
        number = self.n + 1 + np.arange(many)
        emas = [S.carried(e, new["close"], (s + 1) / 2) for e, s in zip(self.emas, SPANS)] if self.emas else [pd.Series(new["close"]).ewm(span=s, adjust=False).mean().to_numpy() for s in SPANS]
        a, b, d = (np.where(number >= s, e, np.nan) for e, s in zip(emas, SPANS))
        with np.errstate(invalid="ignore", divide="ignore"):
            top, bottom = roll(h, BASE_I.bars, "max", 1)[-many:], roll(l, BASE_I.bars, "min", 1)[-many:]
            quiet = ((top - bottom) / bottom * 100 <= BASE_I.box_pct) & (new["close"] > a) & (a > b) & (b > d)
            loud = v >= roll(v, BASE_I.volume_bars, "mean") * BASE_I.volume
            strong = c >= l + (h - l) * BASE_I.close_in_range
            breaks = crossed(c, roll(h, BASE_I.ceiling, "max", 1)) & loud & strong
        signal = breaks[-many:] & np.concatenate([[self.quiet], quiet[:-1]])
        desk = SniperBracket(new, {"signal": signal})
        desk.buying, desk.live = self.buying, self.live
        if self.entry_price is not None:
            desk.entry, desk.entry_at = self.entry_price, self.entry_n - self.n - 1
            desk.desk.lots.append(Lot(desk.entry_at, desk.entry, desk.code))
        first_day, out = self.entry_day, []
        done = desk.walk()
        for t in done.trades:
            out.append((days[t["entry_at"]] if t["entry_at"] >= 0 else first_day, t["entry_price"], t["entry_code"], days[t["exit_at"]], t["exit_price"], t["exit_code"], t["bars_held"]))
        lot = done.lots[0] if done.lots else None
        self.entry_price, self.entry_day, self.entry_n = (lot.price, days[lot.at] if lot.at >= 0 else first_day, self.n + 1 + lot.at) if lot else (None, None, None)
        self.buying, self.live, self.quiet = desk.buying, desk.live, bool(quiet[-1])
        self.emas, self.bars = [float(e[-1]) for e in emas], np.stack([own[k][-TAIL:] for k in COLUMNS]).ravel().tolist()
        self.n, self.last_day = int(number[-1]), days[-1]
        return out


class Walker(StatefulProcessor):
    def __init__(self, idle_days: int):
        self.idle_ms = idle_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.walk = handle.getValueState("walk", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        walk = Walk(*self.walk.get()) if self.walk.exists() else Walk()
        new = pd.concat(list(rows)).sort_values("ts", kind="stable").drop_duplicates("ts", keep="last")
        new["day"] = new["ts"].dt.date
        if walk.last_day is not None:
            new = new[new["day"] > walk.last_day]
        found = walk.moved_on(new["day"].tolist(), {c: new[c].to_numpy(float) for c in COLUMNS}) if len(new) else []
        if len(new):
            walk.bars, walk.emas = list(walk.bars), list(walk.emas)
            self.walk.update(tuple(vars(walk).values()))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(new["ts"].iloc[-1].timestamp() * 1000) + self.idle_ms)
        yield pd.DataFrame([(key[0], *t) for t in found], columns=[x.split()[0] for x in TRADES.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.walk.clear()
        yield pd.DataFrame(columns=[x.split()[0] for x in TRADES.split(", ")])

    def close(self) -> None: ...


def trades_of_stream(bars: DataFrame, late: str = "7 days", idle_days: int = 365) -> DataFrame:
    """Finished trades of strategy K over a stream of bars (ticker, ts, open, high, low, close, volume).

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    own = bars.withWatermark("ts", late).select("ticker", "ts", *[F.col(c).cast("double").alias(c) for c in COLUMNS])
    return own.groupBy("ticker").transformWithStateInPandas(Walker(idle_days), TRADES, "append", "eventTime")
