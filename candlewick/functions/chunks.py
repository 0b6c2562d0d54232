"""EMA, RSI and ATR of histories of any length: linear recurrences as affine maps, composed over chunks.

An average y = a y' + b maps what stood before a bar to what stands behind it.  Such maps compose, so a stretch of bars
shrinks to one map whatever came before.  Three passes: each chunk of a ticker (bars of ``days`` days) becomes a
summary, its first bars as they are and one map for the rest; a ticker's summaries, few and small, are walked in order
and give the state at the start of each chunk; each chunk goes on from its state by itself.  So no task holds more than
a chunk of bars or the summaries of a ticker, and one long history keeps many tasks busy.

The first bars of a chunk are not composed, as they depend on more than an average: on the close before, and on whether
the averages of Wilder are still being filled.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions import series as S

SPAN, WILDER = 12, 14
ALPHA, SMOOTH = 2 / (SPAN + 1), 1 / WILDER
#: Bars of a chunk that are kept as they are; behind them all averages are full.
HEAD = WILDER + 2
DAYS = 2048


@dataclass(frozen=True)
class Carry:
    """What stands before a bar: bars so far, the last close, the averages (sums while they are being filled)."""

    n: int = 0
    close: float = float("nan")
    ema: float = float("nan")
    up: float = 0.0
    down: float = 0.0
    reach: float = 0.0


def filled(y: float, x: float, k: int) -> float:
    """A Wilder average, or the sum that it starts from, behind its k-th value."""
    return y + x if k < WILDER else (y + x) / WILDER if k == WILDER else y * (1 - SMOOTH) + x * SMOOTH


def behind(c: Carry, high: float, low: float, close: float) -> Carry:
    n = c.n + 1
    if n == 1:
        return Carry(1, close, close, 0.0, 0.0, filled(0.0, high - low, 1))
    step, reach = close - c.close, max(high - low, abs(high - c.close), abs(low - c.close))
    return Carry(n, close, c.ema * (1 - ALPHA) + close * ALPHA, filled(c.up, max(step, 0.0), n - 1), filled(c.down, max(-step, 0.0), n - 1), filled(c.reach, reach, n))


def inputs(before: float, high: np.ndarray, low: np.ndarray, close: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gains, losses and true ranges of bars behind a close."""
    past = np.concatenate([[before], close[:-1]])
    step = close - past
    return np.maximum(step, 0), np.maximum(-step, 0), np.maximum(high - low, np.maximum(np.abs(high - past), np.abs(low - past)))


def composed(b: np.ndarray, a: float) -> float:
    """What the inputs b of a recurrence y = (1 - a) y' + a b add to (1 - a) ** n y."""
    return float(a * (b * (1 - a) ** np.arange(len(b) - 1, -1, -1)).sum())


SUMMARY = "ticker string, chunk bigint, high array<double>, low array<double>, close array<double>, rest bigint, last double, ema double, up double, down double, reach double"
STARTS = "ticker string, chunk bigint, n bigint, close double, ema double, up double, down double, reach double"
OUT = "ticker string, date date, ema12 double, rsi14 double, atr14 double"


def summary(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("date")
    high, low, close = (rows[c].to_numpy() for c in ("high", "low", "close"))
    own = {"ticker": rows["ticker"][0].as_py(), "chunk": rows["chunk"][0].as_py(), "high": high[:HEAD].tolist(), "low": low[:HEAD].tolist(), "close": close[:HEAD].tolist(), "rest": len(close[HEAD:]), "last": float(close[-1])}
    if own["rest"]:
        up, down, reach = inputs(close[HEAD - 1], high[HEAD:], low[HEAD:], close[HEAD:])
        own |= {"ema": composed(close[HEAD:], ALPHA), "up": composed(up, SMOOTH), "down": composed(down, SMOOTH), "reach": composed(reach, SMOOTH)}
    else:
        own |= dict.fromkeys(("ema", "up", "down", "reach"), 0.0)
    return pa.Table.from_pylist([own])


def starts(rows: pa.Table) -> pa.Table:
    """The state before each chunk of a ticker."""
    c, out = Carry(), []
    for r in rows.sort_by("chunk").to_pylist():
        out.append({"ticker": r["ticker"], "chunk": r["chunk"]} | asdict(c))
        for bar in zip(r["high"], r["low"], r["close"]):
            c = behind(c, *bar)
        if m := r["rest"]:
            e, w = (1 - ALPHA) ** m, (1 - SMOOTH) ** m
            c = replace(c, n=c.n + m, close=r["last"], ema=e * c.ema + r["ema"], up=w * c.up + r["up"], down=w * c.down + r["down"], reach=w * c.reach + r["reach"])
    return pa.Table.from_pylist(out)


def values(state: pa.Table, rows: pa.Table) -> pa.Table:
    """The averages of a chunk's bars behind its state."""
    rows = rows.sort_by("date")
    high, low, close = (rows[c].to_numpy() for c in ("high", "low", "close"))
    known = state.to_pylist()[0]
    c = Carry(*(known[k] for k in ("n", "close", "ema", "up", "down", "reach")))
    n = c.n + 1 + np.arange(len(close))
    ema, up, down, reach = (np.empty(len(close)) for _ in range(4))
    head = 0
    while head < len(close) and c.n <= WILDER:  # averages that are still being filled
        c = behind(c, high[head], low[head], close[head])
        ema[head], up[head], down[head], reach[head] = c.ema, c.up, c.down, c.reach
        head += 1
    if head < len(close):
        x = inputs(c.close, high[head:], low[head:], close[head:])
        ema[head:] = S.carried(c.ema, close[head:], 1 / ALPHA)
        up[head:], down[head:], reach[head:] = (S.carried(y, b, WILDER) for y, b in zip((c.up, c.down, c.reach), x))
    shown = [np.where(n >= SPAN, ema, np.nan), np.where(n > WILDER, S.rsi_of(up, down), np.nan), np.where(n >= WILDER, reach, np.nan)]
    return pa.Table.from_arrays([rows["ticker"].combine_chunks(), rows["date"].combine_chunks(), *[pa.array(x, pa.float64(), from_pandas=True) for x in shown]], names=["ticker", "date", "ema12", "rsi14", "atr14"])


def averages(bars: DataFrame, days: int = DAYS) -> DataFrame:
    """ema12, rsi14 and atr14 of every bar."""
    own = bars.select("ticker", "date", "high", "low", "close", F.floor(F.unix_date("date") / days).alias("chunk"))
    dealt = own.groupBy("ticker", "chunk")
    before = dealt.applyInArrow(summary, SUMMARY).groupBy("ticker").applyInArrow(starts, STARTS)
    return before.groupBy("ticker", "chunk").cogroup(dealt).applyInArrow(values, OUT)
