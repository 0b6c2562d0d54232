"""Windows over a ticker's bars, and recursive averages.

Every window uses one partitioning and order, so a chain of them plans one exchange and
one sort.  Values are null until a window is full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def by_ticker() -> W:
    return W.partitionBy("ticker").orderBy("date")


def last_n(n: int) -> W:
    return by_ticker().rowsBetween(-(n - 1), 0)


def full(agg, column: Column | str, n: int) -> Column:
    """The aggregate over the last n bars, null while any is missing."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.count(c).over(last_n(n)) == n, agg(c).over(last_n(n)))


def full_before(agg, column: Column | str, n: int, skip: int = 1) -> Column:
    """The aggregate over n bars that end ``skip`` bars before this one."""
    c = F.col(column) if isinstance(column, str) else column
    w = by_ticker().rowsBetween(-(n - 1 + skip), -skip)
    return F.when(F.count(c).over(w) == n, agg(c).over(w))


def lag(column: Column | str, n: int = 1) -> Column:
    return F.lag(column, n).over(by_ticker())


def yes(condition: Column) -> Column:
    """A condition as a plain flag: unknown is false."""
    return F.coalesce(condition, F.lit(False))


def position() -> Column:
    return F.row_number().over(by_ticker())


def since(flag: Column) -> Column:
    """Bars since the flag was last true, null before."""
    k = position()
    return k - F.last(F.when(flag, k), ignorenulls=True).over(by_ticker().rowsBetween(W.unboundedPreceding, 0))


# Recursive averages run over one ticker's arrays inside a grouped map.


def ema(x: np.ndarray, span: int) -> np.ndarray:
    return pd.Series(x).ewm(span=span, adjust=False, min_periods=span).mean().to_numpy()


def seeded(x: np.ndarray, n: int) -> np.ndarray:
    """The mean of the first n defined values, then ((n - 1) y + x) / n; nulls only in front."""
    out = np.full(len(x), np.nan)
    defined = np.flatnonzero(~np.isnan(x))
    if len(defined) < n:
        return out
    start = defined[0] + n - 1
    tail = np.concatenate([[x[defined[:n]].mean()], x[start + 1 :]])
    out[start:] = pd.Series(tail).ewm(alpha=1 / n, adjust=False).mean().to_numpy()
    return out


def carried(last: float, x: np.ndarray, n: int) -> np.ndarray:
    """What `seeded` goes on with behind a bar whose average is ``last``."""
    return pd.Series(np.concatenate([[last], x])).ewm(alpha=1 / n, adjust=False).mean().to_numpy()[1:]


def macd(close: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    line = ema(close, fast) - ema(close, slow)
    sig = ema(line, signal)
    return line, sig, line - sig


def rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    step = np.diff(close, prepend=np.nan)
    return rsi_of(seeded(np.maximum(step, 0), n), seeded(np.maximum(-step, 0), n))


def rsi_of(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """RSI of average gains and losses."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 100 - 100 / (1 + up / down)
    out = np.where((up == 0) & (down == 0), 50.0, np.where(down == 0, 100.0, out))
    return np.where(np.isnan(up) | np.isnan(down), np.nan, out)


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate([[np.nan], close[:-1]])
    return np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    return seeded(true_range(high, low, close), n)


def directional(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """DI+, DI- and ADX."""
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    rise, fall = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    reach = atr(high, low, close, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        plus, minus = 100 * seeded(rise, n) / reach, 100 * seeded(fall, n) / reach
        both = plus + minus
        dx = np.where(both == 0, np.nan, 100 * np.abs(plus - minus) / both)
    return plus, minus, seeded(np.nan_to_num(dx), n)


def pivots(x: np.ndarray, left: int, right: int, highs: bool) -> np.ndarray:
    """A bar that alone is the extreme of the bars around it, reported ``right`` bars later."""
    out = np.full(len(x), np.nan)
    n = left + right + 1
    if len(x) < n:
        return out
    view = np.lib.stride_tricks.sliding_window_view(x, n)
    mid = view[:, left]
    edge = view.max(1) if highs else view.min(1)
    ok = (mid == edge) & ((view == mid[:, None]).sum(1) == 1)
    out[n - 1 :][ok] = mid[ok]
    return out
