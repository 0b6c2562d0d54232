"""Indicators of every bar: windows in the engine, recursions in one grouped map."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.functions import series as S

MOVING = (5, 20, 50, 100, 200)


def moving_averages(bars: DataFrame) -> DataFrame:
    return bars.withColumns({f"ma{n}": S.full(F.avg, "close", n) for n in MOVING})


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Mean and bands of the last n closes, from their distances to the newest: whole prices give a band that is whole exactly, so a price on it is neither above nor below."""
    steps = F.transform(F.collect_list("close").over(S.last_n(n)), lambda x: x - F.col("close"))
    own = bars.withColumns({"bb_mid": S.full(F.avg, "close", n), "_steps": steps})
    total, squares = (F.aggregate("_steps", F.lit(0.0), add) for add in (lambda a, x: a + x, lambda a, x: a + x * x))
    own = own.withColumns({"_sum": total, "_reach": k * F.sqrt(F.greatest(n * squares - total * total, F.lit(0.0)))})
    band = lambda reach: F.when(F.col("bb_mid").isNotNull(), F.col("close") + (F.col("_sum") + reach) / n)
    return own.withColumns({"bb_upper": band(F.col("_reach")), "bb_lower": band(-F.col("_reach"))}).drop("_steps", "_sum", "_reach")


def donchian(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.withColumns({"donchian_upper": S.full(F.max, "high", n), "donchian_lower": S.full(F.min, "low", n)})


def ichimoku(bars: DataFrame) -> DataFrame:
    mid = lambda n: (S.full(F.max, "high", n) + S.full(F.min, "low", n)) / 2
    own = bars.withColumns({"tenkan": mid(9), "kijun": mid(26), "senkou_b": mid(52)})
    return own.withColumn("senkou_a", (F.col("tenkan") + F.col("kijun")) / 2)


def prior_range(bars: DataFrame, n: int) -> DataFrame:
    """High and low of the n bars before this one."""
    return bars.withColumns({"range_high": S.full_before(F.max, "high", n), "range_low": S.full_before(F.min, "low", n)})


def year_range(bars: DataFrame, n: int = 252) -> DataFrame:
    """High and low of a year of bars, the 150-bar mean, and the mean value traded of 20 bars."""
    return bars.withColumns({"hi52": S.full(F.max, "high", n), "lo52": S.full(F.min, "low", n), "ma150": S.full(F.avg, "close", 150), "turnover20": S.full(F.avg, F.col("close") * F.col("volume"), 20)})


def raw_fractals(bars: DataFrame) -> DataFrame:
    """Middle bars of three that beat both neighbours, known two bars later and carried on."""
    past = lambda c, k: F.lag(c, k).over(S.by_ticker())
    known = S.position() > 3
    peak = known & (past("high", 1) < past("high", 2)) & (past("high", 3) < past("high", 2))
    trough = known & (past("low", 1) > past("low", 2)) & (past("low", 3) > past("low", 2))
    so_far = S.by_ticker().rowsBetween(S.W.unboundedPreceding, 0)
    own = bars.withColumns({"_up": F.when(peak, past("high", 2)), "_down": F.when(trough, past("low", 2))})
    return own.withColumns({"fractal_up": F.last("_up", ignorenulls=True).over(so_far), "fractal_down": F.last("_down", ignorenulls=True).over(so_far)}).drop("_up", "_down")


def chaos_bands(up_raw: np.ndarray, down_raw: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, drag: int = 5, hold: int = 5) -> dict[str, np.ndarray]:
    """Fractal bands that follow the price while the trend runs against them, and dots of levels that held.

    The trend of a bar compares with the band before that bar moves it.
    """
    n = len(close)
    out = {k: np.full(n, np.nan) for k in ("fcb_upper", "fcb_lower", "fcb_dot_upper", "fcb_dot_lower")}
    level, dot, born, trend = [np.nan, np.nan], [np.nan, np.nan], [0, 0], 0
    raws, names = (up_raw, down_raw), (("fcb_upper", "fcb_dot_upper"), ("fcb_lower", "fcb_dot_lower"))
    differ = lambda a, b: not (a == b or (np.isnan(a) and np.isnan(b)))
    for t in range(n):
        before = list(level)
        for k in (0, 1):
            if np.isnan(level[k]):
                level[k] = raws[k][t]
        if close[t] > level[0]:
            trend = 1
        if close[t] < level[1]:
            trend = -1
        for k in (0, 1):
            if t and differ(raws[k][t], raws[k][t - 1]):
                level[k] = raws[k][t]
        if t >= drag:
            top, bottom = np.fmax.reduce(high[t - drag : t]), np.fmin.reduce(low[t - drag : t])
            if trend < 0 and not np.isnan(top) and not top >= level[0]:
                level[0] = top
            if trend > 0 and not np.isnan(bottom) and not bottom <= level[1]:
                level[1] = bottom
        for k in (0, 1):
            if differ(level[k], before[k]):
                if t - born[k] >= hold and not np.isnan(before[k]):
                    dot[k] = before[k]
                born[k] = t
            out[names[k][0]][t], out[names[k][1]][t] = level[k], dot[k]
    return out


CHAOS = ["fcb_upper", "fcb_lower", "fcb_dot_upper", "fcb_dot_lower"]
RECURSIVE = ["ema12", "macd_line", "macd_signal", "macd_hist", "rsi14", "atr14", "adx14", "di_plus", "di_minus", "ribbon", *CHAOS]


def ribbon(close: np.ndarray) -> np.ndarray:
    """Strongest is trend and momentum, then the trend alone, then the momentum alone."""
    line, fast, slow = S.macd(close)[0], S.ema(close, 8), S.ema(close, 21)
    return np.where(np.isnan(slow) | np.isnan(line), np.nan, 2.0 * (fast > slow) + 1.0 * (line > 0))


#: What is computed together: names, and their values from a ticker's columns.
FAMILIES = [
    (["ema12"], lambda b: [S.ema(b["close"], 12)]),
    (["macd_line", "macd_signal", "macd_hist"], lambda b: S.macd(b["close"])),
    (["rsi14"], lambda b: [S.rsi(b["close"])]),
    (["atr14"], lambda b: [S.atr(b["high"], b["low"], b["close"])]),
    (["di_plus", "di_minus", "adx14"], lambda b: S.directional(b["high"], b["low"], b["close"])),
    (["ribbon"], lambda b: [ribbon(b["close"])]),
    (CHAOS, lambda b: chaos_bands(b["fractal_up"], b["fractal_down"], b["high"], b["low"], b["close"]).values()),
]


def recursive(bars: DataFrame, wanted: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The recursive indicators that are wanted, one ticker's history at a time (a few thousand bars); ``keep`` stays."""
    wanted = RECURSIVE if wanted is None else wanted
    families = [(names, f) for names, f in FAMILIES if set(names) & set(wanted)]
    chaos = bool(set(CHAOS) & set(wanted))
    inputs = ["high", "low", "close", *(["fractal_up", "fractal_down"] if chaos else [])]
    own = (raw_fractals(bars) if chaos else bars).select("ticker", "date", *dict.fromkeys([*inputs, *keep]))
    shown = own.select("ticker", "date", *keep).schema.fields

    def of_ticker(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("date")
        arrays = {c: rows[c].to_numpy().astype(float) for c in inputs}
        out = rows.select([f.name for f in shown])
        for names, f in families:
            for name, values in zip(names, f(arrays)):
                if name in wanted:
                    out = out.append_column(name, pa.array(values, pa.float64(), from_pandas=True))
        return out.select([f.name for f in shown] + wanted)

    return own.groupBy("ticker").applyInArrow(of_ticker, T.StructType([*shown, *[T.StructField(c, T.DoubleType()) for c in wanted]]))


def capitulation(bars: DataFrame) -> DataFrame:
    return bollinger(bars).withColumn("capitulation", F.when(F.col("bb_lower").isNotNull(), (F.col("close") < F.col("bb_lower")).cast("int")))


def pivot_columns(bars: DataFrame, left: int = 4, right: int = 4) -> DataFrame:
    """Unique extremes of left + right + 1 bars, reported ``right`` bars later, by windows alone."""
    out = bars
    for name, column, agg in (("pivot_high", "high", F.max), ("pivot_low", "low", F.min)):
        mid = F.lag(column, right).over(S.by_ticker())
        older = S.full_before(agg, column, left, right + 1)
        newer = S.full(agg, column, right)
        alone = (mid > older) & (mid > newer) if agg is F.max else (mid < older) & (mid < newer)
        out = out.withColumn(name, F.when(alone, mid))
    return out


def indicators(bars: DataFrame) -> DataFrame:
    """All of them: one exchange for the windows, which the grouped map reuses and passes on."""
    wide = ichimoku(donchian(bollinger(moving_averages(bars)))).withColumns({"bars_available": S.position(), "volume_ma20": S.full(F.avg, "volume", 20)})
    return recursive(wide, keep=tuple(c for c in wide.columns if c not in ("ticker", "date")))
