"""Bars from ticks and per-ticker state over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars_of_ticks(ticks: DataFrame, every: str = "1 day", late: str = "7 days") -> DataFrame:
    """OHLCV per ticker and window of ticks (ticker, ts, price, volume); ticks later than ``late`` are left out.

    The same function serves a stream, with the watermark, and a table.
    """
    own = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    return own.groupBy("ticker", F.window("ts", every)).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume")).select("ticker", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")


EMA_STATE = "seen long, value double, last timestamp"
EMA_OUT = "ticker string, start timestamp, ema double"


def running_ema(bars: DataFrame, span: int = 12, idle: str = "30 days") -> DataFrame:
    """An exponential average that carries its state from batch to batch; null until ``span`` bars were seen.

    A bar that does not start after the last one averaged comes too late and is left out.  The state of a ticker that
    gets no bars for ``idle`` goes.
    """
    a, idle_ms = 2 / (span + 1), int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, value, last = state.get if state.exists else (0, 0.0, None)
        rows = pd.concat(list(frames)).sort_values("start")
        if last is not None:
            rows = rows[rows["start"] > last]
        out = []
        for close in rows["close"]:
            value = close if not seen else value * (1 - a) + a * close
            seen += 1
            out.append(value if seen >= span else None)
        if len(rows):
            state.update((seen, float(value), rows["start"].iloc[-1].to_pydatetime()))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"ticker": key[0], "start": rows["start"], "ema": out})

    return bars.groupBy("ticker").applyInPandasWithState(step, EMA_OUT, EMA_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
