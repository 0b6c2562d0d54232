"""Fetching bars in batches: retries with growing delays, a breaker, and an outcome for every ticker.

The downloader is given: a function from a list of tickers to a frame of their bars, which raises
where a whole batch fails.  At most three workers run, each one task that takes its batches in order.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BAR = "struct<date: date, open: double, high: double, low: double, close: double, volume: bigint>"
OUTCOME = f"batch int, ticker string, status string, rows_written bigint, error_message string, attempt int, bars array<{BAR}>"
#: What an error text says, in the order in which it is looked for; anything else could not be read.
MARKERS = {
    "rate_limited": ("too many requests", "rate limit", "429", "yfratelimit"),
    "network_error": ("connection", "timed out", "timeout", "temporary failure", "name resolution", "unreachable", "max retries exceeded", "ssl", "remote end closed", "getaddrinfo"),
    "empty_response": ("no price data", "no data found"),
}
OTHERWISE = "parse_error"


@dataclass(frozen=True)
class Pace:
    """How gently to ask; delays double from ``base`` to ``most`` seconds, give or take a share ``jitter``."""

    batch: int = 40
    workers: int = 2
    attempts: int = 5
    base: float = 2.0
    most: float = 120.0
    jitter: float = 0.4
    breaker: int = 3
    pause: float = 1.0

    def __post_init__(self) -> None:
        if not 1 <= self.workers <= 3:
            raise ValueError("one to three workers")
        if self.batch < 1:
            raise ValueError("a batch has one ticker at least")

    def delay(self, attempt: int, draw: Callable[[float, float], float] = random.uniform) -> float:
        own = min(self.base * 2 ** max(0, attempt - 1), self.most)
        return max(0.0, own + draw(-own * self.jitter, own * self.jitter))


def status_of(error: BaseException | str) -> str:
    text = (f"{type(error).__name__}: {error}" if isinstance(error, BaseException) else error).lower()
    return next((status for status, parts in MARKERS.items() if any(p in text for p in parts)), OTHERWISE)


def asked(tickers: list[str], downloader: Callable[[list[str]], pd.DataFrame], pace: Pace, sleep: Callable[[float], None]) -> list[dict]:
    """Outcomes of one batch; only a refusal of the whole batch is tried again."""
    for attempt in range(1, pace.attempts + 1):
        try:
            found = dict(list(downloader(tickers).groupby("ticker")))
        except Exception as error:  # recorded for every ticker of the batch
            status = status_of(error)
            if status == "rate_limited" and attempt < pace.attempts:
                sleep(pace.delay(attempt))
                continue
            return [{"ticker": t, "status": status, "rows_written": 0, "error_message": f"{type(error).__name__}: {error}", "attempt": attempt, "bars": []} for t in tickers]
        out = []
        for t in tickers:
            bars = found[t].drop(columns="ticker").to_dict("records") if t in found else []
            out.append({"ticker": t, "status": "ok" if bars else "empty_response", "rows_written": len(bars), "error_message": None, "attempt": attempt, "bars": bars})
        return out
    raise AssertionError("unreachable")


def fetched(tickers: DataFrame, downloader: Callable[[list[str]], pd.DataFrame], pace: Pace = Pace(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """A row of OUTCOME for every ticker.  Write it once before using it: each evaluation asks again.

    After ``breaker`` refused batches in a row a worker leaves its other batches as circuit_open.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True)
        refused = 0
        for k, (batch, own) in enumerate(rows.groupby("batch", sort=True)):
            names = own["ticker"].tolist()
            if refused >= pace.breaker:
                out = [{"ticker": t, "status": "circuit_open", "rows_written": 0, "error_message": f"{refused} batches in a row were refused", "attempt": 1, "bars": []} for t in names]
            else:
                if k and pace.pause:
                    sleep(pace.pause)
                out = asked(names, downloader, pace, sleep)
                refused = refused + 1 if all(x["status"] == "rate_limited" for x in out) else 0
            yield pd.DataFrame([{"batch": batch, **x} for x in out])

    # the listed names are few thousand rows: one window numbers them
    numbered = tickers.select("ticker").distinct().withColumn("batch", ((F.row_number().over(W.orderBy("ticker")) - 1) / pace.batch).cast("int"))
    return numbered.repartitionById(pace.workers, F.col("batch") % pace.workers).mapInPandas(run, OUTCOME)


def landed(outcomes: DataFrame) -> DataFrame:
    """The bars of written outcomes."""
    return outcomes.select("ticker", F.explode("bars").alias("b")).select("ticker", "b.*")
