"""The nightly increment: signals of new bars from a state carried for each ticker.

A state holds what the next bar needs of the past, whatever its length: the last 199 closes, the two Wilder averages of
the RSI, the run of equal closes, the bars of the last cross and of the last bad bar.  A night's bars meet the states by
ticker and move them on; nothing older is read.  A ticker whose bars come late or are corrected (a day that is not after
its last one) is taken up anew from its stored bars, and no other is.

`advance` over all bars and no states is the full computation, so a first load and a night run the same code.  Closes of
stored bars are not null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from candlewick.functions import series as S
from candlewick.operators.indicators import MOVING
from candlewick.operators.quality import JUMP_PCT, STALE_RUN
from candlewick.operators.signals import COLUMNS, NEEDS, TAINT
from candlewick.sources.bars import latest_by, with_actions
from candlewick.sources.snapshots import Snapshot
from candlewick.sources.tables import Store, put, read_from, upsert_in

TAIL, RSI = max(MOVING) - 1, 14
STATE = ["bars", "last_date", "closes", "rsi_up", "rsi_down", "stale_run", "cross_at", "bad_at", "was_above"]
INPUTS = ["ticker", "date", "open", "high", "low", "close", "split_factor"]
#: A row is a bar's signal or, with no date, a ticker's state.
OUT = "ticker string, date date, alignment_depth int, rsi_gate boolean, above_ma5 boolean, days_since_ma5_cross int, tier string, data_quality string, bars_available int, bars bigint, last_date date, closes array<double>, rsi_up double, rsi_down double, stale_run bigint, cross_at bigint, bad_at bigint, was_above boolean"
FRESH = {"bars": 0, "last_date": None, "closes": [], "rsi_up": None, "rsi_down": None, "stale_run": 0, "cross_at": None, "bad_at": None, "was_above": False}


def last_true(flag: np.ndarray, number: np.ndarray, before: int | None) -> np.ndarray:
    """Number of the last bar so far whose flag is set, 0 if there is none."""
    return np.maximum(np.maximum.accumulate(np.where(flag, number, 0)), before or 0)


def moved_on(state: dict, bars: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict]:
    """Signals of a ticker's next bars (one or more, oldest first), and its state behind them."""
    close, n = bars["close"], len(bars["close"])
    number = state["bars"] + 1 + np.arange(n)
    past = np.array(state["closes"], float)
    closes = np.concatenate([past, close])
    ma = {}
    for m in MOVING:
        own = np.full(n, np.nan)
        view = np.lib.stride_tricks.sliding_window_view(closes, m) if len(closes) >= m else np.zeros((0, m))
        full = view[-n:].sum(axis=1) / m
        own[n - len(full) :] = full
        ma[m] = own
    before = np.concatenate([past[-1:] if len(past) else [np.nan], close[:-1]])
    with np.errstate(divide="ignore", invalid="ignore"):
        jump = np.abs(np.where(before == 0, np.nan, close / before - 1) * 100)
    split = np.where(np.isnan(bars["split_factor"]), 1.0, bars["split_factor"])
    o, h, l = bars["open"], bars["high"], bars["low"]
    bad = ((jump > JUMP_PCT) & (split == 1.0)) | (h < l) | (h < o) | (h < close) | (l > o) | (l > close)
    # runs of equal closes, the first of which may go on from the state
    fresh = last_true(close != before, number, None)
    run = np.where(fresh > 0, number - fresh + 1, state["stale_run"] + 1 + np.arange(n))
    # Wilder averages: from the state, or from the start while they are not full
    if state["rsi_up"] is None:
        step = np.diff(closes, prepend=np.nan)
        up, down = (S.seeded(x, RSI)[-n:] for x in (np.maximum(step, 0), np.maximum(-step, 0)))
    else:
        step = close - before
        up, down = S.carried(state["rsi_up"], np.maximum(step, 0), RSI), S.carried(state["rsi_down"], np.maximum(-step, 0), RSI)
    rsi = S.rsi_of(up, down)
    gate = rsi > 50
    above = close > ma[5]
    cross = last_true(above & ~np.concatenate([[state["was_above"]], above[:-1]]), number, state["cross_at"])
    taint = last_true(bad, number, state["bad_at"])
    three = (ma[5] > ma[20]) & (ma[20] > ma[50])
    four, five = three & (ma[50] > ma[100]), three & (ma[50] > ma[100]) & (ma[100] > ma[200])
    depth = np.select([five & (number >= NEEDS[5]), four & (number >= NEEDS[4]), three & (number >= NEEDS[3])], [5, 4, 3], 0)
    reach = np.select([depth == d for d in TAINT], list(TAINT.values()))
    quality = np.select([number < NEEDS[5], (taint > 0) & (number - taint <= reach), run >= STALE_RUN], ["insufficient_history", "suspect", "stale"], "ok")
    tier = np.select([depth == 5, depth == 4, depth == 3], [np.where(gate, "A", "B"), np.where(gate, "B", "C"), np.where(gate, "C", "D")], "")
    out = {
        "alignment_depth": depth, "rsi_gate": np.where(np.isnan(rsi), None, gate), "above_ma5": np.where(np.isnan(ma[5]), None, above), "days_since_ma5_cross": np.where(above, number - cross, None),
        "tier": np.where(tier == "", None, tier), "data_quality": quality, "bars_available": number,
    }
    defined = lambda x: None if np.isnan(x) else float(x)
    end = {
        "bars": int(number[-1]), "last_date": bars["date"][-1], "closes": closes[-TAIL:].tolist(), "rsi_up": defined(up[-1]), "rsi_down": defined(down[-1]), "stale_run": int(run[-1]),
        "cross_at": int(cross[-1]) or None, "bad_at": int(taint[-1]) or None, "was_above": bool(above[-1]),
    }
    return out, end


def advance(states: DataFrame, bars: DataFrame) -> DataFrame:
    """Signals of the bars, and the states of all tickers of either table behind them (rows without a date)."""
    arrow = to_arrow_schema(T.StructType.fromDDL(OUT))

    def of_ticker(state: pa.Table, rows: pa.Table) -> pa.Table:
        known = state.select(STATE).to_pylist()
        end = known[0] if known else FRESH
        ticker = (state if known else rows)["ticker"][0].as_py()
        found = []
        if rows.num_rows:
            rows = rows.sort_by("date")
            own = {c: rows[c].to_numpy().astype(float) for c in INPUTS[2:]} | {"date": rows["date"].to_pylist()}
            out, end = moved_on(end, own)
            n = rows.num_rows
            found.append(pa.Table.from_arrays([pa.array([ticker] * n), rows["date"].combine_chunks(), *[pa.array(out[c].tolist(), arrow.field(c).type) for c in COLUMNS[2:]], *[pa.nulls(n, arrow.field(c).type) for c in STATE]], schema=arrow))
        found.append(pa.Table.from_pylist([{"ticker": ticker} | end], schema=arrow))
        return pa.concat_tables(found)

    own = with_actions(bars).select("ticker", "date", *[F.col(c).cast("double").alias(c) for c in INPUTS[2:]])
    return states.select("ticker", *STATE).groupBy("ticker").cogroup(own.groupBy("ticker")).applyInArrow(of_ticker, OUT)


def night(store: Store, incoming: DataFrame, order: str | None = None) -> Snapshot:
    """One version more: incoming bars in place of those of equal keys, their signals, and the states behind them."""
    change = store.versions.change()
    spark, base = store.spark, store.versions.at(change.base.version)
    if order:
        incoming = latest_by(incoming, ["ticker", "date"], order)
    upsert_in(change, "prices", incoming)
    staged = change.staged()
    states = read_from(base, "signal_state")
    first = incoming.groupBy("ticker").agg(F.min("date").alias("first"))
    late = first.join(states.select("ticker", "last_date"), "ticker").where("first <= last_date").select("ticker")
    prices = read_from(staged, "prices")
    again = prices.join(late, "ticker", "left_semi")
    after = with_actions(incoming).join(late, "ticker", "left_anti")
    fed = after.select(*INPUTS).unionByName(again.select(*INPUTS))
    # written aside once, as signals and states are both read from it
    change.write("_night", advance(states.join(late, "ticker", "left_anti"), fed))
    (at,) = change.parts.pop(("_night", ""))
    found = spark.read.schema(OUT).parquet(f"{base.root}/{at}")
    upsert_in(change, "signals", found.where("date is not null").select(*COLUMNS))
    put(change, "signal_state", found.where("date is null").select("ticker", *STATE), "whole")
    out = change.commit()
    store.versions.files.delete(at)
    return out
