"""Nights, bucketed tables and chunked averages on small tables."""

from datetime import date, timedelta

import numpy as np
import pytest

from candlewick.functions import chunks
from candlewick.operators import indicators, nightly, signals
from candlewick.sources import buckets
from candlewick.sources.tables import Store

BARS = "ticker string, date date, open double, high double, low double, close double, volume bigint, split_factor double"


def walk(ticker, n, seed):
    rng = np.random.default_rng(seed)
    close = 1000.0 + np.cumsum(rng.integers(-9, 11, n))
    close[rng.integers(0, n, 3)] *= 2  # jumps
    close[n // 2 : n // 2 + 7] = close[n // 2]  # a run of equal closes
    return [(ticker, date(2020, 1, 1) + timedelta(days=k), float(c), float(c + 3), float(c - 3), float(c), 5, 2.0 if k == n // 3 else 1.0) for k, c in enumerate(close)]


@pytest.fixture(scope="module")
def rows():
    return walk("A", 420, 1) + walk("B", 260, 2) + walk("C", 9, 3) + walk("D", 1, 4)


def tuples(frame):
    return sorted(tuple(r) for r in frame.select(*signals.COLUMNS).collect())


def signals_equal(spark, store, rows):
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    got, want = (sorted((tuple(r) for r in f.select(*signals.COLUMNS).collect()), key=key) for f in (store.read("signals"), signals.signals(spark.createDataFrame(rows, BARS))))
    assert got == want


@pytest.mark.parametrize("cuts", [[1], [3, 14, 15, 16, 40], [199, 200, 201], [250, 300]])
def test_nights_equal_the_full_computation(spark, tmp_path, rows, cuts):
    own = Store(spark, f"file://{tmp_path}/s")
    own.init()
    start = date(2020, 1, 1)
    days = [start, *[start + timedelta(days=k) for k in cuts], date(2100, 1, 1)]
    for a, b in zip(days, days[1:]):
        version = nightly.night(own, spark.createDataFrame([r for r in rows if a <= r[1] < b], BARS)).version
    assert version == own.snapshot().version == 1 + len(days) - 1
    signals_equal(spark, own, rows)


def test_corrected_and_late_bars_take_up_their_ticker_anew(spark, tmp_path, rows):
    own = Store(spark, f"file://{tmp_path}/s")
    own.init()
    first = [r for r in rows if r[1] < date(2020, 12, 1) and r[:2] != ("B", date(2020, 3, 3))]
    nightly.night(own, spark.createDataFrame([(*r[:5], r[5] + 50, *r[6:]) if r[:2] == ("A", date(2020, 9, 9)) else r for r in first], BARS))
    more = [r for r in rows if r[1] >= date(2020, 12, 1) or r[:2] in (("B", date(2020, 3, 3)), ("A", date(2020, 9, 9)))]
    state = {r.ticker: r.bars for r in own.read("signal_state").collect()}
    assert state == {"A": 335, "B": 259, "C": 9, "D": 1}
    nightly.night(own, spark.createDataFrame([(*r, 1) for r in more] + [(*more[0][:5], 1.0, *more[0][6:], 0)], f"{BARS}, stamp int"), "stamp")
    signals_equal(spark, own, rows)
    assert {r.ticker: r.bars for r in own.read("signal_state").collect()} == {"A": 420, "B": 260, "C": 9, "D": 1}


def test_a_night_without_bars(spark, tmp_path, rows):
    own = Store(spark, f"file://{tmp_path}/s")
    own.init()
    nightly.night(own, spark.createDataFrame(rows[:30], BARS))
    before = tuples(own.read("signals"))
    nightly.night(own, spark.createDataFrame([], BARS))
    assert tuples(own.read("signals")) == before and own.read("signal_state").count() == 1


def test_bucketed_tables_join_without_an_exchange(spark, rows):
    bars = spark.createDataFrame(rows, BARS)
    own = buckets.bucketed(spark, 3, prices=bars.select("ticker", "date", "close"), signals=signals.signals(bars), averages=indicators.moving_averages(bars).select("ticker", "date", "ma5", "ma20"))
    chain = buckets.newest(buckets.chained(own, "prices", "signals", "averages"))
    plan = chain._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    assert {(r.ticker, r.date, r.close) for r in chain.collect()} == {r for r in {t: (t, d, c) for t, d, _, _, _, c, _, _ in rows}.values()}
    own.drop()


@pytest.mark.parametrize("days", [1, 7, 16, 17, 100, 5000])
def test_chunks_give_the_averages_of_whole_histories(spark, rows, days):
    bars = spark.createDataFrame(rows, BARS)
    want = {(r.ticker, r.date): (r.ema12, r.rsi14, r.atr14) for r in indicators.recursive(bars, ["ema12", "rsi14", "atr14"]).collect()}
    got = {(r.ticker, r.date): (r.ema12, r.rsi14, r.atr14) for r in chunks.averages(bars, days).collect()}
    assert got.keys() == want.keys()
    for k, own in got.items():
        for a, b in zip(own, want[k]):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-8)), k
