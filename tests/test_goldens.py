"""Hand-made bars through the walking part of the strategies, and definitions of indicators."""

import numpy as np
import pytest

from candlewick.functions import series as S
from candlewick.operators import indicators
from candlewick.plans import strategies as P
from candlewick.plans import trade_log
from candlewick.sources import bars as B


def bars(n, o=100.0, c=100.0, h=101.0, l=99.0, v=1000.0):
    return {k: np.full(n, float(x)) for k, x in (("open", o), ("high", h), ("low", l), ("close", c), ("volume", v))}


def flags(n, *at):
    out = np.zeros(n, bool)
    out[list(at)] = True
    return out


def ends(desk):
    return [(t["exit_code"], round(t["exit_price"], 2)) for t in desk.trades]


def test_early_entry():
    b = bars(12, h=102, l=98)
    b["high"][2], b["high"][4], b["open"][9], b["low"][9] = 115, 111, 90, 89
    f = {"signal": flags(12, 1, 6), "atr": np.full(12, 2.0)}
    desk = P.EarlyEntry(b, f).run()
    assert ends(desk)[0] == ("CL Stop loss", 100.0) and desk.trades[0]["exit_at"] == 3
    b["high"][2] = 102
    f["atr"] = np.full(12, 3.0)
    assert ends(P.EarlyEntry(b, {"signal": flags(12, 1, 6), "atr": np.full(12, 4.0)}).run())[0] == ("TP Target 10%", 110.0)


def test_buy_the_dip_takes_lots_together():
    b = bars(14, c=101)
    b["open"][8], b["close"][5:10], b["close"][10], b["open"][11] = 104, 106, 102, 102
    f = {"atr": np.full(14, 1.0), "uptrend": np.ones(14, bool), "golden": flags(14, 1), "death": flags(14), "dip": flags(14, 4, 7)}
    desk = P.walk_dips(b, f)
    assert [(t["entry_code"], t["entry_price"], t["exit_code"], t["exit_price"]) for t in desk.trades] == [("BUY Golden cross", 100, "TP Trailing stop", 102), ("BUY Dip", 104, "CL Trailing stop", 102)]
    ok = np.ones(14, bool)
    ok[1] = False
    assert [t["entry_code"] for t in P.walk_dips(b, f | {"entry_ok": ok}).trades][-1] == "BUY Dip"


@pytest.mark.parametrize("edit,want", [({("low", 5): 94.0}, ("CL Stop loss", 94.5)), ({("high", 4): 121.0}, ("TP Target 20%", 120.0)), ({}, ("CL Time stop", 100.0))])
def test_sniper(edit, want):
    b = bars(20)
    for (k, i), x in edit.items():
        b[k][i] = x
    desk = P.Sniper(b, {"signal": flags(20, 1), "range_low": np.full(20, 90.0)}).run()
    assert ends(desk)[0] == want


def test_sniper_bracket_stops_first():
    b = bars(12)
    b["high"][2], b["high"][3], b["low"][7], b["high"][7] = 120, 108, 89, 110
    assert ends(P.SniperBracket(b, {"signal": flags(12, 1, 5)}).run()) == [("TP Target 7%", 107.0), ("CL Stop 10%", 90.0)]


def test_guarded_breakout():
    f = lambda: {"signal": flags(30, 1), "range_low": np.full(30, 90.0), "range_high": np.full(30, 99.0), "atr": np.full(30, 1.0)}
    desk = P.Guarded(bars(30), f()).run()
    assert desk.trades[0]["exit_code"] == "CL Time Stop" and desk.trades[0]["exit_at"] == 18
    b = bars(30)
    b["close"][2] = 97.0
    desk = P.Guarded(b, f()).run()
    assert desk.trades[0]["exit_code"] == "CL Failed Breakout" and desk.trades[0]["exit_at"] == 3


def test_pattern_halves_and_trail():
    b = bars(12, o=1000, c=1000, h=1010, l=990)
    b["high"][3], b["close"][5], b["open"][6] = 1110, 890, 1050
    code = np.full(12, "BUY VCP 2T", object)
    f = {"signal": flags(12, 1, 7), "base_low": np.full(12, 950 / 0.995), "code": code, "trail_ma": np.full(12, 900.0)}
    desk = P.walk_patterns(b, f)
    first = desk.trades[0]
    assert first["entry_price"] == 1000 and first["exit_code"].startswith("TP 2R") and first["exit_price"] > 1000


def test_flat_bars_never_trade():
    for s in P.STRATEGIES.values():
        b = bars(300)
        with np.errstate(invalid="ignore", divide="ignore"):
            assert not s.walk(b, s.prepare(b)).trades, s.key


@pytest.mark.parametrize("key", list(P.STRATEGIES))
def test_finished_trades_ignore_the_future(key):
    rng = np.random.default_rng(3)
    n = 700
    c = 1000 + np.cumsum(rng.integers(-20, 21, n)).astype(float)
    o = np.concatenate([[1000.0], c[:-1]])
    b = {"open": o, "close": c, "high": np.maximum(o, c) + rng.integers(0, 9, n), "low": np.minimum(o, c) - rng.integers(0, 9, n), "volume": rng.integers(1, 9, n) * 3e6}
    s, cut = P.STRATEGIES[key], 600
    with np.errstate(invalid="ignore", divide="ignore"):
        whole = s.walk(b, s.prepare(b)).trades
        short = {k: x[:cut] for k, x in b.items()}
        part = s.walk(short, s.prepare(short)).trades
    done = lambda ts: [(t["entry_at"], t["exit_at"], t["exit_code"], t["exit_price"]) for t in ts if t["resolved"] and t["exit_at"] < cut - 1]
    assert done(whole) == done(part)


def test_rsi_of_plain_series():
    for x, want in ((np.full(20, 5.0), 50), (np.arange(20.0), 100), (-np.arange(20.0), 0)):
        got = S.rsi(x)
        assert np.isnan(got[:14]).all() and got[14:] == pytest.approx(want)


def test_seeded_average_equals_its_recursion():
    x = np.random.default_rng(1).random(60)
    got, y = S.seeded(x, 14), x[:14].mean()
    for i in range(14, 60):
        y = (y * 13 + x[i]) / 14
        assert got[i] == pytest.approx(y)
    assert np.isnan(S.seeded(x[:13], 14)).all()


def test_pivots_are_unique_extremes():
    x = np.array([1, 2, 3, 2, 1, 3, 3, 1, 0.0])
    assert np.nan_to_num(S.pivots(x, 1, 1, True)).tolist() == [0, 0, 0, 3, 0, 0, 0, 0, 0]


# The published bars of each check.


def test_bottom_fishing_buys_the_reclaim_and_cuts_the_crash():
    b = bars(29, h=100.5, l=99.5)
    for i, (h, l, o, c) in enumerate(((95, 88, 95, 90), (102, 99, 96, 101), (92, 80, 90, 82), (86, 78, 85, 79)), 25):
        b["high"][i], b["low"][i], b["open"][i], b["close"][i] = h, l, o, c
    desk = P.walk_bottoms(b, P.bottom_features(b))
    assert desk.codes[26].startswith("BUY (") and desk.trades[0]["entry_at"] == 26
    assert desk.trades[0]["gross_return_pct"] == pytest.approx((82 / 101 - 1) * 100) and desk.trades[0]["exit_code"].startswith("SELL CL")


def test_market_structure_buys_a_higher_low_on_volume():
    c = np.array([*range(100, 131), 126, 124, 122, 124, 126, 128, 126, 124, 126, 128, 130, 133], float)
    v = np.full(len(c), 2000.0)
    v[31:41], v[-2:] = 200, 8000
    b = {"open": np.append(c[:1], c[:-1]), "high": c + 0.5, "low": c - 0.8, "close": c, "volume": v, "ma200": np.full(len(c), np.nan)}
    desk = P.walk_structure(b, P.structure_features(b))
    assert any(x.startswith("BUY LOW (EMA20)") for x in desk.codes) and len(desk.lots) <= 1


def test_reversal_breaks_out_takes_profit_and_enters_again():
    c = np.array([*np.linspace(200, 100, 60), 104, 108, 112, 116, 120, 117, 114, 111, 108, 110, 113, 115, 116, 118, 122, 126, 140, 150, 160, 150, 138, 128, 118, 112, 108, 106, 115, 124, 130], float)
    b = {"open": c, "high": c + 0.5, "low": c - 0.5, "close": c, "volume": np.ones(len(c))}
    desk = P.walk_reversals(b, P.reversal_features(b))
    fired = [x for x in desk.codes if x]
    assert fired.index("BUY HH-HL") < fired.index("TP Smart MA5") < fired.index("BUY Re-Entry")
    assert all(t["gross_return_pct"] > 0 for t in desk.trades if t["exit_code"] == "TP Smart MA5")


def test_accumulation_breakout_follows_the_run():
    c = np.array([100.0 + i % 2 for i in range(30)] + [110, 115, 120, 126, 132, 138, 140, 139, 130, 118, 110])
    v = np.full(len(c), 1000.0)
    v[30] = 5000
    b = {"open": c - 0.5, "high": c + 1, "low": c - 1, "close": c, "volume": v}
    desk = P.Chandelier(b, P.base_features(b, P.BASE_D) | {"signal": flags(len(c), 30)}).run()
    (trade,) = desk.trades
    assert desk.codes[31] == "BUY Breakout" and trade["entry_price"] == 114.5 and not desk.armed
    assert trade["exit_code"] == "TP Trailing stop" and trade["exit_price"] > 114.5


def test_accumulation_signal_needs_base_and_volume():
    c = np.array([100.0 + i % 2 for i in range(79)] + [106.0])
    b = {"open": c - 0.5, "high": c + 1, "low": c - 1, "close": c, "volume": np.array([1000.0] * 79 + [5000.0])}
    assert P.base_features(b, P.BASE_D)["signal"].tolist() == [False] * 79 + [True]


def test_the_directional_gate_opens_on_a_climb_only():
    for c, want in ((np.linspace(100, 200, 80), True), (np.full(80, 100.0), False)):
        f = P.filtered_dip_features({"open": c, "high": c + 1, "low": c - 1, "close": c})
        assert bool(f["entry_ok"][-1]) is want


def test_fills_move_to_the_next_open():
    b = {"open": np.arange(10.0, 16), "high": np.arange(11.0, 17), "low": np.arange(9.0, 15), "close": np.arange(10.5, 16)}
    desk = P.Desk(b)
    closed = {"entry_at": 0, "entry_price": 10.5, "entry_code": "BUY", "exit_at": 2, "exit_price": 12.5, "exit_code": "TP", "bars_held": 2, "gross_return_pct": 0.0, "resolved": True}
    desk.trades = [closed, closed | {"entry_at": 3, "exit_at": 5}, closed | {"entry_at": 5, "exit_at": 5, "resolved": False, "exit_code": "OPEN"}]
    (a, c), waits = P.filled_at_next_open(desk)
    assert waits and (a["entry_price"], a["exit_price"], a["entry_at"], a["bars_held"]) == (11, 13, 1, 2)
    assert (c["entry_price"], c["exit_price"], c["resolved"], c["exit_code"]) == (14, 15.5, False, "OPEN")


def test_chaos_bands_follow_fractals_and_drag_against_the_trend():
    nan = np.nan
    high = np.array([10, 11, 15, 12, 11, 10, 9, 8, 7, 6, 5, 5.0])
    low = high - 2
    up, down = np.full(12, nan), np.full(12, nan)
    up[4:], down[2:] = 15.0, 8.0
    got = indicators.chaos_bands(up, down, high, low, np.append(np.full(6, 9.0), np.full(6, 4.0)))
    assert np.isnan(got["fcb_upper"][:4]).all() and got["fcb_upper"][4] == 15
    # the close under the lower band turns the trend: the upper band falls to the highest of the five bars before
    assert got["fcb_upper"][5:].tolist() == [15, 15, 15, 12, 11, 10, 9]
    assert got["fcb_lower"][2:].tolist() == [8.0] * 10
    # a level that held for five bars leaves a dot, one that moves on at once leaves none
    assert np.isnan(got["fcb_dot_upper"]).all()
    assert np.isnan(got["fcb_dot_lower"]).all()


INVARIANT_KEYS = [k for k in P.STRATEGIES if k != "H"]


def test_invariants_of_every_log(spark):
    """What holds for any bars: one latest row a ticker, one kind of return, peaks inside the trade."""
    frame = B.bars(spark, "/root/testdata/sf0.001").cache()
    own = trade_log.build(frame, *[P.STRATEGIES[k] for k in INVARIANT_KEYS]).toPandas()
    assert len(own) > 50
    for key, log in own.groupby("strategy"):
        trades, watch = log[log.status != "WATCHLIST"], log[log.status == "WATCHLIST"]
        assert (trades.pb == "B").all() and (watch.pb == "P").all() and watch.buy_price.isna().all()
        assert trades[trades.status == "OPEN"].pl_pct.isna().all() and trades[trades.status != "OPEN"].fl_pct.isna().all()
        assert trades.hi_date.isna().equals(trades.max_fl_pct.isna())
        peaked = trades[trades.hi_date.notna()]
        assert (peaked.hi_date > peaked.buy_date).all() and (peaked[peaked.exit_date.notna()].hi_date <= peaked[peaked.exit_date.notna()].exit_date).all()
        flat = trades[trades.hi_date.isna()]
        assert ((flat.status == "OPEN") | (flat.exit_date == flat.buy_date)).all()
        signalled = trades[trades.signal_date.notna()]
        assert (signalled.signal_date < signalled.buy_date).all() and signalled.signal_price.notna().all()
        if key != "C":
            assert (trades.max_fl_pct.isna() | (trades.max_fl_pct >= trades.pl_pct.fillna(-1e9) - 1e-9)).all()
        if key not in ("bottom_fishing", "A", "B", "C"):
            assert (trades[trades.status == "CLOSED"].pl_pct > 0).all()
        assert trades[trades.status == "EXIT"].exit_code.str[:2].isin(["CL", "SL", "SE"]).all()
    counts = trade_log.latest(trade_log.build(frame, P.STRATEGIES["G"])).groupBy("ticker").count()
    assert counts.where("count > 1").isEmpty()
