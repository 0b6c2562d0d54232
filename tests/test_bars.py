"""Operators over small tables in the engine."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.operators import indicators, labels, quality, signals, store, walkforward
from candlewick.operators.costs import EXAMPLE, Band, CostError, Costs
from candlewick.plans.strategies import bottom_features
from candlewick.sources import bars as B

DAY = dt.date(2024, 1, 1)
SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume bigint, split_factor double, dividend double"


def frame(spark, closes, **over):
    rows = []
    for i, c in enumerate(closes):
        row = {"open": c, "high": c + 1, "low": c - 1, "close": c, "volume": 1000, "split_factor": 1.0} | {k: v[i] for k, v in over.items() if i in v}
        rows.append(("T", DAY + dt.timedelta(i), row["open"], row["high"], row["low"], row["close"], row["volume"], row["split_factor"], 0.0))
    return spark.createDataFrame(rows, SCHEMA)


def test_jump_is_suspicious_without_a_split(spark):
    for split, want in ((1.0, True), (2.0, False)):
        got = quality.flagged(frame(spark, [100.0, 140.0], split_factor={1: split})).orderBy("date").collect()
        assert got[1].suspicious_jump is want and not got[0].suspicious_jump


def test_flags_of_bad_bars(spark):
    got = quality.flagged(frame(spark, [100.0] * 7, volume={2: 0}, low={3: 102.0})).orderBy("date").collect()
    assert [r.stale_price for r in got] == [False] * 4 + [True] * 3
    assert got[2].zero_volume and got[3].impossible_bar and got[0].is_clean and not got[3].is_clean


def test_depth_needs_history_and_criteria(spark):
    got = signals.signals(frame(spark, [100.0 + i for i in range(60)])).orderBy("date").collect()[-1]
    assert (got.alignment_depth, got.tier, got.data_quality, got.rsi_gate) == (3, "C", "insufficient_history", True)
    one = spark.range(1).select(signals.criteria(F.lit(3), F.lit(True)).alias("a"), signals.criteria(F.lit(5), F.lit(True)).alias("b"), signals.criteria(F.lit(5), F.lit(None).cast("boolean")).alias("c")).first()
    assert tuple(one) == ("K3, K6", "K1, K2, K3, K4, K5, K6", "K1, K2, K3")


def test_contamination_reaches_two_hundred_bars(spark):
    closes = [100.0 + i for i in range(460)]
    closes[230:] = [c * 2 for c in closes[230:]]
    got = {r.date: r.data_quality for r in signals.signals(frame(spark, closes)).collect()}
    assert got[DAY + dt.timedelta(230 + 200)] == "suspect" and got[DAY + dt.timedelta(230 + 201)] == "ok"


@pytest.mark.parametrize("tie,want", [("unfavourable", "stop"), ("favourable", "target")])
def test_label_tie(spark, tie, want):
    b = frame(spark, [100.0] * 30, high={3: 110.0}, low={3: 90.0})
    entry = spark.createDataFrame([("T", DAY)], "ticker string, date date")
    got = labels.labelled(b, entry, [labels.Rule(20, 8.0, 4.0, tie)]).first()
    assert got.outcome == want and got.bars_held == 2


def test_label_of_a_short_history_is_open(spark):
    entry = spark.createDataFrame([("T", DAY)], "ticker string, date date")
    got = labels.labelled(frame(spark, [100.0] * 10), entry, [labels.HOLD_20], EXAMPLE).first()
    assert got.outcome == "open" and got.return_pct is None and got.gross_return_pct is None


def test_many_rules_equal_single_passes(spark):
    b = frame(spark, [100.0 + (i * 7) % 13 for i in range(60)])
    entries = b.select("ticker", "date").limit(25)
    rules = [labels.HOLD_20, labels.TARGET_8_4, labels.Rule(10)]
    together = {(r.entry_date, r.rule_version): r for r in labels.labelled(b, entries, rules).collect()}
    alone = {(r.entry_date, r.rule_version): r for rule in rules for r in labels.labelled(b, entries, [rule]).collect()}
    assert together == alone


def test_cost_bands_are_checked():
    bad = [(Band(0, 100, 1), Band(200, None, 2)), (Band(0, 100, 1), Band(50, None, 2)), (Band(0, 100, 1),), (Band(0, None, 0),), ()]
    for bands in bad:
        with pytest.raises(CostError):
            Costs(0.001, 0.002, bands)


def test_tick_grid(spark):
    got = spark.range(1).select(EXAMPLE.buy_price(F.lit(1003.0)).alias("a"), EXAMPLE.sell_price(F.lit(1003.0)).alias("b"), EXAMPLE.on_grid(F.lit(1003.0)).alias("c")).first()
    assert tuple(got) == (1005.0, 1000.0, 1005.0)


def test_folds_clamp_months_and_drop_stubs():
    got = walkforward.folds(dt.date(2020, 1, 31), dt.date(2022, 3, 10), 1, 1)
    assert got[0].test_start == dt.date(2020, 2, 29) and (got[-1].test_end - got[-1].test_start).days >= 28


def test_purge_removes_trades_that_reach_the_test(spark):
    rows = spark.createDataFrame([(dt.date(2020, 1, 1), dt.date(2020, 1, 9)), (dt.date(2020, 1, 25), dt.date(2020, 2, 9))], "entry_date date, exit_date date")
    fold = walkforward.fold_table(spark, [walkforward.Fold(1, dt.date(2020, 1, 1), dt.date(2020, 2, 1), dt.date(2020, 3, 1))])
    assert walkforward.training(rows, fold).count() == 1 and walkforward.training(rows, fold, purge=False).count() == 2


def test_universe_rules(spark):
    schema = "ticker string, name string, sector string, is_active boolean, first_seen date, last_seen date, delisted_at date"
    known = spark.createDataFrame([(f"T{i}", "n", "s", i != 0, DAY, DAY, DAY if i == 0 else None) for i in range(9)], schema)
    with pytest.raises(ValueError):
        store.sync_universe(known, known.limit(0), "2024-02-01")
    few = store.sync_universe(known, known.where("ticker in ('T0', 'T1')"), "2024-02-01")
    assert not few.deactivated and few.missing == 7
    back = {r.ticker: r for r in few.tickers.collect()}
    assert back["T0"].is_active and back["T0"].delisted_at is None and back["T5"].is_active


def test_upsert_keeps_the_last(spark):
    a = spark.createDataFrame([("T", 1, 1.0), ("T", 2, 2.0)], "ticker string, k int, x double")
    b = spark.createDataFrame([("T", 2, 5.0, 1), ("T", 2, 7.0, 2), ("U", 1, 9.0, 1)], "ticker string, k int, x double, at int")
    assert sorted((r.ticker, r.k, r.x) for r in store.upsert(a, b, ["ticker", "k"], "at").collect()) == [("T", 1, 1.0), ("T", 2, 7.0), ("U", 1, 9.0)]


def test_listing_dates(spark):
    texts = ["2020-01-02", "3/4/2021", "5 Agustus 2019", "7 Des 2018", "9 May 2017", "?", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(store.listing_date(F.col("t")).alias("d")).collect()
    assert [r.d for r in got] == [dt.date(2020, 1, 2), dt.date(2021, 4, 3), dt.date(2019, 8, 5), dt.date(2018, 12, 7), dt.date(2017, 5, 9), None, None]


def test_landed_bars_are_normalised(spark):
    schema = "ticker string, date date, open string, high string, low string, close string, volume string, split_factor double, dividend double, ingested_at int"
    raw = spark.createDataFrame([("T", DAY, "1", "2", "x", "nan", "5.6", 0.0, None, 1), ("T", DAY, "1", "3", "1", "2", "7", 0.0, None, 2), ("T", DAY + dt.timedelta(1), None, None, None, None, "1", 1.0, 0.0, 1)], schema)
    got = B.normalised(raw).collect()
    assert [(r.high, r.volume, r.split_factor, r.dividend) for r in got] == [(3.0, 7, 1.0, 0.0)]


def on_bands(many, seed=5):
    """Histories of 20 bars whose newest close lies on a band exactly: two deviations of 4 closes that differ from the other 16."""
    rng = np.random.default_rng(seed)
    for k in range(many):
        usual, step = int(rng.integers(500, 3000)) * 2, int(rng.integers(1, 200)) * 2
        closes = [usual] * 16 + [usual + (step if k % 2 else -step)] * 3
        yield [float(x) for x in rng.permutation(closes)] + [float(closes[-1])]


def walk_bands(closes):
    own = bottom_features({k: np.array(closes) for k in ("high", "low", "close")})
    return own["bb_upper"], own["bb_lower"]


def test_a_close_on_a_band_is_on_it(spark):
    histories = list(on_bands(200))
    rows = [(f"T{k}", DAY + dt.timedelta(n), x) for k, own in enumerate(histories) for n, x in enumerate(own)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    got = {r.ticker: r for r in indicators.capitulation(bars).where("bb_mid is not null").collect()}
    assert len(got) == 200
    for k, own in enumerate(histories):
        r = got[f"T{k}"]
        assert (r.bb_upper if k % 2 else r.bb_lower) == r.close == own[-1] and r.capitulation == 0
        upper, lower = walk_bands([1e3, *own])  # a bar before the window takes no part
        assert (upper[-1], lower[-1]) == (r.bb_upper, r.bb_lower) and np.isnan(upper[:19]).all()
    odd = np.random.default_rng(1).normal(1e4, 0.01, 300)
    for n in range(19, 300):
        own = odd[n - 19 : n + 1]
        upper, lower = (x[n] for x in walk_bands(odd))
        assert abs(upper - (own.mean() + 2 * own.std())) < 1e-8 and abs(lower - (own.mean() - 2 * own.std())) < 1e-8
