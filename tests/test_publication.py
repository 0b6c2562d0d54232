"""What is published for readers, on small tables, and small operators beside it."""

import json
import re
from datetime import date, timedelta

import numpy as np
import pytest

from candlewick import registry
from candlewick.operators import calibration, charts, labels, nightly, store, walkforward
from candlewick.operators.costs import CostError, Costs
from candlewick.plans import publication, trade_log
from candlewick.plans.strategies import STRATEGIES
from candlewick.sources.tables import Store

BARS = "ticker string, date date, open double, high double, low double, close double, volume bigint"


def breakouts(ticker, seed, n=420):
    rng = np.random.default_rng(seed)
    close, rows = 1000.0, []
    for k in range(n):
        loud = k % 60 == 55
        before, close = close, float(close + (round(close * 0.03) if loud else rng.integers(-3, 4) + 1))
        rows.append((ticker, date(2020, 1, 1) + timedelta(days=k), before, max(before, close) + 1, min(before, close) - 1, close, 900 if loud else 100))
    return rows


def test_a_publication_is_one_version_of_its_own_rows(spark, tmp_path):
    own, target = Store(spark, f"file://{tmp_path}/full"), Store(spark, f"file://{tmp_path}/slim")
    own.init()
    rows = [r for k in range(3) for r in breakouts("ABC"[k], k)]
    cut = date(2020, 12, 1)
    nightly.night(own, spark.createDataFrame([r for r in rows if r[1] < cut], BARS))
    own.write("tickers", spark.createDataFrame([(t, t, "s", True) for t in "ABC"], "ticker string, name string, sector string, is_active boolean"))
    first = publication.published(own, target, bars=30)
    reader = target.pin()
    nightly.night(own, spark.createDataFrame([r for r in rows if r[1] >= cut], BARS))
    assert publication.published(own, target, bars=30).version == first.version + 1
    logs = lambda s, key: sorted(map(repr, publication.strategy_log(s, key).drop("seq").collect()))
    bars = spark.createDataFrame(rows, BARS)
    for key in "DG":
        assert logs(target, key) == sorted(map(repr, trade_log.build(bars, STRATEGIES[key]).select(*publication.strategy_log(target, key).drop("seq").columns).collect()))
        assert logs(reader, key) == sorted(map(repr, trade_log.build(bars.where(bars.date < cut), STRATEGIES[key]).select(*publication.strategy_log(target, key).drop("seq").columns).collect()))
    assert target.read("prices").count() == target.read("signals").count() == 90 and target.read("latest_signals").count() == 3
    assert {r.date for r in target.read("latest_signals").collect()} == {rows[-1][1]} != {r.date for r in reader.read("latest_signals").collect()}
    assert {r.flag for r in target.read("quality_summary").collect()} >= {"gap", "zero_volume"}
    own_log = publication.ticker_log(publication.strategy_log(target, "D"), "A").collect()
    assert own_log and {r.ticker for r in own_log} == {"A"}
    days = [r.signal_date for r in own_log if r.signal_date]
    assert days == sorted(days, reverse=True) and [r.signal_date for r in own_log[len(own_log) - len(days) :]] == days


def test_rows_of_bars_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Files of bars weigh little, so by their size they would be: in upserts, for the gate, and under labels."""
    joins = lambda frame: re.findall(r"(?:Broadcast|SortMerge|ShuffledHash)\w*Join.*", frame._jdf.queryExecution().executedPlan().toString())
    rows = [r for k in range(2) for r in breakouts("AB"[k], k, 250)]
    spark.createDataFrame(rows, BARS).write.parquet(f"{tmp_path}/bars")
    bars = spark.read.parquet(f"{tmp_path}/bars")
    for order in (None, "volume"):
        assert all("SortMergeJoin" in j for j in joins(store.upsert(bars, bars, ["ticker", "date"], order)))
    entries = bars.selectExpr("ticker", "date", "cast(day(date) as int) bars_available")
    assert all("SortMergeJoin" in j for j in joins(labels.labelled(bars, entries, [labels.HOLD_20])))
    own, target, walked = Store(spark, f"file://{tmp_path}/full"), Store(spark, f"file://{tmp_path}/slim"), []
    own.init()
    nightly.night(own, bars)
    build = trade_log.published
    monkeypatch.setattr(publication.trade_log, "published", lambda frame: walked.append(frame) or build(frame))
    gate = spark.createDataFrame([(d, True) for d in sorted({r[1] for r in rows})], "date date, index_ok boolean")
    publication.published(own, target, gate, bars=30)
    assert ["BuildRight" in j for j in joins(walked[0])] == [True]
    lines = "select 1L l_suppkey, timestamp'2020-01-01' + make_dt_interval(cast(id % 300 as int)) l_shipdate, id l_orderkey, 1 l_linenumber, id l_partkey, 0.05D l_discount, 1D l_quantity from range(900)"
    spark.sql(lines).write.parquet(f"{tmp_path}/sf/lineitem.parquet")
    gated = registry.gated(spark, f"{tmp_path}/sf")
    assert "BuildRight" in joins(gated.select("date", "index_ok").distinct())[0] and gated.count() == 300


def test_days_without_trade(spark):
    bars = spark.createDataFrame([("A", date(2024, 1, d)) for d in (1, 2, 5, 5, 6)] + [("B", date(2024, 1, 3)), (None, date(2024, 1, 1)), (None, date(2024, 1, 3))], "ticker string, date date")
    assert sorted((r.ticker or "", r.date.day) for r in charts.days_without_trade(bars).collect()) == [("", 2), ("A", 3), ("A", 4)]


def test_series_are_drawn_earlier_and_later(spark):
    bars = spark.createDataFrame([("A", date(2024, 1, d), float(v)) for d, v in ((1, 5), (2, 5), (3, 4), (4, 9))], "ticker string, date date, close double")
    rows = charts.volume_rises(charts.drawn_earlier(bars.withColumn("x", bars.close), ["x"])).orderBy("date").collect()
    assert [r.x for r in rows] == [4.0, 9.0, None, None] and [r.rises for r in rows] == [None, True, False, True]
    assert [r.close for r in charts.drawn_later(bars, ["close"], 1).orderBy("date").collect()] == [None, 5.0, 5.0, 4.0]


def test_candidates_are_rules_with_sets_of_tiers(spark):
    trades = spark.createDataFrame([("r1", "A", 1.0), ("r1", "B", 2.0), ("r2", "A", 3.0), ("r2", "D", 4.0), ("r2", None, 5.0)], "rule_version string, tier string, r double")
    got = sorted((r.candidate, r.r) for r in walkforward.candidates(trades, {"a": ["A"], "ab": ["A", "B"]}).collect())
    assert got == [("r1|a", 1.0), ("r1|ab", 1.0), ("r1|ab", 2.0), ("r2|a", 3.0), ("r2|ab", 3.0)]


def test_names_are_merged_with_what_both_sides_say(spark):
    known = spark.createDataFrame([("A", "a", "s", "main", date(2000, 1, 1), False, date(2001, 1, 1), date(2001, 1, 1), date(2002, 1, 1)), ("B", "b", "s", None, None, True, None, None, None)], "ticker string, name string, sector string, board string, listing_date date, is_active boolean, first_seen date, last_seen date, delisted_at date")
    incoming = spark.createDataFrame([("A", None, "t", "new"), ("C", "c", None, None)], "ticker string, name string, sector string, board string")
    got = {r.ticker: r for r in store.upsert_tickers(known, incoming, "2024-01-01").collect()}
    assert (got["A"].name, got["A"].sector, got["A"].board, got["A"].listing_date, got["A"].is_active, got["A"].delisted_at) == ("a", "t", "new", date(2000, 1, 1), True, None)
    assert got["C"].first_seen == date(2024, 1, 1) and got["B"].is_active
    assert publication.reactivated(known, incoming).first().reactivated == 1


@pytest.mark.parametrize("rows,want", [([("A", 40, 3.0), ("B", 30, 2.0), ("C", 30, 1.0)], True), ([("A", 40, 1.0), ("B", 30, 2.0)], False), ([("A", 40, 1.0), ("B", 29, 2.0)], None), ([("A", 40, 2.0), ("B", 10, 9.0), ("C", 30, 1.0)], True), ([], None)])
def test_tiers_rank_by_their_means(spark, rows, want):
    assert calibration.ranks_monotonically(spark.createDataFrame(rows, "tier string, n long, mean_return double")) is want


def test_cost_files_are_checked(tmp_path):
    config = {"verified": True, "buy_fee": 0.0015, "sell_fee": 0.0025, "tick_bands": [{"lower": 0, "upper": 200, "tick": 1}, {"lower": 200, "tick": 2}]}
    at = tmp_path / "costs.json"
    at.write_text(json.dumps(config))
    found = Costs.from_file(at)
    assert (found.buy_fee, len(found.bands), found.lot_size, found.slippage_ticks) == (0.0015, 2, 100, 0)
    for change in ({"verified": False}, {"tick_bands": []}, {"tick_bands": config["tick_bands"][1:]}, {"tick_bands": [{"lower": 0, "upper": 100, "tick": 1}, {"lower": 200, "tick": 2}]}, {"tick_bands": [{"lower": 0, "tick": 0}]}):
        with pytest.raises(CostError):
            Costs.from_dict(config | change)
