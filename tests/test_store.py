"""The store, the ingest log and fetching, on small tables."""

from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.errors import PySparkException

from candlewick.operators import labels, store, walkforward
from candlewick.plans import trade_log
from candlewick.sources import fetch, snapshots
from candlewick.sources.tables import TABLES, Store, put

BARS = "ticker string, date date, open double, high double, low double, close double, volume bigint"


def bar(ticker, day, close):
    return (ticker, day, close, close, close, close, 1)


def test_store_creates_upserts_and_publishes(spark, tmp_path):
    own = Store(spark, f"file://{tmp_path}/full")
    with pytest.raises(FileNotFoundError):
        own.read("prices")
    assert own.init() == dict.fromkeys(TABLES, 0) == own.init()
    own.upsert("prices", spark.createDataFrame([bar("A", date(2023, 5, 1), 1.0), bar("A", date(2024, 5, 1), 2.0), bar("B", date(2024, 5, 2), 3.0)], BARS))
    kept = sorted(str(p) for p in tmp_path.glob("full/prices/year=2023/*.parquet"))
    own.upsert("prices", spark.createDataFrame([(*bar("A", date(2024, 5, 1), 9.0), 1), (*bar("A", date(2024, 5, 1), 8.0), 2), (*bar("C", date(2025, 1, 2), 4.0), 1)], f"{BARS}, stamp int"), "stamp")
    assert sorted((r.ticker, r.date.year, r.close) for r in own.read("prices").collect()) == [("A", 2023, 1.0), ("A", 2024, 8.0), ("B", 2024, 3.0), ("C", 2025, 4.0)]
    assert kept == sorted(str(p) for p in tmp_path.glob("full/prices/year=2023/*.parquet"))  # untouched
    assert own.read("prices").columns[-1] == "dividend" and own.read("prices").where("dividend is not null").isEmpty()
    slim = Store(spark, f"file://{tmp_path}/slim")
    own.publish(slim, bars=1)
    assert sorted((r.ticker, r.date.year) for r in slim.read("prices").collect()) == [("A", 2024), ("B", 2024), ("C", 2025)]
    assert sorted((r.ticker, r.last_date) for r in store.last_dates(own.read("prices")).collect())[0] == ("A", date(2024, 5, 1))


def test_log_refuses_unknown_statuses(spark, tmp_path):
    own = Store(spark, f"file://{tmp_path}/full")
    own.init()
    rows = [("r1", "A", "s", "ok", 2, datetime(2024, 1, 1)), ("r1", "B", "s", "network_error", 0, datetime(2024, 1, 1)), ("r2", None, "t", "run_started", 0, datetime(2024, 1, 2))]
    schema = "run_id string, ticker string, source string, status string, rows_written int, started_at timestamp"
    own.log(spark.createDataFrame(rows[:2], schema))
    own.log(spark.createDataFrame(rows[2:], schema))
    for bad in ("fine", None):
        with pytest.raises(ValueError):
            own.log(spark.createDataFrame([("r3", "A", "s", bad, 0, datetime(2024, 1, 3))], schema))
    log = own.read("ingest_log")
    assert log.count() == 3 and {(r.status, r.n) for r in store.status_counts(log, "r1").collect()} == {("ok", 1), ("network_error", 1)}
    assert [r.run_id for r in store.latest_run(log).collect()] == ["r2"] and [r.run_id for r in store.latest_run(log, "s").collect()] == ["r1"]
    assert store.latest_run(log, "none").isEmpty()
    (rate,) = store.failure_rate(log.where("ticker is not null")).collect()
    assert (rate.n, rate.failed, rate.rate, rate.exit_code) == (2, 1, 0.5, 1)


def test_refused_batches_are_tried_again_and_open_the_breaker():
    calls, waits = [], []

    def source(names):
        calls.append(names)
        if len(calls) < 3:
            raise RuntimeError("429 slow down")
        return pd.DataFrame({"ticker": ["A"], "date": [date(2024, 1, 1)], "close": [1.0]})

    out = fetch.asked(["A", "B"], source, fetch.Pace(jitter=0), waits.append)
    assert [(x["status"], x["attempt"], x["rows_written"]) for x in out] == [("ok", 3, 1), ("empty_response", 3, 0)] and waits == [2.0, 4.0]
    assert [fetch.Pace(jitter=0).delay(k) for k in (1, 2, 7, 9)] == [2, 4, 120, 120]
    assert 1.2 <= fetch.Pace().delay(1) <= 2.8
    for bad in ({"workers": 4}, {"workers": 0}, {"batch": 0}):
        with pytest.raises(ValueError):
            fetch.Pace(**bad)


@pytest.mark.parametrize("error,want", [(TimeoutError("x"), "network_error"), ("YFRateLimitError", "rate_limited"), ("no data found, symbol may be delisted", "empty_response"), (KeyError("Close"), "parse_error"), ("SSL and 429", "rate_limited")])
def test_errors_are_classified_in_order(spark, error, want):
    assert fetch.status_of(error) == want
    text = error if isinstance(error, str) else f"{type(error).__name__}: {error}"
    assert spark.createDataFrame([(text,)], "m string").select(store.error_status("m").alias("s")).first().s == want if isinstance(error, str) else True


def test_workers_keep_their_own_breakers(spark):
    def source(names):
        raise RuntimeError("Too Many Requests")

    names = spark.createDataFrame([(f"T{k:03}",) for k in range(60)], "ticker string")
    got = fetch.fetched(names, source, fetch.Pace(batch=5, workers=2, attempts=2, pause=0), lambda _: None).collect()
    by = {s: sorted({r.batch for r in got if r.status == s}) for s in ("rate_limited", "circuit_open")}
    assert len(got) == 60 and by["rate_limited"] == [0, 1, 2, 3, 4, 5] and by["circuit_open"] == [6, 7, 8, 9, 10, 11]


def test_rule_versions_and_validation():
    # The published names.
    assert [labels.Rule(h).version for h in (10, 20, 40)] == ["hold-h10-01f0b5e7", "hold-h20-f081a07b", "hold-h40-b08b745f"]
    assert labels.TARGET_8_4.version == "t8.0-s4.0-h20-unfav-b8562694" and labels.Rule(20, 12.0, 6.0).version == "t12.0-s6.0-h20-unfav-325de16a"
    assert labels.Rule(20, 8.0).version.startswith("t8.0-sx-h20-unfav-") and labels.Rule(20, label="own").version == "own-f081a07b"
    for bad in ((0,), (5, -1.0), (5, None, 0.0), (5, None, None, "maybe")):
        with pytest.raises(ValueError):
            labels.Rule(*bad)


def test_range_filters_keep_unknown_values(spark):
    frame = spark.createDataFrame([(1.0,), (5.0,), (None,)], "x double")
    assert sorted(map(repr, (r.x for r in trade_log.between(frame, "x", 2).collect()))) == ["5.0", "None"]
    assert trade_log.between(frame, "x", None, 2.0).count() == 2 and trade_log.between(frame, "x").count() == 3


def test_contest_needs_two_paired_folds(spark):
    kinds = "fold int, candidate string, train_n long, train_mean_return double, test_n long, test_mean_return double, test_return_per_bar double, picked boolean"
    rows = [(1, "a", 50, 3.0, 30, 1.0, 0.1, True), (1, "b", 50, 1.0, 30, 2.0, 0.2, False), (2, "b", 40, 2.0, 90, 1.0, 0.5, True), (3, "a", 60, 4.0, 10, 9.0, 0.9, True)]
    found = spark.createDataFrame(rows, kinds)
    r = walkforward.contest(found, "b").first()
    assert r.premium == pytest.approx(1.5) and r.gap == pytest.approx(-0.05) and r.gap_error == pytest.approx(0.05) and r.gap_folds == 2 and r.pooled == pytest.approx(1.0)
    assert walkforward.contest(found.where("fold = 1"), "b").first().gap is None


def test_judged_equals_training_and_testing_apart(spark):
    rows = [(f"T{k % 7}", date(2020 + k % 4, 1 + k % 12, 1 + k % 28), date(2020 + (k + k % 3 == 0) + k % 4, 1 + (k + 1) % 12, 1 + k % 28), "ab"[k % 2], float((k * 37) % 19 - 9), k % 9) for k in range(400)]
    trades = spark.createDataFrame(rows, "ticker string, entry_date date, exit_date date, candidate string, gross_return_pct double, bars_held int").selectExpr("*", "cast(null as double) return_pct")
    folds = walkforward.fold_table(spark, walkforward.folds(date(2020, 1, 1), date(2023, 12, 31), 12, 24))
    found = {(r.fold, r.candidate): r for r in walkforward.judged(trades, folds, least=5).collect()}
    for part, rows_of in (("train", walkforward.training), ("test", walkforward.testing)):
        for r in walkforward.scores(rows_of(trades, folds), "fold", "candidate").collect():
            own = found[r.fold, r.candidate]
            assert own[f"{part}_n"] == r.n and own[f"{part}_mean_return"] == pytest.approx(r.mean_return) and own[f"{part}_median_return"] == pytest.approx(r.median_return) and own[f"{part}_return_per_bar"] == pytest.approx(r.return_per_bar)
    best = {(r.fold, r.candidate) for r in walkforward.chosen(walkforward.scores(walkforward.training(trades, folds), "fold", "candidate"), least=5).collect()}
    assert best == {k for k, r in found.items() if r.picked}


def test_a_reader_keeps_its_version(spark, tmp_path):
    own = Store(spark, f"file://{tmp_path}/full")
    own.init()
    own.upsert("prices", spark.createDataFrame([bar("A", date(2023, 5, 1), 1.0), bar("A", date(2024, 5, 1), 2.0)], BARS))
    reader = own.pin()
    frame = reader.read("prices")
    own.upsert("prices", spark.createDataFrame([bar("A", date(2024, 5, 1), 9.0), bar("B", date(2025, 5, 1), 3.0)], BARS))
    rows = lambda f: sorted((r.ticker, r.date.year, r.close) for r in f.collect())
    assert rows(frame) == rows(reader.read("prices")) == [("A", 2023, 1.0), ("A", 2024, 2.0)]
    assert rows(own.read("prices")) == [("A", 2023, 1.0), ("A", 2024, 9.0), ("B", 2025, 3.0)]
    assert own.read("prices", [2025]).count() == 1
    before, now = reader.snapshot().tables["prices"], own.snapshot().tables["prices"]
    assert before["2023"] == now["2023"] and before["2024"] != now["2024"]  # a year that stays is not copied
    own.versions.clear(keep=1)
    assert rows(own.read("prices"))[0] == ("A", 2023, 1.0) and own.versions.numbers() == [own.snapshot().version]
    with pytest.raises(FileNotFoundError):
        own.versions.at(reader.snapshot().version)


def test_writers_of_one_part_conflict_and_others_do_not(spark, tmp_path):
    own = Store(spark, f"file://{tmp_path}/full")
    own.init()
    a, b, c = (own.versions.change() for _ in range(3))
    put(a, "prices", spark.createDataFrame([bar("A", date(2024, 5, 1), 1.0)], BARS))
    put(b, "prices", spark.createDataFrame([bar("B", date(2023, 5, 1), 2.0)], BARS))
    put(c, "prices", spark.createDataFrame([bar("C", date(2024, 5, 1), 3.0)], BARS))
    first, second = a.commit(), b.commit()
    assert second.version == first.version + 1
    with pytest.raises(snapshots.Conflict):
        c.commit()
    assert sorted(r.ticker for r in own.read("prices").collect()) == ["A", "B"]
    assert own.versions._put(second.version, {}) is False  # a number that is taken stays as it is
    assert own.snapshot().version == second.version


def test_publication_drops_years_that_fall_out_and_comes_at_once(spark, tmp_path):
    own, slim = Store(spark, f"file://{tmp_path}/full"), Store(spark, f"file://{tmp_path}/slim")
    own.init()
    own.upsert("prices", spark.createDataFrame([bar("A", date(2020, 5, 1), 1.0), bar("A", date(2020, 5, 4), 2.0)], BARS))
    own.publish(slim, bars=2)
    old = slim.pin()
    own.upsert("prices", spark.createDataFrame([bar("A", date(2022, 5, 1), 3.0), bar("A", date(2022, 5, 2), 4.0)], BARS))
    version = own.publish(slim, bars=2).version
    assert [r.close for r in slim.read("prices").orderBy("date").collect()] == [3.0, 4.0]
    assert [r.close for r in old.read("prices").orderBy("date").collect()] == [1.0, 2.0]
    assert version == old.snapshot().version + 1 and set(slim.snapshot().tables) == {"prices", "signals", "tickers"}


def test_equal_keys_need_an_order(spark, tmp_path):
    own = Store(spark, f"file://{tmp_path}/full")
    own.init()
    version = own.snapshot().version
    with pytest.raises(PySparkException, match="no order"):
        own.upsert("prices", spark.createDataFrame([bar("A", date(2024, 5, 1), 1.0), bar("A", date(2024, 5, 1), 2.0)], BARS))
    assert own.snapshot().version == version and own.read("prices").isEmpty()


def test_log_asks_its_source_once(spark, tmp_path):
    own = Store(spark, f"file://{tmp_path}/full")
    own.init()
    asked = spark.sparkContext.accumulator(0)

    def source(rows):
        for frame in rows:
            asked.add(len(frame))
            yield frame.assign(status="ok")

    own.log(spark.range(3).repartition(1).mapInPandas(source, "id long, status string"))
    assert asked.value == 3 and own.read("ingest_log").count() == 3
