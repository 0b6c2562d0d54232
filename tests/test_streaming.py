import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.plans import strategies
from candlewick.streaming import bars as SB
from candlewick.streaming import walks

SCHEMA = "ticker string, ts timestamp, price double, volume long"


def ticks(day, prices):
    return [("T", dt.datetime(2024, 1, day, 9 + i), float(p), 10) for i, p in enumerate(prices)]


def test_bars_of_a_table(spark):
    got = SB.bars_of_ticks(spark.createDataFrame(ticks(1, [5, 9, 2, 4]) + ticks(2, [7]), SCHEMA)).orderBy("start").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(5, 9, 2, 4, 40), (7, 7, 7, 7, 10)]


def test_stream_equals_batch_and_keeps_state(spark, tmp_path):
    source, closes = tmp_path / "in", [10.0, 11.0, 13.0, 12.0, 15.0, 14.0]
    rows = [("T", dt.datetime(2024, 1, 1 + i), c) for i, c in enumerate(closes)]
    schema = "ticker string, start timestamp, close double"
    late = ("T", rows[2][1], 99.0)  # averaged already when it comes
    for own in (rows[:3], [late, *rows[3:]]):
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    run = SB.running_ema(stream, 3).writeStream.format("memory").queryName("ema_out").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = [r.ema for r in spark.sql("select ema from ema_out order by start").collect()]
    want, y = [], None
    for i, c in enumerate(closes):
        y = c if y is None else y * 0.5 + c * 0.5
        want.append(y if i >= 2 else None)
    assert got[:2] == [None, None] and got[2:] == pytest.approx(want[2:])


BARS = "ticker string, ts timestamp, open double, high double, low double, close double, volume long"


def breakouts(ticker, seed, n=900):
    """Quiet stretches with breaks on volume, up and down."""
    rng = np.random.default_rng(seed)
    close, rows = 1000.0, []
    for k in range(n):
        loud = k % 60 == 55
        before, close = close, close + (close * 0.03 if loud else rng.integers(-3, 4) + (k % 60 < 8) * rng.integers(-12, 16) + 1)
        rows.append((ticker, dt.datetime(2020, 1, 1) + dt.timedelta(days=k), *map(float, (before, max(before, close) + 1, min(before, close) - 1, close)), 900 if loud else 100))
    return rows


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def streamed(spark, tmp_path, batches, name, **options):
    source = tmp_path / name
    source.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(str(source / f"{k:03}"))
        for f in (source / f"{k:03}").glob("*.parquet"):
            f.rename(source / f"{k:03}.parquet")
            os.utime(source / f"{k:03}.parquet", (1_600_000_000 + k, 1_600_000_000 + k))
    stream = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(str(source / "*.parquet"))
    run = walks.trades_of_stream(stream, **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    assert run.exception() is None
    return sorted(tuple(r) for r in spark.table(name).collect())


def batch_trades(spark, rows):
    bars = spark.createDataFrame(rows, BARS).withColumn("date", F.to_date("ts"))
    found = strategies.run(bars, strategies.STRATEGIES["K"]).where("entry_date is not null and resolved")
    return sorted(tuple(r) for r in found.select("ticker", "entry_date", "entry_price", "entry_code", "exit_date", "exit_price", "exit_code", F.col("bars_held").cast("long")).collect())


def test_walk_of_a_stream_equals_the_batch(spark, tmp_path, rocks):
    rows = [r for k in range(3) for r in breakouts("ABC"[k], k)]
    want = batch_trades(spark, rows)
    assert len(want) >= 6
    cuts = [0, 1, 5, 120, 205, 206, 300, 420, 421, 700, 900]
    day = lambda r: (r[1] - dt.datetime(2020, 1, 1)).days
    batches = [[r for r in reversed(rows) if a <= day(r) < b] for a, b in zip(cuts, cuts[1:])]
    late = batches[6][:2]  # come again with other prices, when the walk is past them
    batches[8] += [(*r[:2], *[x * 3 for x in r[2:6]], r[6]) for r in late]
    assert streamed(spark, tmp_path, batches, "walk_k") == want


def test_idle_walks_expire(spark, tmp_path, rocks):
    rows = breakouts("A", 0)
    day = lambda r: (r[1] - dt.datetime(2020, 1, 1)).days
    away = [("A", r[1] + dt.timedelta(days=200), *r[2:]) for r in rows if day(r) >= 500]
    clock = [("Z", dt.datetime(2020, 1, 1) + dt.timedelta(days=k), 1.0, 1.0, 1.0, 1.0, 1) for k in range(0, 1100, 10)]
    first = [r for r in rows if day(r) < 500]
    batches = [first[:300], first[300:], *[[c] for c in clock if 480 <= (c[1] - dt.datetime(2020, 1, 1)).days <= 690][::5], away]
    got = streamed(spark, tmp_path, batches, "walk_idle", idle_days=60)
    anew = sorted(batch_trades(spark, first) + batch_trades(spark, away))
    assert got == anew != batch_trades(spark, first + away)
