"""Queries over bar data, each with the SQL that it is held against where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions import chunks
from candlewick.functions import series as S
from candlewick.operators import calibration, charts, history, indicators, labels, nightly, quality, readers, signals, store, verification, walkforward
from candlewick.operators.costs import EXAMPLE
from candlewick.plans import oracles as O
from candlewick.plans import publication, trade_log
from candlewick.plans.strategies import STRATEGIES, run
from candlewick.sources import bars as B
from candlewick.sources import buckets, fetch, landed
from candlewick.sources.snapshots import shared_root
from candlewick.sources.tables import Store
from candlewick.streaming.bars import bars_of_ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The folds of the walk-forward queries; training is anchored.
FOLDS = walkforward.folds(date(1992, 1, 1), date(1998, 12, 31), test_months=12, min_train_months=24)
FOLD_VALUES = "folds(fold, train_start, test_start, test_end) as (values " + ", ".join(f"({k}, date '1992-01-01', date '{y}-01-01', date '{z}')" for k, y, z in ((1, 1994, "1995-01-01"), (2, 1995, "1996-01-01"), (3, 1996, "1997-01-01"), (4, 1997, "1998-01-01"), (5, 1998, "1998-12-31"))) + ")"
TODAY = "1998-12-10"


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def rounded(frame: DataFrame, *keep: str) -> DataFrame:
    """The named columns, floating ones to six places, counts as long."""
    kinds = dict(frame.dtypes)
    out = []
    for c in keep or frame.columns:
        k = kinds[c]
        out.append(F.round(F.col(c).cast("double"), 6).alias(c) if k in ("double", "float") or k.startswith("decimal") else F.col(c).cast("bigint").alias(c) if k in ("int", "smallint", "tinyint") else F.col(c))
    return frame.select(*out)


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) {n}" for n in names)


query("bars_walk", O.sql("select * from bars", O.DUCK_BARS))(lambda s, d: rounded(B.bars(s, d)))
query("bars_dirty", O.sql("select ticker, date, open, high, low, close, cast(volume as bigint) volume, cast(split_factor as double) split_factor from dirty", O.DUCK_DIRTY))(lambda s, d: rounded(B.dirty_bars(s, d).withColumn("split_factor", F.col("split_factor").cast("double"))))

query("sma_stack", O.sql(f"select ticker, date, {r('ma5', 'ma20', 'ma50', 'ma100', 'ma200')} from sma", O.DUCK_BARS, O.N, O.SMA))(lambda s, d: rounded(indicators.moving_averages(B.bars(s, d)), "ticker", "date", "ma5", "ma20", "ma50", "ma100", "ma200"))

BB = f"bb as (select *, {O.full('avg', 'close', 20)} bb_mid, {O.full('stddev_pop', 'close', 20)} sd from n)"
query("bollinger", O.sql("select ticker, date, round(bb_mid, 6) bb_mid, round(bb_mid + 2 * sd, 6) bb_upper, round(bb_mid - 2 * sd, 6) bb_lower from bb", O.DUCK_BARS, O.N, BB))(lambda s, d: rounded(indicators.bollinger(B.bars(s, d)), "ticker", "date", "bb_mid", "bb_upper", "bb_lower"))
query("capitulation", O.sql("select ticker, date, cast(case when bb_mid is not null then (close < bb_mid - 2 * sd)::int end as bigint) capitulation from bb", O.DUCK_BARS, O.N, BB))(lambda s, d: rounded(indicators.capitulation(B.bars(s, d)), "ticker", "date", "capitulation"))
query("donchian", O.sql(f"select ticker, date, {O.full('max', 'high', 20)} donchian_upper, {O.full('min', 'low', 20)} donchian_lower from n", O.DUCK_BARS, O.N))(lambda s, d: rounded(indicators.donchian(B.bars(s, d)), "ticker", "date", "donchian_upper", "donchian_lower"))
ICHI = "ichi as (select ticker, date, " + ", ".join(f"({O.full('max', 'high', n)} + {O.full('min', 'low', n)}) / 2 {x}" for n, x in ((9, "tenkan"), (26, "kijun"), (52, "senkou_b"))) + " from n)"
query("ichimoku", O.sql("select ticker, date, tenkan, kijun, senkou_b, (tenkan + kijun) / 2 senkou_a from ichi", O.DUCK_BARS, O.N, ICHI))(lambda s, d: rounded(indicators.ichimoku(B.bars(s, d)), "ticker", "date", "tenkan", "kijun", "senkou_b", "senkou_a"))
query("fractals_raw", O.sql("select ticker, date, fractal_up, fractal_down from frac", O.DUCK_BARS, O.N, O.FRACTALS))(lambda s, d: rounded(indicators.raw_fractals(B.bars(s, d)), "ticker", "date", "fractal_up", "fractal_down"))
query("pivots", O.sql("select ticker, date, case when mh > oh and mh > nh then mh end pivot_high, case when ml < ol and ml < nl then ml end pivot_low from piv", O.DUCK_BARS, O.N, O.PIVOTS))(lambda s, d: rounded(indicators.pivot_columns(B.bars(s, d)), "ticker", "date", "pivot_high", "pivot_low"))
query("prior_range", O.sql("select ticker, date, case when n > 25 then max(high) over (partition by ticker order by date rows between 25 preceding and 1 preceding) end range_high, case when n > 25 then min(low) over (partition by ticker order by date rows between 25 preceding and 1 preceding) end range_low from n", O.DUCK_BARS, O.N))(
    lambda s, d: rounded(indicators.prior_range(B.bars(s, d), 25), "ticker", "date", "range_high", "range_low")
)
query("year_range", O.sql(f"select ticker, date, {O.full('max', 'high', 252)} hi52, {O.full('min', 'low', 252)} lo52, round({O.full('avg', 'close', 150)}, 6) ma150, round({O.full('avg', '(close * volume)', 20)}, 2) turnover20 from n", O.DUCK_BARS, O.N))(
    lambda s, d: indicators.year_range(B.bars(s, d)).select("ticker", "date", "hi52", "lo52", F.round("ma150", 6).alias("ma150"), F.round("turnover20", 2).alias("turnover20"))
)

query("ema12", O.sql("select ticker, date, case when n >= 12 then round(e12, 6) end ema12 from e", O.DUCK_BARS, O.N, O.EMAS))(lambda s, d: rounded(indicators.recursive(B.bars(s, d), ["ema12"]), "ticker", "date", "ema12"))
query("macd", O.sql("select ticker, date, case when n >= 26 then round(e12 - e26, 6) end macd_line, case when n >= 34 then round(sig, 6) end macd_signal, case when n >= 34 then round(e12 - e26 - sig, 6) end macd_hist from e", O.DUCK_BARS, O.N, O.EMAS))(lambda s, d: rounded(indicators.recursive(B.bars(s, d), ["macd_line", "macd_signal", "macd_hist"]), "ticker", "date", "macd_line", "macd_signal", "macd_hist"))
query("ribbon", O.sql("select ticker, date, case when n >= 26 then cast(2 * (e8 > e21)::int + (e12 > e26)::int as double) end ribbon from e", O.DUCK_BARS, O.N, O.EMAS))(lambda s, d: rounded(indicators.recursive(B.bars(s, d), ["ribbon"]), "ticker", "date", "ribbon"))
query("rsi14", O.sql("select n.ticker, n.date, round(rsi14, 6) rsi14 from n left join rsi on rsi.ticker = n.ticker and rsi.n = n.n", O.DUCK_BARS, O.N, O.RSI))(lambda s, d: rounded(indicators.recursive(B.bars(s, d), ["rsi14"]), "ticker", "date", "rsi14"))
query("atr14", O.sql("select m.ticker, m.date, round(a, 6) atr14 from moves m left join rma on rma.ticker = m.ticker and rma.n = m.n", O.DUCK_BARS, O.N, O.DMI))(lambda s, d: rounded(indicators.recursive(B.bars(s, d), ["atr14"]), "ticker", "date", "atr14"))
query("adx14", O.sql("select m.ticker, m.date, round(dip, 6) di_plus, round(dim, 6) di_minus, round(y, 6) adx14 from moves m join dx on dx.ticker = m.ticker and dx.n = m.n left join adx on adx.ticker = m.ticker and adx.n = m.n", O.DUCK_BARS, O.N, O.DMI))(
    lambda s, d: rounded(indicators.recursive(B.bars(s, d), ["di_plus", "di_minus", "adx14"]), "ticker", "date", "di_plus", "di_minus", "adx14")
)
#: A year to a chunk, so that each history is cut several times.
query("chunked_averages", O.sql("select n.ticker, n.date, case when n.n >= 12 then round(e12, 6) end ema12, round(rsi14, 6) rsi14, round(a, 6) atr14 from n join e on e.ticker = n.ticker and e.n = n.n left join rsi on rsi.ticker = n.ticker and rsi.n = n.n left join rma on rma.ticker = n.ticker and rma.n = n.n", O.DUCK_BARS, O.N, O.EMAS, O.RSI, O.DMI))(lambda s, d: rounded(chunks.averages(B.bars(s, d), 365)))
FCB = "fcb.l0 fcb_upper, fcb.l1 fcb_lower, fcb.d0 fcb_dot_upper, fcb.d1 fcb_dot_lower"
query("chaos_bands", O.sql(f"select n.ticker, n.date, {FCB} from n join fcb on fcb.ticker = n.ticker and fcb.n = n.n", O.DUCK_BARS, O.N, O.FRACTALS, O.CHAOS))(lambda s, d: rounded(indicators.recursive(B.bars(s, d), ["fcb_upper", "fcb_lower", "fcb_dot_upper", "fcb_dot_lower"]), "ticker", "date", "fcb_upper", "fcb_lower", "fcb_dot_upper", "fcb_dot_lower"))
MA = [f"ma{k}" for k in (5, 20, 50, 100, 200)]
WIDE = (
    f"select n.ticker, n.date, n.open, n.high, n.low, n.close, cast(n.volume as bigint) volume, {', '.join(f'round(s.{m}, 6) {m}' for m in MA)}, round(bb_mid, 6) bb_mid, round(bb_mid + 2 * sd, 6) bb_upper, round(bb_mid - 2 * sd, 6) bb_lower, du donchian_upper, dl donchian_lower, "
    "tenkan, kijun, senkou_b, (tenkan + kijun) / 2 senkou_a, n.n bars_available, round(v20, 6) volume_ma20, case when n.n >= 12 then round(e12, 6) end ema12, case when n.n >= 26 then round(e12 - e26, 6) end macd_line, case when n.n >= 34 then round(sig, 6) end macd_signal, case when n.n >= 34 then round(e12 - e26 - sig, 6) end macd_hist, "
    f"round(rsi14, 6) rsi14, round(rma.a, 6) atr14, round(y, 6) adx14, round(dip, 6) di_plus, round(dim, 6) di_minus, case when n.n >= 26 then cast(2 * (e8 > e21)::int + (e12 > e26)::int as double) end ribbon, {FCB} "
    "from n join sma s on s.ticker = n.ticker and s.n = n.n join bb on bb.ticker = n.ticker and bb.n = n.n join dv on dv.ticker = n.ticker and dv.n = n.n join ichi on ichi.ticker = n.ticker and ichi.date = n.date join e on e.ticker = n.ticker and e.n = n.n "
    "left join rsi on rsi.ticker = n.ticker and rsi.n = n.n left join rma on rma.ticker = n.ticker and rma.n = n.n left join dx on dx.ticker = n.ticker and dx.n = n.n left join adx on adx.ticker = n.ticker and adx.n = n.n join fcb on fcb.ticker = n.ticker and fcb.n = n.n"
)
DV = f"dv as (select ticker, n, {O.full('max', 'high', 20)} du, {O.full('min', 'low', 20)} dl, {O.full('avg', 'volume', 20)} v20 from n)"
query("indicators", O.sql(WIDE, O.DUCK_BARS, O.N, O.SMA, BB, DV, ICHI, O.EMAS, O.RSI, O.DMI, O.FRACTALS, O.CHAOS))(lambda s, d: rounded(indicators.indicators(B.bars(s, d))))

Q_COLUMNS = "ticker, date, insufficient_history, stale_price, zero_volume, suspicious_jump, gap, impossible_bar, cast(stale_run_length as bigint) stale_run_length, round(jump_pct, 6) jump_pct, cast(gap_days as bigint) gap_days, cast(bars_available as bigint) bars_available, is_clean"
query("quality_flags", O.sql(f"select {Q_COLUMNS} from quality", O.DUCK_DIRTY, O.ND, O.QUALITY))(lambda s, d: rounded(quality.flagged(B.dirty_bars(s, d))))
FLAGS = ["insufficient_history", "stale_price", "zero_volume", "suspicious_jump", "gap", "impossible_bar"]
query("quality_summary", O.sql("select count(distinct ticker) tickers, count(*) bars, " + ", ".join(f"count(*) filter ({f}) {f}" for f in FLAGS) + ", count(*) filter (is_clean) clean from quality", O.DUCK_DIRTY, O.ND, O.QUALITY))(lambda s, d: quality.summary(quality.flagged(B.dirty_bars(s, d))))
query("quality_summary_rows", O.sql(" union all ".join(f"select '{f}' flag, count(*) filter ({f}) bars from quality" for f in FLAGS), O.DUCK_DIRTY, O.ND, O.QUALITY))(lambda s, d: quality.summary_rows(quality.flagged(B.dirty_bars(s, d))))
query("stale_runs", O.sql("select ticker, date, cast(stale_run_length as bigint) stale_run_length from q2", O.DUCK_DIRTY, O.ND, O.QUALITY))(lambda s, d: rounded(quality.stale_runs(B.dirty_bars(s, d)), "ticker", "date", "stale_run_length"))
query(
    "ohlc_integrity",
    O.sql("select * from (select ticker, date, case when high < low then 'high_below_low' when high < open then 'high_below_open' when high < close then 'high_below_close' when low > open then 'low_above_open' when low > close then 'low_above_close' when least(open, high, low, close) <= 0 then 'non_positive_price' end reason from dirty) where reason is not null", O.DUCK_DIRTY),
)(lambda s, d: quality.integrity_reasons(B.dirty_bars(s, d)))


def dirty_signals(s: SparkSession, d: str) -> DataFrame:
    return signals.signals(B.dirty_bars(s, d))


SIGNAL = "ticker, date, cast(alignment_depth as bigint) alignment_depth, rsi_gate, above_ma5, cast(days_since_ma5_cross as bigint) days_since_ma5_cross, tier, data_quality, cast(bars_available as bigint) bars_available"
query("signals", O.sql(f"select {SIGNAL} from signals", *O.ALL))(lambda s, d: rounded(dirty_signals(s, d)))
query("latest_signals", O.sql(f"select {SIGNAL} from signals qualify row_number() over (partition by ticker order by date desc) = 1", *O.ALL))(lambda s, d: rounded(signals.latest(dirty_signals(s, d)).orderBy(F.desc("alignment_depth"), "ticker")))
query("criteria", O.sql("select ticker, date, concat_ws(', ', case when alignment_depth >= 5 then 'K1' end, case when alignment_depth >= 4 then 'K2' end, case when alignment_depth >= 3 then 'K3' end, case when alignment_depth >= 5 and rsi_gate then 'K4' end, case when alignment_depth >= 4 and rsi_gate then 'K5' end, case when alignment_depth >= 3 and rsi_gate then 'K6' end) criteria from signals", *O.ALL))(
    lambda s, d: dirty_signals(s, d).select("ticker", "date", signals.criteria(F.col("alignment_depth"), F.col("rsi_gate")).alias("criteria"))
)
COUNTS = "select date, count(*) filter (alignment_depth = 5 and rsi_gate) depth5_gated, count(*) filter (alignment_depth >= 4 and rsi_gate) depth4plus_gated, count(*) filter (alignment_depth >= 3 and rsi_gate) depth3plus_gated, count(*) tickers from signals group by date order by date desc limit 60"
query("signal_counts_by_date", O.sql(COUNTS, *O.ALL))(lambda s, d: signals.counts_by_day(dirty_signals(s, d), 60))
query("signal_distribution", O.sql("select cast(alignment_depth as bigint) alignment_depth, coalesce(rsi_gate, false) gate, count(*) n from signals group by 1, 2", *O.ALL))(lambda s, d: rounded(dirty_signals(s, d).groupBy("alignment_depth", F.coalesce("rsi_gate", F.lit(False)).alias("gate")).agg(F.count(F.lit(1)).alias("n"))))
query(
    "screener",
    O.sql(
        "select s.ticker, date, cast(alignment_depth as bigint) alignment_depth, tier, sector from (select * from signals qualify row_number() over (partition by ticker order by date desc) = 1) s left join tickers using (ticker) "
        "where coalesce(is_active, true) and alignment_depth >= 3 and rsi_gate and above_ma5 and data_quality not in ('stale', 'suspect', 'insufficient_history')",
        *O.ALL,
        O.DUCK_TICKERS,
    ),
)(lambda s, d: rounded(signals.screened(signals.latest(dirty_signals(s, d)).join(B.tickers(s, d), "ticker", "left")), "ticker", "date", "alignment_depth", "tier", "sector"))

query("liquidity", O.sql("select ticker, round(avg(close * volume), 2) turnover, round(avg(volume) / 100, 6) avg_lots from (select *, row_number() over (partition by ticker order by date desc) k from bars) where k <= 60 group by ticker", O.DUCK_BARS))(lambda s, d: trade_log.liquidity(B.bars(s, d)).select("ticker", F.round("turnover", 2).alias("turnover"), F.round("avg_lots", 6).alias("avg_lots")))
query("universe_counts", O.sql("select count(*) filter (is_active) active, count(*) filter (not is_active) inactive from tickers", O.DUCK_TICKERS))(lambda s, d: B.tickers(s, d).agg(F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive")))
query("coverage", O.sql('select ticker, count(*) bars, min(date) as "first", max(date) as "last" from bars group by ticker', O.DUCK_BARS))(lambda s, d: store.coverage(B.bars(s, d)))
query(
    "freshness",
    O.sql(f"select max(date) latest, (select count(distinct ticker) from bars where date = (select max(date) from bars)) tickers_at_latest, count(distinct ticker) tickers, case when date_diff('day', max(date), date '{TODAY}') <= 4 then 'fresh' when date_diff('day', max(date), date '{TODAY}') <= 10 then 'aging' else 'stale' end state from bars", O.DUCK_BARS),
)(lambda s, d: store.freshness(B.bars(s, d), TODAY))


def gated(s: SparkSession, d: str) -> DataFrame:
    """Bars with the market gate as of their day: the index, one row a day, is densified onto the bars' days and broadcast to them, never the other way round."""
    bars = B.bars(s, d)
    index = B.index_series(bars).withColumn("ticker", F.lit("index"))
    w = S.by_ticker()
    avg = lambda n: F.avg("close").over(w.rowsBetween(-(n - 1), 0))
    gate = index.select("date", S.yes((F.row_number().over(w) >= 200) & (avg(20) > avg(50)) & (F.col("close") > avg(200))).alias("own"))
    days = bars.select("date").distinct().join(gate, "date", "left").withColumn("ticker", F.lit("index"))
    carried = days.select("date", F.coalesce(F.last("own", ignorenulls=True).over(w.rowsBetween(S.W.unboundedPreceding, 0)), F.lit(False)).alias("index_ok"))
    return bars.join(F.broadcast(carried), "date")


query("asof_gate", O.sql("select b.ticker, b.date, coalesce(g.k >= 200 and g.f > g.s and g.close > g.m, false) index_ok from bars b asof left join gate g on b.date >= g.date", O.DUCK_BARS, O.INDEX_GATE))(lambda s, d: gated(s, d).select("ticker", "date", "index_ok"))


def trades(s: SparkSession, d: str, *rules: labels.Rule, costs=None) -> tuple[DataFrame, DataFrame]:
    bars = B.dirty_bars(s, d)
    own = signals.signals(bars)
    return labels.labelled(bars, labels.eligible(own), list(rules), costs, carry=("tier",)), own


L_COLUMNS = ["ticker", "entry_date", "rule_version", "fill_date", "fill_price", "exit_date", "exit_price", "outcome", "bars_held", "gross_return_pct", "mae", "mfe"]
L_SELECT = "ticker, entry_date, rule_version, fill_date, round(fill_price, 6) fill_price, exit_date, round(exit_price, 6) exit_price, outcome, cast(bars_held as bigint) bars_held, round(gross_return_pct, 6) gross_return_pct, round(mae, 6) mae, round(mfe, 6) mfe"
HOLD = (*O.ALL, O.ELIGIBLE, O.labels(20, None, None, "hold-h20-f081a07b"))
TARGET = (*O.ALL, O.ELIGIBLE, O.labels(20, 8.0, 4.0, "t8.0-s4.0-h20-unfav-b8562694"))
query("labels_hold20", O.sql(f"select {L_SELECT} from trade_labels", *HOLD))(lambda s, d: rounded(trades(s, d, labels.HOLD_20)[0], *L_COLUMNS))
query("labels_t8_s4", O.sql(f"select {L_SELECT} from trade_labels", *TARGET))(lambda s, d: rounded(trades(s, d, labels.TARGET_8_4)[0], *L_COLUMNS))
#: The rules' published names.
MANY = {"hold20": (20, None, None, "hold-h20-f081a07b", "unfavourable"), "t8": (20, 8.0, 4.0, "t8.0-s4.0-h20-unfav-b8562694", "unfavourable"), "hold10": (10, None, None, "hold-h10-01f0b5e7", "unfavourable"), "t12": (20, 12.0, 6.0, "t12.0-s6.0-h20-favou-151215bd", "favourable")}
query("labels_many_rules", O.sql(" union all ".join(f"select {L_SELECT}, round(return_pct, 6) return_pct from {name}" for name in MANY), *O.ALL, O.ELIGIBLE, *[O.labels(*rule, name=name, costs=True) for name, rule in MANY.items()]))(
lambda s, d: rounded(trades(s, d, labels.HOLD_20, labels.TARGET_8_4, labels.Rule(10), labels.Rule(20, 12.0, 6.0, "favourable"), costs=EXAMPLE)[0], *labels.COLUMNS))

JOINED = "j as (select l.*, s.tier, gross_return_pct r from trade_labels l join signals s on s.ticker = l.ticker and s.date = l.entry_date)"


def tiered(s: SparkSession, d: str, rule: labels.Rule = labels.TARGET_8_4) -> DataFrame:
    return trades(s, d, rule)[0]


query(
    "tier_summary",
    O.sql("select tier, count(*) n, round(avg((r > 0)::int) * 100, 6) win_pct, round(avg(r), 6) mean_return, round(median(r), 6) median_return, round(avg(mae), 6) mean_mae, round(median(mae), 6) median_mae, round(avg(mfe), 6) mean_mfe, round(avg(bars_held), 6) mean_bars, round(avg((outcome = 'target')::int) * 100, 6) target_pct from j where r is not null and tier is not null group by tier", *TARGET, JOINED),
)(lambda s, d: rounded(calibration.tier_summary(tiered(s, d))))
BY_YEAR = "by_year as (select cast(year(entry_date) as bigint) yr, tier, count(*) n, avg(r) mean_return from j where r is not null and tier is not null group by 1, 2)"
query("tier_by_year", O.sql("select yr, tier, n, round(mean_return, 6) mean_return from by_year", *TARGET, JOINED, BY_YEAR))(lambda s, d: rounded(calibration.tier_by_year(tiered(s, d))))
query(
    "tier_pivot",
    O.sql("select yr, " + ", ".join(f"round(max(mean_return) filter (tier = '{t}'), 6) \"{t}_mean\", max(n) filter (tier = '{t}') \"{t}_n\"" for t in "ABCD") + ", cast(sum(n) as bigint) total from by_year group by yr", *TARGET, JOINED, BY_YEAR),
)(lambda s, d: rounded(calibration.tier_pivot(tiered(s, d))))
query("mae_quantiles", O.sql("select tier, count(*) n, round(quantile_cont(mae, 0.5), 6) p50, round(quantile_cont(mae, 0.25), 6) p75, round(quantile_cont(mae, 0.1), 6) p90, round(quantile_cont(mae, 0.01), 6) p99 from j where tier is not null and outcome <> 'open' group by tier", *HOLD, JOINED))(lambda s, d: rounded(calibration.mae_quantiles(tiered(s, d, labels.HOLD_20))))


def clean(s: SparkSession, d: str) -> DataFrame:
    bars = B.dirty_bars(s, d)
    return bars.join(quality.flagged(bars).where("is_clean").select("ticker", "date"), ["ticker", "date"])


BASE = "clean as (select n.* from n join quality q on q.ticker = n.ticker and q.date = n.date where is_clean), ahead as (select ticker, date, lead(open, 1) over w b, lead(close, 20) over w c from clean window w as (partition by ticker order by date)), rets as (select *, (c * (1 - 0.0025) / (b * (1 + 0.0015)) - 1) * 100 r from ahead where b > 0 and c is not null)"
query("baseline_universe", O.sql("select count(*) n, round(avg((r > 0)::int) * 100, 6) win_pct, round(avg(r), 6) mean_return, round(median(r), 6) median_return from rets", O.DUCK_DIRTY, O.ND, O.QUALITY, BASE))(lambda s, d: rounded(calibration.baseline(clean(s, d), 20, ["ticker"], 0.0015, 0.0025)))
query("baseline_index", O.sql("select count(*) n, round(avg((r > 0)::int) * 100, 6) win_pct, round(avg(r), 6) mean_return, round(median(r), 6) median_return from (select (lead(close, 20) over (order by date) / close - 1) * 100 r from ix) where r is not null", O.DUCK_BARS, O.DUCK_INDEX))(lambda s, d: rounded(calibration.index_baseline(B.index_series(B.bars(s, d)), 20)))

FOLDED = "fold, count(*) n, round(avg(gross_return_pct), 6) mean_return from trade_labels join folds on"
query("folds_purged", O.sql(f"select {FOLDED} entry_date >= train_start and entry_date < test_start and exit_date < test_start where gross_return_pct is not null group by fold", *HOLD, FOLD_VALUES))(
    lambda s, d: rounded(walkforward.scores(walkforward.training(trades(s, d, labels.HOLD_20)[0], walkforward.fold_table(s, FOLDS)), "fold"), "fold", "n", "mean_return")
)
query("folds_tested", O.sql(f"select {FOLDED} entry_date between test_start and test_end where gross_return_pct is not null group by fold", *HOLD, FOLD_VALUES))(
    lambda s, d: rounded(walkforward.scores(walkforward.testing(trades(s, d, labels.HOLD_20)[0], walkforward.fold_table(s, FOLDS)), "fold"), "fold", "n", "mean_return")
)
query("universe_by_fold", O.sql("select fold, count(*) n, round(avg(r), 6) mean_return from rets join folds on date between test_start and test_end group by fold", O.DUCK_DIRTY, O.ND, O.QUALITY, BASE, FOLD_VALUES))(lambda s, d: rounded(walkforward.universe_by_fold(clean(s, d), walkforward.fold_table(s, FOLDS), 20, 0.0015, 0.0025)))
TIER_SETS = {"1:A": ["A"], "2:AB": ["A", "B"], "3:ABC": ["A", "B", "C"]}


def walk_scores(s: SparkSession, d: str) -> DataFrame:
    sets = s.createDataFrame([(k, t) for k, ts in TIER_SETS.items() for t in ts], "candidate string, tier string")
    return walkforward.judged(tiered(s, d, labels.HOLD_20).join(F.broadcast(sets), "tier"), walkforward.fold_table(s, FOLDS))


def part_of(scores: DataFrame, part: str) -> DataFrame:
    return scores.where(f"{part}_n > 0").select("fold", "candidate", *[F.col(f"{part}_{c}").alias(c) for c in ("n", "mean_return", "median_return", "return_per_bar", "return_per_risk")])


def picked(s: SparkSession, d: str, part: str) -> DataFrame:
    return part_of(walk_scores(s, d).where("picked"), part)


CANDIDATES = "sets(candidate, tier) as (values " + ", ".join(f"('{k}', '{t}')" for k, ts in TIER_SETS.items() for t in ts) + "), jc as (select j.*, candidate from j join sets using (tier) where r is not null)"
TRAIN = "train as (select fold, candidate, count(*) n, avg(r) / avg(greatest(bars_held, 1)) rpb from jc join folds on entry_date >= train_start and entry_date < test_start and exit_date < test_start group by all), pick as (select fold, candidate, n, rpb from train where n >= 30 qualify row_number() over (partition by fold order by rpb desc, candidate) = 1)"
query("walkforward_choice", O.sql("select cast(fold as bigint) fold, candidate, n, round(rpb, 6) return_per_bar from pick", *HOLD, JOINED, FOLD_VALUES, CANDIDATES, TRAIN))(lambda s, d: rounded(picked(s, d, "train"), "fold", "candidate", "n", "return_per_bar"))
query("walkforward_test", O.sql("select cast(fold as bigint) fold, candidate, count(*) n, round(avg(r), 6) mean_return from jc join folds using () on entry_date between test_start and test_end join pick using (fold, candidate) group by all".replace(" using () on", " on"), *HOLD, JOINED, FOLD_VALUES, CANDIDATES, TRAIN))(lambda s, d: rounded(picked(s, d, "test"), "fold", "candidate", "n", "mean_return"))
TESTED = "tested as (select fold, candidate, count(*) n, avg(r) mean_return from jc join folds on entry_date between test_start and test_end join pick using (fold, candidate) group by all), switched as (select *, (lag(candidate) over (order by fold) <> candidate)::int switch from tested)"
query(
    "walkforward_rollup",
    O.sql("select count(*) folds, round(sum(mean_return * n) / sum(n), 6) pooled, round(avg(mean_return), 6) averaged, round(stddev_samp(mean_return) / sqrt(count(*)), 6) std_error, cast(coalesce(sum(switch), 0) as bigint) switches, count(distinct candidate) distinct_picks from switched", *HOLD, JOINED, FOLD_VALUES, CANDIDATES, TRAIN, TESTED),
)(lambda s, d: rounded(walkforward.rolled_up(picked(s, d, "test"))))


CONTEST = """trained as (select fold, candidate, count(*) n, avg(r) inside, avg(r) / avg(greatest(bars_held, 1)) rpb from jc join folds on entry_date >= train_start and entry_date < test_start and exit_date < test_start group by all),
best as (select * from trained where n >= 30 qualify row_number() over (partition by fold order by rpb desc, candidate) = 1),
outs as (select fold, candidate, count(*) n, avg(r) outside, avg(r) / avg(greatest(bars_held, 1)) rpb from jc join folds on entry_date between test_start and test_end group by all),
duel as (select b.fold, inside, o.outside, o.n, o.rpb - f.rpb gap from best b join outs o using (fold, candidate) left join outs f on f.fold = b.fold and f.candidate = '3:ABC' where o.n >= 30)"""
query(
    "walkforward_contest",
    O.sql("select round(avg(inside - outside), 6) premium, round(case when count(gap) >= 2 then avg(gap) end, 6) gap, round(case when count(gap) >= 2 then stddev_samp(gap) / sqrt(count(gap)) end, 6) gap_error, count(gap) gap_folds, round(sum(outside * n) / sum(n), 6) pooled, round(avg(outside), 6) averaged from duel", *HOLD, JOINED, FOLD_VALUES, CANDIDATES, CONTEST),
)(lambda s, d: rounded(walkforward.contest(walk_scores(s, d), "3:ABC")))
query(
    "walkforward_scores",
    O.sql(
        "select cast(fold as bigint) fold, candidate, count(*) n, round(avg(r), 6) mean_return, round(median(r), 6) median_return, round(avg(r) / avg(greatest(bars_held, 1)), 6) return_per_bar, round(avg(r) / stddev_samp(r), 6) return_per_risk "
        "from jc join folds on entry_date between test_start and test_end group by all having stddev_samp(r) > 0",
        *HOLD, JOINED, FOLD_VALUES, CANDIDATES,
    ),
)(lambda s, d: rounded(part_of(walk_scores(s, d), "test").where("return_per_risk is not null"), "fold", "candidate", "n", "mean_return", "median_return", "return_per_bar", "return_per_risk"))


def half_updated(s: SparkSession, d: str) -> DataFrame:
    bars = B.bars(s, d)
    late = bars.where(F.col("date") >= "1998-01-01").withColumns({"close": F.col("close") + 1, "stamp": F.lit(2)})
    older = bars.where(F.col("date") >= "1998-06-01").withColumns({"close": F.col("close") - 5, "stamp": F.lit(1)})
    return store.upsert(bars, late.unionByName(older), ["ticker", "date"], "stamp").select("ticker", "date", "close", F.col("stamp").cast("bigint").alias("stamp"))


query("upsert_latest_wins", O.sql("select ticker, date, case when date >= date '1998-01-01' then close + 1 else close end as close, case when date >= date '1998-01-01' then 2::bigint end stamp from bars", O.DUCK_BARS))(half_updated)


def synced(s: SparkSession, d: str) -> DataFrame:
    known = B.tickers(s, d).select("ticker", "name", "sector", "is_active", F.lit("2024-01-01").cast("date").alias("first_seen"), F.lit("2024-01-01").cast("date").alias("last_seen"), F.lit(None).cast("date").alias("delisted_at"))
    incoming = B.tickers(s, d).where(~F.col("ticker").endswith("7")).select("ticker", "name", F.lit(None).cast("string").alias("sector"))
    return store.sync_universe(known, incoming, "2024-06-01", allow_large_drop=True).tickers


query(
    "universe_sync",
    O.sql("select ticker, name, sector, not suffix(ticker, '7') is_active, date '2024-01-01' first_seen, case when suffix(ticker, '7') then date '2024-01-01' else date '2024-06-01' end last_seen, case when suffix(ticker, '7') and is_active then date '2024-06-01' end delisted_at from tickers", O.DUCK_TICKERS),
)(synced)
query(
    "refetch_diff",
    O.sql("select ticker, date, close stored_close, round(close * 1.02, 6) fetched_close, 2.0::double diff_pct from bars qualify row_number() over (partition by ticker order by date) % 7 = 0", O.DUCK_BARS),
)(lambda s, d: (lambda b: rounded(store.refetch_differences(b, b.withColumn("close", F.col("close") * F.when(S.position() % 7 == 0, 1.02).otherwise(1.0)))))(B.bars(s, d)))
query(
    "fetch_failures",
    "select count(*) n, count(*) filter (event_type = 'click') failed, round(count(*) filter (event_type = 'click') / count(*), 6) rate, case when count(*) filter (event_type = 'click') / count(*) > 0.05 then 1::bigint else 0 end exit_code from events",
)(lambda s, d: rounded(store.failure_rate(B.table(s, d, "events").select(F.when(F.col("event_type") == "click", "network_error").otherwise("ok").alias("status")))))


def landing(tickers: list[str]) -> pd.DataFrame:
    """A source that misbehaves in known ways, by the number of the batch of ten: two bars for each name, none for every tenth."""
    batch = int(tickers[0][1:]) // 10
    if batch == 3:
        raise TimeoutError("read timed out")
    if batch in (5, 6, 7):
        raise RuntimeError("HTTP 429")
    days = [date(2024, 1, 2), date(2024, 1, 3)]
    rows = [{"ticker": t, "date": day, "open": 1.0, "high": 2.0, "low": 1.0, "close": float(int(t[1:])), "volume": 10} for t in tickers if int(t[1:]) % 10 for day in days]
    return pd.DataFrame(rows, columns=["ticker", "date", "open", "high", "low", "close", "volume"])


def outcomes(s: SparkSession, d: str) -> DataFrame:
    return fetch.fetched(B.tickers(s, d), landing, fetch.Pace(batch=10, workers=1, pause=0), lambda _: None)


FETCHED = "f as (select concat('S', lpad(cast(s_suppkey as varchar), 5, '0')) ticker, s_suppkey k, s_suppkey // 10 b from supplier), fetched as (select *, case when b >= 8 then 'circuit_open' when b between 5 and 7 then 'rate_limited' when b = 3 then 'network_error' when k % 10 = 0 then 'empty_response' else 'ok' end status from f)"
query("fetch_outcomes", O.sql("select ticker, b batch, status, case status when 'ok' then 2::bigint else 0 end rows_written, case status when 'rate_limited' then 5::bigint else 1 end attempt from fetched", FETCHED))(lambda s, d: rounded(outcomes(s, d), "ticker", "batch", "status", "rows_written", "attempt"))
query("fetched_bars", O.sql("select ticker, unnest([date '2024-01-02', date '2024-01-03']) date, cast(k as double) as close from fetched where status = 'ok'", FETCHED))(lambda s, d: fetch.landed(outcomes(s, d)).select("ticker", "date", "close"))
query("run_status_counts", O.sql("select status, count(*) n from fetched group by status", FETCHED))(lambda s, d: store.status_counts(outcomes(s, d).withColumn("run_id", F.lit("run")), "run"))
query("latest_run", "select arg_max(event_id, ts) run_id, max(ts) started_at from events where event_type = 'view'")(lambda s, d: store.latest_run(B.table(s, d, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("source"), F.col("ts").alias("started_at")), "view"))
query("last_price_dates", O.sql("select ticker, max(date) last_date from bars group by ticker", O.DUCK_BARS))(lambda s, d: store.last_dates(B.bars(s, d)))
query("error_statuses", "select event_id, case event_id % 4 when 0 then 'rate_limited' when 1 then 'network_error' when 2 then 'empty_response' else 'parse_error' end status from events")(
    lambda s, d: B.table(s, d, "events").select("event_id", store.error_status(F.element_at(F.array(*map(F.lit, ("HTTP 429 Too Many Requests", "ReadTimeout: read timed out", "possibly delisted; no price data found", "ValueError: bad JSON"))), (F.col("event_id") % 4 + 1).cast("int"))).alias("status"))
)


def strategy_bars(s: SparkSession, d: str, key: str) -> DataFrame:
    return gated(s, d) if key == "H" else B.bars(s, d)


def logged(log: DataFrame) -> DataFrame:
    return rounded(log.withColumn("turnover", F.round("turnover", 2).cast("decimal(38,2)"))).withColumn("turnover", F.round("turnover", 2))


def log_sql(key: str, body: str, *more: str) -> str | None:
    if key in O.LOT_WALKS:
        return O.sql(body, *O.LOT_WALKS[key], *more)
    parts, code = O.WALKS.get(key, ((), ""))
    return O.sql(body, *parts, O.log(code), *more) if parts else None


for _key in STRATEGIES:
    query(f"trade_log_{_key}", log_sql(_key, f"select {O.LOG_ROWS} from log"))(lambda s, d, key=_key: logged(trade_log.build(strategy_bars(s, d, key), STRATEGIES[key])))
    query(f"trade_summary_{_key}", log_sql(_key, O.LOG_SUMMARY))(lambda s, d, key=_key: rounded(trade_log.summary(trade_log.build(strategy_bars(s, d, key), STRATEGIES[key]))))
LAST_ROW = "qualify row_number() over (partition by ticker order by (status = 'WATCHLIST')::int desc, buy_date desc, coalesce(exit_date, date '9999-12-31') desc, entry_code desc) = 1"
query("latest_trades", log_sql("D", f"select {O.LOG_ROWS} from log {LAST_ROW}"))(lambda s, d: logged(trade_log.latest(trade_log.build(B.bars(s, d), STRATEGIES["D"]))))
query("trade_log_published")(lambda s, d: logged(trade_log.published(gated(s, d))))
query("trade_log_last_year", log_sql("D", f"select {O.LOG_ROWS} from log where signal_date is null or signal_date between (select max(signal_date) from log) - interval 12 month and (select max(signal_date) from log)"))(lambda s, d: logged(trade_log.last_months(trade_log.build(B.bars(s, d), STRATEGIES["D"]), 12)))


RAW_TRADES = ["ticker", "entry_date", "entry_price", "exit_date", "exit_price", "exit_code", "bars_held", "resolved"]


def raw_trades(s: SparkSession, d: str, key: str) -> DataFrame:
    return rounded(run(B.bars(s, d), STRATEGIES[key]).where("entry_date is not null"), *RAW_TRADES)


for _key, (_parts, _) in O.WALKS.items():
    query(f"trades_{_key}", O.sql(O.TRADES, *_parts, O.TRADES_TABLE))(lambda s, d, key=_key: raw_trades(s, d, key))
query(
    "event_bars",
    """select event_type ticker, date_trunc('day', ts) as "start", arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close, count(*) volume from events group by 1, 2""",
)(lambda s, d: bars_of_ticks(B.table(s, d, "events").select(F.col("event_type").alias("ticker"), "ts", F.col("value").alias("price"), F.lit(1).alias("volume"))))


query("ticker_history", O.sql("select ticker, date, close, round(ma5, 6) ma5, round(ma200, 6) ma200 from sma where ticker = 'S00003' order by date desc limit 120", O.DUCK_BARS, O.N, O.SMA))(lambda s, d: rounded(readers.ticker_history(indicators.moving_averages(B.bars(s, d)), "S00003", 120), "ticker", "date", "close", "ma5", "ma200"))
query(
    "measured_outcomes",
    O.sql("select tier, count(*) n, round(avg((r > 0)::int) * 100, 6) win_pct, round(avg(r), 6) mean_return, round(median(r), 6) median_return, min(entry_date) first_entry, max(entry_date) last_entry, any_value(rule_version) rule_version from j where r is not null and tier is not null group by tier", *HOLD, JOINED),
)(lambda s, d: (lambda found: rounded(readers.measured_outcomes(calibration.tiered(found[0].drop("tier"), found[1]), labels.HOLD_20.version)))(trades(s, d, labels.HOLD_20)))
RADAR = """last_walk as (select * from walk qualify row_number() over (partition by ticker order by n desc) = 1),
said as (select ticker, n, 'BUY Breakout' code from walk where hold and en = n union all select ticker, n, code from walk where code is not null),
last_said as (select ticker, arg_max(code, n) last_code from said group by ticker)"""
query(
    "radar_D",
    O.sql("select w.ticker, case when hold then 'holding' when pb then 'armed' else 'waiting' end state, last_code, case when last_code is null then 'OTHER' when last_code like 'BUY %' then 'BUY' when last_code like 'TP %' then 'TAKE PROFIT' else 'CUT LOSS' end category from last_walk w left join last_said using (ticker) where w.n >= 51", *O.WALKS["D"][0], RADAR),
)(lambda s, d: readers.radar(B.bars(s, d), STRATEGIES["D"]))
query(
    "radar_A",
    O.sql("select w.ticker, case when hold then 'holding' when watching then 'armed' else 'waiting' end state, last_code, case when last_code is null then 'OTHER' when last_code like 'BUY %' then 'BUY' when last_code = 'PANTAU' then 'WATCH' when last_code like 'SELL%' then 'TAKE PROFIT' else 'CUT LOSS' end category from last_walk w left join last_said using (ticker)", *O.STRUCTURE_WALK, O.RADAR_STRUCTURE),
)(lambda s, d: readers.radar(B.bars(s, d), STRATEGIES["A"]))
query(
    "recent_entries_G",
    O.sql("select t.ticker, t.entry_date, any_value(entry_code) entry_code, any_value(entry_price) entry_price, count(b.date) bars_ago from (select * from tr qualify row_number() over (partition by ticker order by entry_date desc) = 1) t left join bars b on b.ticker = t.ticker and b.date > t.entry_date group by t.ticker, t.entry_date having count(b.date) < 20", *O.DIPS, O.LOT_TRADES),
)(lambda s, d: readers.recent_entries(B.bars(s, d), STRATEGIES["G"], 20))
query("trade_span_D", O.sql("select min(entry_date) as \"first\", max(exit_date) as \"last\", count(*) n, round(date_diff('day', min(entry_date), max(exit_date)) / 365.25, 6) as \"years\", coalesce(date_diff('day', min(entry_date), max(exit_date)) / 365.25 >= 2, false) enough from tr", *O.WALKS["D"][0], O.TRADES_TABLE))(lambda s, d: rounded(readers.span_guard(run(B.bars(s, d), STRATEGIES["D"]).where("entry_date is not null"))))
query(
    "stock_list",
    "select concat('C', cast(c_custkey as varchar), '.JK') ticker, c_name as name from customer where c_custkey < 100000",
)(lambda s, d: readers.stock_list(B.table(s, d, "customer").select(F.concat(F.lit(" c"), F.col("c_custkey").cast("string"), F.lit(".jk")).alias("Kode Saham"), F.col("c_name").alias("Nama Perusahaan"))))


def new_store(s: SparkSession) -> Store:
    own = Store(s, f"{shared_root(s)}/store-{uuid.uuid4().hex}")
    own.init()
    return own


def two_versions(s: SparkSession, d: str) -> DataFrame:
    """What a reader of a version sees once the next one is there, beside what that one holds, by year."""
    bars, own = B.bars(s, d), new_store(s)
    own.upsert("prices", bars.where("date < '1997-01-01'"))
    reader = own.pin()
    early = reader.read("prices")
    own.upsert("prices", bars.where("date >= '1996-07-01'").withColumn("close", F.col("close") + 1))
    by_year = lambda frame, name: frame.groupBy(F.year("date").alias("yr")).agg(F.count(F.lit(1)).alias("bars"), F.sum("close").alias("closes")).withColumn("reader", F.lit(name))
    return rounded(by_year(early, "pinned").unionByName(by_year(own.read("prices"), "latest")))


query(
    "store_versions",
    O.sql("select 'pinned' reader, cast(year(date) as bigint) yr, count(*) bars, sum(close) closes from bars where date < '1997-01-01' group by all union all select 'latest', cast(year(date) as bigint), count(*), sum(case when date >= '1996-07-01' then close + 1 else close end) from bars group by all", O.DUCK_BARS),
)(two_versions)


def republished(s: SparkSession, d: str) -> DataFrame:
    """A publication of the last 60 bars after one of an older state, whose years have fallen out."""
    bars, own, slim = B.bars(s, d), new_store(s), new_store(s)
    own.upsert("prices", bars.where("date < '1994-01-01'"))
    own.publish(slim, 60)
    own.upsert("prices", bars.where("date >= '1994-01-01'"))
    own.publish(slim, 60)
    return slim.read("prices").select("ticker", "date", "close")


query("store_published", O.sql("select ticker, date, close from bars qualify row_number() over (partition by ticker order by date desc) <= 60", O.DUCK_BARS))(republished)

#: The first load of the nightly queries reaches to the first day; a night ends before each further one.
NIGHTS = ["1998-06-01", "1998-08-01", "1998-08-03", "9999-01-01"]


def after_nights(s: SparkSession, d: str) -> Store:
    """A store after a first load and three nights; the first night corrects the closes of one old day, too."""
    bars, own = B.dirty_bars(s, d), new_store(s)
    mended = F.col("date") == "1997-03-03"
    nightly.night(own, bars.where(F.col("date") < NIGHTS[0]).withColumn("close", F.when(mended, F.col("close") + 7).otherwise(F.col("close"))))
    for k, (start, end) in enumerate(zip(NIGHTS, NIGHTS[1:])):
        tonight = (F.col("date") >= start) & (F.col("date") < end)
        nightly.night(own, bars.where(tonight | mended if k == 0 else tonight))
    return own


query("nightly_signals", O.sql(f"select {SIGNAL} from signals", *O.ALL))(lambda s, d: rounded(after_nights(s, d).read("signals")))


def stored(s: SparkSession, d: str) -> buckets.Bucketed:
    bars = B.dirty_bars(s, d)
    return buckets.bucketed(s, prices=bars.select("ticker", "date", "close", "volume"), indicators=indicators.recursive(indicators.moving_averages(bars), ["rsi14", "atr14"], ("ma20", "ma50")), signals=signals.signals(bars), quality=quality.flagged(bars).select("ticker", "date", "is_clean", "stale_run_length"))


CHAIN = "chain as (select n.ticker, n.date, n.close, s.ma20, s.ma50, r.rsi14, a.a atr14, g.alignment_depth, g.tier, q.is_clean from n left join sma s using (ticker, date) left join rsi r on r.ticker = n.ticker and r.n = n.n left join rma a on a.ticker = n.ticker and a.n = n.n left join signals g on g.ticker = n.ticker and g.date = n.date left join quality q on q.ticker = n.ticker and q.date = n.date)"
CHAINED = ["ticker", "date", "close", "ma20", "ma50", "rsi14", "atr14", "alignment_depth", "tier", "is_clean"]
CHAIN_ROWS = "ticker, date, close, round(ma20, 6) ma20, round(ma50, 6) ma50, round(rsi14, 6) rsi14, round(atr14, 6) atr14, cast(alignment_depth as bigint) alignment_depth, tier, is_clean"
query("stored_chain", O.sql(f"select {CHAIN_ROWS} from chain", *O.ALL, O.DMI, CHAIN))(lambda s, d: rounded(buckets.chained(stored(s, d), "prices", "indicators", "signals", "quality"), *CHAINED))
query("stored_latest", O.sql(f"select {CHAIN_ROWS}, sector from chain left join tickers using (ticker) where coalesce(is_active, true) qualify row_number() over (partition by ticker order by date desc) = 1", *O.ALL, O.DMI, CHAIN, O.DUCK_TICKERS))(
    lambda s, d: rounded(buckets.newest(buckets.chained(stored(s, d), "prices", "indicators", "signals", "quality")).join(B.tickers(s, d), "ticker", "left").where(F.coalesce("is_active", F.lit(True))), *CHAINED, "sector")
)


def wide_batch(s: SparkSession, d: str) -> DataFrame:
    """A landed download of the nations' mean bars: a row a day, a column for each nation and field."""
    nations = B.bars(s, d).join(B.tickers(s, d).select("ticker", "sector"), "ticker").groupBy("sector", "date").agg(F.min("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("close").alias("close"), F.sum("volume").alias("volume"))
    names = [r[0] for r in B.table(s, d, "nation").select("n_name").distinct().orderBy("n_name").collect()]  # 25 by nature
    cells = [F.max(F.when(F.col("sector") == n, F.col(f))).alias(f"{n}|{f.capitalize()}") for n in names for f in landed.FIELDS]
    return nations.groupBy("date").agg(*cells)


query("landed_depivot", O.sql("select sector ticker, date, min(open) as open, max(high) high, min(low) low, max(close) as close, cast(sum(volume) as double) volume from bars join tickers using (ticker) group by all", O.DUCK_BARS, O.DUCK_TICKERS))(lambda s, d: rounded(landed.depivoted(wide_batch(s, d))))

#: Lines that land: the events' properties, damaged for some ids.
DAMAGED = "case when event_id % 29 = 0 then null when event_id % 23 = 0 then '<html><title>Attention required</title></html>' when event_id % 19 = 0 then substr(props, 1, 5) when event_id % 17 = 0 then '[1, 2]' when event_id % 13 = 0 then '{\"k\": \"many\"}' when event_id % 11 = 0 then '{\"j\": 1}' else props end"


def landed_lines(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return landed.json_lines(B.table(s, d, "events").selectExpr("event_id", f"{DAMAGED} as line"), "k bigint", ["k"])


query("landed_json", "select event_id, cast(json_extract(props, '$.k') as bigint) k from events where event_id % 29 <> 0 and event_id % 23 <> 0 and event_id % 19 <> 0 and event_id % 17 <> 0 and event_id % 13 <> 0 and event_id % 11 <> 0")(lambda s, d: landed_lines(s, d)[0])
query(
    "landed_quarantine",
    f"select event_id, line, case when line is null then 'empty' when event_id % 23 = 0 then 'page' when event_id % 19 = 0 then 'not_json' when event_id % 17 = 0 then 'not_an_object' when event_id % 13 = 0 then 'wrong_type' else 'missing' end reason from (select event_id, {DAMAGED} line from events) where event_id % 29 = 0 or event_id % 23 = 0 or event_id % 19 = 0 or event_id % 17 = 0 or event_id % 13 = 0 or event_id % 11 = 0",
)(lambda s, d: landed_lines(s, d)[1])

#: Listed shares: what a supplier has shipped by the end of each year, in thousands, known from the second of January on.
SHARES = "select concat('S', lpad(cast(l_suppkey as {text}), 5, '0')) ticker, make_date(cast(year(l_shipdate) + 1 as int), 1, 2) as_of, cast(sum(sum(cast(l_quantity as bigint))) over (partition by l_suppkey order by year(l_shipdate)) * 1000 as bigint) shares from {lineitem} group by l_suppkey, year(l_shipdate)"
DUCK_SHARES = f"shares as ({SHARES.format(text='varchar', lineitem='lineitem')})"


def shares(s: SparkSession, d: str) -> DataFrame:
    return s.sql(SHARES.format(text="string", lineitem="{lines}"), lines=B.table(s, d, "lineitem"))


query("listed_shares", O.sql("select ticker, arg_max(shares, as_of) shares from shares group by ticker", DUCK_SHARES))(lambda s, d: history.newest(shares(s, d), ["ticker"], "shares"))
query("shares_as_of_bar", O.sql("select b.ticker, b.date, h.shares from bars b asof left join shares h on h.ticker = b.ticker and h.as_of <= b.date", O.DUCK_BARS, DUCK_SHARES))(lambda s, d: history.as_of(B.bars(s, d).select("ticker", "date"), shares(s, d), ["ticker"], "shares", "date"))
query("share_intervals", O.sql("select ticker, shares, as_of valid_from, lead(as_of) over (partition by ticker order by as_of) - 1 valid_to from shares", DUCK_SHARES))(lambda s, d: history.intervals(shares(s, d), ["ticker"]).select("ticker", "shares", "valid_from", "valid_to"))


def log_with_value(s: SparkSession, d: str, key: str) -> DataFrame:
    bars = strategy_bars(s, d, key)
    ends = bars.groupBy("ticker").agg(F.max("date").alias("last_date"))
    return history.with_market_value(trade_log.build(bars, STRATEGIES[key]), shares(s, d), ends).select("ticker", "status", "signal_date", "buy_date", "exit_date", "last_close", F.col("mcap").cast("double").alias("mcap"))


query("trade_log_D_mcap", log_sql("D", "select log.ticker, status, signal_date, buy_date, exit_date, log.last_close, cast(h.shares * log.last_close as double) mcap from log join ends using (ticker) left join (select e.ticker, arg_max(shares, as_of) shares from ends e join shares on shares.ticker = e.ticker and as_of <= last_date group by e.ticker) h on h.ticker = log.ticker", DUCK_SHARES))(lambda s, d: log_with_value(s, d, "D"))


def checked_sample(s: SparkSession, d: str, k: int = 12, seed: int = 7) -> DataFrame:
    """A drawn sample of active names held against a second source that lacks every third name and differs on every seventh bar."""
    bars = B.bars(s, d)
    second = bars.withColumn("close", F.col("close") * F.when(S.position() % 7 == 0, 1.02).otherwise(1.0)).where("cast(substr(ticker, 2) as int) % 3 <> 0")
    return verification.verified(bars, second, verification.sampled(B.tickers(s, d).where("is_active"), "ticker", k, seed))


query(
    "verification_sample",
    O.sql("select ticker, any_value(cast(substr(ticker, 2) as int) % 3 <> 0) known, count(b.date) filter (cast(substr(ticker, 2) as int) % 3 <> 0) bars, count(b.date) filter (cast(substr(ticker, 2) as int) % 3 <> 0 and k % 7 = 0) differing from (select ticker from tickers where is_active order by sha256('7:' || ticker), ticker limit 12) left join (select *, row_number() over (partition by ticker order by date) k from bars) b using (ticker) group by ticker", O.DUCK_BARS, O.DUCK_TICKERS),
)(lambda s, d: rounded(checked_sample(s, d)))
query("verification_by_sector", O.sql("select ticker, sector from tickers qualify row_number() over (partition by sector order by sha256('3:' || ticker), ticker) <= 2", O.DUCK_TICKERS))(lambda s, d: verification.sampled(B.tickers(s, d), "ticker", 2, 3, "sector").select("ticker", "sector"))


#: Publications of this session, by the folder of their source: readers open what is there.
PUBLISHED: dict[tuple[str, str], Store] = {}


def opened(s: SparkSession, d: str) -> Store:
    """The publication over a folder's bars, which the first reader of a session makes."""
    key = s.sparkContext.applicationId, d
    if key not in PUBLISHED:
        own, target = new_store(s), new_store(s)
        nightly.night(own, B.with_actions(B.bars(s, d)))
        own.write("tickers", B.tickers(s, d))
        publication.published(own, target, gated(s, d).select("date", "index_ok").distinct())
        PUBLISHED[key] = target
    return PUBLISHED[key].pin()


CLEAN_SIGNALS = (O.DUCK_BARS, "dirty as (select *, 1.0 split_factor from bars)", O.ND, O.SMA, O.RSI, O.QUALITY, O.SIGNALS)
query("reader_latest_signals", O.sql(f"select {SIGNAL} from signals qualify row_number() over (partition by ticker order by date desc) = 1", *CLEAN_SIGNALS))(lambda s, d: rounded(opened(s, d).read("latest_signals")))
query("reader_quality", O.sql(" union all ".join(f"select '{f}' flag, count(*) filter ({f}) bars from quality" for f in FLAGS), O.DUCK_BARS, "dirty as (select *, 1.0 split_factor from bars)", O.ND, O.QUALITY))(lambda s, d: opened(s, d).read("quality_summary"))
query(
    "reader_outcomes",
    O.sql("select tier, count(*) n, round(avg((r > 0)::int) * 100, 6) win_pct, round(avg(r), 6) mean_return, round(median(r), 6) median_return, min(entry_date) first_entry, max(entry_date) last_entry, any_value(rule_version) rule_version from j where r is not null and tier is not null group by tier", *CLEAN_SIGNALS, O.ELIGIBLE, O.labels(20, None, None, "hold-h20-f081a07b"), JOINED),
)(lambda s, d: rounded(opened(s, d).read("measured_outcomes")))
for _key in O.WALKS:
    query(f"reader_log_{_key}", log_sql(_key, f"select {O.LOG_ROWS} from log"))(lambda s, d, key=_key: logged(publication.strategy_log(opened(s, d), key)).drop("seq"))
query("reader_ticker_log", log_sql("D", f"select {O.LOG_ROWS} from log where ticker = 'S00003'"))(lambda s, d: logged(publication.ticker_log(publication.strategy_log(opened(s, d), "D"), "S00003")).drop("seq"))
query("reader_window", O.sql("select ticker, date, close from bars qualify row_number() over (partition by ticker order by date desc) <= 180", O.DUCK_BARS))(lambda s, d: opened(s, d).read("prices").select("ticker", "date", "close"))
query("reactivated_names", O.sql("select count(*) reactivated from tickers where not is_active and not suffix(ticker, '7')", O.DUCK_TICKERS))(lambda s, d: publication.reactivated(B.tickers(s, d), B.tickers(s, d).where(~F.col("ticker").endswith("7"))))


GRID = (*O.ALL, O.ELIGIBLE, O.labels(20, None, None, "hold-h20-f081a07b", name="hold20"), O.labels(10, None, None, "hold-h10-01f0b5e7", name="hold10"), "trade_labels as (select * from hold20 union all select * from hold10)", JOINED)
GRID_SETS = "sets(tiers, tier) as (values " + ", ".join(f"('{k}', '{t}')" for k, ts in TIER_SETS.items() for t in ts) + "), jg as (select j.*, rule_version || '|' || tiers candidate from j join sets using (tier) where r is not null)"
query(
    "walkforward_grid",
    O.sql("select cast(fold as bigint) fold, candidate, count(*) n, round(avg(r), 6) mean_return, round(avg(r) / avg(greatest(bars_held, 1)), 6) return_per_bar from jg join folds on entry_date >= train_start and entry_date < test_start and exit_date < test_start group by all", *GRID, FOLD_VALUES, GRID_SETS),
)(lambda s, d: rounded(part_of(walkforward.judged(walkforward.candidates(trades(s, d, labels.HOLD_20, labels.Rule(10))[0], TIER_SETS), walkforward.fold_table(s, FOLDS)), "train"), "fold", "candidate", "n", "mean_return", "return_per_bar"))
query("days_without_trade", O.sql("select ticker, cast(unnest(generate_series(date + 1, nxt - 1, interval 1 day)) as date) date from (select ticker, date, lead(date) over (partition by ticker order by date) nxt from bars) where nxt - date > 1", O.DUCK_BARS))(lambda s, d: charts.days_without_trade(B.bars(s, d)))
query("chart_series", O.sql("select ticker, date, lead(fractal_up, 2) over w fractal_up, close >= lag(close) over w rises from (select f.*, n.close from frac f join n using (ticker, n)) window w as (partition by ticker order by date)", O.DUCK_BARS, O.N, O.FRACTALS))(
    lambda s, d: charts.volume_rises(charts.drawn_earlier(indicators.raw_fractals(B.bars(s, d)), ["fractal_up"])).select("ticker", "date", "fractal_up", "rises")
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
