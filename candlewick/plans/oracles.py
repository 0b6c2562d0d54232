"""DuckDB SQL that the queries are held against, built from shared table expressions."""

from __future__ import annotations

from candlewick.sources.bars import DUCK_BARS, DUCK_DIRTY, DUCK_INDEX, DUCK_TICKERS


def sql(body: str, *parts: str) -> str:
    return f"with recursive {', '.join(parts)} {body}"


def full(agg: str, column: str, n: int) -> str:
    w = f"over (partition by ticker order by date rows between {n - 1} preceding and current row)"
    return f"case when count({column}) {w} = {n} then {agg}({column}) {w} end"


N = "n as (select *, row_number() over (partition by ticker order by date) n from bars)"
ND = "n as (select *, row_number() over (partition by ticker order by date) n from dirty)"
SMA = "sma as (select *, " + ", ".join(f"{full('avg', 'close', k)} ma{k}" for k in (5, 20, 50, 100, 200)) + " from n)"
EMAS = """step as (select ticker, date, n, close from n),
e as (
  select ticker, date, n, close e8, close e12, close e21, close e26, cast(null as double) sig from step where n = 1
  union all
  select s.ticker, s.date, s.n, e8 * (1 - 2.0 / 9) + s.close * 2 / 9, e12 * (1 - 2.0 / 13) + s.close * 2 / 13, e21 * (1 - 2.0 / 22) + s.close * 2 / 22, e26 * (1 - 2.0 / 27) + s.close * 2 / 27,
    case when s.n < 26 then null
         when s.n = 26 then (e12 * (1 - 2.0 / 13) + s.close * 2 / 13) - (e26 * (1 - 2.0 / 27) + s.close * 2 / 27)
         else sig * 0.8 + 0.2 * ((e12 * (1 - 2.0 / 13) + s.close * 2 / 13) - (e26 * (1 - 2.0 / 27) + s.close * 2 / 27)) end
  from e join step s on s.ticker = e.ticker and s.n = e.n + 1)"""
RSI = """diffs as (select ticker, date, n, close - lag(close) over (partition by ticker order by date) d from n),
wilder as (
  select ticker, 15::bigint n, avg(greatest(d, 0)) u, avg(greatest(-d, 0)) v from diffs where n between 2 and 15 group by ticker having count(*) = 14
  union all
  select s.ticker, s.n, (u * 13 + greatest(d, 0)) / 14, (v * 13 + greatest(-d, 0)) / 14 from wilder w join diffs s on s.ticker = w.ticker and s.n = w.n + 1),
rsi as (select ticker, n, case when u = 0 and v = 0 then 50 when v = 0 then 100 else 100 - 100 / (1 + u / v) end rsi14 from wilder)"""
DMI = """moves as (
  select ticker, date, n, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) tr, high - lag(high) over w up, lag(low) over w - low dn
  from n window w as (partition by ticker order by date)),
dm as (select ticker, n, tr, case when up > dn and up > 0 then up else 0 end p, case when dn > up and dn > 0 then dn else 0 end m from moves),
rma as (
  select ticker, 14::bigint n, avg(tr) a, avg(p) p, avg(m) m from dm where n <= 14 group by ticker having count(*) = 14
  union all
  select s.ticker, s.n, (a * 13 + s.tr) / 14, (r.p * 13 + s.p) / 14, (r.m * 13 + s.m) / 14 from rma r join dm s on s.ticker = r.ticker and s.n = r.n + 1),
dx as (select d.ticker, d.n, a, 100 * r.p / a dip, 100 * r.m / a dim, coalesce(case when r.p + r.m > 0 then 100 * abs(100 * r.p / a - 100 * r.m / a) / (100 * r.p / a + 100 * r.m / a) end, 0) x from dm d left join rma r on r.ticker = d.ticker and r.n = d.n),
adx as (
  select ticker, 14::bigint n, avg(x) y from dx where n <= 14 group by ticker having count(*) = 14
  union all
  select s.ticker, s.n, (y * 13 + s.x) / 14 from adx r join dx s on s.ticker = r.ticker and s.n = r.n + 1)"""
FRACTALS = """f0 as (
  select *, lag(high, 1) over w h1, lag(high, 2) over w h2, lag(high, 3) over w h3, lag(low, 1) over w l1, lag(low, 2) over w l2, lag(low, 3) over w l3 from n window w as (partition by ticker order by date)),
frac as (
  select ticker, date, n,
    last_value(case when n > 3 and h1 < h2 and h3 < h2 then h2 end ignore nulls) over (partition by ticker order by date rows between unbounded preceding and current row) fractal_up,
    last_value(case when n > 3 and l1 > l2 and l3 > l2 then l2 end ignore nulls) over (partition by ticker order by date rows between unbounded preceding and current row) fractal_down
  from f0)"""
#: Fractal bands bar by bar: the level before the bar decides the trend; a level that held five bars leaves a dot.
CHAOS = """fh as (
  select f.ticker, f.date, f.n, f.close, fractal_up u, fractal_down d, lag(fractal_up) over w pu, lag(fractal_down) over w pd,
    case when f.n > 5 then max(f.high) over (partition by f.ticker order by f.n rows between 5 preceding and 1 preceding) end top, case when f.n > 5 then min(f.low) over (partition by f.ticker order by f.n rows between 5 preceding and 1 preceding) end bot
  from (select frac.*, n.high, n.low, n.close from frac join n using (ticker, n)) f window w as (partition by f.ticker order by f.n)),
fcb as (
  select distinct ticker, 0::bigint n, null::double l0, null::double l1, null::double d0, null::double d1, 0::bigint b0, 0::bigint b1, 0 trend from fh
  union all
  select f.ticker, f.n, v.l0, v.l1,
    case when v.l0 is distinct from w.l0 and f.n - 1 - w.b0 >= 5 and w.l0 is not null then w.l0 else w.d0 end, case when v.l1 is distinct from w.l1 and f.n - 1 - w.b1 >= 5 and w.l1 is not null then w.l1 else w.d1 end,
    case when v.l0 is distinct from w.l0 then f.n - 1 else w.b0 end, case when v.l1 is distinct from w.l1 then f.n - 1 else w.b1 end, y.trend
  from fcb w join fh f on f.ticker = w.ticker and f.n = w.n + 1,
    lateral (select coalesce(w.l0, f.u) s0, coalesce(w.l1, f.d) s1) x,
    lateral (select case when f.close < x.s1 then -1 when f.close > x.s0 then 1 else w.trend end trend) y,
    lateral (select case when f.n > 1 and f.u is distinct from f.pu then f.u else x.s0 end m0, case when f.n > 1 and f.d is distinct from f.pd then f.d else x.s1 end m1) z,
    lateral (select case when y.trend < 0 and f.top is not null and not coalesce(f.top >= z.m0, false) then f.top else z.m0 end l0, case when y.trend > 0 and f.bot is not null and not coalesce(f.bot <= z.m1, false) then f.bot else z.m1 end l1) v)"""
QUALITY = """q0 as (
  select *, lag(close) over w prev, lag(date) over w prev_date, case when close = lag(close) over w then 0 else 1 end fresh from n window w as (partition by ticker order by date)),
q1 as (select *, sum(fresh) over (partition by ticker order by date rows between unbounded preceding and current row) run from q0),
q2 as (select *, row_number() over (partition by ticker, run order by date) stale_run_length, (close / nullif(prev, 0) - 1) * 100 jump_pct, date_diff('day', prev_date, date) gap_days from q1),
q3 as (
  select ticker, date, n < 200 insufficient_history, stale_run_length >= 5 stale_price, coalesce(volume, 0) <= 0 zero_volume,
    coalesce(abs(jump_pct) > 35 and coalesce(split_factor, 1) = 1, false) suspicious_jump, coalesce(gap_days > 10, false) gap,
    high < low or high < open or high < close or low > open or low > close impossible_bar,
    stale_run_length, jump_pct, gap_days, n bars_available from q2),
quality as (select *, not (stale_price or zero_volume or suspicious_jump or gap or impossible_bar) is_clean from q3)"""
SIGNALS = """g0 as (
  select s.*, r.rsi14, q.stale_price, q.suspicious_jump or q.impossible_bar bad, coalesce(s.close > s.ma5, false) above,
    coalesce(lag(coalesce(s.close > s.ma5, false)) over (partition by s.ticker order by s.date), false) was_above,
    case when coalesce(ma5 > ma20 and ma20 > ma50 and ma50 > ma100 and ma100 > ma200, false) and s.n >= 200 then 5
         when coalesce(ma5 > ma20 and ma20 > ma50 and ma50 > ma100, false) and s.n >= 100 then 4
         when coalesce(ma5 > ma20 and ma20 > ma50, false) and s.n >= 50 then 3 else 0 end depth
  from sma s left join rsi r on r.ticker = s.ticker and r.n = s.n join quality q on q.ticker = s.ticker and q.date = s.date),
g1 as (
  select *, last_value(case when above and not was_above then n end ignore nulls) over w cross_at, last_value(case when bad then n end ignore nulls) over w bad_at
  from g0 window w as (partition by ticker order by date rows between unbounded preceding and current row)),
signals as (
  select ticker, date, depth alignment_depth, rsi14 > 50 rsi_gate, case when ma5 is not null then close > ma5 end above_ma5, case when above then n - cross_at end days_since_ma5_cross,
    case depth when 5 then if(coalesce(rsi14 > 50, false), 'A', 'B') when 4 then if(coalesce(rsi14 > 50, false), 'B', 'C') when 3 then if(coalesce(rsi14 > 50, false), 'C', 'D') end tier,
    case when n < 200 then 'insufficient_history' when coalesce(n - bad_at <= case depth when 5 then 200 when 4 then 100 when 3 then 50 else 5 end, false) then 'suspect' when stale_price then 'stale' else 'ok' end data_quality,
    n bars_available from g1)"""
ALL = (DUCK_DIRTY, ND, SMA, RSI, QUALITY, SIGNALS)
ELIGIBLE = "eligible as (select s.ticker, s.date, s.tier, n.n k from signals s join n on n.ticker = s.ticker and n.date = s.date where alignment_depth >= 3 and rsi_gate and above_ma5 and data_quality not in ('stale', 'suspect'))"


def tick(price: str) -> str:
    """The ticks of the example costs."""
    return f"(case when {price} < 200 then 1 when {price} < 500 then 2 when {price} < 2000 then 5 when {price} < 5000 then 10 else 25 end)"


def labels(h: int, target: float | None, stop: float | None, version: str, tie: str = "unfavourable", name: str = "trade_labels", costs: bool = False) -> str:
    """Labels of eligible signals; the bars of a trade are n from k + 1 to k + h.  With costs, fills are on the tick grid and returns are net too."""
    paid = f"round(ceil(f.open / {tick('f.open')} - 1e-9) * {tick('f.open')}, 6)" if costs else "f.open"
    net = "null::double"
    if costs:
        net = f"round(floor(x / {tick('x')} + 1e-9) * {tick('x')}, 6) * (1 - 0.0025) / (round(ceil(fill_price / {tick('fill_price')} - 1e-9) * {tick('fill_price')}, 6) * (1 + 0.0015))"
        net = f"({net} - 1) * 100"
    up = f"{paid} * (1 + {target} / 100)" if target is not None else "cast(null as double)"
    down = f"{paid} * (1 - {stop} / 100)" if stop is not None else "cast(null as double)"
    order = "case when coalesce(high >= up, false) and (tie_good or not coalesce(low <= down, false)) then 'target' else 'stop' end"
    l0, l1, l2, l3 = (f"{name}_{k}" for k in range(4))
    return f"""{l0} as (
  select e.ticker, e.date entry_date, e.k, f.date fill_date, {paid} fill_price, {up} up, {down} down, {'true' if tie == 'favourable' else 'false'} tie_good
  from eligible e join n f on f.ticker = e.ticker and f.n = e.k + 1 where f.open > 0),
{l1} as (
  select l.*, b.n - l.k pos, b.date, b.high, b.low, b.close, coalesce(b.high >= up, false) or coalesce(b.low <= down, false) hit, {order} what,
    min(case when coalesce(b.high >= up, false) or coalesce(b.low <= down, false) then b.n - l.k end) over (partition by l.ticker, l.entry_date) hit_at, max(b.n - l.k) over (partition by l.ticker, l.entry_date) last_at
  from {l0} l join n b on b.ticker = l.ticker and b.n between l.k + 1 and l.k + {h}),
{l2} as (
  select ticker, entry_date, fill_date, fill_price, max(date) exit_date, arg_max(close, pos) last_close, arg_max(what, pos) what, any_value(hit_at) hit_at, any_value(last_at) last_at, any_value(up) up, any_value(down) down, max(pos) - 1 bars_held,
    least(0, (min(low) / fill_price - 1) * 100) mae, greatest(0, (max(high) / fill_price - 1) * 100) mfe
  from {l1} where pos <= coalesce(hit_at, pos) group by ticker, entry_date, fill_date, fill_price),
{l3} as (
  select *, case outcome when 'target' then up when 'stop' then down else last_close end x from (
    select *, case when hit_at is not null then what when last_at < {h} then 'open' else 'timeout' end outcome from {l2})),
{name} as (
  select ticker, entry_date, '{version}' rule_version, fill_date, fill_price, exit_date, x exit_price, outcome, bars_held,
    case when outcome <> 'open' then (x / fill_price - 1) * 100 end gross_return_pct, mae, mfe, case when outcome <> 'open' then {net} end return_pct from {l3})"""


INDEX_GATE = f"""{DUCK_INDEX},
gate as (select date, row_number() over w k, close, avg(close) over (order by date rows 19 preceding) f, avg(close) over (order by date rows 49 preceding) s, avg(close) over (order by date rows 199 preceding) m from ix window w as (order by date))"""


def emas(*spans: int) -> str:
    """EMAs of several spans in one recursion, null until full: em(ticker, n, e<span>...)."""
    first = ", ".join(f"close e{s}" for s in spans)
    after = ", ".join(f"e{s} * (1 - 2.0 / {s + 1}) + b.close * 2 / {s + 1}" for s in spans)
    shown = ", ".join(f"case when n >= {s} then e{s} end e{s}" for s in spans)
    return f"em0 as (select ticker, n, {first} from n where n = 1 union all select b.ticker, b.n, {after} from em0 join n b on b.ticker = em0.ticker and b.n = em0.n + 1), em as (select ticker, n, {shown} from em0)"


def before(agg: str, column: str, k: int) -> str:
    w = f"over (partition by ticker order by date rows between {k} preceding and 1 preceding)"
    return f"case when count({column}) {w} = {k} then {agg}({column}) {w} end"


def base_signal(bars: int, box: float, ceiling: int, volume_bars: int, volume: float, close_in_range: float | None, trend: str) -> str:
    """feat: the bars with ``signal`` of a quiet base, a breakout and volume."""
    strong = f"and close >= low + (high - low) * {close_in_range}" if close_in_range is not None else ""
    return f"""fa as (
  select n.*, {before('max', 'high', bars)} top, {before('min', 'low', bars)} bottom, {before('max', 'high', ceiling)} roof, {full('avg', 'volume', volume_bars)} usual, lag(close) over (partition by ticker order by date) prev from n),
fb as (select fa.*, em.* exclude (ticker, n), coalesce((top - bottom) / bottom * 100 <= {box} and {trend}, false) quiet, lag(roof) over (partition by fa.ticker order by date) roof_before from fa join em on em.ticker = fa.ticker and em.n = fa.n),
fc as (select *, lag(quiet) over (partition by ticker order by date) was_quiet from fb),
feat as (select *, coalesce(close > roof and prev <= roof_before and was_quiet and volume >= usual * {volume} {strong}, false) signal from fc)"""


BRACKET = """walk as (
  select distinct ticker, 0::bigint n, false pb, false hold, cast(null as double) entry, cast(null as bigint) en, cast(null as double) px, cast(null as varchar) code, cast(null as double) sold_entry, cast(null as bigint) sold_en from feat
  union all
  select f.ticker, f.n, not ((w.pb or w.hold) and not x.out) and f.signal, (w.pb or w.hold) and not x.out, case when w.pb then f.open else w.entry end, case when w.pb then f.n else w.en end,
    case when x.out then case when f.low <= w.entry * (1 - 10.0 / 100) then least(f.open, w.entry * (1 - 10.0 / 100)) else greatest(f.open, w.entry * (1 + 7.0 / 100)) end end,
    case when x.out then case when f.low <= w.entry * (1 - 10.0 / 100) then 'CL Stop 10%' else 'TP Target 7%' end end, w.entry, w.en
  from walk w join feat f on f.ticker = w.ticker and f.n = w.n + 1, lateral (select w.hold and (f.low <= w.entry * (1 - 10.0 / 100) or f.high >= w.entry * (1 + 7.0 / 100)) as out) x)"""

ATRS = "fx as (select feat.*, a atr from feat left join rma on rma.ticker = feat.ticker and rma.n = feat.n)"
#: What every walk starts with and how it meets a ticker's bars one by one.
STATE = "false pb, false ps, false hold, cast(null as double) entry, cast(null as bigint) en, cast(null as double) peak, cast(null as double) stop, cast(null as double) px, cast(null as varchar) code, cast(null as double) sold_entry, cast(null as bigint) sold_en"


def chandelier(reach: int, first: str) -> str:
    """A stop on closes, ``reach`` ATRs below the highest high since the signal."""
    return f"""{ATRS},
walk as (
  select distinct ticker, 0::bigint n, {STATE} from fx
  union all
  select f.ticker, f.n, not x.h and f.signal, x.h and f.close < x.s, x.h, case when w.pb then f.open else w.entry end, case when w.pb then f.n else w.en end,
    case when x.h then x.p when f.signal then f.high end, case when x.h then x.s when f.signal then {first} end,
    case when w.ps then f.open end, case when w.ps then case when f.open > w.entry then 'TP Trailing stop' else 'CL Trailing stop' end end, w.entry, w.en
  from walk w join fx f on f.ticker = w.ticker and f.n = w.n + 1,
    lateral (select (w.hold and not w.ps) or w.pb h, greatest(w.peak, f.high) p, greatest(w.stop, greatest(w.peak, f.high) - {reach} * f.atr) s) x)"""


CHANDELIER = chandelier(3, "f.close - 3 * f.atr")
WIDE = chandelier(4, "greatest(f.close - 4 * f.atr, f.bottom)")

#: F: a limit and a trailing stop, both resting from the bar after the fill.
EARLY = f"""{ATRS},
walk as (
  select distinct ticker, 0::bigint n, {STATE} from fx
  union all
  select f.ticker, f.n, not x.h and f.signal, false, x.h, case when w.pb then f.open else w.entry end, case when w.pb then f.n else w.en end,
    case when x.h then x.p end, case when x.h then greatest(case when not w.pb then w.stop end, x.p - 3 * f.atr) end,
    case when x.hit then x.price end, case when x.hit then case when not x.stopped then 'TP Target 10%' when x.price > w.entry then 'TP Trailing stop' else 'CL Stop loss' end end, w.entry, w.en
  from walk w join fx f on f.ticker = w.ticker and f.n = w.n + 1,
    lateral (select w.hold and coalesce(f.low <= w.stop, false) stopped, w.hold and (coalesce(f.low <= w.stop, false) or f.high >= w.entry * (1 + 10.0 / 100)) hit,
      case when f.low <= w.stop then least(f.open, w.stop) else greatest(f.open, w.entry * (1 + 10.0 / 100)) end price,
      w.pb or (w.hold and not (coalesce(f.low <= w.stop, false) or f.high >= w.entry * (1 + 10.0 / 100))) h, greatest(case when not w.pb then w.peak end, f.high) p) x)"""

#: I: a stop under the base that trails once ahead, a target, and a time stop; resting orders from the bar after the fill.
PATIENT = f"""walk as (
  select distinct ticker, 0::bigint n, {STATE}, false trails, cast(null as bigint) signal_at from feat
  union all
  select f.ticker, f.n, not x.h and f.signal, x.h and not x.t and f.n - w.signal_at >= 10, x.h, case when w.pb then f.open else w.entry end, case when w.pb then f.n else w.en end,
    case when x.h then x.p when f.signal then f.close end, case when x.h then case when x.t then greatest(w.stop, x.p * (1 - 3.0 / 100)) else w.stop end when f.signal then greatest(f.bottom, f.close * (1 - 5.5 / 100)) end,
    case when w.ps then f.open when x.hit then x.price end,
    case when w.ps then case when f.open > w.entry then 'TP Time stop' else 'CL Time stop' end
         when x.hit then concat(case when x.price > w.entry then 'TP ' else 'CL ' end, case when not x.stopped then 'Target 20%' when w.trails then 'Trailing stop' else 'Stop loss' end) end,
    w.entry, w.en, x.h and x.t, case when x.h then w.signal_at when f.signal then f.n end
  from walk w join feat f on f.ticker = w.ticker and f.n = w.n + 1,
    lateral (select *, w.pb or (w.hold and not w.ps and not hit) h, (w.trails and not w.pb) or p >= e * (1 + 5.0 / 100) t from (
      select w.hold and not w.ps and f.low <= w.stop stopped, w.hold and not w.ps and (f.low <= w.stop or f.high >= w.entry * (1 + 20.0 / 100)) hit,
        case when f.low <= w.stop then least(f.open, w.stop) else greatest(f.open, w.entry * (1 + 20.0 / 100)) end price, greatest(w.peak, f.high) p, case when w.pb then f.open else w.entry end e)) x)"""

#: J: a capped first stop, a break-even lock, failed-breakout and time exits, all decided at closes.
GUARDED = f"""{ATRS},
walk as (
  select distinct ticker, 0::bigint n, {STATE}, cast(null as double) base_top, cast(null as varchar) why from fx
  union all
  select f.ticker, f.n, not x.h and f.signal, x.h and y.reason is not null, x.h, case when x.h then x.e end, case when x.h then x.since end,
    case when x.h then x.p end, case when x.h then y.s when f.signal then greatest(f.close - 4 * f.atr, f.bottom, f.close * 0.93) end,
    case when w.ps then f.open end, case when w.ps then concat(case when f.open > w.entry then 'TP ' else 'CL ' end, w.why) end, w.entry, w.en,
    case when x.h then w.base_top when f.signal then f.top end, case when x.h then y.reason end
  from walk w join fx f on f.ticker = w.ticker and f.n = w.n + 1,
    lateral (select w.pb or (w.hold and not w.ps) h, greatest(case when not w.pb then w.peak end, f.high) p, case when w.pb then f.open else w.entry end e, case when w.pb then f.n else w.en end since) x,
    lateral (select s, case when f.close < s then 'Stop Hit' when f.n - x.since <= 10 and f.close < w.base_top * (1 - 2.0 / 100) then 'Failed Breakout' when f.n - x.since >= 15 and x.p < x.e * (1 + 5.0 / 100) then 'Time Stop' end reason
      from (select greatest(w.stop, x.p - 4 * f.atr, case when x.p >= x.e * (1 + 8.0 / 100) then x.e * (1 + 1.0 / 100) end) s)) y)"""

TRADES_TABLE = """tr as (
  select w.ticker, e.date entry_date, sold_entry entry_price, x.date exit_date, px exit_price, code exit_code, w.n - sold_en bars_held, true resolved
  from walk w join n e on e.ticker = w.ticker and e.n = sold_en join n x on x.ticker = w.ticker and x.n = w.n where code is not null
  union all
  select w.ticker, e.date, entry, x.date, x.close, 'OPEN', w.n - en, false
  from (select * from walk qualify row_number() over (partition by ticker order by n desc) = 1) w join n e on e.ticker = w.ticker and e.n = en join n x on x.ticker = w.ticker and x.n = w.n where hold)"""
TRADES = "select ticker, entry_date, entry_price, exit_date, round(exit_price, 6) exit_price, exit_code, bars_held, resolved from tr"
LIQUIDITY = "liq as (select ticker, avg(close * volume) turnover, avg(volume) / 100 avg_lots from (select *, row_number() over (partition by ticker order by date desc) k from bars) where k <= 60 group by ticker)"


def log(code: str, trades: str = TRADES_TABLE, entry_code: str | None = None, armed: str = "pb and not hold", pending: str = "true") -> str:
    """The trade log of a walk whose buys have one code, or the code in a column of its trades.

    ``armed``: whether a ticker's last state waits; ``pending``: whether it does for a buy at the next open.
    """
    entry_code = entry_code or f"'{code}'"
    return f"""{trades}, {LIQUIDITY},
ends as (select ticker, max(date) last_date, arg_max(close, date) last_close from bars group by ticker),
prior as (select ticker, date entry_date, lag(date) over w signal_date, lag(close) over w signal_price from bars window w as (partition by ticker order by date)),
tops as (
  select t.ticker, t.entry_date, b.date, greatest(b.high, b.close) top, max(greatest(b.high, b.close)) over (partition by t.ticker, t.entry_date) hi_price
  from tr t join bars b on b.ticker = t.ticker and b.date > t.entry_date and b.date <= t.exit_date),
peaks as (select ticker, entry_date, any_value(hi_price) hi_price, min(date) filter (top = hi_price) hi_date from tops group by all),
armed as (select ticker, {pending} pending from (select * from walk qualify row_number() over (partition by ticker order by n desc) = 1) where {armed}),
log as (
  select ticker, case when not resolved then 'OPEN' when exit_code like 'CL%' or exit_code like 'SELL CL%' or exit_code = 'SL' then 'EXIT' else 'CLOSED' end status, signal_date, signal_price, entry_date buy_date, 'B' pb, entry_price buy_price, last_close,
    case when not resolved then (exit_price / entry_price - 1) * 100 end fl_pct, hi_price, hi_date, (hi_price / entry_price - 1) * 100 max_fl_pct,
    case when resolved then exit_date end exit_date, case when resolved then exit_price end exit_price, case when resolved then (exit_price / entry_price - 1) * 100 end pl_pct,
    {entry_code} entry_code, case when resolved then exit_code end exit_code, turnover, avg_lots, bars_held
  from tr join prior using (ticker, entry_date) join ends using (ticker) join liq using (ticker) left join peaks using (ticker, entry_date)
  union all by name
  select ticker, 'WATCHLIST' status, case when pending then last_date end signal_date, case when pending then last_close end signal_price,
    case when pending then last_date + case isodow(last_date) when 5 then 3 when 6 then 2 else 1 end end buy_date, 'P' pb, last_close, turnover, avg_lots
  from armed join ends using (ticker) join liq using (ticker))"""


_SHOWN = ("buy_price", "fl_pct", "hi_price", "max_fl_pct", "exit_price", "pl_pct", "avg_lots")
LOG_ROWS = "ticker, status, signal_date, signal_price, buy_date, pb, last_close, hi_date, exit_date, entry_code, exit_code, round(turnover, 2) turnover, cast(bars_held as bigint) bars_held, " + ", ".join(f"round({c}, 6) {c}" for c in _SHOWN)
LOG_SUMMARY = (
    "select count(*) trades, count(*) filter (status = 'CLOSED') take_profits, count(*) filter (status = 'EXIT') cut_losses, round(avg((pl_pct > 0)::int) * 100, 6) win_pct, round(avg(pl_pct), 6) mean_pl, round(median(pl_pct), 6) median_pl, "
    "round(avg(((1 + pl_pct / 100) * (1 - 0.0025) / (1 + 0.0015) - 1) * 100), 6) mean_net, round(avg(pl_pct) filter (status = 'CLOSED'), 6) mean_tp, round(avg(pl_pct) filter (status = 'EXIT'), 6) mean_cl from log where pl_pct is not null"
)
#: Bars, features and walk of the strategies that SQL can follow, and the code of their buys.
_D = (DUCK_BARS, N, DMI, emas(50), base_signal(25, 15.0, 25, 25, 1.3, None, "close >= e50 * 0.95"), CHANDELIER)
_E = (DUCK_BARS, N, DMI, emas(200), base_signal(20, 12.0, 20, 50, 1.5, 0.7, "close > e200"))
_F = (DUCK_BARS, N, DMI, emas(100), base_signal(20, 15.0, 10, 50, 1.5, 0.6, "close > e100"), EARLY)
_I = (DUCK_BARS, N, emas(50, 150, 200), base_signal(40, 12.0, 20, 50, 2.0, 0.7, "close > e50 and e50 > e150 and e150 > e200"))
WALKS = {"D": (_D, "BUY Breakout"), "E": ((*_E, WIDE), "BUY Breakout"), "F": (_F, "BUY Early Entry"), "I": ((*_I, PATIENT), "BUY Sniper"), "J": ((*_E, GUARDED), "BUY Breakout"), "K": ((*_I, BRACKET), "BUY Sniper")}


_LOTS = "cast([] as struct(en bigint, px double, code varchar)[])"


def dips(ok: str, *joined: str) -> str:
    """G and H: a list of lots, bought at dips and golden crosses, sold together on a trailing stop or the cross down."""
    return f"""fd as (select n.*, {full("avg", "close", 20)} fast, {full("avg", "close", 50)} slow from n),
fe as (
  select fd.*, rma.a atr, coalesce(fast > slow, false) up, coalesce(fast > slow and lag(fast) over w <= lag(slow) over w, false) golden, coalesce(fast < slow and lag(fast) over w >= lag(slow) over w, false) death,
    coalesce(low <= fast and close > slow and close > open, false) touched, coalesce({ok}, false) ok
  from fd left join rma on rma.ticker = fd.ticker and rma.n = fd.n {" ".join(joined)} window w as (partition by fd.ticker order by fd.date)),
walk as (
  select distinct ticker, 0::bigint n, {_LOTS} lots, cast(null as varchar) sell, cast(null as varchar) buy, cast(null as double) trail, -1000000000::bigint signal_at, {_LOTS} sold, cast(null as double) sold_px, cast(null as varchar) sold_code from fe
  union all
  select f.ticker, f.n, y.lots, z.sell, b.buy, case when (len(y.lots) > 0 and z.sell is null) or b.buy is not null then greatest(w.trail, f.close - 3 * f.atr) end, case when b.buy is not null then f.n else w.signal_at end,
    case when w.sell is not null then w.lots else {_LOTS} end, f.open, w.sell
  from walk w join fe f on f.ticker = w.ticker and f.n = w.n + 1,
    lateral (select list_concat(case when w.sell is not null then {_LOTS} else w.lots end, case when w.buy is not null then [{{'en': f.n, 'px': f.open, 'code': w.buy}}] else {_LOTS} end) lots) y,
    lateral (select case when len(y.lots) > 0 and f.death then 'MA cross down' when len(y.lots) > 0 and f.close < w.trail then 'Trailing stop' end sell) z,
    lateral (select case when f.up and f.ok and len(y.lots) < 5 and f.n - w.signal_at >= 5 and z.sell is null and (f.golden or f.touched) then case when f.golden then 'BUY Golden cross' else 'BUY Dip' end end buy) b)"""


LOT_TRADES = """tr as (
  select w.ticker, e.date entry_date, w.l.px entry_price, w.l.code entry_code, x.date exit_date, sold_px exit_price, concat(case when sold_px > w.l.px then 'TP ' else 'CL ' end, sold_code) exit_code, w.n - w.l.en bars_held, true resolved
  from (select ticker, n, sold_px, sold_code, unnest(sold) l from walk where len(sold) > 0) w join n e on e.ticker = w.ticker and e.n = w.l.en join n x on x.ticker = w.ticker and x.n = w.n
  union all
  select w.ticker, e.date, w.l.px, w.l.code, x.date, x.close, 'OPEN', w.n - w.l.en, false
  from (select ticker, n, unnest(lots) l from (select * from walk qualify row_number() over (partition by ticker order by n desc) = 1)) w join n e on e.ticker = w.ticker and e.n = w.l.en join n x on x.ticker = w.ticker and x.n = w.n)"""
DIPS = (DUCK_BARS, N, DMI, dips("true"))
GATED = "days as (select distinct date from bars), gated as (select d.date, g.k >= 200 and g.f > g.s and g.close > g.m index_ok from days d asof left join gate g on d.date >= g.date)"
FILTERED = (DUCK_BARS, N, DMI, INDEX_GATE, GATED, dips("index_ok and adx.y > 20 and dx.dip > dx.dim", "left join gated using (date)", "left join dx on dx.ticker = fd.ticker and dx.n = fd.n", "left join adx on adx.ticker = fd.ticker and adx.n = fd.n"))
LOTS_LOG = log("", LOT_TRADES, "entry_code", "buy is not null and len(lots) = 0")
LOT_WALKS = {"G": (*DIPS, LOTS_LOG), "H": (*FILTERED, LOTS_LOG)}

PIVOTS = """piv as (select ticker, date, n, lag(high, 4) over w mh, lag(low, 4) over w ml,
  case when n > 8 then max(high) over (partition by ticker order by date rows between 8 preceding and 5 preceding) end oh, case when n > 8 then max(high) over (partition by ticker order by date rows between 3 preceding and current row) end nh,
  case when n > 8 then min(low) over (partition by ticker order by date rows between 8 preceding and 5 preceding) end ol, case when n > 8 then min(low) over (partition by ticker order by date rows between 3 preceding and current row) end nl
  from n window w as (partition by ticker order by date))"""
#: A: levels of the last pivots, buys, bars to watch; then from each buy to its end.
STRUCTURE = f"""sa as (
  select n.*, e9, e20, case when mh > oh and mh > nh then mh end ph, case when ml < ol and ml < nl then ml end pl, {full("avg", "close", 200).replace("close", "n.close").replace("ticker order by date", "n.ticker order by n.date")} ma200,
    {full("avg", "volume", 20).replace("ticker order by date", "n.ticker order by n.date")} usual, {full("avg", "volume", 3).replace("ticker order by date", "n.ticker order by n.date")} v3, {full("max", "high", 40).replace("ticker order by date", "n.ticker order by n.date")} top, {full("min", "low", 40).replace("ticker order by date", "n.ticker order by n.date")} bottom
  from n join piv using (ticker, n) join em using (ticker, n)),
sl as (select ticker, n, pl > lag(pl) over (partition by ticker order by n) climbs from sa where pl is not null),
sb as (
  select sa.* exclude (date), sa.date, coalesce((top - bottom) / bottom * 100 >= 30.0, false) or ma200 is null short, last_value(pl ignore nulls) over w base, last_value(ph ignore nulls) over w ceiling, last_value(climbs::int ignore nulls) over w climbing,
    coalesce(v3 <= usual * 0.85 or (volume < usual and v3 is not null), false) dry, coalesce(close > e9 and lag(close) over w <= lag(e9) over w, false) over9, lag(high) over w h1, lag(low) over w l1
  from sa left join sl using (ticker, n) window w as (partition by sa.ticker order by sa.n rows between unbounded preceding and current row)),
sc as (select *, coalesce(close > (case when short then e20 else ma200 end) and close > open and close > base, false) rebound, lag(dry) over (partition by ticker order by n) dry1 from sb),
sd as (
  select ticker, n, date, open, high, low, close, short, base, ceiling, coalesce(rebound and dry1 and volume >= usual and (close > h1 or over9), false) buy, coalesce(rebound and climbing = 1 and dry and volume < usual, false) watch, coalesce(close < open and close < l1, false) falls
  from sc where ticker in (select ticker from n group by ticker having count(*) >= 45)),
walk as (
  select distinct ticker, 0::bigint n, false hold, cast(null as bigint) en, cast(null as double) entry, cast(null as double) stop, cast(null as double) peak, cast(null as double) paid, cast(null as varchar) entry_code, cast(null as varchar) code, cast(null as bigint) sold_en, false watching from sd
  union all
  select f.ticker, f.n, y.reason is null and (w.hold or f.buy), case when w.hold then w.en when f.buy then f.n end, case when w.hold then w.entry when f.buy then f.close end, case when w.hold then w.stop when f.buy then f.base * (1.0 - 1.5 / 100.0) end,
    case when w.hold then x.peak when f.buy then f.high end, case when w.hold then x.paid end, case when w.hold then w.entry_code when f.buy then case when f.short then 'BUY LOW (EMA20)' else 'BUY LOW (SMA200)' end end, y.reason, w.en, f.watch and not w.hold
  from walk w join sd f on f.ticker = w.ticker and f.n = w.n + 1,
    lateral (select greatest(w.peak, f.high) peak, coalesce(w.paid, f.open) paid) x,
    lateral (select case when not w.hold then null when ((x.peak - w.entry) / w.entry * 100.0 >= 8.0 or coalesce(f.high >= f.ceiling * 0.99, false)) and f.falls and f.close > x.paid then 'SELL HIGH' when f.close < w.stop then 'SL' end reason) y)"""
#: Trades decided at a close and filled at the next open; an end that has no next bar leaves the trade open.
NEXT_OPEN_TRADES = """raw as (
  select ticker, sold_en en, n xn, entry_code, code from walk where code is not null
  union all
  select ticker, en, null, entry_code, null from (select * from walk qualify row_number() over (partition by ticker order by n desc) = 1) where hold),
ending as (select * from n qualify row_number() over (partition by ticker order by n desc) = 1),
tr as (
  select r.ticker, e.date entry_date, e.open entry_price, r.entry_code, coalesce(x.date, z.date) exit_date, coalesce(x.open, z.close) exit_price, case when x.n is not null then r.code else 'OPEN' end exit_code, coalesce(x.n, z.n) - e.n bars_held, x.n is not null resolved
  from raw r join n e on e.ticker = r.ticker and e.n = r.en + 1 left join n x on x.ticker = r.ticker and x.n = r.xn + 1 join ending z on z.ticker = r.ticker)"""
STRUCTURE_WALK = (DUCK_BARS, N, PIVOTS, emas(9, 20), STRUCTURE)
LOT_WALKS["A"] = (*STRUCTURE_WALK, log("", NEXT_OPEN_TRADES, "entry_code", "(watching and not hold) or (hold and en = n)", "hold"))
RADAR_STRUCTURE = """last_walk as (select * from walk qualify row_number() over (partition by ticker order by n desc) = 1),
said as (
  select ticker, n, entry_code said from walk where hold and en = n union all select ticker, n, code from walk where code is not null
  union all select ticker, n, 'PANTAU' from walk where watching and not (hold and en = n) and code is null),
last_said as (select ticker, arg_max(said, n) last_code from said group by ticker)"""
#: B: swings from one 50-bar low to the next, breaks of their rally's high, and trades from those or from a cross back.
REVERSAL = f"""ra as (
  select n.*, {full("avg", "close", 5)} ma5, {full("avg", "close", 20)} ma20, {full("min", "low", 50)} low50, {full("min", "low", 7)} low7 from n),
rb as (
  select ra.*, rma.a atr, coalesce(low = low50, false) bottom, case when ml < ol and ml < nl then ml end pl, coalesce(close > ma20 and lag(close) over w <= lag(ma20) over w, false) over20
  from ra left join rma on rma.ticker = ra.ticker and rma.n = ra.n join piv on piv.ticker = ra.ticker and piv.n = ra.n where ra.ticker in (select ticker from n group by ticker having count(*) >= 50) window w as (partition by ra.ticker order by ra.n)),
walk as (
  select distinct ticker, 0::bigint n, 0 st, cast(null as double) first_low, cast(null as double) rally, cast(null as bigint) rally_at, cast(null as double) second_low, false hold, cast(null as bigint) en, cast(null as double) stop, false ready, cast(null as double) paid, cast(null as varchar) entry_code,
    false again, false dropped, cast(null as varchar) code, cast(null as bigint) sold_en from rb
  union all
  select f.ticker, f.n, c.st, a.first_low, b.rally, b.rally_at, c.second_low, e.hold and g.reason is null, e.en, e.stop, e.ready, e.paid, e.entry_code,
    case when g.reason is null then w.again and not (e.buy and not c.broke) else g.reason like 'TP%' end, g.reason is null and d.dropped and not (e.buy and not c.broke), g.reason, e.en
  from walk w join rb f on f.ticker = w.ticker and f.n = w.n + 1,
    lateral (select case when f.bottom then 1 else w.st end st, case when f.bottom then f.low else w.first_low end first_low, case when f.bottom then f.high else w.rally end rally, case when f.bottom then f.n else w.rally_at end rally_at) a,
    lateral (select case when a.st = 1 then greatest(a.rally, f.high) else a.rally end rally, case when a.st = 1 and f.high > a.rally then f.n else a.rally_at end rally_at) b,
    lateral (select coalesce(f.pl > a.first_low and f.n - 4 > b.rally_at, false) higher, a.st = 2 and coalesce(f.close > b.rally and f.close > f.ma5, false) broke) h,
    lateral (select h.broke, case when a.st = 1 and h.higher then 2 when a.st = 2 and h.broke then 3 when a.st = 2 and f.low < a.first_low then 0 else a.st end st, case when a.st in (1, 2) and h.higher then f.pl else w.second_low end second_low) c,
    lateral (select w.dropped or (w.again and not w.hold and coalesce(f.close < f.ma20, false)) dropped) d,
    lateral (select not w.hold and (c.broke or (w.again and d.dropped and f.over20)) buy) i,
    lateral (select i.buy, w.hold or i.buy hold, case when i.buy then f.n else w.en end en, case when i.buy then (case when c.broke then c.second_low else f.low7 end) * 0.99 else w.stop end stop, case when i.buy then null else coalesce(w.paid, f.open) end paid,
      (not i.buy and w.ready) or ((w.hold or i.buy) and coalesce(f.close > f.ma20 and f.high - f.ma5 >= f.atr, false)) ready, case when i.buy then case when c.broke then 'BUY HH-HL' else 'BUY Re-Entry' end else w.entry_code end entry_code) e,
    lateral (select case when not e.hold then null when f.low <= e.stop then 'CL Struktur' when e.ready and not e.buy and f.close < f.ma5 and f.close > e.paid then 'TP Smart MA5' end reason) g)"""
REVERSAL_WALK = (DUCK_BARS, N, DMI, PIVOTS, REVERSAL)
LOT_WALKS["B"] = (*REVERSAL_WALK, log("", NEXT_OPEN_TRADES, "entry_code", "(st = 2 and not hold and code is null) or (hold and en = n)", "hold"))

#: Bottom fishing: setups under the bands, buys at closes back over the short average, levels reached before a profit is taken.
BOTTOMS = f"""fa as (
  select n.*, {full("avg", "close", 5)} ma5, {full("avg", "close", 10)} ma10, {full("avg", "close", 20)} ma20, {full("stddev_pop", "close", 20)} sd, {full("max", "high", 20)} du, {full("min", "low", 20)} dl from n),
fb as (select *, ma20 + 2 * sd bu, ma20 - 2 * sd bl, (du + dl) / 2 middle, lag(dl) over (partition by ticker order by date) dl1 from fa where ticker in (select ticker from n group by ticker having count(*) >= 25)),
walk as (
  select distinct ticker, 0::bigint n, '' setup, false again, false dipped, '' last_exit, false hold, cast(null as bigint) en, cast(null as double) floor, cast(null as double) stop, false c1, false c2, false b1, false b2, cast(null as varchar) entry_code, cast(null as varchar) code, cast(null as bigint) sold_en from fb
  union all
  select f.ticker, f.n, case when b.buy then '' else a.setup end, case when b.buy then false else w.again or g.reason is not null end, case when b.buy then false when g.reason is not null then g.reason like 'SELL%' else a.dipped end,
    case when g.reason is null then w.last_exit when g.reason like 'SELL%' then 'CL' else 'TP' end, (w.hold or b.buy) and g.reason is null, case when b.buy then f.n else w.en end, case when b.buy then f.dl else w.floor end, case when b.buy then f.close * (1.0 - 0.10) else w.stop end,
    not b.buy and g.reason is null and r.c1, not b.buy and g.reason is null and r.c2, not b.buy and g.reason is null and r.b1, not b.buy and g.reason is null and r.b2,
    case when b.fresh then concat('BUY (', a.setup, ')') when b.buy then case when w.last_exit = 'CL' then 'BUYBACK (d2)' else 'BUYBACK (d1)' end else w.entry_code end, g.reason, w.en
  from walk w join fb f on f.ticker = w.ticker and f.n = w.n + 1,
    lateral (select f.ma20 is not null and f.dl1 is not null and f.bl is not null seen) v,
    lateral (select v.seen and not w.hold and f.close < f.ma5 under) u,
    lateral (select case when not u.under then w.setup when f.low < f.dl1 then 'a3' when f.low <= f.dl then 'a2' when f.low <= f.bl then 'a1' else w.setup end setup, w.dipped or (u.under and w.again) dipped) a,
    lateral (select v.seen and not w.hold and f.close > f.ma5 and f.close > f.open turned) t,
    lateral (select t.turned and a.setup <> '' and not (f.ma5 > f.ma20 and f.ma5 > f.middle) fresh, t.turned and ((a.setup <> '' and not (f.ma5 > f.ma20 and f.ma5 > f.middle)) or (w.again and a.dipped)) buy) b,
    lateral (select w.c1 or (v.seen and w.hold and f.high >= f.bu) c1, w.c2 or (v.seen and w.hold and f.high >= f.du) c2, w.b1 or (v.seen and w.hold and f.high >= f.bu * 0.9) b1, w.b2 or (v.seen and w.hold and f.high >= f.du * 0.9) b2) r,
    lateral (select case when not v.seen or not w.hold then null when f.close < w.floor or f.low < w.floor then 'SELL CL (e1)' when least(f.low, f.close) <= w.stop then 'SELL CL (e2)' when f.close < f.ma10 and r.c1 then 'TP MA10 (c1)' when f.close < f.ma10 and r.c2 then 'TP MA10 (c2)'
      when f.close < f.ma5 and r.b1 then 'TP MA5 (b1)' when f.close < f.ma5 and r.b2 then 'TP MA5 (b2)' end reason) g)"""
#: Trades that are bought and sold at closes.
CLOSE_TRADES = """tr as (
  select w.ticker, e.date entry_date, e.close entry_price, w.entry_code, x.date exit_date, x.close exit_price, w.code exit_code, w.n - w.sold_en bars_held, true resolved
  from walk w join n e on e.ticker = w.ticker and e.n = w.sold_en join n x on x.ticker = w.ticker and x.n = w.n where w.code is not null
  union all
  select w.ticker, e.date, e.close, w.entry_code, x.date, x.close, 'OPEN', w.n - w.en, false
  from (select * from walk qualify row_number() over (partition by ticker order by n desc) = 1) w join n e on e.ticker = w.ticker and e.n = w.en join n x on x.ticker = w.ticker and x.n = w.n where w.hold)"""
LOT_WALKS["bottom_fishing"] = (DUCK_BARS, N, BOTTOMS, log("", CLOSE_TRADES, "entry_code", "setup <> '' and not hold"))


def at_pivot(column: str, agg: str) -> str:
    """A bar that alone is the extreme of the five bars on either side, known five bars later."""
    sign = ">" if agg == "max" else "<"
    mid, older, newer = f"lag({column}, 5) over (partition by ticker order by date)", *(f"{agg}({column}) over (partition by ticker order by date rows between {a} preceding and {b})" for a, b in ((10, "6 preceding"), (4, "current row")))
    return f"case when n > 10 and {mid} {sign} {older} and {mid} {sign} {newer} then {mid} end"


_NEAR = "coalesce({0} < f.close and f.close <= {0} * (1 + 5.0 / 100), false)"
_LIST = "cast([] as double[])"
#: C: contractions under the highest pivot and twin lows with a neckline, bar by bar; then half out at twice the risk, the rest trailing.
PATTERNS = f"""pa as (
  select n.*, {full("avg", "close", 50)} a50, {full("avg", "close", 150)} a150, {full("avg", "close", 200)} a200, {full("avg", "volume", 50)} v50, {full("avg", "volume", 10)} v10, {full("min", "low", 252)} l252, {full("max", "high", 252)} h252, {full("avg", "(close * volume)", 20)} turned, {at_pivot("high", "max")} ph, {at_pivot("low", "min")} pl
  from n),
pb as (
  select pa.*, e21 trail, coalesce(close > a50 and a50 > a150 and a150 > a200 and a200 > lag(a200, 20) over w and close >= l252 * 1.25 and close >= h252 * 0.75, false) trend, coalesce(turned >= 5e9, false) liquid, coalesce(volume >= v50 * 1.5, false) active, coalesce(lag(v10 < v50 * 0.85) over w, false) dried
  from pa join em using (ticker, n) where ticker in (select ticker from n group by ticker having count(*) >= 60) window w as (partition by pa.ticker order by pa.date)),
pat as (
  select distinct ticker, 0::bigint n, cast(null as double) top, -1::bigint began, cast(null as double) swing, {_LIST} depths, cast(null as double) pv, cast(null as double) lw, cast(null as double) low1, -1::bigint last_at, cast(null as double) cand, cast(null as double) neck, cast(null as double) tlow, -1::bigint armed,
    false fire, cast(null as double) base_low, cast(null as varchar) code from pb
  union all
  select f.ticker, f.n, a.top, a.began, b.swing, b.depths, case when e.vcp or coalesce(f.close > b.pv * (1 + 5.0 / 100), false) then null else b.pv end, b.lw, case when f.pl is not null then f.pl else w.low1 end, case when f.pl is not null then f.n - 6 else w.last_at end, case when f.pl is null then a.cand end,
    case when e.twin or coalesce(f.close > c.neck * (1 + 5.0 / 100), false) then null else c.neck end, b.tlow, b.armed, e.vcp or e.twin, case when e.vcp then b.lw when e.twin then b.tlow end, case when e.vcp then concat('BUY VCP ', d.many, 'T') when e.twin then 'BUY Double Bottom' end
  from pat w join pb f on f.ticker = w.ticker and f.n = w.n + 1,
    lateral (select f.ph is not null and (w.top is null or f.ph > w.top) fresh) x,
    lateral (select case when x.fresh then f.ph else w.top end top, case when x.fresh then f.n - 6 else w.began end began, case when x.fresh then f.ph when f.ph is not null then greatest(w.swing, f.ph) else w.swing end swing, case when x.fresh then {_LIST} else w.depths end depths,
      case when not x.fresh then w.pv end pv, case when not x.fresh then w.lw end lw, case when f.ph is not null and w.low1 is not null and f.n - 6 > w.last_at then greatest(w.cand, f.ph) else w.cand end cand) a,
    lateral (select f.pl is not null and a.top is not null and a.swing is not null falls, coalesce(f.pl is not null and a.top is not null and a.swing is null and len(a.depths) > 0 and f.pl < a.lw and a.pv is not null, false) deeper,
      coalesce(f.pl is not null and w.low1 is not null and a.cand is not null and f.n - 6 - w.last_at between 15 and 120 and abs((f.pl - w.low1) / w.low1 * 100) <= 4.0 and (a.cand - least(f.pl, w.low1)) / least(f.pl, w.low1) * 100 between 10.0 and 40.0, false) twins) y,
    lateral (select case when y.falls then list_concat(case when len(a.depths) = 6 then list_slice(a.depths, 2, 6) else a.depths end, [(a.swing - f.pl) / a.swing * 100]) when y.deeper then list_concat(list_slice(a.depths, 1, len(a.depths) - 1), [(a.pv - f.pl) / a.pv * 100]) else a.depths end depths,
      case when y.falls then a.swing else a.pv end pv, case when y.falls or y.deeper then f.pl else a.lw end lw, case when not y.falls then a.swing end swing, case when y.twins then a.cand else w.neck end neck, case when y.twins then least(f.pl, w.low1) else w.tlow end tlow, case when y.twins then f.n - 1 else w.armed end armed) b,
    lateral (select case when not (coalesce(f.close < b.tlow * (1 - 4.0 / 100), false) or f.n - 1 - b.armed > 40) then b.neck end neck) c,
    lateral (select case when len(b.depths) = 0 then 0 when not coalesce(b.depths[-1] <= b.depths[-2] * 0.85, false) then 1 when not coalesce(b.depths[-2] <= b.depths[-3] * 0.85, false) then 2 when not coalesce(b.depths[-3] <= b.depths[-4] * 0.85, false) then 3
      when not coalesce(b.depths[-4] <= b.depths[-5] * 0.85, false) then 4 when not coalesce(b.depths[-5] <= b.depths[-6] * 0.85, false) then 5 else 6 end many) d,
    lateral (select f.trend and f.liquid and f.dried and f.active and d.many >= 2 and coalesce(b.depths[-d.many] <= 35.0 and b.depths[-1] <= 10.0, false) and case when a.began >= 0 then f.n - 1 - a.began else 0 end between 20 and 260 and {_NEAR.format("b.pv")} vcp) v,
    lateral (select v.vcp, not v.vcp and f.active and f.liquid and {_NEAR.format("c.neck")} twin) e),
pc as (select pb.*, fire, base_low, code from pb join pat using (ticker, n)),
walk as (
  select distinct ticker, 0::bigint n, false hold, cast(null as bigint) en, cast(null as double) entry, cast(null as double) stop, cast(null as double) lim, cast(null as double) half, false selling, false planned, cast(null as double) plan_stop, cast(null as double) plan_lim, cast(null as varchar) plan_code, cast(null as varchar) entry_code,
    cast(null as double) px, cast(null as varchar) code, cast(null as bigint) sold_en, cast(null as double) sold_entry, cast(null as varchar) sold_code from pc
  union all
  select f.ticker, f.n, k.hold, a.en, a.entry, case when k.hold and k.half is not null then greatest(a.stop, a.entry) else a.stop end, case when k.hold and a.en = f.n then a.entry + 2.0 * (a.entry - a.stop) else a.lim end, k.half, k.hold and k.half is not null and coalesce(f.close < f.trail, false),
    not k.hold and coalesce(f.fire and p.s < f.close, false), p.s, f.close + 2.0 * (f.close - p.s), f.code, a.entry_code,
    case when w.selling then case when w.half is null then f.open else 0.5 * w.half + (1 - 0.5) * f.open end when k.stopped then case when a.half is null then least(f.open, a.stop) else 0.5 * a.half + (1 - 0.5) * least(f.open, a.stop) end end,
    case when w.selling then 'TP 2R + Trail EMA21' when k.stopped then case when a.half is null then 'CL Stop loss' else 'TP 2R + BE stop' end end, case when w.selling then w.en else a.en end, case when w.selling then w.entry else a.entry end, case when w.selling then w.entry_code else a.entry_code end
  from walk w join pc f on f.ticker = w.ticker and f.n = w.n + 1,
    lateral (select (w.hold and not w.selling) or w.planned holds, case when w.planned then f.n else w.en end en, case when w.planned then f.open else w.entry end entry, case when w.planned then w.plan_stop else w.stop end stop, case when w.planned then w.plan_lim else w.lim end lim, case when not w.planned then w.half end half, case when w.planned then w.plan_code else w.entry_code end entry_code) a,
    lateral (select a.holds and f.low <= a.stop stopped, a.holds and not (f.low <= a.stop) hold, case when a.holds and not (f.low <= a.stop) and a.half is null and f.high >= a.lim then greatest(f.open, a.lim) else a.half end half) k,
    lateral (select greatest(f.base_low * 0.995, f.close * (1 - 8.0 / 100)) s) p)"""
PATTERN_TRADES = """tr as (
  select w.ticker, e.date entry_date, sold_entry entry_price, sold_code entry_code, x.date exit_date, px exit_price, code exit_code, w.n - sold_en bars_held, true resolved
  from walk w join n e on e.ticker = w.ticker and e.n = sold_en join n x on x.ticker = w.ticker and x.n = w.n where code is not null
  union all
  select w.ticker, e.date, entry, w.entry_code, x.date, case when half is null then x.close else 0.5 * half + (1 - 0.5) * x.close end, 'OPEN', w.n - en, false
  from (select * from walk qualify row_number() over (partition by ticker order by n desc) = 1) w join n e on e.ticker = w.ticker and e.n = en join n x on x.ticker = w.ticker and x.n = w.n where hold)"""
LOT_WALKS["C"] = (DUCK_BARS, N, emas(21), PATTERNS, log("", PATTERN_TRADES, "entry_code", "planned and not hold"))
