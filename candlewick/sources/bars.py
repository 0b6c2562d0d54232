"""Bar sources over the driver tables, and their twins in DuckDB SQL.

Prices are integers, so sums over windows are the same in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: One body for both engines; the dialects differ in a few names.
WALK = """
  select ticker, date,
         cast({first}(px, k) as double) as open,
         cast(greatest(max(px), max(px0)) + 2 as double) as high,
         cast(least(min(px), min(px0)) - 2 as double) as low,
         cast({last}(px, k) as double) as close,
         cast(sum(q) * 200000 as bigint) as volume
  from (
    select *, greatest(100, 1000 + 4 * cum) px, greatest(100, 1000 + 4 * (cum - step)) px0
    from (
      select *, sum(step) over (partition by ticker order by date, ok, ln, pk, step, q
                                rows between unbounded preceding and current row) cum,
             row_number() over (partition by ticker order by date, ok, ln, pk, step, q) k
      from (
        select concat('S', lpad(cast(l_suppkey as {text}), 5, '0')) ticker, cast(l_shipdate as date) date,
               l_orderkey ok, l_linenumber ln, l_partkey pk,
               cast(round(l_discount * 100) as bigint) - 5 step, cast(l_quantity as bigint) q
        from {lineitem}) l) w) p
  group by ticker, date
"""

DUCK_WALK = WALK.format(first="arg_min", last="arg_max", text="varchar", lineitem="lineitem")

#: bars_dirty: every k-th bar of a ticker is damaged in a known way.
DIRTY = """
  select ticker, date, open, high,
         case when k % 97 = 0 then high + 1 else low end as low,
         case when k between 150 and 156 then c150 when k % 211 = 0 then close * 2 else close end as close,
         case when k % 53 = 0 then 0 else volume end as volume,
         case when k % 422 = 0 then 2.0 else 1.0 end as split_factor
  from (
    select *, max(case when k = 150 then close end) over (partition by ticker) c150
    from (select *, row_number() over (partition by ticker order by date) k from {bars}) b) d
"""

DUCK_BARS = f"bars as ({DUCK_WALK})"
DUCK_DIRTY = f"{DUCK_BARS}, dirty as ({DIRTY.format(bars='bars')})"
DUCK_INDEX = "ix as (select date, round(avg(close), 0) as close from bars group by date)"
DUCK_TICKERS = "tickers as (select concat('S', lpad(cast(s_suppkey as varchar), 5, '0')) ticker, s_name as name, n_name as sector, s_suppkey % 10 <> 0 as is_active from supplier join nation on s_nationkey = n_nationkey)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, open, high, low, close, volume: one walk of prices for each supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_quantity")
    return spark.sql(WALK.format(first="min_by", last="max_by", text="string", lineitem="{lines}"), lines=lines)


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRTY.format(bars="{b}"), b=bars(spark, sf_dir))


def with_actions(frame: DataFrame) -> DataFrame:
    """Adds the neutral corporate actions to bars that carry none."""
    for name, value in (("split_factor", 1.0), ("dividend", 0.0)):
        if name not in frame.columns:
            frame = frame.withColumn(name, F.lit(value))
    return frame


def index_series(frame: DataFrame) -> DataFrame:
    """The market index: mean close of each day."""
    return frame.groupBy("date").agg(F.round(F.avg("close"), 0).alias("close"))


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension, small by nature (a row per listed name)."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")).alias("ticker"), F.col("s_name").alias("name"), F.col("n_name").alias("sector"), (F.col("s_suppkey") % 10 != 0).alias("is_active")
    )


def finite(frame: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column: what follows compares with nulls only."""
    kinds = dict(frame.dtypes)
    return frame.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in frame.columns])


def normalised(raw: DataFrame, order: str = "ingested_at") -> DataFrame:
    """Landed bars in store form: all-null bars dropped, split 0 to 1, no dividend to 0, whole volumes, last of a key kept."""
    prices = ["open", "high", "low", "close"]
    own = finite(raw.select("*", *[F.expr(f"try_cast({c} as double)").alias(f"_{c}") for c in prices]).drop(*prices).withColumnsRenamed({f"_{c}": c for c in prices})).dropna(how="all", subset=prices)
    own = own.withColumns({"volume": F.expr("cast(round(try_cast(volume as double)) as bigint)"), "split_factor": F.expr("coalesce(nullif(try_cast(split_factor as double), 0), 1.0)"), "dividend": F.expr("coalesce(try_cast(dividend as double), 0.0)"), "date": F.col("date").cast("date")})
    return latest_by(own, ["ticker", "date"], order)


def latest_by(frame: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return frame.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(order)))).where("_n = 1").drop("_n")
