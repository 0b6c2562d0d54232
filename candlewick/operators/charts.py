"""What a chart of bars needs besides the indicators: days without trade, shifted series, the direction of volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions import series as S


def days_without_trade(bars: DataFrame, key: str = "ticker") -> DataFrame:
    """Calendar days between a name's first and last bar on which it has none.

    Each bar fills the gap up to the next one, so there is one exchange and nothing grows with the span of all names.
    """
    after = F.lead("date").over(S.W.partitionBy(key).orderBy("date"))
    gaps = bars.select(key, "date").distinct().withColumn("_next", after).where(F.datediff("_next", "date") > 1)
    return gaps.select(key, F.explode(F.sequence(F.date_add("date", 1), F.date_sub("_next", 1))).alias("date"))


def drawn_earlier(bars: DataFrame, columns: list[str], n: int = 2) -> DataFrame:
    """The columns moved n bars to the left: fractals are known that much later than they are drawn."""
    return bars.withColumns({c: F.lead(c, n).over(S.by_ticker()) for c in columns})


def drawn_later(bars: DataFrame, columns: list[str], n: int = 26) -> DataFrame:
    """The columns moved n bars to the right, as leading spans are."""
    return bars.withColumns({c: S.lag(c, n) for c in columns})


def volume_rises(bars: DataFrame) -> DataFrame:
    """Adds ``rises``: the close is not below the one before; the first bar's is null."""
    return bars.withColumn("rises", F.col("close") >= S.lag("close"))
