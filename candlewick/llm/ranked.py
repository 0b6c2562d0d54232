"""Global row numbers, and the k-th row of a table, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.session import kept, width

#: Keys that halve the range in one round of `kth`; each round costs two passes over the rows still in it.
PIVOTS = 16


def numbered(frame: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """The frame written in the order of ``keys``, which no two rows share, with ``index`` from 0 in that order.

    Rows are dealt by ranges of their keys and sorted there; the driver sees one count for each range.
    """
    spark = frame.sparkSession
    order = frame.repartitionByRange(width(spark), *keys).sortWithinPartitions(*keys)
    out = kept(spark, order.withColumn("place", F.monotonically_increasing_id()), name)
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["part"], r["count"]) for r in out.groupBy(part.alias("part")).count().collect())
    before, total = [], 0
    for k, many in counts:
        before.append((k, total))
        total += many
    starts = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    return out.withColumn("part", part).join(starts, "part").withColumn("index", F.col("before") + within).drop("part", "before", "place")


def _literal(key: tuple, kind) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, kind.fields)])


def kth(table: DataFrame, k: int, seed: int = 0, pivots: int = PIVOTS) -> Column | None:
    """The k-th smallest value (from 1) of the struct column ``key``, which no two rows share and which holds no nulls.

    Quickselect over the cluster: random pivot keys of the range that is left, exact counts of what is less than and
    equal to each of them, and on with the range between two neighbours, until a pivot is the k-th itself.  Only the
    pivots and their counts reach the driver.
    """
    if k < 1:
        return None
    kind = table.schema["key"].dataType
    low = high = None
    below, turn = 0, 0
    while True:
        left = table
        left = left if low is None else left.where(F.col("key") > _literal(low, kind))
        left = left if high is None else left.where(F.col("key") < _literal(high, kind))
        found = left.select("key", F.xxhash64("key", F.lit(seed), F.lit(turn)).alias("h")).orderBy("h", "key").limit(pivots).select("key").collect()
        if not found:
            raise ValueError("the table holds fewer rows")
        keys = sorted(tuple(r["key"]) for r in found)
        sums = []
        for i, p in enumerate(keys):
            own = _literal(p, kind)
            sums += [F.count(F.when(F.col("key") < own, 1)).alias(f"less_{i}"), F.count(F.when(F.col("key") == own, 1)).alias(f"same_{i}")]
        counts = left.agg(*sums).first()
        start = below
        for i, p in enumerate(keys):
            less, same = start + counts[f"less_{i}"], counts[f"same_{i}"]
            if less < k <= less + same:
                return _literal(p, kind)
            if less + same < k:
                low, below = p, less + same
            else:
                high = p
                break
        turn += 1
