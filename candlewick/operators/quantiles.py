"""Exact quantiles of a few huge groups, by refining histograms.

A group's values are counted in bins of equal width between its least and greatest value; only the bin that holds a
wanted rank is looked into again, between the least and greatest value that it really holds, until these are one.  A
pass aggregates in the sending tasks and moves a row for each bin, so no task holds a group's values.  Values are
written once, as each pass reads them again.  For many small groups `F.percentile` does with one pass.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.sources.snapshots import spilled

BINS = 4096


def quantiles(values: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], bins: int = BINS) -> DataFrame:
    """One row a group: for each name in ``wanted`` the quantile of (column, share) of its values that are not null.

    Quantiles between two values are interpolated.  The groups' ranks and bins pass through the driver: groups times
    quantiles times ``bins`` numbers.
    """
    spark = values.sparkSession
    columns = sorted({c for c, _ in wanted.values()})
    # a row for each value: the group's keys, the column's name, the value
    long = values.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*keys, "x.of", "x.v")
    long = spilled(long.where("v is not null"), "values")
    ids = [*keys, "of"]
    groups = {tuple(r[k] for k in ids): (r["n"], r["low"], r["high"]) for r in long.groupBy(*ids).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    # (group, rank) -> least and greatest value that it can have, values below
    ranks = {}
    for group, (n, low, high) in groups.items():
        for column, share in wanted.values():
            if group[-1] == column:
                for rank in (math.floor(share * (n - 1)), math.ceil(share * (n - 1))):
                    ranks[group, rank] = (low, high, 0)
    kinds = dict(long.dtypes)
    while todo := sorted({(*g, low, high) for (g, _), (low, high, _) in ranks.items() if low < high}, key=repr):
        schema = ", ".join(f"`_{k}` {kinds[k]}" for k in ids) + ", low double, high double, part int"
        ranges = F.broadcast(spark.createDataFrame([(*t, i) for i, t in enumerate(todo)], schema))
        met = F.lit(True)
        for k in ids:
            met &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        place = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins))
        found: dict[tuple, list] = {}
        for r in long.join(ranges, met & F.col("v").between(F.col("low"), F.col("high"))).groupBy("part", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect():
            found.setdefault(todo[r["part"]], []).append((r["bin"], r["n"], r["a"], r["b"]))
        for (group, rank), (low, high, below) in ranks.items():
            if low < high:
                for _, n, a, b in sorted(found[*group, low, high]):
                    if rank < below + n:
                        ranks[group, rank] = (a, b, below)
                        break
                    below += n
    rows = []
    for own in sorted({g[:-1] for g in groups}, key=repr):
        row = list(own)
        for column, share in wanted.values():
            n = groups.get((*own, column), (0,))[0]
            at = share * (n - 1)
            low, high = (ranks[(*own, column), f(at)][0] for f in (math.floor, math.ceil)) if n else (None, None)
            row.append(low + (high - low) * (at - math.floor(at)) if n else None)
        rows.append(tuple(row))
    return spark.createDataFrame(rows, ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{name}` double" for name in wanted]))
