"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is an aggregation and a join on node ids; a hub of the graph is
pre-aggregated before the exchange and its join side is one row, so its many
neighbours can be split by the engine.  Nothing is collected but two checksums a round.
What is written has as many partitions as its rows ask for, so that few links don't
cost a task for every partition of an exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.session import kept

ROUNDS = 50
#: Links in a partition, and partitions at least.
LINKS, LEAST = 50_000, 8


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """edges (a, b), a < b.  large: each node's larger neighbours link to its smallest; else its smaller ones do."""
    spark = edges.sparkSession
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = kept(spark, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts), "low")
        out = both.where("v > u").join(lowest, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        lowest = kept(spark, edges.groupBy("b").agg(F.min("a").alias("m")).coalesce(parts), "low")
        out = edges.join(lowest, "b").select(F.col("m").alias("a"), F.col("a").alias("x"), "b").selectExpr("stack(2, a, x, a, b) as (a, b)")
    return kept(spark, out.where("a < b").coalesce(parts).distinct().coalesce(parts), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link."""
    spark = edges.sparkSession
    now = kept(spark, edges.selectExpr("cast(least(a, b) as bigint) a", "cast(greatest(a, b) as bigint) b").where("a < b").distinct(), "links")
    state, parts = None, LEAST
    for _ in range(ROUNDS):
        found = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if found == state:
            break
        state = found
        parts = max(LEAST, found[0] // LINKS)
        now = _star(_star(now, True, parts), False, parts)
    else:
        raise RuntimeError("links did not settle")
    leaves = now.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    return leaves.unionByName(now.select(F.col("a").alias("node")).distinct().join(leaves.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))).coalesce(parts)
