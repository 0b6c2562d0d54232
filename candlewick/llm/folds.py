"""Training and held-out rows, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def training_labels(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, y) of the rows that may be learned from; of repeated rows the largest label counts."""
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(name).cast("int").alias("y"))
    return own.where(~held_out()).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))


def sample(docs: DataFrame, labels: DataFrame, name: str, rows: int, size: int) -> list[tuple[int, str, int]]:
    """At most ``rows`` labelled training documents of ``size`` bytes together, by a hash of their ids: (doc_id, text, label).

    First only ids and lengths reach the driver, then the texts that fit; one that no longer fits is passed over, not
    those after it, and if none fits the shortest is taken.  Of rows that repeat an id one counts.  The sample of labels
    has a fixed bound, so it is broadcast to the documents.
    """
    chosen = training_labels(labels, name).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("twin", F.xxhash64("text"))
    about = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("twin", F.octet_length("text").alias("size"))).alias("t"))
    found = about.select("doc_id", "t.twin", "t.size").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    total, fit = 0, []
    for r in found:
        if total + r["size"] <= size:
            total += r["size"]
            fit.append(r)
    fit = fit or sorted(found, key=lambda r: r["size"])[:1]
    picked = docs.sparkSession.createDataFrame([(r["doc_id"], r["twin"]) for r in fit], "doc_id long, twin long").join(chosen, "doc_id")
    return sorted({(r["doc_id"], r["text"], r["y"]) for r in own.join(F.broadcast(picked), ["doc_id", "twin"]).collect()})
