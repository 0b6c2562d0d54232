"""Importance resampling towards a target distribution, over hashed word features.

Both tables are counted into one array of buckets.  The gain of a bucket is the logarithm of
its smoothed frequency in the target over that in the documents, in thousandths; a document's
weight is the sum of the gains of its features, looked up in the array.  A Gumbel variable made
of a hash of the doc_id is added to the weight, so that the highest scores are a draw without
replacement in proportion to the exponentials of the weights.

The draw finds the k-th score by a distributed quickselect (`ranked.kth`) over composite keys:
score, then doc_id, then a hash of the text, then the row.  Only the rows drawn are sorted and
ranked; the others go straight to the result.

Counts are exact and over all rows; what is broadcast is the array of gains, of fixed size.

A null text has no features.  Every row has one result row: of rows that repeat an id each is
scored, drawn and ranked by itself.  A null doc_id counts as the empty string in the hash and
stands behind the others among equal scores.  Rows of fewer than ``MIN_WORDS`` words are scored
and never drawn.  Null texts of the target hold nothing; an empty target or table gives gains of
smoothed zeros.  Columns other than doc_id and text, of any name, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import kernels as K
from candlewick.llm.ranked import kth, numbered
from candlewick.llm.session import kept, read

BUCKETS, ORDER, SEED = 10_000, 1, 2024
MIN_WORDS, PERCENT = 20, 10
#: Longer features are hashed one by one, shorter ones together, byte by byte.
TOGETHER = 64


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> np.uint32(1) ^ np.uint32(0xEDB88320), out >> np.uint32(1)).astype(np.uint32)
    return out


CRC = _crc_table()


def crc32(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """zlib's crc32 of every span."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, size = starts[order], sizes[order]
    one_by_one = int(np.searchsorted(-size, -TOGETHER, "left"))
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for j in range(int(size[one_by_one]) if one_by_one < len(size) else 0):
        live = slice(one_by_one, int(np.searchsorted(-size, -j, "left")))
        crc[live] = CRC[(crc[live] ^ buf[at[live] + j]) & np.uint32(255)] ^ crc[live] >> np.uint32(8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(one_by_one):
        crc[i] = zlib.crc32(buf[at[i] : at[i] + size[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(s: K.TextSlice, order: int = ORDER) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text; for runs of 1, 2, .. ``order`` words their crc32 and how many stand before each text."""
    starts, ends = K.runs(K.ALNUM[s.buf], s.offsets)
    before = K.by_text(starts, s.offsets)
    words = np.diff(before)
    sizes = ends - starts + 1
    text = np.full(int(sizes.sum()), 32, np.uint8)  # the words, a space behind each
    begin = np.cumsum(sizes) - sizes
    text[K.spread(begin, sizes - 1)] = K.LOWER[s.buf[K.spread(starts, sizes - 1)]]
    out = []
    for run in range(1, order + 1):
        many = np.maximum(words - run + 1, 0)
        first = K.spread(before[:-1], many)
        last = first + run - 1
        out.append((crc32(text, begin[first], begin[last] + sizes[last] - 1), np.concatenate([[0], np.cumsum(many)])))
    return words, out


def histogram(texts: DataFrame, buckets: int, order: int) -> np.ndarray:
    """Features of all texts by bucket; a task sends its sums once."""

    def count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for s in K.slices(batch.column(0)):
                for crc, _ in features(s, order)[1]:
                    sums += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        own = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(sums[own])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(count_buckets, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[np.asarray(found["bucket"])] = np.asarray(found["n"])
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(smoothed share in the target / smoothed share in the documents)) of each bucket."""
    S, T, n = int(documents.sum()), int(target.sum()), len(documents)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(S + n) / (float(s + 1) * float(T + n)))) for s, t in zip(documents.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, order: int) -> DataFrame:
    """doc_id, a hash of the text, words, features, and the sum of their gains."""
    shipped = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shipped.value
        for batch in batches:
            for s in K.slices(batch.column(1)):
                words, runs = features(s, order)
                many, weight = np.zeros(s.n, np.int64), np.zeros(s.n, np.int64)
                for crc, before in runs:
                    sums = np.concatenate([[0], np.cumsum(gain[crc % np.uint32(len(gain))])])
                    many += np.diff(before)
                    weight += sums[before[1:]] - sums[before[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), batch.column(2).slice(s.first, s.n), pa.array(words), pa.array(many), pa.array(weight)], names=["doc_id", "twin", "n_words", "n_features", "weight"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("twin"))
    return own.mapInArrow(weigh, "doc_id long, twin long, n_words long, n_features long, weight long")


def gumbel(seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of the hash of ``seed:doc_id``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score of every row, and the rank from 1 of the ``percent`` of the rows of enough words that are drawn."""
    spark = docs.sparkSession
    gain = gains(histogram(docs, buckets, order), histogram(target, buckets, order))
    scores = weighed(docs, gain, order).withColumn("score", F.col("weight") + gumbel(seed)).withColumn("row", F.monotonically_increasing_id())
    key = F.struct((-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("int").alias("absent"), F.coalesce("doc_id", F.lit(0)).alias("doc"), "twin", "row")
    table = kept(spark, scores.select("doc_id", "n_features", "weight", "score", (F.col("n_words") >= min_words).alias("enough"), key.alias("key")), "scores")
    able = table.where("enough")
    last = kth(able, able.count() * percent // 100, seed)
    shown = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return table.select(*shown, F.lit(None).cast("bigint").alias("rank"))
    drawn = F.col("enough") & (F.col("key") <= last)
    ranked = numbered(table.where(drawn).select(*shown, "key"), [F.col("key")], "drawn")
    return ranked.select(*shown, (F.col("index") + 1).alias("rank")).unionByName(table.where(~drawn).select(*shown, F.lit(None).cast("bigint").alias("rank")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = r"""
with recursive step as (
  select i, i::bigint c, 0 k from range(256) t(i)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from step where k < 8),
crc as (select list(c order by i) tab from step where k = 8),
docs as (
  select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
goal as (
  select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
d as (select r, w, count(*) n from (select r, unnest(ws) w from docs) group by r, w),
g as (select w, count(*) n from (select unnest(ws) w from goal) group by w),
words as (
  select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 bucket
  from (select w from d union select w from g), crc),
s as (select bucket, sum(n)::double s from d join words using (w) group by bucket),
t as (select bucket, sum(n)::double t from g join words using (w) group by bucket),
gain as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (coalesce((select sum(s) from s), 0) + 10000) / ((coalesce(s, 0) + 1) * (coalesce((select sum(t) from t), 0) + 10000))))::bigint gain
  from s full join t using (bucket)),
weight as (select r, sum(n * gain)::bigint weight from d join words using (w) join gain using (bucket) group by r),
scored as (
  select r, doc_id, len(ws)::bigint n_features, coalesce(weight, 0) weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296))))::bigint score
  from docs left join weight using (r)),
able as (select r, row_number() over (order by score desc, doc_id nulls last) place from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= (select count(*) from able) * 10 // 100 then place end rank
from scored left join able using (r)
"""
