"""Toxicity: class-conditional Kneser-Ney models of words.

Two models, one of toxic and one of ordinary training documents, share their backoff.  With
c(w) the documents of a class that hold word w and m(w) the different words that w follows in
both classes together,

    q(w) = (c(w) - D(c(w)) + s(w) * sum over x of D(c(x))) / sum c
    s(w) = m(w) / sum m

The order of a class counts what occurs, once a document, so that no long document speaks for
its class; what its discounts take is given back through s, which counts continuations as Kneser
and Ney have it.  So an expression that is rare in one class is smoothed by the counts both
share.  D(1), D(2) and D(3 and more) come from each class's own counts of counts (Chen and
Goodman's estimate).  A conditional order above q was tried and left out (README).

A toxic text is ordinary prose with toxic expressions in it, so its likelihood is a mixture of
the two: a word has (1 - SHARE) * q(w, ordinary) + SHARE * q(w, toxic).  The score compares the
log-likelihoods of the whole text by their difference for a word: every occurrence of every word
counts, log(1 + SHARE * (q(w, toxic) / q(w, ordinary) - 1)); words in no training text have
the same likelihood in both.  A logistic function turns the log of that evidence (from 0 for none)
into a score.  It is fitted on at most ``SAMPLE`` labelled rows of a quarter of the training rows,
which the models don't count; toxic ones weigh ``TOXIC`` times as much there.

All other training rows count, however many, and no table is cut.  Pairs of words are exchanged
packed, pre-aggregated in the sending tasks, those of one word to ``SALT`` places.  The counts of
all words stay a distributed table, and only sums over it reach the driver.  The ``COMMON`` most
frequent words of it travel to the documents as a table of fixed size; documents ask for all
others, which a bitmap of fixed size marks, by a join, so no key of the join is a common word.

Words are runs of letters, digits and non-ASCII characters, lower-cased for A-Z.  Null, empty and
wordless texts get the score of no evidence.  Every row has one result row: repeated ids and null
ids too.  Without labels of both classes the score is that of no evidence.  Empty tables give
empty results, and further columns of any name are ignored.  Labels, language, source and doc_id
are no inputs of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import kernels as K
from candlewick.llm.dealing import MARKS, SCHEMA, bucket_of, by_bucket, deal, gathered, mark, marked, marks, rows
from candlewick.llm.folds import held_out, training_labels
from candlewick.llm.session import kept, most, read, width

#: Rows for the coefficients, at most, and the fold (of 0 to 4; 0 is held out) that they come from.
SAMPLE, CALIBRATION = 2000, 4
#: Of a toxic text's words, the share that its own model speaks for; what a toxic row weighs in the fit of the coefficients.
SHARE, TOXIC = 0.01, 4.0
#: Words whose weights travel as a table, about; places that share a word's predecessors.
COMMON, SALT = 1 << 18, 16
#: Words that a task holds before it aggregates and sends them.
FLUSH = 1_000_000
PAIRS, HELD = 1, 2
#: Stands before the first word of a text.
START = np.uint64(0x1D8E4E27C47D124F)
ODD = np.uint64(0x9FB21C651E98DF25)


def words(s: K.TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every word of each text: its hash, that of its predecessor, and words before each text."""
    starts, ends = K.runs(K.ALNUM[s.buf], s.offsets)
    h = K.SpanHash(K.BYTE_WORDS[K.LOWER[s.buf]])(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    before = K.by_text(starts, s.offsets)
    prev = np.empty_like(h)
    prev[1:] = h[:-1]
    prev[before[:-1][np.diff(before) > 0]] = START
    return h, prev, before


def pack_pairs(word: np.ndarray, before: np.ndarray) -> bytes:
    order = np.lexsort((before, word))
    return K.pack_columns(K.deltas(word[order]), before[order])


def unpack_pairs(found: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    parts = [K.unpack_columns(p, np.uint64, np.uint64) for _, p in found]
    return np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), np.concatenate([p[1] for p in parts])


def send_words(labelled: DataFrame, n: int) -> DataFrame:
    """Of a task's training documents (text, y): the different word pairs, and of each word the documents of each class that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            prev, word, inside, toxic = (np.concatenate([h[k] for h in held]) for k in range(4))
            _, first = np.unique(K.mix(prev * ODD + word), return_index=True)
            own, before = word[first], prev[first]
            place = bucket_of(own + (K.mix(before) % np.uint64(SALT)) * ODD, n)
            names, at = np.unique(inside, return_inverse=True)
            count = [np.bincount(at[toxic == y], minlength=len(names)).astype(np.uint32) for y in (0, 1)]
            return rows(by_bucket(place, [own, before], PAIRS, pack_pairs) + by_bucket(bucket_of(names, n), [names, *count], HELD, lambda w, *c: K.pack_columns(K.deltas(w), *c)))

        for batch in batches:
            y = np.asarray(batch.column(1).cast(pa.int64()))
            for s in K.slices(batch.column(0)):
                h, prev, before = words(s)
                text = np.repeat(np.arange(s.n), np.diff(before))
                _, first = np.unique(K.mix(h + K.mix(text.astype(np.uint64))), return_index=True)
                held.append((prev, h, h[first], y[s.first + text[first]]))
                size += len(h)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return labelled.select("text", "y").mapInArrow(run, SCHEMA)


COUNTS = "word long, n0 long, n1 long, m long"


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the words of a bucket: documents with it, of each class, and different pairs that meet here; sums of them are whole."""
    got = gathered(batches)

    def answer(word: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in sums)], names=["word", "n0", "n1", "m"])

    if PAIRS in got:
        word, before = unpack_pairs(got.pop(PAIRS))
        order = np.lexsort((before, word))
        word, before = word[order], before[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (before[1:] != before[:-1])
        names, m = np.unique(word[new], return_counts=True)
        yield answer(names, np.zeros(len(names)), np.zeros(len(names)), m)
    if HELD in got:
        parts = [K.unpack_columns(p, np.uint64, np.uint32, np.uint32) for _, p in got.pop(HELD)]
        names, at = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)
        yield answer(names, *(np.bincount(at, np.concatenate([p[k] for p in parts]), len(names)) for k in (1, 2)), np.zeros(len(names)))


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(word, n0, n1, m) over the documents with a label in ``labels`` (doc_id, y); only their texts are exchanged."""
    spark = docs.sparkSession
    n, shipped = width(spark), spark.sparkContext.broadcast(marks(labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(shipped.value, np.asarray(batch.column(2)))))

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null").withColumn("place", mark("doc_id"))
    # labels grow with the documents: the same join at every size, and one Python worker for a task
    labelled = own.mapInArrow(run, own.schema).drop("place").join(labels.hint("merge"), "doc_id")
    found = deal(send_words(labelled, n), n).mapInArrow(count, COUNTS)
    return kept(spark, found.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "m")]), "words")


def discounts(many: list[int]) -> list[float]:
    """D(1), D(2), D(3 and more) from how many words have counts of 1, 2, 3 and 4; half the count where there are none of it."""
    y = many[0] / max(many[0] + 2 * many[1], 1)
    return [min(max(k - (k + 1) * y * many[k] / many[k - 1], 0.1), k) if many[k - 1] else k / 2 for k in (1, 2, 3)]


def weighed(table: DataFrame) -> DataFrame:
    """(word, times, weight): documents with each word, and the log-likelihoods' difference; from sums over all words."""
    classes = ("n0", "n1")
    ones = [F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in classes for k in range(1, 5)]
    total = table.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*classes, "m")], *ones).first()
    if not min(total["n0"], total["n1"]):
        return table.select("word", F.lit(0).cast("long").alias("times"), F.lit(0.0).alias("weight")).limit(0)
    own = {c: discounts([total[f"{c}_{k}"] for k in range(1, 5)]) for c in classes}
    taken = {c: F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, own[c][0]).when(F.col(c) == 2, own[c][1]).otherwise(own[c][2]) for c in classes}
    back = table.agg(*[F.sum(taken[c]).alias(c) for c in classes]).first()
    q = [(F.col(c) - taken[c] + F.col("m") / total["m"] * back[c]) / total[c] for c in classes]
    return table.select("word", (F.col("n0") + F.col("n1")).alias("times"), F.log1p(SHARE * (q[1] / q[0] - 1)).alias("weight"))


def common(weights: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """About COMMON of the most frequent words, sorted, with their weights; which ones only decides how words travel."""
    found = most(weights, "word", "times", COMMON).select("word", "weight").toArrow()
    word = np.asarray(found["word"]).view(np.uint64)
    order = np.argsort(word)
    return word[order], np.asarray(found["weight"])[order]


def evidence(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, evidence) of every row: the mean of its words' weights, over every occurrence."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((marks(weights.select(F.col("word").bitwiseAND(MARKS - 1).alias("place"))), *common(weights)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, table, weight = shipped.value
        for batch in batches:
            for s in K.slices(batch.column(1)):
                h, _, before = words(s)
                at = np.minimum(np.searchsorted(table, h), max(len(table) - 1, 0))
                known = table[at] == h if len(table) else np.zeros(len(h), bool)
                sums = np.concatenate([[0.0], np.cumsum(weight[at] * known if len(table) else np.zeros(len(h)))])
                rest = np.flatnonzero(~known & marked(bitmap, h & np.uint64(MARKS - 1)))
                offsets = pa.array(np.searchsorted(rest, before).astype(np.int32))
                asked = pa.ListArray.from_arrays(offsets, pa.array(h[rest].view(np.int64)))
                cells = [batch.column(0).slice(s.first, s.n), pa.array(np.diff(before).astype(np.int64)), pa.array(np.diff(sums[before])), asked]
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "words", "part", "asked"])

    every = kept(spark, docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, words long, part double, asked array<long>"), "asked")
    every = every.withColumn("row", F.monotonically_increasing_id())
    asked = every.select("row", F.explode("asked").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    met = asked.join(weights.select("word", "weight"), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("weight")).alias("sum"))
    whole = every.select("row", "doc_id", "words", "part").join(met, "row", "left")
    return kept(spark, whole.select("doc_id", ((F.col("part") + F.coalesce("sum", F.lit(0.0))) / F.greatest("words", F.lit(1))).alias("evidence")), "evidence")


def scale(evidence_: str) -> Column:
    """The log of the evidence above the least that a mixture allows: 0 for none, at least that of a hundredth."""
    least = -math.log1p(-SHARE)
    return F.log(F.greatest(F.col(evidence_) + least, F.lit(least / 100)) / least)


def calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Factor and intercept of the scaled evidence by Newton steps on the penalised log loss, toxic rows weighing TOXIC."""
    weights = np.array([4.0, -1.0])
    if len(y) and 0 < y.mean() < 1 and x.std() > 0:
        scale = np.array([x.std(), 1.0])
        x = np.stack([x, np.ones(len(x))], 1) / scale
        weights = np.zeros(2)
        ridge, heavy = np.array([1e-3, 1e-6]), np.where(y == 1, TOXIC, 1.0)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            g = x.T @ (heavy * (p - y)) / len(y) + ridge * weights
            hess = (x * (heavy * p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge)
            step = np.linalg.solve(hess, g)
            weights = weights - step * min(1.0, 10 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-8:
                break
        weights = weights / scale
    return weights


@dataclass
class Fitted:
    docs: DataFrame
    weights: DataFrame  # of words
    found: DataFrame  # the evidence of docs
    coefficients: np.ndarray


def fitted(docs: DataFrame, labels: DataFrame) -> Fitted:
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    chosen = training_labels(labels.where(fold == CALIBRATION), "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # all others are counted, those of the fold that the sample has no room for too
    own = training_labels(labels, "toxic").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    weights = kept(spark, weighed(counted(docs, kept(spark, own, "counted"))), "weights")
    found = evidence(docs, weights)
    # equal ids may repeat: as many rows as the sample has
    fit = found.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.max("evidence").alias("evidence")).select(scale("evidence").alias("evidence"), "y").toArrow()
    return Fitted(docs, weights, found, calibrated(np.asarray(fit["evidence"]), np.asarray(fit["y"]).astype(float)))


def scored(docs: DataFrame, model: Fitted) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    factor, intercept = map(float, model.coefficients)
    found = model.found if docs is model.docs else evidence(docs, model.weights)
    score = 1 / (1 + F.exp(-(scale("evidence") * factor + intercept)))
    return found.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, read(spark, sf_dir, "labels")))
