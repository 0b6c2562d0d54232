"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into blocks of 128 bytes; a chunk is two neighbouring blocks, so chunks
overlap by half and cover the whole document, of whatever length.  Filters with learned
weights for each byte at each of eight offsets slide over the text in steps of four; each
filter's maximum over a chunk passes a rectifier, and a learned head turns the maxima of
a chunk into a probability.  Those of all chunks are combined into one, their mean.

Training uses at most ``SAMPLE`` labelled rows that are not held out, chosen by a hash of
their ids, of ``SAMPLE_BYTES`` together; both bounds hold before texts leave the
executors.  It runs on the driver; the network has a fixed size.  Scoring reads every
whole text once, without an exchange.  Null and empty texts are one empty block and have
a score like any other.  Every row has one result row, repeated and null ids too; an
empty table gives an empty result, and further columns of any name are ignored, in
`stage` kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import kernels as K
from candlewick.llm.folds import held_out, sample
from candlewick.llm.session import read

SAMPLE, SAMPLE_BYTES = 3000, 16 << 20
BLOCK, STEP, TAPS, FILTERS = 128, 4, 8, 12
EPOCHS, BATCH, RATE, DECAY = 14, 64, 0.02, 1e-4
THRESHOLD = 0.3


@dataclass
class Network:
    taps: np.ndarray  # (TAPS, 256, FILTERS): weight of each byte at each offset
    bias: np.ndarray  # (FILTERS,)
    head: np.ndarray  # (FILTERS + 1,): weights of a chunk's maxima, and the intercept


def padded(s: K.TextSlice) -> tuple[np.ndarray, np.ndarray]:
    """Texts at block borders, each followed by an empty block; first block of each text."""
    sizes = np.diff(s.offsets)
    blocks = np.maximum(1, -(-sizes // BLOCK)) + 1
    first = np.zeros(s.n + 1, np.int64)
    np.cumsum(blocks, out=first[1:])
    out = np.zeros(int(first[-1]) * BLOCK, np.uint8)
    out[K.spread(first[:-1] * BLOCK, sizes)] = s.buf
    return out, first


def responses(net: Network, text: np.ndarray) -> np.ndarray:
    """(positions, FILTERS) before the rectifier."""
    n = len(text) // STEP
    wide = np.concatenate([text, np.zeros(TAPS, np.uint8)])
    out = np.tile(net.bias, (n, 1))
    for j in range(TAPS):
        out += net.taps[j].take(wide[j : j + n * STEP : STEP], axis=0)
    return out


@dataclass
class Pass:
    """A forward pass over padded texts."""

    blocks: np.ndarray  # responses by block
    at: np.ndarray  # first and second block of each chunk
    pair: np.ndarray
    before: np.ndarray  # chunks before each text
    maxima: np.ndarray  # rectified, of each chunk
    chunk: np.ndarray  # probability of each chunk
    text: np.ndarray  # probability of each text


def forward(net: Network, text: np.ndarray, first: np.ndarray) -> Pass:
    blocks = responses(net, text).reshape(-1, BLOCK // STEP, FILTERS)
    top = blocks.max(1)
    own = np.diff(first) - 1
    chunks = np.maximum(1, own - 1)
    before = np.zeros(len(own) + 1, np.int64)
    np.cumsum(chunks, out=before[1:])
    at = K.spread(first[:-1], chunks)
    pair = np.where(np.repeat(own, chunks) > 1, at + 1, at)
    maxima = np.maximum(np.maximum(top[at], top[pair]), 0)
    chunk = 1 / (1 + np.exp(-np.clip(maxima @ net.head[:-1] + net.head[-1], -30, 30)))
    return Pass(blocks, at, pair, before, maxima, chunk, np.add.reduceat(chunk, before[:-1]) / chunks)


def scores(net: Network, s: K.TextSlice) -> np.ndarray:
    return forward(net, *padded(s)).text


def gradients(net: Network, text: np.ndarray, first: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss, for taps, bias and head; positions that win a chunk's maximum get its gradient."""
    run = forward(net, text, first)
    p = np.clip(run.text, 1e-4, 1 - 1e-4)
    chunks = np.diff(run.before)
    outer = (p - y) / (p * (1 - p)) / len(y) / chunks
    step = np.repeat(outer, chunks) * run.chunk * (1 - run.chunk)
    head = np.append(run.maxima.T @ step, step.sum())
    back = step[:, None] * net.head[:-1] * (run.maxima > 0)
    # the winning position of each chunk and filter
    arg, top = run.blocks.argmax(1), run.blocks.max(1)
    f = np.broadcast_to(np.arange(FILTERS), back.shape)
    second = top[run.pair] > top[run.at]
    place = np.where(second, run.pair[:, None] * (BLOCK // STEP) + arg[run.pair], run.at[:, None] * (BLOCK // STEP) + arg[run.at])
    live = back != 0
    place, f, back = place[live], f[live], back[live]
    wide = np.concatenate([text, np.zeros(TAPS, np.uint8)])
    taps = [np.bincount(wide[place * STEP + j].astype(np.int64) * FILTERS + f, back, 256 * FILTERS).reshape(256, FILTERS) for j in range(TAPS)]
    return [np.stack(taps), np.bincount(f, back, FILTERS), head]


def train(rows: list[tuple[int, str, int]], seed: int = 7) -> Network:
    """Gradient descent with momentum estimates (Adam) on the log loss and a small penalty of the weights."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.1, (TAPS, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.append(rng.normal(0, 0.3, FILTERS), 0.0))
    if not rows:
        return net
    y = np.array([r[2] for r in rows], float)
    rate = min(max(y.mean(), 0.01), 0.99)
    net.head[-1] = np.log(rate / (1 - rate))
    texts = [r[1].encode() for r in rows]
    weights = [net.taps, net.bias, net.head]
    m, v = [np.zeros(w.shape) for w in weights], [np.zeros(w.shape) for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            buf, offsets, valid = K.text_column(pa.array([texts[i] for i in pick], pa.binary()))
            grads = gradients(net, *padded(K.TextSlice(0, buf, offsets, valid)), y[pick])
            grads[0] += DECAY * net.taps
            grads[2] += DECAY * net.head
            step += 1
            pace = RATE * min(1.0, 2 * (1 - epoch / EPOCHS))
            for i, w in enumerate(weights):
                m[i] = 0.9 * m[i] + 0.1 * grads[i]
                v[i] = 0.999 * v[i] + 0.001 * grads[i] ** 2
                w -= (pace * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(w.dtype)
    return net


def scored(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(1)):
                p = scores(shipped.value, s)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    done = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return done.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def fitted(spark: SparkSession, sf_dir: str) -> Network:
    return train(sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "quality", SAMPLE, SAMPLE_BYTES))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"), fitted(spark, sf_dir))


def stage(docs: DataFrame, net: Network) -> DataFrame:
    """docs without those that the classifier rejects, in one pass over them."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(at)):
                keep = pa.array(scores(shipped.value, s) >= THRESHOLD)
                yield batch.slice(s.first, s.n).filter(keep)

    return docs.mapInArrow(run, docs.schema)
