"""Packing: documents become sequences of at most ``CAPACITY`` tokens with little padding.

A document's ids, with the end id behind them, are cut into pieces of ``CAPACITY`` and a rest.  Pieces are packed
shortest-pack-first over the histogram of their lengths: lengths are placed from the longest down, each on the packs
that are shortest so far, as long as it fits there.  What is placed are counts: a pattern (a tuple of lengths) stands
for all packs that hold these lengths, so the plan's size depends on ``CAPACITY`` alone, not on the documents.  A step
either uses up a length or a pattern.  Patterns are joined back to pieces by rank: pieces are sorted by length over
the cluster and numbered (`ranked.numbered`), and each slot of a pattern owns a range of the numbers.

The driver sees the histogram, at most ``CAPACITY`` counts; the segments of the plan are broadcast.  No key is a
length or a document, so a length that a third of all pieces share is dealt over as many ranges as its rows ask for.

Ids are those of the `tokenizers` library.  It is asked once for each distinct piece that its pre-tokenizer's pattern
cuts (`byte_bpe.Pieces`); a worker knows pieces by 64-bit hashes.  Special tokens' strings are ordinary text.  A null
text is an empty one and has the end id alone.  Every row has its own pieces, of repeated and null ids too; texts of
any length are encoded whole; an empty table gives an empty result; further columns of any name are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from candlewick.llm import kernels as K
from candlewick.llm.byte_bpe import Pieces
from candlewick.llm.ranked import numbered
from candlewick.llm.session import kept, read

TOKENIZER_FILE = "byte_bpe_50k.json"
CAPACITY, END = 1024, 0
#: Distinct pieces that a worker keeps between slices, at most; beyond that the rarer half is forgotten.
KNOWN = 1_000_000
#: Pieces that the library is asked for together: what it returns takes far more room than the ids.
AT_ONCE = 10_000
#: Bytes of text cut and encoded together.
SLICE = 2 << 20


class Encoder:
    """Ids by a tokenizer of the library, each distinct piece of text encoded once.

    Known pieces are sorted arrays: name, how often met, where its ids begin, how many they are.
    """

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.pieces = Pieces()
        self.names, self.met = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.many, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __call__(self, s: K.TextSlice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the slice, and ids before each text."""
        bounds, before = self.pieces(s)
        if len(bounds) < 2:
            return np.zeros(0, np.uint32), np.zeros(s.n + 1, np.int64)
        names = K.SpanHash(K.BYTE_WORDS[s.buf])(bounds[:-1], bounds[1:])
        unique, first, inverse, met = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.names, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.names)
        new[inside] = self.names[at[inside]] != unique[inside]
        self.met[at[~new]] += met[~new]
        if new.any():
            self._learn(unique[new], met[new], bounds[first[new]], bounds[first[new] + 1], s.buf)
            at = np.searchsorted(self.names, unique)
        many = self.many[at][inverse]
        ids = self.flat[K.spread(self.begin[at][inverse], many)]
        if len(self.names) > KNOWN:
            self._keep(np.sort(np.argsort(-self.met, kind="stable")[: KNOWN // 2]))
        return ids, np.concatenate([[0], np.cumsum(many)])[before]

    def _learn(self, names: np.ndarray, met: np.ndarray, starts: np.ndarray, ends: np.ndarray, buf: np.ndarray) -> None:
        raw = buf.tobytes()
        sizes, flat = [], [self.flat]
        for at in range(0, len(names), AT_ONCE):
            texts = [raw[a:b].decode() for a, b in zip(starts[at : at + AT_ONCE].tolist(), ends[at : at + AT_ONCE].tolist())]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[-1].sum())))
        many = np.concatenate(sizes)
        begin = len(self.flat) + np.cumsum(many) - many
        self.flat = np.concatenate(flat)
        order = np.argsort(all_names := np.concatenate([self.names, names]), kind="stable")
        self.names = all_names[order]
        self.met, self.begin, self.many = (np.concatenate(x)[order] for x in ((self.met, met), (self.begin, begin), (self.many, many)))

    def _keep(self, own: np.ndarray) -> None:
        """Forget all other pieces."""
        self.flat = self.flat[K.spread(self.begin[own], self.many[own])]
        self.names, self.met, self.many = self.names[own], self.met[own], self.many[own]
        self.begin = np.cumsum(self.many) - self.many


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(definition: str) -> Encoder:
    if definition not in _ENCODERS:
        _ENCODERS[definition] = Encoder(definition)
    return _ENCODERS[definition]


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of every document: where they start, their length and ids (little-endian unsigned 32-bit), the document's tokens."""
    shipped = docs.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(shipped.value)
        for batch in batches:
            for s in K.slices(batch.column(1), SLICE):
                ids, before = encode(s)
                before = before + np.arange(s.n + 1)  # each document's ids and the end id
                flat = np.full(int(before[-1]), end, "<u4")
                own = np.ones(len(flat), bool)
                own[before[1:] - 1] = False
                flat[own] = ids
                tokens = np.diff(before)
                many = -(-tokens // capacity)
                of = np.repeat(np.arange(s.n), many)
                start = (K.spread(np.zeros(s.n, np.int64), many)) * capacity
                length = np.minimum(capacity, tokens[of] - start)
                at = np.concatenate([[0], np.cumsum(length)])
                blobs = pa.BinaryArray.from_buffers(pa.binary(), len(of), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n).take(pa.array(of)), pa.array(start), pa.array(length), pa.array(tokens[of]), blobs], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, how many packs hold these), for so many pieces of each length."""
    packs: list[tuple[int, tuple[int, ...], int]] = []  # a heap by the length so far
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if packs and packs[0][0] + length <= capacity:
                total, lengths, many = heapq.heappop(packs)
                used = min(left, many)
                if many > used:
                    heapq.heappush(packs, (total, lengths, many - used))
                heapq.heappush(packs, (total + length, (*lengths, length), used))
                left -= used
            else:  # on no pack: on new ones, each of which is the shortest until it is full
                full, rest = divmod(left, capacity // length)
                for lengths, many in (((length,) * (capacity // length), full), ((length,) * rest, 1)):
                    if lengths and many:
                        heapq.heappush(packs, (length * len(lengths), lengths, many))
                left = 0
    return [(lengths, many) for _, lengths, many in sorted(packs)]


def segments(packs: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (first number, first sequence, offset) over pieces numbered by length: each slot of a pattern owns a range."""
    slots, sequence = [], 0
    for lengths, many in packs:
        offset = 0
        for length in lengths:
            slots.append((length, sequence, offset, many))
            offset += length
        sequence += many
    slots.sort()
    first = np.concatenate([[0], np.cumsum([s[3] for s in slots])])[:-1] if slots else np.zeros(0, np.int64)
    return np.array([(f, s[1], s[2]) for f, s in zip(first.tolist(), slots)], np.int64).reshape(-1, 3)


def placed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found``, one row a piece with its ``length`` and any further columns, with sequence_id and offset."""
    spark = found.sparkSession
    table = kept(spark, found.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}
    shipped = spark.sparkContext.broadcast(segments(shortest_pack_first(histogram, capacity)))
    sorted_ = numbered(table, [F.col("length"), F.col("piece")], "packed")
    shown = sorted_.select(*found.columns, "index")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sequence, offset = shipped.value.T
        for batch in batches:
            index = np.asarray(batch.column(batch.num_columns - 1))
            own = np.searchsorted(first, index, "right") - 1
            columns = [batch.column(k) for k in range(batch.num_columns - 1)] + [pa.array(sequence[own] + index - first[own]), pa.array(offset[own])]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return shown.mapInArrow(place, T.StructType([*found.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_FILE))
    return placed(found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
