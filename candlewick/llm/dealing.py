"""Exchanges of packed rows.

Operators that compare substrings or shingles of all documents would shuffle
hundreds of millions of tiny rows.  Instead a task packs, for each of the ``n``
buckets, the columns of everything it sends there into one compressed blob, so an
exchange moves few rows of (bucket, kind, payload) and a bucket's share is one
numpy array on the other side.  A bucket is a partition of the exchange: its
number follows spark.sql.shuffle.partitions, so a bucket's size is bounded by
input / partitions apart from what one key gathers, and keys are pre-aggregated
in the sending tasks.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm import kernels as K

SCHEMA = "bucket int, kind int, payload binary"
ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def deal(frame: DataFrame, n: int) -> DataFrame:
    return frame.repartitionById(n, F.col("bucket"))


def bound(step: Callable, n: int) -> Callable:
    """The step with its number of buckets, under its own name in the plan."""

    @K.released
    @functools.wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return step(batches, n)

    return run


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], schema=ARROW)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of 64-bit keys by their high bits, which hashes kept elsewhere don't use."""
    return ((K.mix(keys.astype(np.uint64)) >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def by_bucket(buckets: np.ndarray, columns: list[np.ndarray], kind: int, pack: Callable[..., bytes] = K.pack_columns) -> list[tuple[int, int, bytes]]:
    """Rows for an exchange; the columns keep their order inside a bucket."""
    if not len(buckets):
        return []
    order = np.argsort(buckets, kind="stable")
    sorted_ = buckets[order]
    cuts = np.flatnonzero(np.diff(sorted_, prepend=-1, append=sorted_[-1] + 1))
    moved = [c[order] for c in columns]
    return [(int(sorted_[a]), kind, pack(*(c[a:b] for c in moved))) for a, b in zip(cuts[:-1], cuts[1:])]


def gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[int, bytes]]]:
    """All rows of a partition: kind -> [(bucket, payload)]."""
    out: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for bucket, kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            out.setdefault(kind, []).append((bucket, payload))
    return out


def columns(found: list[tuple[int, bytes]], *kinds: type) -> list[np.ndarray]:
    """The unpacked columns of several payloads, joined."""
    parts = [K.unpack_columns(p, *kinds) for _, p in found]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds)]


#: Bits of a set of marked rows, whatever the input: with many rows more unmarked ones pass, none that is marked is lost.
MARKS = 1 << 26


def mark(column: str) -> Column:
    """The place of a row among the marks."""
    return F.pmod(F.xxhash64(column), F.lit(MARKS))


def marks(places: DataFrame) -> np.ndarray:
    """Bitmap of the places of doc_id, at most a million words of 64 bits, aggregated before they reach the driver."""
    place = places.select(mark("doc_id").alias("place")) if "place" not in places.columns else places
    found = place.groupBy(F.shiftright("place", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits")).toArrow()
    out = np.zeros(MARKS >> 6, np.uint64)
    out[np.asarray(found["slot"])] = np.asarray(found["bits"]).view(np.uint64)
    return out


def marked(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    place = place.astype(np.uint64)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


TEXTS = 0


class TextPacker:
    """Sends whole texts to the buckets of their doc_id."""

    def __init__(self, n: int, limit: int = 24 << 20, nulls: bool = False):
        self.nulls = nulls
        self.n, self.limit, self.ids, self.parts, self.size = n, limit, [], [], 0

    def add(self, ids: np.ndarray, s: K.TextSlice) -> None:
        self.ids.append(ids)
        self.parts.append((s.buf, np.diff(s.offsets), s.valid))
        self.size += len(s.buf)

    def full(self) -> bool:
        return self.size >= self.limit

    def flush(self) -> list[tuple[int, int, bytes]]:
        if not self.ids:
            return []
        ids = np.concatenate(self.ids)
        sizes = np.concatenate([p[1] for p in self.parts])
        buf = np.concatenate([p[0] for p in self.parts])
        starts = np.cumsum(sizes) - sizes
        shown = np.where(np.concatenate([p[2] for p in self.parts]), sizes, -1) if self.nulls else sizes
        self.ids, self.parts, self.size = [], [], 0
        buckets = bucket_of(ids, self.n)
        order = np.argsort(buckets, kind="stable")
        cuts = np.flatnonzero(np.diff(buckets[order], prepend=-1, append=-1))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = order[a:b]
            out.append((int(buckets[own[0]]), TEXTS, K.pack_columns(ids[own], shown[own], buf[K.spread(starts[own], sizes[own])])))
        return out


def texts(docs: DataFrame, n: int, nulls: bool = False, wanted: np.ndarray | None = None) -> DataFrame:
    """Rows of kind TEXTS with every document's whole text; a null text has no bytes, and size -1 with ``nulls``.

    With ``wanted``, a bitmap by `marks`, only documents that it marks are sent.
    """
    shipped = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = TextPacker(n, nulls=nulls)
        for batch in batches:
            if shipped is not None:
                batch = batch.filter(pa.array(marked(shipped.value, np.asarray(batch.column(2)))))
            ids = K.long_column(batch.column(0))
            for s in K.slices(batch.column(1), 8 << 20):
                packer.add(ids[s.first : s.first + s.n], s)
                if packer.full():
                    yield rows(packer.flush())
        if packer.ids:
            yield rows(packer.flush())

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return (own if wanted is None else own.withColumn("place", mark("doc_id"))).mapInArrow(run, SCHEMA)


def row_names(column: pa.Array, s: K.TextSlice) -> tuple[np.ndarray, np.ndarray]:
    """What orders the rows of a slice: doc_id, null ones last, and among equal ids a hash of the text."""
    own = column.slice(s.first, s.n).cast(pa.int64())
    absent = np.asarray(own.is_null())
    whole = K.SpanHash(K.BYTE_WORDS[s.buf])(s.offsets[:-1], s.offsets[1:])
    return np.asarray(own.fill_null(np.iinfo(np.int64).max)), whole >> np.uint64(1) | absent.astype(np.uint64) << np.uint64(63)


def row_key(doc: np.ndarray, twin: np.ndarray) -> np.ndarray:
    """One key of a row's names; only rows that repeat both id and text share it."""
    return K.mix(doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + K.mix(twin))


def elsewhere(same: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Of sorted groups (``same`` as the one before) those at another place than the group's first; ``moved``: than the one before."""
    steps = np.cumsum(same & moved)
    heads = np.flatnonzero(~same)
    return steps > np.repeat(steps[heads], np.diff(np.append(heads, len(same))))


def repeated(keys: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which keys were met before, here or in ``seen``, which takes them in."""
    out = np.zeros(len(keys), bool)
    for i, k in enumerate(keys.tolist()):
        out[i] = k in seen
        seen.add(k)
    return out


def keyed_texts(docs: DataFrame, n: int, carried: list[str] | None = None) -> DataFrame:
    """Rows of kind TEXTS under the row's key: key, doc_id, whether it is one, size (-1: null text), bytes, other columns."""
    carried = carried or []

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key, doc, valid, sizes, shown, buf = (np.concatenate([h[k] for h in held]) for k in range(6))
            rest = pa.Table.from_batches([h[6] for h in held])
            starts = np.cumsum(sizes) - sizes

            def pack(own: np.ndarray) -> bytes:
                sink = pa.BufferOutputStream()
                if carried:
                    with pa.ipc.new_stream(sink, rest.schema) as out:
                        out.write_table(rest.take(pa.array(own)).combine_chunks())
                return K.pack_columns(key[own], doc[own], valid[own], shown[own], buf[K.spread(starts[own], sizes[own])], np.frombuffer(sink.getvalue(), np.uint8))

            return rows(by_bucket(bucket_of(key, n), [np.arange(len(key))], TEXTS, pack))

        for batch in batches:
            rest = batch.select(list(range(2, batch.num_columns)))
            for s in K.slices(batch.column(1)):
                doc, twin = row_names(batch.column(0), s)
                sizes = np.diff(s.offsets)
                held.append((row_key(doc, twin), doc, twin >> np.uint64(63) == 0, sizes, np.where(s.valid, sizes, -1), s.buf, rest.slice(s.first, s.n)))
                size += len(s.buf)
                if size >= 24 << 20:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *[F.col(c).alias(f"carried_{c}") for c in carried]).mapInArrow(run, SCHEMA)


def read_texts(found: list[tuple[int, bytes]], limit: int | None = None) -> Iterator[tuple[np.ndarray, pa.Array, K.TextSlice, pa.Table | None]]:
    """(keys, doc ids, texts, other columns) of each packed run of texts, or of slices of it of at most ``limit`` bytes."""
    for _, payload in found:
        key, doc, valid, sizes, buf, rest = K.unpack_columns(payload, np.uint64, np.int64, bool, np.int64, np.uint8, np.uint8)
        offsets = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
        ids, others = pa.array(doc, pa.int64(), mask=~valid), pa.ipc.open_stream(rest.tobytes()).read_all() if len(rest) else None
        for s in K.cut(buf, offsets, sizes >= 0, len(buf) if limit is None else limit):
            yield key[s.first : s.first + s.n], ids.slice(s.first, s.n), s, others if others is None else others.slice(s.first, s.n)
