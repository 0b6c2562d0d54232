"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of words with smallest period q and length >= max(``LEAST``, ``TIMES`` * q) that no neighbouring
word extends keeping period q.

For each power of two, every factor (stretch) of that many words gets a name within its text: words by value, longer
factors by the pair of their halves.  A factor that occurs once in its text can't lie in a run of three periods and is
dropped, with all longer ones that hold it.  The successor of an occurrence is the next one of the same name; where
both lie within twice the factor's length, so that the distance is at most the length, occurrences whose distance
stays the same from word to word form arithmetic progressions.  A stretch of starts that makes a progression of three
terms or more proposes its distance as a period.  As no nearer occurrence exists, the proposed period is the smallest
one.  Proposals are extended to both sides as far as words repeat at that distance, and deduplicated over the lengths.
A run with period q is found at the first power of two from q up.

The text of one document is worked on by one task, whatever its length, in arrays of at most some dozen integers for
each of its words; a slice of shorter texts is worked on together.

Words are runs of bytes other than blanks and the controls from tab to carriage return, and are known by 64-bit hashes
within their text.  A null or empty text has no words and no runs.  Every row has one result row, of repeated and null
ids too; an empty table gives an empty result; further columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import kernels as K
from candlewick.llm.session import read

LEAST, TIMES = 6, 4
#: Bytes of texts that are worked on together.
SLICE = 2 << 20


def word_spans(s: K.TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and words before each text."""
    starts, ends = K.runs(~K.SPACE[s.buf], s.offsets)
    return starts, ends, K.by_text(starts, s.offsets)


def ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name of each tuple of keys, and the order that groups equal names and keeps positions in order inside them."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        sorted_ = key[order]
        new[1:] |= sorted_[1:] != sorted_[:-1]
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(new)
    return name, order


def found_runs(words: np.ndarray, before: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start, then period; ``words`` by value, ``before[i]`` words stand before text i."""
    n = len(words)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    first, last = before[:-1][text], before[1:][text]  # of each word's text
    top = int(np.diff(before).max(initial=0)) // times  # no longer period is possible
    at = np.arange(n)
    name, order = ranks(text, words)
    value = name
    size = 1
    proposals = []
    while len(at):
        # successors: neighbours of equal names
        sorted_ = name[order]
        same = sorted_[1:] == sorted_[:-1]
        step = np.zeros(len(at), np.int64)
        step[order[:-1][same]] = at[order[1:][same]] - at[order[:-1][same]]
        near = np.flatnonzero((step > 0) & (step <= size))
        if len(near):
            # stretches of starts with one distance
            p, d = at[near], step[near]
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 1) | (np.diff(d) != 0) | (text[p[1:]] != text[p[:-1]])]))
            begin, end = p[cut], p[np.append(cut[1:], len(p)) - 1]
            # a progression of three terms: a start and the one a period on have the same distance
            keep = end - begin >= d[cut]
            begin, end, d = begin[keep], end[keep], d[cut][keep]
            proposals.append(extended(value, first, last, begin, end + size + d, d))
        if size >= top:
            break
        # only factors that occur again make longer ones
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at, name = at[again], name[again]
        other = np.searchsorted(at, at + size)
        whole = other < len(at)
        whole[whole] = (at[other[whole]] == at[whole] + size) & (text[at[other[whole]]] == text[at[whole]])
        name, order = ranks(name[whole], name[other[whole]])
        at = at[whole]
        size *= 2
    if not proposals:
        return (np.zeros(0, np.int64),) * 3
    start, end, period = (np.concatenate(x) for x in zip(*proposals))
    enough = end - start >= np.maximum(least, times * period)
    found = np.unique(np.stack([start[enough], period[enough], end[enough]], 1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def extended(value: np.ndarray, first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches made longer while the word before repeats a period on, and the word behind a period before."""
    start, end = start.copy(), end.copy()
    low, high = first[start], last[start]
    live = np.arange(len(start))
    while len(live):
        live = live[start[live] > low[live]]
        live = live[value[start[live] - 1] == value[start[live] - 1 + period[live]]]
        start[live] -= 1
    live = np.arange(len(start))
    while len(live):
        live = live[end[live] < high[live]]
        live = live[value[end[live]] == value[end[live] - period[live]]]
        end[live] += 1
    return start, end, period


def planted(n: int, name: str | None) -> np.ndarray:
    """For each of n words the word that stands there: of a tenth of the ids the end of the text becomes periodic."""
    out = np.arange(n)
    h = _crc(name)
    if name is None or h % 10 or not n:
        return out
    g = h // 10
    a = g % n
    out[a:] = a + (out[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return out


def _crc(name: str | None) -> int:
    return zlib.crc32(name.encode()) if name is not None else 0


SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string"
KIND = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("text", pa.string())])


def collapsed(docs: DataFrame, least: int = LEAST, times: int = TIMES, plant: bool = False) -> DataFrame:
    """doc_id, the runs of each text by start, then period, and the text's words joined by one space without those that
    any run holds after its first period.  With ``plant`` texts are altered first, as `planted` says."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(1), SLICE):
                ids = batch.column(0).slice(s.first, s.n)
                starts, ends, before = word_spans(s)
                if plant:
                    own = np.concatenate([np.zeros(0, np.int64)] + [before[i] + planted(int(before[i + 1] - before[i]), None if d is None else str(d)) for i, d in enumerate(ids.to_pylist())])
                    starts, ends = starts[own], ends[own]
                words = K.SpanHash(K.BYTE_WORDS[s.buf])(starts, ends) if len(starts) else np.zeros(0, np.uint64)
                start, end, period = found_runs(words, before, least, times)
                # words behind the first period of any run
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, end, -1)
                kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                # kept words with a space between those of a text
                sizes = ends[kept] - starts[kept]
                cuts = np.searchsorted(kept, before)
                gap = np.ones(len(kept), np.int64)
                gap[cuts[:-1][np.diff(cuts) > 0]] = 0
                stop = np.cumsum(sizes + gap)
                flat = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
                flat[K.spread(stop - sizes, sizes)] = s.buf[K.spread(starts[kept], sizes)]
                at = np.concatenate([[0], stop])[cuts]
                of = np.searchsorted(before, start, "right") - 1
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(s.n + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(start - before[of]), pa.array(end - start), pa.array(period)], names=["start", "length", "period"]))
                texts = pa.StringArray.from_buffers(s.n, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat))
                yield pa.RecordBatch.from_arrays([ids, lists, texts], schema=KIND)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(find, SCHEMA)


def best(runs: list[dict]) -> dict | None:
    """The run of the greatest exact length / period; of equal ones that with the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None)


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digests(found: DataFrame) -> DataFrame:
    """Counts, the best run and digests of `collapsed` rows."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for runs in batch.column(1).to_pylist():
                top = best(runs)
                lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
                out.append((len(runs), *([top["start"], top["length"], top["period"], 1000 * top["length"] // top["period"]] if top else [None] * 4), hashlib.sha256(lines.encode()).hexdigest()))
            columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(5)] + [pa.array([r[5] for r in out], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2)], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return found.select("doc_id", "runs", F.sha2(F.col("text").cast("binary"), 256).alias("name")).mapInArrow(digest, DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(collapsed(read(spark, sf_dir, "documents"), plant=True))
