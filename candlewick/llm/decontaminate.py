"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every window of ten consecutive item words (or a whole shorter item) is a
pattern over normalised text: ASCII letters in lower case, each run of
non-word bytes one blank, a blank at either end.  A pattern keeps its framing
blanks, so an occurrence is always one of whole words.

Patterns of similar length share a search.  Its shift table gives, for the
block of bytes under the end of the search window, how far the window can move
without passing an occurrence; only where the shift is zero do the last eight bytes
of the window select the bucket of patterns whose first ``m`` bytes end alike, and
bytes are then compared directly.  The search advances thousands of
windows over a slice of the text at once, each in its own lane.

A benchmark of more than ``PASS_BYTES`` is searched in passes: items are dealt by hash into parts of
about half of that, each part is searched for in all documents, and the hits of the parts are
merged by document.  Results are the same however many passes there are.

Nulls and texts without words have no hits; null or wordless items no windows.  Items that repeat a
window all count it, and rows that repeat an item_id are one item.  Rows without an item_id are no
items.  Every row of the documents has one result row, of repeated and null ids too.  Empty tables
give no rows, or rows without hits; further columns of any name are ignored, and `stage` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import kernels as K
from candlewick.llm.session import read

WINDOW = 10
#: Bytes of benchmark text that a pass may broadcast.
PASS_BYTES = 16 << 20
BLOCK = 3
HASH_BITS = 16
LANE = 512


def normalised(s: K.TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of ``' w1 w2 ... wn '`` text after text, the word starts in them, words before each text, text starts.

    A text without words has no bytes.
    """
    flags = K.ALNUM[s.buf]
    starts, ends = K.runs(flags, s.offsets)
    counts = np.diff(K.by_text(starts, s.offsets))
    sizes = ends - starts
    # one blank before every word and one more after the last word of each text
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    lead = np.ones(len(starts), np.int64)
    heads = first[:-1][(counts > 0)]
    extra = np.zeros(len(starts), np.int64)
    extra[heads] = 1
    extra[:1] = 0
    place = np.cumsum(sizes + lead + extra) - sizes
    total = int(place[-1] + sizes[-1] + 1) if len(starts) else 0
    out = np.full(total, 32, np.uint8)
    out[K.spread(place, sizes)] = K.LOWER[s.buf[flags]]
    return out, place, first, counts


class Search:
    """One Wu-Manber search: patterns at least ``m`` bytes long, by their first ``m`` bytes."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = min(BLOCK, self.m)
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(-1, self.m)
        far = self.m - self.block + 1
        self.shift = np.full(1 << HASH_BITS, far, np.int32)
        for at in range(far):
            codes = self._codes(heads, at + self.block)
            np.minimum.at(self.shift, codes, far - 1 - at)
        # buckets by the last bytes of the heads, up to eight as one word
        self.tail = min(8, self.m)
        words = self._words(heads[:, self.m - self.tail :].T)
        self.order = np.argsort(words, kind="stable")
        self.buckets = words[self.order]
        self.flat = np.frombuffer(b"".join(patterns), np.uint8)
        sizes = np.array([len(p) for p in patterns], np.int64)
        self.sizes = sizes
        self.begin = np.cumsum(sizes) - sizes

    def _codes(self, rows: np.ndarray, end: int) -> np.ndarray:
        code = np.zeros(len(rows), np.uint32)
        for k in range(self.block):
            code = code * np.uint32(0x01000193) ^ rows[:, end - self.block + k]
        return (code ^ (code >> np.uint32(15))) & np.uint32((1 << HASH_BITS) - 1)

    def _at(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        code = np.zeros(len(ends), np.uint32)
        for k in range(self.block):
            code = code * np.uint32(0x01000193) ^ text[ends - self.block + k]
        return (code ^ (code >> np.uint32(15))) & np.uint32((1 << HASH_BITS) - 1)

    def _words(self, columns) -> np.ndarray:
        out = np.uint64(0)
        for c in columns:
            out = out << np.uint64(8) | c.astype(np.uint64)
        return out

    def candidates(self, text: np.ndarray) -> np.ndarray:
        """Starts of windows with shift zero."""
        n = len(text)
        if n < self.m:
            return np.zeros(0, np.int64)
        at = np.arange(self.m, n + 1, LANE, dtype=np.int64)
        stop = np.minimum(at + LANE, n + 1)
        found = []
        while len(at):
            code = self._at(text, at)
            step = self.shift[code]
            hit = step == 0
            if hit.any():
                found.append(at[hit] - self.m)
                step = np.where(hit, 1, step)
            at = at + step
            live = at < stop
            at, stop = at[live], stop[live]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of every occurrence."""
        starts = self.candidates(text)
        starts = starts[text[starts] == 32]
        ends = starts + self.m
        words = self._words(text[ends - k] for k in range(self.tail, 0, -1)) if len(starts) else np.zeros(0, np.uint64)
        first = np.searchsorted(self.buckets, words, "left")
        many = np.searchsorted(self.buckets, words, "right") - first
        where = np.repeat(starts, many)
        which = self.order[K.spread(first, many)]
        fits = where + self.sizes[which] <= len(text)
        where, which = where[fits], which[fits]
        # direct comparison, a few bytes of all pairs at a time, pairs that differ leave at once
        alive = np.arange(len(where))
        done = 0
        while len(alive):
            sizes = self.sizes[which[alive]]
            rest = sizes > done
            if not rest.any():
                break
            ok = np.ones(len(alive), bool)
            for k in range(done, done + 4):
                live = sizes > k
                ok[live] &= text[where[alive[live]] + k] == self.flat[self.begin[which[alive[live]]] + k]
            alive = alive[ok]
            done += 4
        return where[alive], which[alive]


class Benchmark:
    """Windows of the items, grouped into searches by length class."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        owners: dict[tuple[bytes, int], set[int]] = {}
        texts = pa.array([t for _, t in items], pa.string())
        for s in K.slices(texts):
            for i in range(s.n):
                words = self.words(s.text(i))
                runs = [words] if 0 < len(words) < window else [words[k : k + window] for k in range(len(words) - window + 1)]
                for run in runs:
                    owners.setdefault((b" " + b" ".join(run) + b" ", len(run)), set()).add(items[s.first + i][0])
        keys = sorted(owners)
        self.items = [sorted(owners[k]) for k in keys]
        self.n_words = np.array([n for _, n in keys], np.int64)
        classes: dict[int, list[int]] = {}
        for k, (p, _) in enumerate(keys):
            classes.setdefault(len(p).bit_length(), []).append(k)
        self.searches = [(Search([keys[k][0] for k in ks]), np.array(ks)) for ks in classes.values()]

    @staticmethod
    def words(text: bytes) -> list[bytes]:
        raw = np.frombuffer(text, np.uint8)
        return np.where(K.ALNUM[raw], K.LOWER[raw], 32).astype(np.uint8).tobytes().split()

    def hits(self, s: K.TextSlice) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
        """Which words are hit, words before each text, items found in each text."""
        text, place, first, _ = normalised(s)
        marks = np.zeros(len(place) + 1, np.int32)
        found: list[set[int]] = [set() for _ in range(s.n)]
        for search, ids in self.searches:
            where, which = search.occurrences(text)
            if not len(where):
                continue
            word = np.searchsorted(place, where)  # the word right after the pattern's first blank
            pattern = ids[which]
            np.add.at(marks, word, 1)
            np.add.at(marks, word + self.n_words[pattern], -1)
            doc = np.searchsorted(first, word, "right") - 1
            for d, p in np.unique(np.stack([doc, pattern], 1), axis=0).tolist():
                found[d].update(self.items[p])
        return np.cumsum(marks[:-1]) > 0, first, found

    def scan(self, s: K.TextSlice) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
        """Words, hit words and items found, text by text."""
        hit, first, found = self.hits(s)
        sums = np.zeros(len(hit) + 1, np.int64)
        np.cumsum(hit, out=sums[1:])
        return np.diff(first), sums[first[1:]] - sums[first[:-1]], found


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<long>"


def parts_of(benchmark: DataFrame) -> list[Broadcast]:
    """The benchmark's items in broadcasts of about half of ``PASS_BYTES`` each, or one if they fit."""
    own = benchmark.where("item_id is not null").select("item_id", "text")
    size = own.selectExpr("coalesce(sum(octet_length(text)), 0) n").first()[0]
    many = 1 if size <= PASS_BYTES else -(-2 * size // PASS_BYTES)
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(many))
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast([(r[0], r[1]) for r in own.where(place == k).collect()]) for k in range(many)]


def worker_benchmark(items: list[tuple[int, str | None]], window: int) -> Benchmark:
    """The searches of a part, built once in a worker; the last part is kept."""
    key = hashlib.sha256(repr(items).encode()).hexdigest(), window
    return K.built(key, lambda: Benchmark(items, window))


KINDS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("item_ids", pa.list_(pa.int64()))])


def result(ids: pa.Array, counts: np.ndarray, hits: np.ndarray, found: list[set[int]]) -> pa.RecordBatch:
    names = [hashlib.sha256(",".join(sorted(map(str, f))).encode()).hexdigest() for f in found]
    return pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(hits), pa.array([len(f) for f in found], pa.int64()), pa.array(names, pa.string()), pa.array(hits > 0), pa.array([sorted(f) for f in found], pa.list_(pa.int64()))], schema=KINDS)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words inside any occurrence of a benchmark window, and the items found."""
    parts = parts_of(benchmark)
    if len(parts) > 1:
        return merged(docs, parts, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = worker_benchmark(parts[0].value, window)
        for batch in batches:
            for s in K.slices(batch.column(1)):
                counts, hits, found = bench.scan(s)
                yield result(batch.column(0).slice(s.first, s.n), counts, hits, found)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


#: A row's name: rows that share it are equal in all that counts here.
ROW = ["doc_id", "twin"]
PLACES = "doc_id long, twin long, starts array<long>, ends array<long>, item_ids array<long>"


def places(docs: DataFrame, part: Broadcast, window: int) -> DataFrame:
    """Of each document with hits of a part: the stretches of words that are hit, and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = worker_benchmark(part.value, window)
        for batch in batches:
            for s in K.slices(batch.column(1)):
                hit, first, found = bench.hits(s)
                own = [i for i, f in enumerate(found) if f]
                if not own:
                    continue
                starts, ends = K.runs(hit, first)
                lists = ([], [])
                for i in own:
                    x, y = np.searchsorted(starts, [first[i], first[i + 1]])
                    for out, values in zip(lists, (starts, ends)):
                        out.append((values[x:y] - first[i]).tolist())
                at = pa.array([s.first + i for i in own])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), *[pa.array(x, pa.list_(pa.int64())) for x in lists], pa.array([sorted(found[i]) for i in own], pa.list_(pa.int64()))], names=["doc_id", "twin", "starts", "ends", "item_ids"])

    return docs.mapInArrow(run, PLACES)


def merged(docs: DataFrame, parts: list[Broadcast], window: int) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("twin"))
    found = [places(own, part, window) for part in parts]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    hits = every.groupBy(*ROW).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")], F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(1)):
                starts, _ = K.runs(K.ALNUM[s.buf], s.offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), batch.column(2).slice(s.first, s.n), pa.array(np.diff(K.by_text(starts, s.offsets)))], names=["doc_id", "twin", "n_words"])

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, found = [], []
            for starts, ends, items in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                end = total = 0
                for a, b in sorted(zip(starts or [], ends or [])):
                    total += max(0, b - max(a, end))
                    end = max(end, b)
                many.append(total)
                found.append(set(items or []))
            yield result(batch.column(0), np.asarray(batch.column(1)), np.array(many, np.int64), found)

    words = own.mapInArrow(count, "doc_id long, twin long, n_words long").alias("w")
    met = words.join(hits.alias("h"), F.col("w.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("w.twin") == F.col("h.twin")), "left")
    return met.select("w.doc_id", "n_words", "starts", "ends", "item_ids").mapInArrow(union, SCHEMA)


def stage(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold an occurrence of any window, with all their columns; one pass for each part of the benchmark.

    Rows that repeat an id are judged one by one; null texts and ids stay.
    """
    at = docs.columns.index("text")

    def without(part: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = worker_benchmark(part.value, window)
            for batch in batches:
                for s in K.slices(batch.column(at)):
                    yield batch.slice(s.first, s.n).filter(pa.array(bench.scan(s)[1] == 0))
            K.give_back()

        return run

    for part in parts_of(benchmark):
        docs = docs.mapInArrow(without(part), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("item_ids")


ORACLE = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
p as (
  select distinct item_id, least(10, len(ws)) n, unnest([array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') for i in range(1, len(ws) - least(10, len(ws)) + 2)]) win
  from b where len(ws) > 0),
sizes as (select distinct n from p),
d as (
  select doc_id, n, unnest(range(1, len(ws) - n + 2)) i, unnest([array_to_string(ws[i : i + n - 1], ' ') for i in range(1, len(ws) - n + 2)]) win
  from w cross join sizes where len(ws) >= n),
h as (select distinct doc_id, i, d.n, item_id from d join p on d.n = p.n and d.win = p.win),
hit as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + n)) j from h) group by doc_id),
it as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) ids from (select distinct doc_id, cast(item_id as varchar) s from h) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from w left join hit using (doc_id) left join it using (doc_id)
"""
