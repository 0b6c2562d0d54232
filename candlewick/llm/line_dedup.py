"""Line dedup: a suffix array over line-ID sequences, by prefix doubling.

A document is the sequence of the IDs of its lines (split at line feeds, 96-bit
hashes).  A *run* of consecutive lines counts if its text, line feeds between lines
included, has at least ``MIN_BYTES`` bytes.  A line goes if it lies in a run that counts
and also starts earlier: in a smaller doc_id, or further up in the same document.  Runs
never cross documents and are judged on the input; of a longer repeated run every line
goes, short ones at its end too.

Doubling: the name of 2h lines from line i is a hash of the names of the h lines from
i and from i + h, so names of all powers of two take log2 steps, and a run of any length
is named by the two powers that cover it.  Since a run stays inside one document the
steps need no exchange; the exchange is the sort.  Two suffix arrays are built, of the
sequences and of their reverse: of each suffix its shortest prefix that counts is sorted,
under its name, and equal names are the intervals whose longest common prefix reaches
the threshold.  All but the first place of an interval go, and what goes joins into the
maximal repeated runs: a line x of a repeated run [p, q] lies in the shortest run from p
that counts or, past its end, in the shortest one that ends at x, and both lie in [p, q]
and repeat with it.  So no longer prefix need be compared, and the order inside an
interval is that of places.  Later places that meet in one task are dropped before the
exchange, so a line in every third document sends one row per task.

Null text: no lines, nothing to lose.  Empty text: one empty line.  Every row is judged
on its own: rows that repeat a doc_id come in the order of a hash of their texts, null
ids after all others, and of rows equal in id and text any one comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from candlewick.llm import kernels as K
from candlewick.llm.dealing import SCHEMA, TEXTS, bound, bucket_of, by_bucket, columns, deal, elsewhere, gathered, keyed_texts, read_texts, repeated, row_key, row_names, rows
from candlewick.llm.session import read, width

MIN_BYTES = 64
FLUSH = 500_000
SUFFIXES, LOST = 1, 2
SECOND = np.uint64(0x8CB92BA72F3D8DD7)


def lines(s: K.TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line of the slice, and lines before each text; null texts have none."""
    feeds = np.flatnonzero(s.buf == 10)
    first = s.offsets[:-1][s.valid]
    last = s.offsets[1:][s.valid]
    starts = np.sort(np.concatenate([first, feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([last, feeds]), kind="stable")
    per_text = np.diff(np.searchsorted(feeds, s.offsets)) + s.valid
    before = np.zeros(s.n + 1, np.int64)
    np.cumsum(per_text, out=before[1:])
    return starts, ends, before


def suffixes(s: K.TextSlice, min_bytes: int = MIN_BYTES) -> tuple[np.ndarray, ...]:
    """Per shortest run that counts, from its first line or to its last one: name, second name, text index, line index, lines in the run."""
    starts, ends, before = lines(s)
    n = len(starts)
    if not n:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    text = np.repeat(np.arange(s.n), np.diff(before))
    at = np.arange(n)
    # the first line that ends far enough from each line's start, the last one that starts far enough from each line's end
    reach = np.searchsorted(ends, starts + min_bytes, "left")
    back = np.searchsorted(starts, ends - min_bytes, "right") - 1
    onward, backward = reach < before[text + 1], back >= before[text]
    run = np.unique(np.concatenate([at[onward] * (n + 1) + (reach - at + 1)[onward], back[backward] * (n + 1) + (at - back + 1)[backward]]))
    at, size = run // (n + 1), run % (n + 1)
    names = K.SpanHash(K.BYTE_WORDS[s.buf])(starts, ends)
    level, h = [names], 1
    while h * 2 <= size.max(initial=0):
        last = level[-1]
        nxt = last.copy()
        nxt[: n - h] = K.mix(last[: n - h] * np.uint64(0x9FB21C651E98DF25) + last[h:])
        level.append(nxt)
        h *= 2
    power = np.log2(size).astype(np.int64)
    table = np.stack(level)
    a, b = table[power, at], table[power, at + size - (1 << power)]
    name = K.mix(a * np.uint64(0xD1342543DE82EF95) + b + size.astype(np.uint64))
    check = K.mix(b * SECOND + (a ^ size.astype(np.uint64)))
    return name, check & np.uint64(0xFFFFFFFF), text[at], at - before[text[at]], size


def lost(doc: np.ndarray, twin: np.ndarray, line: np.ndarray, size: np.ndarray, n: int) -> list[tuple[int, int, bytes]]:
    key = row_key(doc, twin)
    order = np.lexsort((line, key))
    return by_bucket(bucket_of(key, n)[order], [key[order], line[order], size[order]], LOST, lambda d, a, k: K.pack_columns(K.deltas(d), a.astype(np.uint32), k.astype(np.uint32)))


def later(name: np.ndarray, check: np.ndarray, doc: np.ndarray, twin: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order by (name, place), whether each has another place of its interval before it, and the first of each interval."""
    order = np.lexsort((line, twin, doc, check, name))
    nm, ck, place = name[order], check[order], [x[order] for x in (doc, twin, line)]
    same, moved = np.zeros((2, len(order)), bool)
    same[1:] = (nm[1:] == nm[:-1]) & (ck[1:] == ck[:-1])
    for x in place:
        moved[1:] |= x[1:] != x[:-1]
    return order, elsewhere(same, moved), ~same


def send(docs: DataFrame, n: int, min_bytes: int) -> DataFrame:
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        many = 0

        def flush() -> pa.RecordBatch:
            name, check, doc, twin, line, size = (np.concatenate([h[k] for h in held]) for k in range(6))
            order, after, first = later(name, check, doc, twin, line)
            gone, own = order[after], order[first]
            return rows(lost(doc[gone], twin[gone], line[gone], size[gone], n) + by_bucket(bucket_of(name[own], n), [name[own], check[own].astype(np.uint32), doc[own], twin[own], line[own].astype(np.uint32), size[own].astype(np.uint32)], SUFFIXES))

        for batch in batches:
            for s in K.slices(batch.column(1)):
                name, check, text, line, size = suffixes(s, min_bytes)
                if len(name):
                    doc, twin = row_names(batch.column(0), s)
                    held.append((name, check, doc[text], twin[text], line, size))
                    many += len(name)
                if many >= FLUSH:
                    yield flush()
                    held, many = [], 0
        if held:
            yield flush()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def intervals(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    got = gathered(batches)
    for bucket, payload in got.get(LOST, []):
        yield rows([(bucket, LOST, payload)])
    name, check, doc, twin, line, size = columns(got.pop(SUFFIXES, []), np.uint64, np.uint32, np.int64, np.uint64, np.uint32, np.uint32)
    order, after, _ = later(name, check, doc, twin, line)
    gone = order[after]
    if len(gone):
        yield rows(lost(doc[gone], twin[gone], line[gone], size[gone], n))


RESULT = "doc_id long, n_lines long, n_removed long, n_runs long, kept_sha256 string"


def rebuilt(batches: Iterator[pa.RecordBatch], min_bytes: int, columns_: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of RESULT, or with ``columns_`` the documents that are left, in those columns."""
    got = gathered(batches)
    parts = [K.unpack_columns(p, np.uint64, np.uint32, np.uint32) for _, p in got.get(LOST, [])]
    key = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]) if parts else np.zeros(0, np.uint64)
    line = np.concatenate([p[1] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    size = np.concatenate([p[2] for p in parts]).astype(np.int64) if parts else line
    order = np.argsort(key, kind="stable")
    key, line, size = key[order], line[order], size[order]
    seen: set[int] = set()
    for keys, ids, s, rest in read_texts(got.get(TEXTS, []), K.SLICE):
        buf, offsets, valid = s.buf, s.offsets, s.valid
        starts, ends, before = lines(s)
        a, b = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
        which = K.spread(a, b - a)
        base = np.repeat(before[:-1], b - a)
        step = np.zeros(len(starts) + 1, np.int32)
        np.add.at(step, base + line[which], 1)
        np.add.at(step, base + line[which] + size[which], -1)
        copy = repeated(keys, seen)
        if copy.any():
            # every run of a copy also starts in the row that it repeats
            _, _, text, at, many = suffixes(s, min_bytes)
            own = copy[text]
            np.add.at(step, before[text[own]] + at[own], 1)
            np.add.at(step, before[text[own]] + at[own] + many[own], -1)
        gone = np.cumsum(step[:-1]) > 0
        runs, _ = K.runs(gone, before)
        sums = np.concatenate([[0], np.cumsum(gone)])
        n_removed = sums[before[1:]] - sums[before[:-1]]
        raw = buf.tobytes()
        kept = []
        bounds = zip(before[:-1].tolist(), before[1:].tolist())
        for i, (x, y) in enumerate(bounds):
            if not n_removed[i]:
                kept.append(raw[offsets[i] : offsets[i + 1]])
            else:
                kept.append(b"\n".join(raw[starts[k] : ends[k]] for k in range(x, y) if not gone[k]))
        if columns_ is None:
            arrays = [ids, pa.array(np.diff(before)), pa.array(n_removed), pa.array(np.diff(K.by_text(runs, before))), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256"])
            continue
        text = pa.array([k if v else None for k, v in zip(kept, valid.tolist())], pa.binary()).cast(pa.string())
        new = {"text": text, "n_chars": pc.utf8_length(text).cast(pa.int64())}
        whole = pa.table([new[c] if c in new else rest[f"carried_{c}"] for c in columns_], names=columns_)
        yield from whole.filter(pa.array((n_removed == 0) | (n_removed < np.diff(before)))).combine_chunks().to_batches()


def dealt(docs: DataFrame, min_bytes: int, carried: list[str] | None = None) -> DataFrame:
    """Texts and what they lose, by row."""
    n = width(docs.sparkSession)
    found = deal(send(docs, n, min_bytes), n).mapInArrow(bound(intervals, n), SCHEMA)
    return deal(found.unionByName(keyed_texts(docs, n, carried)), n)


def deduplicated(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Per document the lines removed."""
    return dealt(docs, min_bytes).mapInArrow(bound(rebuilt, min_bytes), RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents"))


def stage(docs: DataFrame) -> DataFrame:
    """docs with the removed lines gone; a document that lost all its lines goes too."""
    names = docs.columns
    return dealt(docs, MIN_BYTES, [c for c in names if c not in ("text", "n_chars")]).mapInArrow(K.released(lambda b: rebuilt(b, MIN_BYTES, names)), T.StructType([T.StructField(f.name, T.LongType() if f.name == "n_chars" else f.dataType) for f in docs.schema]))


#: Equal lines on one diagonal of two documents, one after another, are a common run.
ORACLE = r"""
with l as (
  select doc_id, string_split(text, chr(10)) ls from documents where text is not null),
p as (
  select doc_id, unnest(ls) x, unnest(range(1, len(ls) + 1)) i from l),
m as (
  select a.doc_id, a.i, b.doc_id other, a.i - b.i diagonal, strlen(a.x) b from p a join p b on a.x = b.x and (b.doc_id < a.doc_id or b.doc_id = a.doc_id and b.i < a.i)),
r as (select *, i - row_number() over (partition by doc_id, other, diagonal order by i) island from m),
c as (select *, sum(b + 1) over (partition by doc_id, other, diagonal, island) - 1 bytes from r),
g as (select distinct doc_id, i x from c where bytes >= 64),
n as (select doc_id, count(*) n_removed, count(*) filter (coalesce(prev, -9) <> x - 1) n_runs from (select doc_id, x, lag(x) over (partition by doc_id order by x) prev from g) group by doc_id),
kept as (select p.doc_id, string_agg(p.x, chr(10) order by i) t from p left join g on g.doc_id = p.doc_id and g.x = p.i where g.x is null group by p.doc_id)
select d.doc_id, coalesce(len(ls), 0) n_lines, coalesce(n_removed, 0) n_removed, coalesce(n_runs, 0) n_runs, sha256(coalesce(kept.t, '')) kept_sha256
from documents d left join l using (doc_id) left join n using (doc_id) left join kept using (doc_id)
"""
