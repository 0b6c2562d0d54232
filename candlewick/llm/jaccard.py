"""N-gram Jaccard join: grouped prefix join over word shingles.

Two documents link when their sets of distinct five-word shingles have a Jaccard
similarity of 0.75 or more.  A document with fewer words is one shingle, the whole
sequence; one without words (or a null text) is empty and links with nothing.

1.  Shingles are ordered rare first: by the class of their document count where they
    are common (a bounded table of the most common ones), then by hash.  Any order is
    right; this one keeps passages that many documents share out of the prefixes.
2.  A document sends its prefix to the shingles' buckets: of n shingles the n / 4 of
    which any partner must hold one, and n / 12 more, so that a partner must hold
    1 + n / 12 of them.  The first n / 7 + n / 12 are those a larger partner must meet.
    Documents of a task with equal sets send once.
3.  In a bucket, the documents with one prefix shingle form a list; those with identical
    prefixes and size collapse into one group.  Group pairs are filtered by size and
    prefix position.  Instead of all pairs a list proposes stars: each group to the
    smallest one it can link to, and each member to its group's first.
4.  Proposals made for enough shingles are verified on the full sets, the centre's text
    travelling once to each bucket that holds partners.  Only texts of such documents
    move: a bitmap of fixed size, which may name some too many, tells which.
5.  Links give components.  A list whose members now share a component needs nothing
    more; in any other, the shared prefix shingles of every pair across components are
    counted.  Of the pairs that reach the bound each document first verifies the ``TOP``
    that share most, components contract, pairs inside one drop out, and the rest is
    verified, so no link between components is missed.  A verifying task joins the
    components of its links as it goes and skips pairs inside one, so it returns fewer
    links than the components it met, not all pairs of a group.

Result: one row per doc_id with the size of its set and the smallest doc_id reachable
by links.  Rows that repeat a doc_id are compared row by row and share its component; the
largest set counts as its size.  A row without a doc_id links with nothing and has no component.
Null texts, empty tables and further columns of any name are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import kernels as K
from candlewick.llm.components import components
from candlewick.llm.dealing import SCHEMA, TEXTS, bound, bucket_of, by_bucket, columns, deal, gathered, mark, marked, marks, rows, texts
from candlewick.llm.session import kept, most, read, width

WORDS = 5
#: The most common shingles, with their class, known to every task: about so many.
COMMON = 200_000
#: A task reports a shingle that so many of the documents it holds at once share.
COMMON_LOCAL = 4
#: Documents whose postings a task packs together.
FLUSH = 8192
POSTINGS, LISTS, CENTRES, PARTNERS, SETS, LABELS, COUNTS = 1, 2, 3, 4, 5, 6, 7
#: Centres of a list by hash, besides the smallest; pairs of a document that are verified before the others.
CENTRES_BY_HASH, TOP = 3, 4
#: Bytes of texts that a task sends together.
SEND = 16 << 20
WEIGHTS = K.mix(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingles(s: K.TextSlice, words: int = WORDS) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    starts, ends = K.runs(~K.SPACE[s.buf], s.offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * s.n
    h = K.SpanHash(K.BYTE_WORDS[K.LOWER[s.buf]])(starts, ends)
    bounds = K.by_text(starts, s.offsets)
    full = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        full += h[k : len(h) - words + 1 + k] * WEIGHTS[k] if len(full) else np.uint64(0)
    full = K.mix(full)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            own = np.sort(full[a : b - words + 1])
            fresh = np.ones(len(own), bool)
            fresh[1:] = own[1:] != own[:-1]
            out.append(own[fresh])
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(K.mix(np.array([(h[a:b] * WEIGHTS[: b - a]).sum(dtype=np.uint64) ^ np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(own: np.ndarray) -> tuple[int, int]:
    a = int(K.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    b = int(K.mix(own ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64))
    return a - (1 << 63), b - (1 << 63)


ROW_NAME = "xxhash64(doc_id, text) row"


def row_named(docs: DataFrame, repeated: np.ndarray) -> DataFrame:
    """(doc_id, text) with the row's name for doc_id where the id is marked as repeated: each row stands for itself."""
    shipped = docs.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pc.if_else(pa.array(marked(shipped.value, np.asarray(batch.column(3)))), batch.column(2), batch.column(0))
            yield pa.RecordBatch.from_arrays([ids, batch.column(1)], names=["doc_id", "text"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text", ROW_NAME).withColumn("place", mark("doc_id")).mapInArrow(run, "doc_id long, text string")


def described(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row name, n_shingles, signature), and packed local counts of common shingles, from one scan."""
    schema = "doc_id long, row long, n_shingles long, sig1 long, sig2 long, bucket int, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()

        def flush() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            heads = np.flatnonzero(np.diff(every, prepend=every[:1] ^ np.uint64(1)))
            many = np.diff(np.append(heads, len(every)))
            often = many >= COMMON_LOCAL
            own = every[heads][often]
            found = by_bucket(bucket_of(own, n), [own, many[often].astype(np.uint32)], 0)
            blank = [None] * len(found)
            return pa.RecordBatch.from_arrays([pa.array(blank, pa.int64())] * 5 + [pa.array([f[0] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary())], names=names)

        for batch in batches:
            ids = batch.column(0)
            for s in K.slices(batch.column(1)):
                sets = shingles(s)
                sigs = [signature(x) for x in sets]
                for own, sig in zip(sets, sigs):
                    if sig not in seen:
                        seen.add(sig)
                        held.append(own)
                yield pa.RecordBatch.from_arrays([ids.slice(s.first, s.n), batch.column(2).slice(s.first, s.n), pa.array([len(x) for x in sets], pa.int64()), pa.array([x[0] for x in sigs], pa.int64()), pa.array([x[1] for x in sigs], pa.int64()), pa.nulls(s.n, pa.int32()), pa.nulls(s.n, pa.binary())], names=names)
            if len(held) >= FLUSH:
                yield flush()
                held, seen = [], set()
        yield flush()

    both = kept(docs.sparkSession, docs.selectExpr("cast(doc_id as bigint) doc_id", "text", ROW_NAME).mapInArrow(run, schema), "described")
    return both.where("n_shingles is not null").select(*names[:5]), both.where("bucket is not null").selectExpr("bucket", "0 kind", "payload")


def common(counts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The about COMMON shingles of most documents, sorted, and their classes; bounded, so that it may be broadcast."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, many = columns(gathered(batches).get(0, []), np.uint64, np.uint32)
        unique, inverse = np.unique(own, return_inverse=True)
        sums = np.bincount(inverse, many).astype(np.int64) if len(own) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(sums)], names=["name", "many"])

    sums = kept(counts.sparkSession, deal(counts, n).mapInArrow(total, "name long, many long"), "common")
    top = most(sums, "name", "many", COMMON).toArrow()
    names = np.asarray(top["name"]).view(np.uint64)
    classes = np.log2(np.maximum(np.asarray(top["many"]), 1)).astype(np.uint8) + 1
    order = np.argsort(names)
    return names[order], classes[order].astype(np.uint8)


def shared(n: int | np.ndarray) -> int | np.ndarray:
    """Prefix shingles that two documents of at least n shingles share if they link."""
    return 1 + n // 12


def prefix(own: np.ndarray, names: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, int]:
    """The shingles that a partner must meet, and how many of them a larger partner must."""
    n = len(own)
    probe, index = n - (3 * n + 3) // 4 + shared(n), n - (6 * n + 6) // 7 + shared(n)
    if len(names):
        at = np.minimum(np.searchsorted(names, own), len(names) - 1)
        level = np.where(names[at] == own, classes[at], 0)
        if level.any():
            own = own[np.argsort(level, kind="stable")]
    return own[:probe], index


def send_postings(docs: DataFrame, n: int, names: np.ndarray, classes: np.ndarray) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast((names, classes))

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, classes = shipped.value
        seen: dict[tuple[int, int], int] = {}
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            doc, size, group = (np.array([h[k] for h in held], t) for k, t in ((0, np.int64), (1, np.int64), (2, np.uint64)))
            many = np.array([len(h[3]) for h in held], np.int64)
            index = np.array([h[4] for h in held], np.int64)
            token = np.concatenate([h[3] for h in held])
            owner = np.repeat(np.arange(len(held)), many)
            early = np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many) < index[owner]

            def pack(token: np.ndarray, owner: np.ndarray, early: np.ndarray) -> bytes:
                order = np.argsort(token, kind="stable")
                token, owner, early = token[order], owner[order], early[order]
                used, inverse = np.unique(owner, return_inverse=True)
                return K.pack_columns(K.deltas(token), (inverse << 1 | early).astype(np.uint32), K.deltas(doc[used]), size[used].astype(np.uint32), group[used].astype(np.uint32))

            return rows(by_bucket(bucket_of(token, n), [(token & np.uint64(0xFFFFFFFF)).astype(np.uint32), owner, early], POSTINGS, pack))

        for batch in batches:
            ids = K.long_column(batch.column(0)).tolist()
            for s in K.slices(batch.column(1)):
                for i, own in enumerate(shingles(s)):
                    if not len(own):
                        continue
                    sig, doc = signature(own), ids[s.first + i]
                    if sig in seen:  # an equal set of this task stands for it
                        continue
                    seen[sig] = doc
                    head, index = prefix(own, names, classes)
                    with np.errstate(over="ignore"):
                        name = K.mix(np.array([K.mix(head).sum(dtype=np.uint64) + np.uint64(len(own))]))[0]
                    held.append((doc, len(own), name, head, index))
            if len(held) >= FLUSH:
                held.sort(key=lambda h: h[0])
                yield flush()
                held, seen = [], {}
        if held:
            held.sort(key=lambda h: h[0])
            yield flush()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def unpack_postings(blob: bytes) -> tuple[np.ndarray, ...]:
    token, owner, doc, size, group = K.unpack_columns(blob, np.uint32, np.uint32, np.int64, np.uint32, np.uint32)
    early = (owner & 1).astype(bool)
    owner = owner >> 1
    return np.cumsum(token, dtype=np.uint32), np.cumsum(doc)[owner], size[owner].astype(np.int64), group[owner], early


def pack_lists(name: np.ndarray, doc: np.ndarray, size: np.ndarray, early: np.ndarray, times: np.ndarray) -> bytes:
    return K.pack_columns(name, doc, (size << 1 | early).astype(np.uint32), times.astype(np.uint32))


def summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs (rows of two ids), a place of each, and the sum of its times."""
    if not len(pairs):
        return pairs, np.zeros(0, np.int64), times
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    moved = pairs[order]
    head = np.ones(len(pairs), bool)
    head[1:] = (moved[1:] != moved[:-1]).any(1)
    at = np.flatnonzero(head)
    return moved[at], order[at], np.add.reduceat(times[order].astype(np.int64), at)


def propose(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Lists of the shingles of a bucket, once each, and the stars they propose."""
    parts = [unpack_postings(p) for _, p in gathered(batches).get(POSTINGS, [])]
    if not parts:
        return
    token, doc, size, group, early = (np.concatenate([p[k] for p in parts]) for k in range(5))
    del parts
    order = np.argsort(token, kind="stable")
    t = token[order]
    multi = np.zeros(len(t), bool)
    multi[1:] |= t[1:] == t[:-1]
    multi[:-1] |= t[1:] == t[:-1]
    order = order[multi]
    if not len(order):
        return
    order = order[np.lexsort((doc[order], group[order], size[order], token[order]))]
    token, doc, size, group, early = token[order], doc[order], size[order], group[order], early[order]
    # lists with the same members count once: their name is a sum over the members
    head = np.diff(token, prepend=token[0] ^ np.uint32(1)) != 0
    which = np.cumsum(head) - 1
    bounds = np.append(np.flatnonzero(head), len(token))
    mixed = np.zeros(len(token) + 1, np.uint64)
    np.cumsum(K.mix(doc.astype(np.uint64) * np.uint64(2) + early), out=mixed[1:])
    name = K.mix(mixed[bounds[1:]] - mixed[bounds[:-1]])
    _, first, repeated = np.unique(name, return_index=True, return_counts=True)
    chosen = np.zeros(len(name), np.int64)
    chosen[first] = repeated
    use = chosen[which] > 0
    doc, size, group, early, which = doc[use], size[use], group[use], early[use], which[use]
    times = chosen[which]
    head = np.diff(which, prepend=-1) != 0
    # groups: equal prefix and size
    new = head.copy()
    new[1:] |= (group[1:] != group[:-1]) | (size[1:] != size[:-1])
    leader = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    a, b = [leader[~new]], [np.flatnonzero(~new)]
    # stars over the leaders: a centre is early in its prefix and at least 3/4 as large as its partners
    lead = np.flatnonzero(new)
    todo = lead
    while len(todo):
        w = which[todo]
        begin = np.diff(w, prepend=-1) != 0
        ranks = np.where(early[todo], np.arange(len(todo)), len(todo))
        starts = np.flatnonzero(begin)
        best = np.minimum.reduceat(ranks, starts)
        lists = np.cumsum(begin) - 1
        centre = best[lists]
        ok = (centre < len(todo)) & (np.arange(len(todo)) > centre)
        centre_at = todo[np.minimum(centre, len(todo) - 1)]
        near = ok & (size[todo] * 3 <= size[centre_at] * 4)
        a.append(centre_at[near])
        b.append(todo[near])
        todo = todo[ok & ~near]
    # more stars around leaders chosen by hash: a document is centre of many of its lists at once
    w = which[lead]
    starts = np.flatnonzero(np.diff(w, prepend=-1) != 0)
    lists = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(lead))))
    index = np.arange(len(lead))
    for k in range(CENTRES_BY_HASH):
        rank = K.mix(doc[lead].astype(np.uint64) + np.uint64(k + 1 << 40)) >> np.uint64(32) << np.uint64(31) | index.astype(np.uint64)
        centre = (np.minimum.reduceat(np.where(early[lead], rank, ~np.uint64(0)), starts) & np.uint64((1 << 31) - 1)).astype(np.int64)[lists]
        centre = np.minimum(centre, len(lead) - 1)
        x, y = lead[np.minimum(centre, index)], lead[np.maximum(centre, index)]
        ok = (centre != index) & early[x] & (size[y] * 3 <= size[x] * 4) & (which[x] == which[y])
        a.append(x[ok])
        b.append(y[ok])
    a, b = np.concatenate(a), np.concatenate(b)
    differ = doc[a] != doc[b]
    a, b = a[differ], b[differ]
    # a pair counts once for each list, however many of its stars propose it
    _, once = np.unique(a << 32 | b, return_index=True)
    a, b = a[once], b[once]
    pairs, at, weight = summed(np.stack([doc[a], doc[b]], 1), times[b])
    need = shared(np.minimum(size[a], size[b]))[at]
    out = send_pairs(pairs, weight, need, pairs, n)
    full = name[which]
    out += by_bucket(bucket_of(full, n), [full, doc, size, early, times], LISTS, pack_lists)
    if out:
        yield rows(out)


#: Columns of a pair: centre and partner, shingles it was proposed for and those it needs, components of both.
PAIR = (np.int64, np.int64, np.uint32, np.uint32, np.int64, np.int64)


def send_pairs(pairs: np.ndarray, weight: np.ndarray, need: np.ndarray, labels: np.ndarray, n: int) -> list[tuple[int, int, bytes]]:
    """A pair goes to the bucket of its centre, which sends its set on, and to that of its partner."""
    own = [pairs[:, 0], pairs[:, 1], weight.astype(np.uint32), need.astype(np.uint32), labels[:, 0], labels[:, 1]]
    return by_bucket(bucket_of(pairs[:, 0], n), own, CENTRES) + by_bucket(bucket_of(pairs[:, 1], n), own, PARTNERS)


def proposed(found: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs proposed for at least half of the shingles that linked documents share, and their components.

    A star sees only part of what a pair shares; what this leaves out is counted in full later.
    """
    a, b, weight, need, left, right = columns(found, *PAIR)
    pairs, at, weight = summed(np.stack([a, b], 1), weight)
    enough = 2 * weight >= need[at]
    return pairs[enough], np.stack([left, right], 1)[at[enough]]


#: Columns of a pair that is verified: centre and partner, components of both.
DECIDED = (np.int64, np.int64, np.int64, np.int64)


def decide(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The pairs of a bucket that were proposed often enough, as centres' and as partners'."""
    got = gathered(batches)
    out = []
    for kind in (CENTRES, PARTNERS):
        pairs, labels = proposed(got.get(kind, []))
        out += by_bucket(bucket_of(pairs[:, int(kind == PARTNERS)], n), [pairs[:, 0], pairs[:, 1], labels[:, 0], labels[:, 1]], kind)
    if out:
        yield rows(out)


class Kept:
    """Chosen texts of a bucket, sent on in few blobs."""

    def __init__(self, bucket: int):
        self.bucket, self.parts, self.size = bucket, [], 0

    def add(self, ids: np.ndarray, sizes: np.ndarray, buf: np.ndarray, use: np.ndarray) -> None:
        if len(use):
            starts = np.cumsum(sizes) - sizes
            self.parts.append((ids[use], sizes[use], buf[K.spread(starts[use], sizes[use])]))
            self.size += len(self.parts[-1][2])

    def flush(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.parts and self.size >= least:
            yield rows([(self.bucket, TEXTS, K.pack_columns(*(np.concatenate([p[k] for p in self.parts]) for k in range(3))))])
            self.parts, self.size = [], 0


def sets_of(payload: bytes) -> Iterator[tuple[int, np.ndarray]]:
    ids, sizes, buf = K.unpack_columns(payload, np.int64, np.int64, np.uint8)
    for s in K.cut(buf, np.concatenate([[0], np.cumsum(sizes)]), np.ones(len(ids), bool)):
        yield from zip(ids[s.first : s.first + s.n].tolist(), shingles(s))


def send_centres(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The text of each centre to every bucket with a partner of it, once; partners' pairs and texts stay.

    A packed text is a third of its set of hashes, so the bucket makes the set again.
    """
    got = gathered(batches)
    pairs = np.stack(columns(got.get(CENTRES, []), *DECIDED)[:2], 1)
    to = np.unique(np.stack([pairs[:, 0], bucket_of(pairs[:, 1], n)], 1), axis=0)
    centres = np.unique(to[:, 0])
    a, b, left, right = columns(got.get(PARTNERS, []), *DECIDED)
    pairs, labels = np.stack([a, b], 1), np.stack([left, right], 1)
    wanted = np.unique(pairs[:, 1])
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        ids, sizes, flat = (np.concatenate([h[k] for h in held]) for k in range(3))
        starts = np.cumsum(sizes) - sizes
        x, y = np.searchsorted(to[:, 0], ids, "left"), np.searchsorted(to[:, 0], ids, "right")
        which = np.repeat(np.arange(len(ids)), y - x)

        def pack(which: np.ndarray) -> bytes:
            return K.pack_columns(ids[which], sizes[which], flat[K.spread(starts[which], sizes[which])])

        return rows(by_bucket(to[K.spread(x, y - x), 1], [which], SETS, pack))

    found = got.get(TEXTS, [])
    keep = Kept(found[0][0]) if found else None
    for _, payload in found:
        ids, sizes, buf = K.unpack_columns(payload, np.int64, np.int64, np.uint8)
        use = np.flatnonzero(np.isin(ids, centres))
        if len(use):
            held.append((ids[use], sizes[use], buf[K.spread((np.cumsum(sizes) - sizes)[use], sizes[use])]))
            size += len(held[-1][2])
        if size >= SEND:
            yield flush()
            held, size = [], 0
        keep.add(ids, sizes, buf, np.flatnonzero(np.isin(ids, wanted)))
        yield from keep.flush(SEND)
    if keep:
        yield from keep.flush(0)
    if held:
        yield flush()
    if len(pairs):
        yield rows(by_bucket(bucket_of(pairs[:, 1], n), [pairs[:, 0], pairs[:, 1], labels[:, 0], labels[:, 1]], PARTNERS))


class Joined:
    """Components that a task has joined so far."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x


@K.released
def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket whose full sets link and whose components no link before them here has joined."""
    got = gathered(batches)
    a, b, left, right = columns(got.get(PARTNERS, []), *DECIDED)
    sets = {doc: own for _, payload in got.pop(SETS, []) for doc, own in sets_of(payload)}
    order = np.argsort(b, kind="stable")
    a, b, left, right = a[order], b[order], left[order], right[order]
    joined = Joined()
    for _, payload in got.get(TEXTS, []):
        found: tuple[list[int], list[int]] = ([], [])
        for doc, own in sets_of(payload):
            x, y = np.searchsorted(b, [doc, doc + 1])
            for c, one, two in zip(a[x:y].tolist(), left[x:y].tolist(), right[x:y].tolist()):
                other = sets.get(c)
                one, two = joined.top(one), joined.top(two)
                if other is None or not len(own) or one == two:
                    continue
                at = np.minimum(np.searchsorted(other, own), len(other) - 1)
                common_ = int((other[at] == own).sum())
                if 100 * common_ >= 75 * (len(own) + len(other) - common_):
                    joined.up[max(one, two)] = min(one, two)
                    found[0].append(c)
                    found[1].append(doc)
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])


def labelled(doc: np.ndarray, node: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The component of each document, which is itself if none is given."""
    if not len(node):
        return doc.copy()
    order = np.argsort(node)
    at = np.minimum(np.searchsorted(node[order], doc), len(node) - 1)
    return np.where(node[order][at] == doc, label[order][at], doc)


def across(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """For lists over several components: every pair across them that passes the filters."""
    got = gathered(batches)
    name, doc, size, times = columns(got.get(LISTS, []), np.uint64, np.int64, np.uint32, np.uint32)
    node, label = columns(got.get(LABELS, []), np.int64, np.int64)
    if not len(name):
        return
    # a list that several buckets sent is one, its times added
    order = np.lexsort((doc, size >> 1, name))
    name, doc, size, times = name[order], doc[order], size[order], times[order].astype(np.int64)
    head = np.ones(len(name), bool)
    head[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    times = np.add.reduceat(times, at)
    name, doc, size = name[at], doc[at], size[at]
    size, early = (size >> 1).astype(np.int64), (size & 1).astype(bool)
    own = labelled(doc, node, label)
    bounds = np.append(np.flatnonzero(np.diff(name, prepend=name[0] ^ np.uint64(1))), len(name))
    low, high = np.minimum.reduceat(own, bounds[:-1]), np.maximum.reduceat(own, bounds[:-1])
    a, b, many = [], [], 0

    def flush() -> pa.RecordBatch:
        x, y = np.concatenate(a), np.concatenate(b)
        pairs, at, weight = summed(np.stack([doc[x], doc[y]], 1), times[x])
        x, y = x[at], y[at]
        return rows(send_counts(pairs, weight, shared(np.minimum(size[x], size[y])), np.stack([own[x], own[y]], 1), n))

    for k in np.flatnonzero(low != high).tolist():
        x, y = bounds[k], bounds[k + 1]
        lab, sz, ea = own[x:y], size[x:y], early[x:y]
        names, counts = np.unique(lab, return_counts=True)
        most = names[counts.argmax()]
        for i in np.flatnonzero(lab != most).tolist():
            # partners outside i's component; between two of them outside the largest, the later one asks
            js = np.arange(np.searchsorted(sz, -(-sz[i] * 3 // 4), "left"), np.searchsorted(sz, sz[i] * 4 // 3, "right"))
            js = js[(lab[js] != lab[i]) & ((js < i) | (lab[js] == most))]
            first, second = np.minimum(js, i), np.maximum(js, i)
            ok = ea[first]
            a.append(x + first[ok])
            b.append(x + second[ok])
            many += len(a[-1])
            if many > 500_000:
                yield flush()
                a, b, many = [], [], 0
    if many:
        yield flush()


def send_counts(pairs: np.ndarray, weight: np.ndarray, need: np.ndarray, labels: np.ndarray, n: int) -> list[tuple[int, int, bytes]]:
    """A pair goes to the bucket of the document that asks, the one in the component named later."""
    asks = np.where(labels[:, 0] > labels[:, 1], pairs[:, 0], pairs[:, 1])
    return by_bucket(bucket_of(asks, n), [pairs[:, 0], pairs[:, 1], weight.astype(np.uint32), need.astype(np.uint32), labels[:, 0], labels[:, 1]], COUNTS)


def agreed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Pairs that share as many prefix shingles as linked documents must; those that share most, for verification."""
    a, b, weight, need, left, right = columns(gathered(batches).get(COUNTS, []), *PAIR)
    pairs, at, weight = summed(np.stack([a, b], 1), weight)
    enough = weight >= need[at]
    pairs, at, weight = pairs[enough], at[enough], weight[enough]
    if not len(pairs):
        return
    need, labels = need[at], np.stack([left, right], 1)[at]
    asks = np.where(labels[:, 0] > labels[:, 1], pairs[:, 0], pairs[:, 1])
    order = np.lexsort((-weight / need, asks))
    heads = np.flatnonzero(np.diff(asks[order], prepend=asks[order[0]] ^ 1))
    rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    best, rest = order[rank < TOP], order[rank >= TOP]
    yield rows(send_pairs(pairs[best], weight[best], need[best], labels[best], n) + send_counts(pairs[rest], weight[rest], need[rest], labels[rest], n))


def remaining(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Pairs that are still in different components."""
    got = gathered(batches)
    a, b, weight, need, _, _ = columns(got.get(COUNTS, []), *PAIR)
    node, label = columns(got.get(LABELS, []), np.int64, np.int64)
    labels = np.stack([labelled(a, node, label), labelled(b, node, label)], 1)
    apart = labels[:, 0] != labels[:, 1]
    if apart.any():
        yield rows(send_pairs(np.stack([a, b], 1)[apart], weight[apart], need[apart], labels[apart], n))


def send_labels(found: DataFrame, labels: DataFrame, n: int, kind: int, kinds: tuple, docs_at: tuple) -> DataFrame:
    """Components of the documents in some columns of packed rows, to the buckets of these rows: asked for by bucket, sent back."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, to = [], []
        for bucket, payload in gathered(batches).get(kind, []):
            own = K.unpack_columns(payload, *kinds)
            doc = np.unique(np.concatenate([own[k] for k in docs_at]))
            docs.append(doc)
            to.append(np.full(len(doc), bucket, np.int64))
        if docs:
            asked = np.unique(np.stack([np.concatenate(docs), np.concatenate(to)], 1), axis=0)
            yield rows(by_bucket(bucket_of(asked[:, 0], n), [asked[:, 0], asked[:, 1]], LISTS))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label = K.long_column(batch.column(0)), K.long_column(batch.column(1))
            yield rows(by_bucket(bucket_of(node, n), [node, label], LABELS))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches)
        doc, to = columns(got.get(LISTS, []), np.int64, np.int64)
        node, label = columns(got.get(LABELS, []), np.int64, np.int64)
        if len(node) and len(doc):
            o = np.argsort(node)
            node, label = node[o], label[o]
            want = np.unique(np.stack([to, doc], 1), axis=0)
            at = np.minimum(np.searchsorted(node, want[:, 1]), len(node) - 1)
            ok = node[at] == want[:, 1]
            yield rows(by_bucket(want[ok, 0], [want[ok, 1], label[at[ok]]], LABELS))

    asked = found.mapInArrow(ask, SCHEMA).unionByName(labels.mapInArrow(put, SCHEMA))
    return deal(asked, n).mapInArrow(answer, SCHEMA)


def pair_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of the pairs of a bucket."""
    for batch in batches:
        for payload in batch.column(2).to_pylist():
            a, b = K.unpack_columns(payload, *DECIDED)[:2]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([a, b])))], names=["doc_id"])


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    n = width(spark)
    every, counts = described(docs, n)
    about, named = every.where("doc_id is not null"), docs.where("doc_id is not null")
    repeated = marks(about.groupBy("doc_id").count().where("count > 1"))
    if repeated.any():
        named = row_named(named, repeated)
    names, classes = common(counts, n)
    found = kept(spark, deal(send_postings(named, n, names, classes), n).mapInArrow(bound(propose, n), SCHEMA), "proposed")
    lists, pairs = found.where(F.col("kind") == LISTS), found.where(F.col("kind") != LISTS)

    def links(pairs: DataFrame) -> DataFrame:
        pairs = kept(spark, deal(pairs, n).mapInArrow(bound(decide, n), SCHEMA), "decided")
        wanted = marks(pairs.where(F.col("kind") == PARTNERS).mapInArrow(pair_docs, "doc_id long"))
        sent = deal(pairs.unionByName(texts(named, n, wanted=wanted)), n).mapInArrow(bound(send_centres, n), SCHEMA)
        return kept(spark, deal(sent, n).mapInArrow(verify, "a long, b long"), "links")

    first = links(pairs)
    labels = kept(spark, components(first), "labels")
    cross = deal(lists.unionByName(send_labels(lists, labels, n, LISTS, (np.uint64, np.int64, np.uint32, np.uint32), (1,))), n).mapInArrow(bound(across, n), SCHEMA)
    cross = kept(spark, deal(cross, n).mapInArrow(bound(agreed, n), SCHEMA), "cross")
    best, others = cross.where(F.col("kind") != COUNTS), cross.where(F.col("kind") == COUNTS)
    forest = labels.select(F.col("component").alias("a"), F.col("node").alias("b"))
    labels = kept(spark, components(forest.unionByName(links(best))), "labels")
    rest = deal(others.unionByName(send_labels(others, labels, n, COUNTS, PAIR, (0, 1))), n).mapInArrow(bound(remaining, n), SCHEMA)
    forest = labels.select(F.col("component").alias("a"), F.col("node").alias("b"))
    forest = forest.unionByName(links(kept(spark, rest, "rest")))
    if repeated.any():
        owner = about.groupBy("row").agg(F.min("doc_id").alias("doc"))
        for end in ("a", "b"):
            forest = forest.join(owner, forest[end] == owner.row, "left").withColumn(end, F.coalesce("doc", end)).drop("row", "doc")
    # equal sets are one document: each links to the smallest of its signature
    sets = about.where("n_shingles > 0").groupBy("sig1", "sig2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("many"))
    sets = kept(spark, sets.where("many > 1").drop("many"), "sets")
    copies = about.join(sets, ["sig1", "sig2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a < b")
    final = components(forest.unionByName(copies)).withColumnRenamed("node", "doc_id")
    out = about.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")).join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.unionByName(every.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))


def stage(docs: DataFrame) -> DataFrame:
    """One document of each component: the smallest doc_id; rows without an id stand after all others, by a hash of their text."""
    own = F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62))
    # those that go are far fewer than those that stay: the smaller side of the join
    gone = linked(docs.select(own.alias("doc_id"), "text")).where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id"))
    gone = kept(docs.sparkSession, gone, "gone")
    named = docs.where("doc_id is not null")
    named = named.join(gone, named.doc_id.cast("bigint") == gone.gone_id, "left_anti")
    # equal texts without an id share a name: one stays, of those without words all
    rest = docs.where("doc_id is null").withColumn("own_name", own)
    rest = rest.join(gone, rest.own_name == gone.gone_id, "left_anti")
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rest = rest.withColumn("own_copy", F.when(wordless, F.monotonically_increasing_id()).otherwise(F.lit(-1))).dropDuplicates(["own_name", "own_copy"])
    return named.unionByName(rest.drop("own_name", "own_copy"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(read(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else [array_to_string(ws[i : i + 4], ' ') for i in range(1, len(ws) - 3)] end) sh from w),
c as (select doc_id, count(*) n from s group by doc_id),
i as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from i join c a on a.doc_id = x join c b on b.doc_id = y where 100 * k >= 75 * (a.n + b.n - k)),
e as (select x, y from l union all select y, x from l),
r as (select x node, x reach from e union select r.node, e.y from r join e on r.reach = e.x)
select w.doc_id, cast(coalesce(c.n, 0) as bigint) n_shingles, coalesce(m.m, w.doc_id) component_id
from w left join c using (doc_id) left join (select node, min(reach) m from r group by node) m on m.node = w.doc_id
"""
