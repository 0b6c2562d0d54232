"""Suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts earlier
(smaller doc_id, or the same document further left).  Strings are judged on the
input and never cross documents.

Co-location.  Every string of 100 bytes is assigned to an *anchor*, the 32 bytes in
it with the smallest hash (the leftmost of equals), so equal strings have equal
anchors, and the strings of one anchor occurrence form one *context*, the bytes from
the first to the last of them.  Only anchors are exchanged, as hashes; those that
occur once can hold no repeat and stop there.  Equal contexts are one text with
several places: all but the first place go.  Within the sending task that is decided
before the exchange, so a passage in a third of all documents sends one row per task.
Whole contexts are told apart by hashes, 48 bits beside the 64 of their anchor; they never
enter the transform, which is for strings that different contexts share.

Expansion.  Anchors with several different contexts have those contexts fetched from
the texts and indexed: `repeats` sorts their suffixes up to the threshold, forms the
transform, and derives common prefixes by increasing value: the boundaries between
suffixes whose common prefix is shorter than l, extended backward by every symbol at
once, give those for l + 1; after 100 levels the intervals without a boundary hold
equal strings, and all but the earliest place of an interval go.

Null and empty texts, and texts under 100 bytes, lose nothing and have one result row
each.  Every row is judged on its own: rows that repeat a doc_id come in the order of a
hash of their texts, null ids after all others, and of rows equal in id and text any one
comes first.  A text of any length is read whole.  An empty table gives an empty result;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from candlewick.llm import kernels as K
from candlewick.llm.dealing import SCHEMA, TEXTS, bound, bucket_of, by_bucket, columns, deal, elsewhere, gathered, keyed_texts, read_texts, repeated, row_key, row_names, rows
from candlewick.llm.session import read, width

LENGTH = 100
GRAM = 32
#: Bits of a place in the key that an anchor is chosen by; longer buffers are cut into windows of that size.
PLACE_BITS = 24
ANCHORS, SPANS, WANTED, CONTEXTS = 1, 2, 3, 4
#: Anchors that a task gathers before it sends them; bytes of contexts that are indexed
#: together, and that are sent together.
FLUSH, INDEX, SEND = 1_000_000, 2 << 20, 32 << 20


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, bits: int = PLACE_BITS) -> tuple[np.ndarray, ...]:
    """Per anchor occurrence: gram hash, context hash, text index, first string's start in the buffer, number of strings."""
    n = len(buf)
    empty = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n < length:
        return empty
    if n > 1 << bits:
        # windows that share length - 1 bytes: every string lies in one, and has the anchor that it has anywhere
        parts = []
        for a in range(0, n - length + 1, (1 << bits) - length + 1):
            b = min(a + (1 << bits), n)
            found = anchors(buf[a:b], np.clip(offsets, a, b) - a, length, gram, bits)
            parts.append((*found[:3], found[3] + a, found[4]))
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(5))
    place = np.uint64((1 << bits) - 1)
    spans = K.SpanHash(K.BYTE_WORDS[buf])
    sums, down = spans.sums, spans.down
    grams = K.mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    key = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    low, size = key, 1
    span = length - gram + 1
    while size * 2 <= span:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    # strings that stay inside their text
    ok = np.zeros(len(low) + 1, bool)
    sizes = np.diff(offsets)
    fit = sizes >= length
    step = np.zeros(len(low) + 2, np.int32)
    np.add.at(step, offsets[:-1][fit], 1)
    np.add.at(step, offsets[1:][fit] - length + 1, -1)
    ok = np.cumsum(step[: len(low)]) > 0
    at = (low & place).astype(np.int64)
    head = ok.copy()
    head[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
    starts = np.flatnonzero(head)
    if not len(starts):
        return empty
    # a run of strings ends where the next anchor or text begins
    tail = ok.copy()
    tail[:-1] &= head[1:] | ~ok[1:]
    ends = np.flatnonzero(tail)
    where = at[starts]
    return grams[where], spans(starts, ends + length), np.searchsorted(offsets, starts, "right") - 1, starts, ends - starts + 1


def pack_anchors(gram: np.ndarray, context: np.ndarray, doc: np.ndarray, twin: np.ndarray, at: np.ndarray, many: np.ndarray) -> bytes:
    order = np.argsort(gram, kind="stable")
    key, first, inverse = np.unique(row_key(doc, twin)[order], return_index=True, return_inverse=True)
    by_id = np.argsort(doc[order][first], kind="stable")
    place = np.empty(len(key), np.uint32)
    place[by_id] = np.arange(len(key))
    inverse, first = place[inverse], first[by_id]
    context = context[order]
    return K.pack_columns(K.deltas(gram[order]), context.astype(np.uint32), (context >> np.uint64(32)).astype(np.uint16), K.deltas(doc[order][first]), twin[order][first], (inverse & 0xFFFF).astype(np.uint16), (inverse >> 16).astype(np.uint16), at[order].astype(np.uint32), many[order].astype(np.uint8))


def unpack_anchors(blob: bytes) -> tuple[np.ndarray, ...]:
    gram, low, high, ids, twin, near, far, at, many = K.unpack_columns(blob, np.uint32, np.uint32, np.uint16, np.int64, np.uint64, np.uint16, np.uint16, np.uint32, np.uint8)
    index = near.astype(np.int64) | far.astype(np.int64) << 16
    return np.cumsum(gram, dtype=np.uint32), low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), np.cumsum(ids)[index], twin[index], at.astype(np.int64), many.astype(np.int64)


def spans_by_text(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int) -> list[tuple[int, int, bytes]]:
    """Rows of kind SPANS; overlapping spans of a row, which doc is the key of, are joined first."""
    if not len(doc):
        return []
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    # running end inside a document, by lifting each document above the ones before
    lift = np.cumsum(np.append(False, doc[1:] != doc[:-1])).astype(np.int64) << 40
    reach = np.maximum.accumulate(stop + lift)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + lift[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(doc)) - 1
    doc, start, stop = doc[heads], start[heads], reach[last] - lift[last]
    return by_bucket(bucket_of(doc, n), [doc, start, stop], SPANS, lambda d, a, b: K.pack_columns(K.deltas(d), a.astype(np.uint32), (b - a).astype(np.uint32)))


def send_anchors(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        many = 0

        def flush() -> pa.RecordBatch:
            gram, context, doc, twin, at, strings = (np.concatenate([h[k] for h in held]) for k in range(6))
            context = context & np.uint64(0xFFFFFFFFFFFF)
            # equal contexts here: the first place stands for all, the others go
            order = np.lexsort((at, twin, doc, gram, context))
            same, moved = np.zeros((2, len(order)), bool)
            same[1:] = np.logical_and(*(x[order][1:] == x[order][:-1] for x in (context, gram)))
            for x in (doc, twin, at):
                moved[1:] |= x[order][1:] != x[order][:-1]
            gone, kept = order[elsewhere(same, moved)], order[~same]
            out = spans_by_text(row_key(doc[gone], twin[gone]), at[gone], at[gone] + strings[gone] - 1 + LENGTH, n)
            own = gram[kept]
            out += by_bucket(bucket_of(own, n), [(own & np.uint64(0xFFFFFFFF)).astype(np.uint32), context[kept], doc[kept], twin[kept], at[kept], strings[kept]], ANCHORS, pack_anchors)
            return rows(out)

        for batch in batches:
            for s in K.slices(batch.column(1), 1 << 20):
                gram, context, text, start, strings = anchors(s.buf, s.offsets)
                if len(gram):
                    doc, twin = row_names(batch.column(0), s)
                    held.append((gram, context, doc[text], twin[text], start - s.offsets[text], strings))
                    many += len(gram)
                if many >= FLUSH:
                    yield flush()
                    held, many = [], 0
        if held:
            yield flush()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def match_anchors(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Repeated anchors of a bucket: places that go, and one place of each context that must be compared."""
    got = gathered(batches)
    for bucket, payload in got.get(SPANS, []):
        yield rows([(bucket, SPANS, payload)])
    sent = got.pop(ANCHORS, [])
    if not sent:
        return
    bucket = sent[0][0]
    parts = [unpack_anchors(p) for _, p in sent]
    del sent
    gram, context, doc, twin, at, many = (np.concatenate([p[k] for p in parts]) for k in range(6))
    del parts
    order = np.argsort(gram, kind="stable")
    g = gram[order]
    same = g[1:] == g[:-1]
    multi = np.zeros(len(g), bool)
    multi[1:] |= same
    multi[:-1] |= same
    order = order[multi]
    if not len(order):
        return
    order = order[np.lexsort((at[order], twin[order], doc[order], context[order], gram[order]))]
    gram, context, doc, twin, at, many = gram[order], context[order], doc[order], twin[order], at[order], many[order]
    new_gram = np.diff(gram, prepend=gram[0] ^ np.uint32(1)) != 0
    new_context = new_gram.copy()
    new_context[1:] |= context[1:] != context[:-1]
    moved = np.zeros(len(order), bool)
    for x in (doc, twin, at):
        moved[1:] |= x[1:] != x[:-1]
    gone, row = elsewhere(~new_context, moved), row_key(doc, twin)
    out = spans_by_text(row[gone], at[gone], at[gone] + many[gone] - 1 + LENGTH, n)
    group = np.cumsum(new_gram) - 1
    mixed = np.bincount(group, new_context) > 1
    want = new_context & mixed[group]
    # the key names the anchor among all buckets
    key = gram[want].astype(np.uint64) | np.uint64(bucket) << np.uint64(32)
    out += by_bucket(bucket_of(row[want], n), [key, doc[want], twin[want], at[want], many[want]], WANTED)
    if out:
        yield rows(out)


def fetch_contexts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    got = gathered(batches)
    for bucket, payload in got.get(SPANS, []):
        yield rows([(bucket, SPANS, payload)])
    key, doc, twin, at, many = columns(got.get(WANTED, []), np.uint64, np.int64, np.uint64, np.int64, np.int64)
    order = np.argsort(row_key(doc, twin), kind="stable")
    key, doc, twin, at, many = key[order], doc[order], twin[order], at[order], many[order]
    row = row_key(doc, twin)
    seen: set[int] = set()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        which = np.concatenate([h[0] for h in held])
        flat = np.concatenate([h[1] for h in held])
        sizes = many[which] - 1 + LENGTH
        starts = np.cumsum(sizes) - sizes

        def pack(which: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bytes:
            return K.pack_columns(key[which], doc[which], twin[which], at[which], many[which], flat[K.spread(starts, sizes)])

        return rows(by_bucket(bucket_of(key[which], n), [which, starts, sizes], CONTEXTS, pack))

    for rows_, _, s, _ in read_texts(got.get(TEXTS, [])):
        offsets, buf = s.offsets, s.buf
        a, b = np.searchsorted(row, rows_, "left"), np.searchsorted(row, rows_, "right")
        # of equal rows one is asked
        b = np.where(repeated(rows_, seen), a, b)
        which = K.spread(a, b - a)
        if not len(which):
            continue
        held.append((which, buf[K.spread(np.repeat(offsets[:-1], b - a) + at[which], many[which] - 1 + LENGTH)]))
        size += len(held[-1][1])
        if size >= SEND:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def bounded_suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` symbols at least, equal ones by place; and each suffix's rank."""
    n = len(symbols)
    wide = np.concatenate([symbols.astype(np.uint64), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key << np.uint64(9) | wide[k : k + n]
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    head = np.ones(n, bool)
    head[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    heads = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = heads
    h = 7
    while h < depth:
        # only suffixes that still tie are sorted again
        tie = ~head
        tie[:-1] |= ~head[1:]
        slots = np.flatnonzero(tie)
        if not len(slots):
            break
        sub = order[slots]
        nxt = rank[np.minimum(sub + h, n)]
        again = np.argsort(heads[slots].astype(np.uint64) << np.uint64(32) | (nxt + 1).astype(np.uint64), kind="stable")
        sub, nxt, group = sub[again], nxt[again], heads[slots][again]
        order[slots] = sub
        fresh = np.ones(len(sub), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
        head[slots] = fresh
        heads = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order] = heads
        h *= 2
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    return order, inverse


def repeats(symbols: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each slot whether its common prefix with the slot before is ``length`` or more.

    symbols: 0 ends a text, other values are bytes plus one.
    """
    n = len(symbols)
    order, inverse = bounded_suffix_order(symbols, length + 1)
    # the transform, as its inverse walk: psi[i] is the slot of suffix i without its first symbol
    psi = inverse[np.minimum(order + 1, n - 1)]
    first = symbols[order]
    bound = np.ones(n, bool)
    bound[1:] = (first[1:] != first[:-1]) | (first[1:] == 0)
    open_ = np.flatnonzero(~bound)
    low, high = np.minimum(psi[open_ - 1], psi[open_]), np.maximum(psi[open_ - 1], psi[open_])
    fresh = bound
    for _ in range(1, length):
        # backward extension of every interval by every symbol at once: slots i-1 and i part at the
        # next level where a boundary of this level lies between their images
        near = high - low == 1
        parted = fresh[high]
        if not near.all():
            sums = np.cumsum(fresh)
            parted = sums[high] > sums[low]
        if not parted.any():
            break
        fresh = np.zeros(n, bool)
        fresh[open_[parted]] = True
        bound = bound | fresh
        stay = ~parted
        open_, low, high = open_[stay], low[stay], high[stay]
    return order, ~bound


def later_places(row: np.ndarray, doc: np.ndarray, twin: np.ndarray, at: np.ndarray, many: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of the strings in these contexts that start earlier elsewhere among them."""
    sizes = many - 1 + LENGTH
    total = int(sizes.sum()) + len(sizes)
    symbols = np.zeros(total, np.uint16)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    symbols[K.spread(starts, sizes)] = flat.astype(np.uint16) + 1
    order, equal = repeats(symbols)
    owner = np.searchsorted(starts, order, "right") - 1
    within = order - starts[owner]
    valid = within < many[owner]
    cls = np.cumsum(~equal)
    keep = valid
    cls, owner, within = cls[keep], owner[keep], within[keep]
    d, a = row[owner], at[owner] + within
    again = np.lexsort((a, twin[owner], doc[owner], cls))
    cls, d, a = cls[again], d[again], a[again]
    later = np.zeros(len(cls), bool)
    later[1:] = cls[1:] == cls[:-1]
    return d[later], a[later]


def expand(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    got = gathered(batches)
    for bucket, payload in got.get(SPANS, []):
        yield rows([(bucket, SPANS, payload)])
    key, doc, twin, at, many, flat = columns(got.pop(CONTEXTS, []), np.uint64, np.int64, np.uint64, np.int64, np.int64, np.uint8)
    if not len(key):
        return
    sizes = many - 1 + LENGTH
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    cuts = np.append(np.flatnonzero(np.diff(ordered, prepend=ordered[0] ^ np.uint64(1))), len(order))
    bytes_ = np.concatenate([[0], np.cumsum(sizes[order])])
    a = 0
    while a < len(cuts) - 1:
        b = max(a + 1, int(np.searchsorted(bytes_[cuts], bytes_[cuts[a]] + INDEX, "right")) - 1)
        own = order[cuts[a] : cuts[b]]
        d, s = later_places(row_key(doc[own], twin[own]), doc[own], twin[own], at[own], many[own], flat[K.spread(starts[own], sizes[own])])
        if len(d):
            yield rows(spans_by_text(d, s, s + LENGTH, n))
        a = b


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    got = gathered(batches)
    doc, start, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = []
    for _, payload in got.get(SPANS, []):
        d, a, k = K.unpack_columns(payload, np.uint64, np.uint32, np.uint32)
        parts.append((np.cumsum(d, dtype=np.uint64), a.astype(np.int64), k.astype(np.int64)))
    if parts:
        doc, start, size = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.argsort(doc, kind="stable")
        doc, start, size = doc[order], start[order], size[order]
    seen: set[int] = set()
    for keys, ids, s, _ in read_texts(got.get(TEXTS, [])):
        offsets, buf = s.offsets, s.buf
        a, b = np.searchsorted(doc, keys, "left"), np.searchsorted(doc, keys, "right")
        which = K.spread(a, b - a)
        base = np.repeat(offsets[:-1], b - a)
        step = np.zeros(len(buf) + 1, np.int32)
        np.add.at(step, base + start[which], 1)
        np.add.at(step, base + start[which] + size[which], -1)
        # every string of a copy also starts in the row that it repeats
        copy = repeated(keys, seen) & (np.diff(offsets) >= LENGTH)
        np.add.at(step, offsets[:-1][copy], 1)
        np.add.at(step, offsets[1:][copy], -1)
        gone = np.cumsum(step[:-1]) > 0
        spans, _ = K.runs(gone, offsets)
        sums = np.concatenate([[0], np.cumsum(gone)])
        n_removed = sums[offsets[1:]] - sums[offsets[:-1]]
        kept = buf[~gone]
        keep_at = offsets - sums[offsets]
        names = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(keep_at[:-1].tolist(), keep_at[1:].tolist())]
        arrays = [ids, pa.array(np.diff(offsets)), pa.array(n_removed), pa.array(np.diff(K.by_text(spans, offsets))), pa.array(names, pa.string())]
        labels = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            arrays.append(pa.array([kept[x:y].tobytes() for x, y in zip(keep_at[:-1].tolist(), keep_at[1:].tolist())], pa.binary()))
            labels.append("kept")
        yield pa.RecordBatch.from_arrays(arrays, names=labels)


def deduplicated(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document the bytes removed; with ``with_text`` also those that are left."""
    n = width(docs.sparkSession)
    found = deal(send_anchors(docs, n), n).mapInArrow(bound(match_anchors, n), SCHEMA)
    contexts = deal(found.unionByName(keyed_texts(docs, n)), n).mapInArrow(bound(fetch_contexts, n), SCHEMA)
    spans = deal(contexts, n).mapInArrow(bound(expand, n), SCHEMA)
    return deal(spans.unionByName(keyed_texts(docs, n)), n).mapInArrow(lambda b: removed(b, with_text), RESULT + (", kept binary" if with_text else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents"))
