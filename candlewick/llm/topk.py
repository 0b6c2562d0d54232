"""Exact top-k search by inner product, with pivot-table elimination.

Vectors become integers, floor(64 x), and are compared by inner product.  A table holds
every vector's distances to the pivots, which are chosen on a bounded sample to lie far
apart.  For a query q and a vector x, |d(q,p) - d(x,p)| is a lower bound of d(q,x) for
each pivot p; the largest of these gives an upper bound of the inner product,
(|q|^2 + |x|^2 - bound^2) / 2.  Candidates are evaluated in the order of that bound, for a few
queries at once, and the rest is left out once it falls below their k-th best scores.  The bounds only decide
what is evaluated, so results are exact whatever the pivots are.

Blocks of queries meet groups of vectors, each pair in one task that streams the group
past the block; best lists of the groups are merged per query.  The grid of blocks and
groups follows the tasks that the cluster runs at once, and a block holds at most
``QUERIES`` queries, so what is exchanged grows with the vectors: twenty times fewer
queries go to many groups, and vectors to few blocks.

Vectors that are null or hold nulls or non-finite values take no part.  Shorter vectors
are filled with zeros.  vec_id is a key: repeated rows of an id are one candidate, by the row that
scores best, and one query, by the row whose integers are least (compared from the first component on).
Rows without an id take no part.  Components of any finite size count exactly, and a score
beyond 64 bits is the nearest integer of 64 bits.  Empty tables give an empty result;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.llm import kernels as K
from candlewick.llm.session import read

K_BEST, EVERY, SCALE = 20, 20, 64
PIVOTS, SAMPLE = 16, 1024
#: Queries of a block, at most; cells of the table of bounds that a task holds at once.
QUERIES, CELLS = 8192, 1 << 23
#: Queries that are evaluated together, and candidates of the first and of each later step.
ROWS, FIRST, NEXT = 32, 256, 1024
QUERY, DATA = 0, 1
#: No vector; stands in best lists that are not full.
NONE = np.iinfo(np.int64).min


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their integers, which doubles hold exactly: of a double, 64 times and the floor are exact."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.values.cast(pa.float64()).fill_null(np.nan))
    offsets = np.asarray(column.offsets).astype(np.int64)
    valid = np.asarray(column.is_valid())
    flat = np.append(flat, 0.0)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ok = valid & (bad[offsets[1:]] == bad[offsets[:-1]])
    use = np.flatnonzero(ok)
    sizes = offsets[use + 1] - offsets[use]
    wide = int(sizes.max()) if len(use) else 0
    out = np.zeros((len(use), wide))
    rows = np.repeat(np.arange(len(use)), sizes)
    cols = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        out[rows, cols] = np.nan_to_num(np.floor(SCALE * flat[K.spread(offsets[use], sizes)]))
    return use, out


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any size, cut to 64 bits at the end."""
    own = [int(v) for v in q]
    sums = (sum(int(a) * b for a, b in zip(row, own)) for row in x)
    return np.array([min(max(v, -(1 << 63)), (1 << 63) - 1) for v in sums], np.int64)


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.concatenate([x, np.zeros((len(x), width - x.shape[1]), x.dtype)], 1)


def chosen_pivots(sample: np.ndarray, many: int = PIVOTS) -> np.ndarray:
    """Vectors of the sample, each as far as can be from those before it."""
    if not len(sample):
        return sample
    picked = [0]
    with np.errstate(over="ignore"):
        far = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(many, len(sample)) and far.max() > 0:
        picked.append(int(far.argmax()))
        with np.errstate(over="ignore"):
            far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], pivots.shape[1])
    a, b = widened(x, width), widened(pivots, width)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


class Block:
    """Queries of a task with their best lists so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray, k: int):
        self.ids, self.x, self.table, self.k = ids, x, table, k
        with np.errstate(over="ignore"):
            self.norm = (x**2).sum(1)
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.best = np.full((len(ids), k), NONE, np.int64)
        self.met = self.evaluated = 0

    def meet(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray) -> None:
        step = max(1, CELLS // max(1, len(self.ids)))
        for a in range(0, len(ids), step):
            self._meet(ids[a : a + step], x[a : a + step], table[a : a + step])

    def _meet(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray) -> None:
        width = max(self.x.shape[1], x.shape[1])
        q, x = widened(self.x, width), widened(x, width)
        most = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * width
        self.exact = most < 1 << 53
        with np.errstate(over="ignore", invalid="ignore"):
            norm = (x**2).sum(1)
            left, right = self.table.astype(np.float32), table.astype(np.float32)
            low, gap = np.zeros((len(q), len(x)), np.float32), np.empty((len(q), len(x)), np.float32)
            for p in range(table.shape[1]):
                np.subtract(left[:, p, None], right[None, :, p], out=gap)
                np.maximum(low, np.abs(gap, out=gap), out=low)
            # a little room, as distances and norms are rounded
            low -= np.float32(1e-3 + 1e-6 * max(left.max(initial=0), right.max(initial=0)))
            np.multiply(np.maximum(low, 0, out=low), low, out=low)
            both = np.add(self.norm[:, None], norm[None, :], dtype=np.float32, casting="same_kind", out=gap)
            bound = np.multiply(np.subtract(np.multiply(both, np.float32(1 + 1e-6), out=both), low, out=low), np.float32(0.5), out=low)
            bound += np.float32(1e-2)
        bound[np.isnan(bound)] = np.inf
        self.met += len(q) * len(x)
        for a in range(0, len(q), ROWS):
            sub = slice(a, a + ROWS)
            own, kth = bound[sub], self.score[sub, -1:]
            reach = own.max(0)
            todo = np.flatnonzero((own >= kth).any(0))
            if len(todo) > FIRST:
                # the highest bounds first: they raise what the others must reach
                head = np.argpartition(-reach[todo], FIRST)
                self._take(sub, todo[head[:FIRST]], ids, q, x)
                todo = todo[head[FIRST:]]
                todo = todo[(own[:, todo] >= self.score[sub, -1:]).any(0)]
            todo = todo[np.argsort(-reach[todo])]
            for b in range(0, len(todo), NEXT):
                if reach[todo[b]] < self.score[sub, -1].min():
                    break
                self._take(sub, todo[b : b + NEXT], ids, q, x)

    def _take(self, sub: slice, at: np.ndarray, ids: np.ndarray, q: np.ndarray, x: np.ndarray) -> None:
        """Evaluates some candidates for a few queries and merges those that reach their best lists."""
        self.evaluated += len(self.ids[sub]) * len(at)
        found = (q[sub] @ x[at].T).astype(np.int64) if self.exact else np.stack([products(x[at], v) for v in q[sub]])
        near = (found >= self.score[sub, -1:]) & (ids[at] != self.ids[sub][:, None])
        for r in np.flatnonzero(near.any(1)).tolist():
            i, own = sub.start + r, near[r]
            score, best = np.concatenate([self.score[i], found[r, own]]), np.concatenate([self.best[i], ids[at[own]]])
            taken = np.concatenate([self.best[i] != NONE, np.ones(own.sum(), bool)])
            # those taken first, by score (as its complement, which can't overflow) and id; the first row of an id counts
            order = np.lexsort((best, ~score, ~taken))
            _, first = np.unique(best[order], return_index=True)
            keep = np.zeros(len(order), bool)
            keep[first] = True
            order = np.concatenate([order[keep & taken[order]], order[~taken[order]]])[: self.k]
            self.score[i], self.best[i] = score[order], best[order]

    def result(self) -> pa.RecordBatch:
        row, col = np.nonzero(self.best != NONE)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.best[row, col]), pa.array(self.score[row, col])], names=["query_id", "vec_id", "score"])


def pack(ids: np.ndarray, x: np.ndarray, table: np.ndarray) -> bytes:
    return K.pack_columns(np.array(x.shape), ids, x.astype(np.int32) if np.abs(x).max(initial=0) < 1 << 31 else x, table)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shape, ids, raw, table = K.unpack_columns(blob, np.int64, np.int64, np.uint8, np.float64)
    kind = np.int32 if raw.size == 4 * shape.prod() else np.float64
    return ids, raw.view(kind).reshape(shape).astype(float), table.reshape(len(ids), -1)


def grid(queries: int, tasks: int, every: int) -> tuple[int, int]:
    """Blocks of queries and groups of vectors: few blocks, as each takes all vectors, and about ``tasks`` pairs."""
    blocks = max(1, -(-queries // QUERIES), round((tasks / every) ** 0.5))
    return blocks, max(1, -(-tasks // blocks))


def top_k(vectors: DataFrame, k: int = K_BEST, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    own = vectors.selectExpr("cast(vec_id as bigint) vec_id", "embedding").where("vec_id is not null")
    n_blocks, n_groups = grid(own.where(F.col("vec_id") % every == 0).count(), 3 * spark.sparkContext.defaultParallelism, every)
    sample = own.where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    pivots = chosen_pivots(integers(sample.column(0))[1]) if sample.num_rows else np.zeros((0, 0))
    shipped = spark.sparkContext.broadcast(pivots)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use, x = integers(batch.column(1))
            ids = K.long_column(batch.column(0))[use]
            table = distances(x, shipped.value)
            place = K.mix(ids.astype(np.uint64))
            out = []
            for kind, ok, many in ((DATA, np.ones(len(ids), bool), n_groups), (QUERY, ids % every == 0, n_blocks)):
                part = (place % np.uint64(many)).astype(np.int64)
                for g in np.unique(part[ok]).tolist():
                    at = np.flatnonzero(ok & (part == g))
                    out.append((g, kind, pack(ids[at], x[at], table[at])))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["part", "kind", "payload"])

    packed = own.mapInArrow(split, "part int, kind int, payload binary")
    # a group meets every block of queries, and a block every group
    other = F.when(F.col("kind") == DATA, F.sequence(F.lit(0), F.lit(n_blocks - 1))).otherwise(F.sequence(F.lit(0), F.lit(n_groups - 1)))
    met = packed.withColumn("other", F.explode(other)).select(F.when(F.col("kind") == DATA, F.col("other") * n_groups + F.col("part")).otherwise(F.col("part") * n_groups + F.col("other")).cast("int").alias("bucket"), "kind", "payload")
    parts = n_blocks * n_groups

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, block, queries, held, many = None, None, [], [], 0

        def meet() -> None:
            nonlocal block, held, many
            if block is None and queries:
                block = joined(queries, k)
            if block is not None and held:
                block.meet(*merge(held))
            held, many = [], 0

        for batch in batches:
            for b, kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if b != bucket:
                    meet()
                    if block is not None:
                        yield block.result()
                    bucket, block, queries = b, None, []
                got = unpack(payload.as_py())
                if kind == QUERY:
                    queries.append(got)
                else:
                    held.append(got)
                    many += len(got[0])
                    if many >= 4096:
                        meet()
        meet()
        if block is not None:
            yield block.result()

    best = met.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "kind").mapInArrow(search, "query_id long, vec_id long, score long")
    once = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def merge(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = max(h[1].shape[1] for h in held)
    return np.concatenate([h[0] for h in held]), np.concatenate([widened(h[1], width) for h in held]), np.concatenate([h[2] for h in held])


def joined(queries: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> Block:
    ids, x, table = merge(queries)
    order = np.lexsort((*x.T[::-1], ids))  # of the rows of an id the least vector, component by component
    _, first = np.unique(ids[order], return_index=True)
    at = order[first]
    return Block(ids[at], x[at], table[at], k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


ORACLE = """
with v as (
  select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] e from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select q.vec_id query_id, c.vec_id, cast(list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)]) as bigint) score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
