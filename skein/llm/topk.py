"""Exact top-k search by columnar branch-and-bound.

Vectors are quantised to integers (floor(scale * x)) and stored vertically, once: a shard is a
row that holds the ids of some thousand vectors and one array a dimension. Query vectors, every
row whose id is divisible by `every`, are broadcast in rounds of at most `query_bytes`, and a
task streams its shards past them. A shard is met dimension block by dimension block; after
each, a candidate's score so far plus the most that the remaining dimensions can add
(Cauchy-Schwarz on the remaining masses of both sides) bounds its final score, and candidates
whose bound is under the query's k-th best so far, of all shards that the task has seen, are
compacted away.

Vectors are never shuffled; k rows a query and task are, for the final ranking. A table of n rows
with q queries is read q * dims * 8 / query_bytes times.

Defined results: vectors that are null, or hold a null, NaN or infinite component, take no
part, nor do null ids; an empty vector scores 0; vectors are compared over the dimensions of
the longer one, missing ones counting 0. Rows are known by their place, not their id: rows that
repeat an id are candidates of each other, and each such query has ranks of its own. Ties go
to the smaller id; scores beyond 64 bits are held at their ends; an empty table gives an empty
result. Other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.scratch import settle

SAFE = 2.0**53
_SHARD = pa.schema([("ids", pa.binary()), ("rows", pa.binary()), ("values", pa.binary())])
_QUERY = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("values", pa.binary())])
_BEST = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Best:
    """The k best candidates of each query so far, and what a candidate must reach."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.rows, self.queries, self.k = ids, rows, queries, k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
        self.floor = np.full(len(ids), -np.inf)

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.found[i][0], ids]), np.concatenate([self.found[i][1], scores])
        best = np.lexsort((ids, -scores))[: self.k]
        self.found[i] = ids[best], scores[best]
        if len(best) == self.k:
            self.floor[i] = scores[best[-1]]

    def batch(self) -> pa.RecordBatch:
        n = [len(f[0]) for f in self.found]
        ids = np.concatenate([f[0] for f in self.found] or [np.zeros(0, np.int64)])
        scores = [s for f in self.found for s in f[1].tolist()]
        held = pa.array([max(-(2**63), min(2**63 - 1, int(s))) for s in scores], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.rows, n)), pa.array(np.repeat(self.ids, n)), pa.array(ids), held], schema=_BEST)


def search(best: Best, ids: np.ndarray, rows: np.ndarray, columns: np.ndarray, step: int = 16) -> None:
    """Meet one shard: columns holds a row a dimension; all values are integers as float64."""
    dims, count, k = columns.shape[0], len(ids), best.k
    if not count or not len(best.ids):
        return
    order = np.argsort(-np.abs(best.queries).sum(axis=0), kind="stable")  # dimensions with the most query mass first
    cuts = list(range(0, dims, step))
    stored = [np.ascontiguousarray(columns[order[c : c + step]]) for c in cuts]
    rest = np.zeros((len(cuts) + 1, count))  # candidate mass in the dimension blocks from c on
    for c in range(len(cuts) - 1, -1, -1):
        rest[c] = rest[c + 1] + (stored[c] ** 2).sum(axis=0)
    rest = np.sqrt(rest) * (1 + 1e-9)
    at = {r: i for i, r in enumerate(rows.tolist())}
    for low in range(0, len(best.ids), 64):
        asked = best.queries[low : low + 64][:, order]
        first = asked[:, :step] @ stored[0]
        for j, q in enumerate(asked):
            i = low + j
            left = np.sqrt([(q[c:] ** 2).sum() for c in cuts] + [0.0]) * (1 + 1e-9)
            alive, score = np.arange(count), first[j]
            own = at.get(int(best.rows[i]))
            if own is not None:
                alive, score = np.delete(alive, own), np.delete(score, own)
            floor = best.floor[i]
            for c in range(len(cuts)):
                if c:
                    score = score + q[cuts[c] : cuts[c] + step] @ stored[c][:, alive]
                if c + 1 < len(cuts):
                    reach = left[c + 1] * rest[c + 1][alive]
                    if len(score) >= k:
                        floor = max(floor, np.partition(score - reach, -k)[-k])
                    keep = score + reach >= floor - 0.5
                    if not keep.all():
                        alive, score = alive[keep], score[keep]
            best.add(i, ids[alive], score)


def exact(best: Best, ids: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
    """The same over Python integers, for values whose products could leave float64's exact range."""
    vectors = [[int(x) for x in v] for v in columns.T]
    for i, q in enumerate(best.queries):
        q = [int(x) for x in q]
        found = sorted((-sum(a * b for a, b in zip(q, v)), d) for v, d, r in zip(vectors, ids.tolist(), rows.tolist()) if r != best.rows[i])[: best.k]
        best.add(i, np.array([d for _, d in found], np.int64), np.array([-s for s, _ in found], object))


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """A row a vector, from the flat values of a list array; short vectors end in zeros."""
    flat, lengths = np.asarray(vectors.flatten(), float), np.diff(np.asarray(vectors.offsets))
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    ends = np.cumsum(lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
    return out


def _shards(rows: DataFrame, dims: int, kind: str, shard_rows: int) -> DataFrame:
    """Vectors as vertical shards of values of one kind, made where they are read."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for low in range(0, batch.num_rows, shard_rows):
                part = batch.slice(low, shard_rows)
                values = _matrix(part.column(1), dims).astype(kind)
                at = np.arange(number, number + part.num_rows)
                number += part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (np.asarray(part.column(0)).tobytes(), at.tobytes(), np.ascontiguousarray(values.T).tobytes())], schema=_SHARD)

    return rows.mapInArrow(run, "ids binary, rows binary, values binary")


def _opened(batch: pa.RecordBatch, dims: int, kind: str):
    for ids, rows, values in zip(*(batch.column(i) for i in range(3))):
        ids = np.frombuffer(ids.as_py(), np.int64)
        yield ids, np.frombuffer(rows.as_py(), np.int64), np.frombuffer(values.as_py(), kind).reshape(dims, len(ids)).astype(float)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", query_bytes: int = 64 << 20, shard_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of highest integer inner product of each query."""
    spark = vectors.sparkSession
    ints = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    sound = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"))
    shape = rows.agg(F.sum((F.col("id") % every == 0).cast("long")).alias("q"), F.max(F.size("v")).alias("d"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    n_queries, dims, top = shape["q"] or 0, max(shape["d"] or 0, 1), shape["top"] or 0.0
    meet = search if top * top * dims < SAFE else exact
    kind = "<i4" if top < 2**31 else "<f8"
    shards = settle(_shards(rows, dims, kind, shard_rows))
    rounds = -(-n_queries * (dims * 8 + 16) // query_bytes) or 1

    def asked(batches):
        for batch in batches:
            for ids, at, values in _opened(batch, dims, kind):
                mine = np.flatnonzero(ids % every == 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[mine]), pa.array(at[mine]), pa.array([values[:, i].tobytes() for i in mine], pa.binary())], schema=_QUERY)

    queries = shards.mapInArrow(asked, "id long, row long, values binary")
    queries = settle(queries) if rounds > 1 else queries
    found = None
    for r in range(rounds):  # every shard meets every query block: the stated query set against all rows
        block = (queries.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r) if rounds > 1 else queries).toArrow()
        ids, at = np.asarray(block.column("id")), np.asarray(block.column("row"))
        values = np.frombuffer(b"".join(block.column("values").to_pylist())).reshape(len(ids), dims)
        sent = spark.sparkContext.broadcast((ids, at, values))

        def run(batches, sent=sent):
            best = Best(*sent.value, k)
            for batch in batches:
                for shard in _opened(batch, dims, kind):
                    meet(best, *shard)
            yield best.batch()

        out = shards.mapInArrow(run, "row long, query_id long, vec_id long, score long")
        if rounds > 1:
            out = settle(out)
            sent.unpersist()
        found = out if found is None else found.unionByName(out)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    return top_k(vectors.select("vec_id", "embedding"))


SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
