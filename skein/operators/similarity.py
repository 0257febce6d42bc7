"""Cosine search, hashed-token vectors, votes and retrieval scores."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skein.operators.rules import tokens
from skein.scratch import stable


class MatrixError(ValueError):
    """No matrix to search, or one of another model: not the same as no match."""


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where lengths differ, a vector is empty or has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm)


QUERY_BYTES, SCORE_BYTES = 64 << 20, 32 << 20  # of queries sent to the tasks at once, and of scores held at once


def _by_length(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors of each length: those without entries, with a null or without a length of their own are left out."""
    held = {}
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
    for n in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == n)
        rows = np.asarray(vectors.take(pa.array(at)).flatten(), float).reshape(len(at), n)
        norm = np.sqrt((rows * rows).sum(axis=1))
        sound = np.isfinite(norm) & (norm > 0)
        held[n] = at[sound], rows[sound] / norm[sound, None]
    return held


def _nearest(queries: pa.Table, k: int, threshold: float | None, others: bool):
    """A function of batches (id, vector) that gives the k nearest rows of each query: matrix products, block by block."""
    asked = _by_length(queries.column("vector").combine_chunks())
    names = queries.column("query").to_pylist()

    def run(batches):
        best: dict[int, list] = {}
        floor = np.full(len(names), -np.inf if threshold is None else threshold - 1e-9)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for n, (at, rows) in _by_length(batch.column(1)).items():
                if n not in asked:
                    continue
                places, block = asked[n]
                step = max(1, SCORE_BYTES // (8 * len(places)))
                for low in range(0, len(rows), step):
                    scores = block @ rows[low : low + step].T
                    # a row must come near a query's k-th best so far; only such scores are rounded and sorted
                    hits = scores >= floor[places, None]
                    if scores.shape[1] > 2 * k:
                        for at_ in np.flatnonzero(hits.sum(axis=1) > 2 * k):  # one more than k: a query's own row may be among them
                            hits[at_] &= scores[at_] >= np.partition(scores[at_], -k - 1)[-k - 1] - 1e-9
                    places_, columns = np.nonzero(hits)
                    rounded = np.round(scores[places_, columns], 12).tolist()
                    new: dict[int, list] = {}
                    for q, i, score in zip(places[places_].tolist(), (at[low + columns]).tolist(), rounded):
                        if not (others and ids[i] == names[q]) and (threshold is None or score >= threshold):
                            new.setdefault(q, []).append((score, ids[i]))
                    for q, more in new.items():
                        best[q] = sorted(best.get(q, []) + more, key=lambda x: (-x[0], x[1] is not None, x[1]))[:k]
                        if len(best[q]) == k:
                            floor[q] = max(floor[q], best[q][-1][0] - 1e-9)
        rows = [(names[q], i, s) for q, found in best.items() for s, i in found]
        yield pa.RecordBatch.from_pydict({"query": pa.array([r[0] for r in rows], queries.schema.field("query").type), "id": [r[1] for r in rows], "score": pa.array([r[2] for r in rows], pa.float64())})

    return run


def top_k(queries: DataFrame, corpus: DataFrame, k: int, threshold: float | None = None, model: str | None = None, others: bool = False, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query, id, score, rank): the k corpus rows (id, vector) nearest to each query (query, vector), ties by id.

    Queries are a given set: they are sent to the tasks in rounds of at most `query_bytes`, and the corpus, which is never shuffled,
    is read once a round and met by matrix products. A task gives k rows a query. Scores that differ after the twelfth digit only
    are ties. Rows of another length, with a null or of no length match nothing. With `others`, rows of the query's own id are left out."""
    if model is not None and corpus.where(F.col("model") == model).isEmpty():
        raise MatrixError(f"no vectors of model {model!r}")
    rows = (corpus.where(F.col("model") == model) if model is not None else corpus).select("id", F.col("vector").cast("array<double>").alias("vector"))
    asked = queries.select("query", F.col("vector").cast("array<double>").alias("vector"))
    rows, asked = stable(rows), stable(asked)  # read once a round: vectors are not made anew each time
    size = asked.agg(F.sum(F.greatest(F.size("vector"), F.lit(0)) * 8 + 64)).first()[0] or 0
    rounds = -(-size // query_bytes) or 1
    schema = T.StructType([asked.schema["query"], rows.schema["id"], T.StructField("score", T.DoubleType())])
    found = None
    for r in range(rounds):
        block = asked.where(F.pmod(F.xxhash64("query"), F.lit(rounds)) == r) if rounds > 1 else asked
        kind = rows.schema["id"].dataType
        near = rows.mapInArrow(_cast(_nearest(block.toArrow(), k, threshold, others), kind), schema)
        found = near if found is None else found.unionByName(near)
    order = Window.partitionBy("query").orderBy(F.round("score", 12).desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("score", F.round("score", 6))


def _cast(run, kind: T.DataType):
    """The same with ids of the given type, also where a task finds none."""
    to = to_arrow_type(kind)

    def typed(batches):
        for b in run(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(to), b.column(2)], names=b.schema.names)

    return typed


def token_bucket(token: Column) -> Column:
    """FNV-1a-64 of the lower-cased token modulo 256, which needs only the low bytes of offset and prime."""
    bytes_ = F.filter(F.split(F.lower(token), ""), lambda c: c != "")  # tokens are ASCII
    return F.aggregate(bytes_, F.lit(37), lambda h, c: (h.bitwiseXOR(F.ascii(c)) * 179) % 256)


def token_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, n) of the texts' tokens; a token is hashed once however often it stands anywhere."""
    found = texts.select(key, F.explode(tokens(F.col(text))).alias("_t")).groupBy(key, "_t").agg(F.count(F.lit(1)).alias("_c"))
    hashed = found.select("_t").distinct().withColumn("bucket", token_bucket(F.col("_t")))
    return found.join(hashed, "_t").groupBy(key, "bucket").agg(F.sum("_c").alias("n"))


_TOKEN = re.compile(r"[A-Za-z0-9_-]+")  # as in rules.tokens
KNOWN = 1 << 18  # tokens whose buckets a task remembers


def _bucket(token: str) -> int:
    h = 0xCBF29CE484222325
    for byte in token.lower().encode():
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def token_vectors(texts: DataFrame, key: str, text: str, buckets: int = 256) -> DataFrame:
    """(key, vector): counts by bucket; texts without tokens have no row. Nothing is shuffled but the texts of keys that stand again."""
    kind = texts.schema[key]
    if not texts.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").isEmpty():
        texts = texts.groupBy(key).agg(F.array_join(F.collect_list(text), " ").alias(text))

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            keys, rows = [], []
            for n, t in enumerate(batch.column(1)):
                found = Counter(_TOKEN.findall(t.as_py() or ""))
                if not found:
                    continue
                if len(known) > KNOWN:
                    known.clear()
                for token in found:
                    if token not in known:
                        known[token] = _bucket(token) % buckets
                keys.append(n)
                rows.append(np.bincount([known[x] for x in found], list(found.values()), buckets))
            if keys:
                flat = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * buckets, np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), flat], names=[key, "vector"])

    return texts.select(key, text).mapInArrow(run, T.StructType([kind, T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def recurrence(new: DataFrame, prior: DataFrame, threshold: float = 0.6, others: bool = False) -> DataFrame:
    """(query, id, score): the nearest prior text (id, text) of each new one (query, text), if it is near enough."""
    return top_k(token_vectors(new, "query", "text"), token_vectors(prior, "id", "text"), 1, threshold, others=others).drop("rank")


def related(touches: DataFrame, hub: int = 5, cap: int = 8) -> DataFrame:
    """(item, related): items that share an entity with an item, entities of more than `hub` items left out; first `cap` in order.

    Self-joins stay linear: an entity has at most `hub` items when it comes to the join."""
    distinct = touches.select("item", "entity").distinct()
    live = distinct.groupBy("entity").agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") <= hub) & (F.col("_n") > 1)).select("entity")
    kept = distinct.join(live, "entity")
    pairs = kept.join(kept.withColumnRenamed("item", "related"), "entity").where("item <> related").select("item", "related").distinct()
    order = Window.partitionBy("item").orderBy("related")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


WEIGHTS = {"phrase": 2, "term": 1, "semantic": 2, "provenance": 2}


def votes(hits: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """(query, item, vote, score) of hits (query, item, source, score): each source votes once an item."""
    w = WEIGHTS if weights is None else weights
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in w.items() for x in kv))[F.col("source")], F.lit(0))
    once = hits.groupBy("query", "item", "source").agg(F.max("score").alias("score"))
    return once.groupBy("query", "item").agg(F.sum(weight).alias("vote"), F.max("score").alias("score"))


def band(hits: DataFrame, share: float = 0.8, least: float = 0.4) -> DataFrame:
    """Semantic hits near the best one of their query, if that one is good enough."""
    best = F.max("score").over(Window.partitionBy("query"))
    return hits.withColumn("_m", best).where((F.col("_m") >= least) & (F.col("score") >= share * F.col("_m"))).drop("_m")


def prune(voted: DataFrame) -> DataFrame:
    """Where any item of a query has two votes or more, only such items."""
    best = F.max("vote").over(Window.partitionBy("query"))
    return voted.withColumn("_m", best).where("_m < 2 OR vote >= 2").drop("_m")


def similar_items(hits: DataFrame, cap: int = 5, share: float = 0.8, least: float = 0.4) -> DataFrame:
    """(query, item, vote, score, rank): banded, voted, pruned, the first `cap`."""
    semantic = band(hits.where("source = 'semantic'"), share, least)
    voted = prune(votes(semantic.unionByName(hits.where("source <> 'semantic'"))))
    order = Window.partitionBy("query").orderBy(F.desc("vote"), F.desc("score"), "item")
    return voted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def probe_terms(text: Column, n: int = 3, least: int = 5) -> Column:
    """The n longest tokens of at least `least` characters, longest first, repeats next to each other once."""
    long = F.filter(tokens(text), lambda t: F.length(t) >= least)
    keyed = F.transform(long, lambda t, i: F.struct((-F.length(t)).alias("l"), i.alias("i"), t.alias("t")))
    ordered = F.transform(F.array_sort(keyed), lambda s: s["t"])
    return F.slice(F.filter(ordered, lambda t, i: (i == 0) | (t != F.element_at(ordered, F.greatest(i, F.lit(1))))), 1, n)


def scores(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """(probe, precision, recall, f1) of (probe, item) sets; a probe of either side counts."""
    a, b = retrieved.select("probe", "item").distinct().withColumn("_a", F.lit(1)), relevant.select("probe", "item").distinct().withColumn("_b", F.lit(1))
    per = a.join(b, ["probe", "item"], "full").groupBy("probe").agg(F.sum(F.col("_a") * F.col("_b")).alias("hit"), F.sum("_a").alias("got"), F.sum("_b").alias("want")).fillna(0)
    p = F.when(F.col("got") > 0, F.col("hit") / F.col("got")).otherwise(0.0)
    r = F.when(F.col("want") > 0, F.col("hit") / F.col("want")).otherwise(0.0)
    return per.select("probe", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def macro_f1(scored: DataFrame) -> DataFrame:
    return scored.agg(F.round(F.avg("f1"), 3).alias("macro_f1"), F.count(F.lit(1)).alias("probes"))
