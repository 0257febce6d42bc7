"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's subwords are the byte n-grams (3 to 5) of `<word>`, lower-cased, hashed to buckets,
so an unseen misspelling or ending shares vectors with the words it was made from. A word is
the mean of its subwords' vectors under a linear softmax; a document's score is the mean logit of
its `TOP` most toxic words, so a few words in a long text are not averaged away and one chance
likeness is not enough. Training alternates: first every word of a toxic document counts as toxic,
later only those that score as such and the highest one, against every word of clean documents. A
fifth of the sample is kept out of that and calibrates document scores.

The model is fitted on at most `max_rows` toxic and twice as many clean labelled documents, chosen
by a hash of the id, of which whole texts are taken in that order up to `max_bytes` a class: both
are documented bounds, so what reaches the driver does not grow with the corpus. Scoring covers
all of every text. Only text is an input of a score.

Defined results: null and empty texts score as made of usual clean words; labels that are null or
not 0/1, and null ids, are ignored; a document with both labels counts as toxic; of rows that
repeat an id the largest text is the example; without labelled rows of both classes every score is
the prior (0.5 without any label). One text must fit a task. Columns of the input named like an
output give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm import textops as X
from skein.llm.exchange import relieve

GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
MAX_ROWS = 1000
MAX_BYTES = 16 << 20
THRESHOLD = 0.7
TOP = 3
RARE = 10.0


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of the n-grams of each word, and the len+1 offsets of the words' n-grams; made over `most` words at a time."""
    parts = [_subwords(data, starts[i : i + most], ends[i : i + most]) for i in range(0, len(starts), most)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts]))])


def _subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of the words' n-grams, word by word, and how many each has."""
    lengths = (ends - starts) + 2
    at = np.concatenate([[0], np.cumsum(lengths)])
    padded = np.empty(int(at[-1]), np.uint8)
    padded[at[:-1]] = ord("<")
    padded[at[1:] - 1] = ord(">")
    inner = np.ones(len(padded), bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    flat = np.repeat(starts - at[:-1] - 1, lengths) + np.arange(len(padded))
    padded[inner] = data[flat[inner]]
    sums = X.byte_sums(padded)
    word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(padded)) - at[:-1][word]
    ids, owner = [], []
    for n in GRAMS:
        ok = np.flatnonzero(place + n <= lengths[word])
        ids.append((X.mix(X.range_hash(sums, ok, ok + n) + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32))
        owner.append(word[ok])
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.bincount(owner, minlength=len(lengths))


def vocabulary(texts: pa.Array):
    """Distinct words' subwords, each word's place among them, and the words' offsets by text."""
    data, offsets = X.buffer_of(texts)
    low = X.LOWER[data]
    starts, ends, at = X.tokens(low, offsets, X.ALNUM)
    hashes = X.word_hashes(low, starts, ends)
    _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    grams, gram_at = subwords(low, starts[first], ends[first])
    return grams, gram_at, word, at


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges between offsets; empty ranges are 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def train(texts: list[str], toxic: list[int], dims: int = 4, epochs: int = 60, seed: int = 5) -> dict:
    """Per-bucket logits (the embeddings times the difference of the softmax's two rows), bias, and calibration."""
    y = np.array(toxic, np.int64)
    prior = float(y.mean()) if len(y) else 0.5
    bias = float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
    flat = {"bucket": np.zeros(BUCKETS, np.float32), "bias": bias, "floor": bias, "scale": 1.0, "shift": 0.0}
    if not len(y) or y.min() == y.max():
        return flat
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(y), bool)
    for kind in (0, 1):
        own = np.flatnonzero(y == kind)
        aside[rng.permutation(own)[: len(own) // 5]] = True
    model = _fit([t for t, x in zip(texts, aside) if not x], y[~aside], dims, epochs, rng)
    if model is None:
        return flat
    sample = aside if aside.any() and len(set(y[aside])) == 2 else np.ones(len(y), bool)
    z = worst(pa.array([t for t, x in zip(texts, sample) if x], pa.large_string()), model)
    return model | calibrate(z, y[sample])


def calibrate(z: np.ndarray, y: np.ndarray) -> dict:
    """Scale and shift of a logistic curve through documents' logits; both classes weigh the same."""
    scale = max(float(z.std()), 1e-6)
    x, a, b = (z - z.mean()) / scale, 1.0, 0.0
    weight = np.where(y == 1, 1.0 / max((y == 1).sum(), 1), 1.0 / max((y == 0).sum(), 1))
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = (p - y) * weight
        a, b = a - 4 * (float(g @ x) + 1e-3 * a), b - 4 * float(g.sum())
        a = max(a, 1e-3)
    return {"scale": a / scale, "shift": b - a * float(z.mean()) / scale}


class Spread:
    """n rows, each the sum of the rows of[i] over all i of which to[i] is its number; `to` is put in order once."""

    def __init__(self, to: np.ndarray, of: np.ndarray, n: int):
        order = None if (np.diff(to) >= 0).all() else np.argsort(to, kind="stable")
        self.of = of if order is None else of[order]
        counts = np.bincount(to, minlength=n)
        self.full = np.flatnonzero(counts)
        self.at = np.concatenate([[0], np.cumsum(counts[self.full])])
        self.n = n

    def __call__(self, rows: np.ndarray, most: int = 1 << 19) -> np.ndarray:
        out = np.zeros((self.n, rows.shape[1]), np.float32)
        low = 0
        while low < len(self.full):  # a part at a time, so that memory does not follow the sample
            high = max(low + 1, int(np.searchsorted(self.at, self.at[low] + most, side="right")) - 1)
            base = self.at[low]
            out[self.full[low:high]] = np.add.reduceat(rows[self.of[base : self.at[high]]], self.at[low:high] - base, axis=0)
            low = high
        return out


def _fit(texts: list[str], y: np.ndarray, dims: int, epochs: int, rng) -> dict | None:
    """Joint gradient descent on embeddings and softmax, over the distinct words of each document."""
    grams, gram_at, word, at = vocabulary(pa.array(texts, pa.large_string()))
    if not len(word) or y.min() == y.max():
        return None
    n_grams = np.diff(gram_at)
    pairs = np.unique(np.repeat(np.arange(len(y)), np.diff(at)) * len(n_grams) + word)
    doc, word = pairs // len(n_grams), pairs % len(n_grams)
    first = np.flatnonzero(np.diff(doc, prepend=-1))  # each document's first pair
    used = np.flatnonzero(np.bincount(grams, minlength=BUCKETS))
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    grams = place[grams]
    gram_word = np.repeat(np.arange(len(n_grams), dtype=np.int32), n_grams)
    to_words, from_words = Spread(gram_word, grams, len(n_grams)), Spread(grams, gram_word, len(used))
    size = np.maximum(n_grams, 1).astype(np.float32)[:, None]
    w = rng.normal(0, 1.0, (dims, 2)).astype(np.float32)
    e, b = np.zeros((len(used), dims), np.float32), np.zeros(2, np.float32)
    params = [e, w, b]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    clean = y[doc] == 0
    chosen = ~clean
    for epoch in range(epochs):
        mean = to_words(e) / size
        z = mean @ w + b
        p = (1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -60, 60))))[word]  # the softmax's share of the toxic class
        if epoch >= epochs // 3:  # from here on a toxic document speaks through its worst words
            best = np.repeat(np.maximum.reduceat(p, first), np.diff(np.append(first, len(doc))))
            chosen = ~clean & ((p >= best) | (p > 0.5))
        # clean words that look toxic weigh more
        weight = np.where(clean, (1.0 + 20.0 * p) / max(clean.sum(), 1), np.where(chosen, 1.0 / max(chosen.sum(), 1), 0.0)) / 2
        g = np.bincount(word, weight * (p - ~clean), len(n_grams)).astype(np.float32)
        g = np.stack([-g, g], axis=1)
        for i, grad in enumerate((from_words((g @ w.T) / size), mean.T @ g, g.sum(axis=0))):
            m1[i] += 0.1 * (grad - m1[i])
            m2[i] += 0.02 * (grad * grad - m2[i])
            step = 0.12 * (m1[i] / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(m2[i] / (1 - 0.98 ** (epoch + 1))) + 1e-9)
            params[i] -= step
    # a subword of few documents says little: its logit shrinks
    seen = from_words(np.bincount(word, minlength=len(n_grams)).astype(np.float32)[:, None])[:, 0]
    out = np.zeros(BUCKETS, np.float32)
    out[used] = (e @ (w[:, 1] - w[:, 0])) * seen / (seen + RARE)
    bias = float(b[1] - b[0])
    usual = (to_words(out[used][:, None]) / size)[:, 0] + bias
    return {"bucket": out, "bias": bias, "floor": float(usual[word[clean]].mean())}


def worst(texts: pa.Array, model: dict, top: int = TOP) -> np.ndarray:
    """The mean logit of every text's `top` most toxic words; missing ones count as a usual clean word."""
    grams, gram_at, word, at = vocabulary(texts)
    if not len(word):
        return np.full(len(texts), model["floor"])
    per_word = _sums(model["bucket"][grams].astype(np.float64), gram_at) / np.maximum(np.diff(gram_at), 1) + model["bias"]
    n = np.diff(at)
    own = np.repeat(np.arange(len(n)), n)
    logit = per_word[word]
    logit = logit[np.lexsort((-logit, own))]  # words stay in their text's range
    first = np.arange(len(own)) - at[:-1][own] < top
    return (np.bincount(own[first], logit[first], len(n)) + np.maximum(top - n, 0) * model["floor"]) / top


def scores(texts: pa.Array, model: dict) -> np.ndarray:
    """The calibrated score of every text."""
    return 1 / (1 + np.exp(-np.clip(model["scale"] * worst(texts, model) + model["shift"], -60, 60)))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> dict:
    """A model from at most max_rows toxic and 2 * max_rows clean labelled documents that are not held out, and max_bytes of text of each."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("_i"), F.col("toxic").cast("int").alias("_t")).where(F.col("_i").isNotNull() & F.col("_t").isin(0, 1) & ~held_out("_i"))
    known = known.groupBy("_i").agg(F.max("_t").alias("_t"))
    picked = []
    for kind in (0, 1):
        picked += [(r["_i"], kind) for r in known.where(F.col("_t") == kind).orderBy(F.xxhash64("_i"), "_i").limit(max_rows * (2 - kind)).collect()]
    if not picked:
        return train([], [])
    chosen = spark.createDataFrame(picked, "_i long, _t int")  # at most 3 * max_rows ids
    rows = docs.select(F.col(id_col).cast("long").alias("_i"), F.col(text_col).cast("string").alias("_x")).join(F.broadcast(chosen), "_i").where(F.col("_x").isNotNull())
    rows = rows.groupBy("_i").agg(F.max("_x").alias("_x"), F.max("_t").alias("_t"))  # a repeated id is one example
    so_far = F.sum(F.octet_length("_x")).over(Window.partitionBy("_t").orderBy(F.xxhash64("_i"), "_i"))
    rows = rows.withColumn("_b", so_far).where(F.col("_b") <= max_bytes).select("_i", "_x", "_t").collect()
    rows.sort(key=lambda r: r["_i"])
    texts, toxic = [r["_x"] for r in rows], [r["_t"] for r in rows]
    del rows
    model = train(texts, toxic)
    relieve()
    return model


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs plus score (0 to 1) and predicted (1 where score >= threshold)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, max_rows, max_bytes))
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    # the input's columns travel in one struct, so that no name of theirs meets one of these
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for a, b in X.slices(np.diff(X.buffer_of(texts)[1]), 2 << 20):
                s = scores(texts.slice(a, b - a), model.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["row", "score", "predicted"])

    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col("row").getField(c).alias(c) for c in own), "score", "predicted")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = toxicity(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
