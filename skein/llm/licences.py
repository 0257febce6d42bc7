"""Licence scans: Dice coefficient over word bigrams between text and licence templates.

Words are runs of ASCII letters, digits and non-ASCII bytes of the lower-cased text. A
template is looked for in the whole text and in every window of as many words as it has, so
a notice inside a longer text is found. Size bounds prune: a text of b distinct bigrams can
reach a coefficient t against a distinct bigrams only if t / (2 - t) * a <= b, a template only
where the text holds that many of its bigrams, and a window only where it does. Windows slide with
running counts of distinct and of shared bigrams.

A licence can have several templates (`name` and `name/form`) and is found by its best. All
licences at or over the threshold are returned, best first.

Defined results: null or empty texts, and texts under two words, match nothing; ties go to
the higher coefficient, then the longer template, then the earlier place, then the template's
name; an empty table gives an empty result; no templates match nothing. Texts of any length are
scanned whole, those over 4 MB alone in their slice. Input columns named like an output give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm import textops as X
from skein.llm.licence_texts import TEMPLATES

_FOUND = T.ArrayType(T.StructType([T.StructField("licence", T.StringType()), T.StructField("template", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("first_word", T.LongType())]))
_KINDS = (pa.int64(), pa.list_(pa.struct([("licence", pa.string()), ("template", pa.string()), ("dice", pa.float64()), ("first_word", pa.int64())])))
ADDED = ("n_words", "licence", "dice", "first_word", "n_found", "found")


def _words(texts: pa.Array):
    data, offsets = X.buffer_of(texts)
    low = X.LOWER[data]
    starts, ends, at = X.tokens(low, offsets, X.ALNUM)
    return X.word_hashes(low, starts, ends), at


def from_table(templates: DataFrame, most_bytes: int = 32 << 20) -> dict[str, str]:
    """Templates of a table (name, text), refused beyond a size that every task can hold."""
    size = templates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of templates, over {most_bytes}")
    return {r["name"]: r["text"] for r in templates.where("name IS NOT NULL AND text IS NOT NULL").select("name", "text").collect()}


class Compiled:
    """Templates of at least two words: their names, sizes in words and distinct bigrams, and which templates hold each bigram."""

    def __init__(self, templates: dict[str, str]):
        hashes, at = _words(pa.array([templates[n] for n in sorted(templates)], pa.string()))
        self.names, self.words, self.grams = [], [], []
        for i, name in enumerate(sorted(templates)):
            h = hashes[at[i] : at[i + 1]]
            if len(h) >= 2:
                self.names.append(name)
                self.words.append(len(h))
                self.grams.append(np.unique(X.window_hashes(h, np.arange(len(h) - 1), 2)))
        self.sizes = np.array([len(g) for g in self.grams], np.int64)
        flat = np.concatenate(self.grams) if self.grams else np.zeros(0, np.uint64)
        self.every, member = np.unique(flat, return_inverse=True)
        order = np.argsort(member, kind="stable")
        self.holders = np.repeat(np.arange(len(self.grams)), self.sizes)[order]
        self.holder_at = np.concatenate([[0], np.cumsum(np.bincount(member, minlength=len(self.every)))]).astype(np.int64)


def best_window(own: np.ndarray, grams: np.ndarray, size: int, least: float) -> tuple[float, int]:
    """The best coefficient of any window of `size` bigrams, and its first: counts slide along the text."""
    n, need = len(grams), least / (2 - least) * len(own)
    mine = own[np.minimum(np.searchsorted(own, grams), len(own) - 1)] == grams
    held = np.concatenate([[0], np.cumsum(mine)])
    spots = np.flatnonzero(held[size:] - held[:-size] >= need)  # repeats count: an upper bound of what is shared
    if not len(spots):
        return -1.0, 0
    _, kind = np.unique(grams[spots[0] : spots[-1] + size], return_inverse=True)
    base = int(spots[0])
    # a bigram is new in a window where its last place before is outside it
    order = np.argsort(kind, kind="stable")
    before = np.full(len(kind), -1, np.int64)
    same = kind[order][1:] == kind[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    best = (-1.0, 0)
    lows = spots - base
    for cut in range(0, len(lows), 4096):  # distinct bigrams of some thousand windows at a time
        part = lows[cut : cut + 4096]
        step = max(1, (1 << 22) // size)
        for at in range(0, len(part), step):
            here = part[at : at + step]
            places = here[:, None] + np.arange(size)
            fresh = before[places] < here[:, None]
            shared = (fresh & mine[base + places]).sum(axis=1)
            d = 2.0 * shared / (len(own) + fresh.sum(axis=1))
            top = int(np.argmax(d))
            if d[top] > best[0]:
                best = (float(d[top]), int(here[top]) + base)
    return best


def scan(hashes: np.ndarray, compiled: Compiled, least: float) -> list[tuple[str, float, int]]:
    """(template, coefficient, first word) of every licence found in one text, best first."""
    n = len(hashes) - 1
    if n < 1 or not len(compiled.every):
        return []
    grams = X.window_hashes(hashes, np.arange(n), 2)
    at = np.minimum(np.searchsorted(compiled.every, grams), len(compiled.every) - 1)
    hit = np.unique(at[compiled.every[at] == grams])
    if not len(hit):
        return []
    runs = compiled.holder_at[hit + 1] - compiled.holder_at[hit]
    where = np.repeat(compiled.holder_at[hit] - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(int(runs.sum()))
    shared = np.bincount(compiled.holders[where], minlength=len(compiled.sizes))
    likely = np.flatnonzero(shared >= least / (2 - least) * compiled.sizes)
    if not len(likely):
        return []
    whole, found = len(np.unique(grams)), {}
    for t in likely.tolist():
        own, size = compiled.grams[t], min(compiled.words[t] - 1, n)
        d, first = best_window(own, grams, size, least)
        if 2 * shared[t] / (len(own) + whole) > d:
            d, first = 2 * shared[t] / (len(own) + whole), 0
        name = compiled.names[t].split("/")[0]
        if d >= least:
            found[name] = min(found.get(name, (1.0,)), (-d, -compiled.words[t], first, compiled.names[t]))
    return [(x[3], round(-x[0], 6), x[2]) for x in sorted(found.values())]


def licences(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """docs plus n_words, the best licence (null: none), its coefficient and first word, n_found, and found: every licence with its template, coefficient and first word."""
    compiled = Compiled(TEMPLATES if templates is None else templates)
    own = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("found", _FOUND)])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for a, b in X.slices(np.diff(X.buffer_of(texts)[1]), 4 << 20):
                hashes, at = _words(texts.slice(a, b - a))
                found = [[{"licence": t.split("/")[0], "template": t, "dice": d, "first_word": w} for t, d, w in scan(hashes[at[i] : at[i + 1]], compiled, least)] for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(np.diff(at), _KINDS[0]), pa.array(found, _KINDS[1])], names=[*batch.schema.names, "n_words", "found"])

    best = F.get(F.col("found"), F.lit(0))
    out = rows.mapInArrow(run, schema).select("row", "n_words", best.getField("licence").alias("licence"), best.getField("dice").alias("dice"), best.getField("first_word").alias("first_word"), F.size("found").cast("long").alias("n_found"), "found")
    return out.select(*(F.col("row").getField(c).alias(c) for c in own), *ADDED)


def report(docs: DataFrame) -> DataFrame:
    return licences(docs.select("doc_id", "text")).drop("text", "found")
