"""Benchmark decontamination: a broadcast hash set of item n-grams, scanned over every window.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. An item's
windows are its n-grams, or all its words where it has fewer. The set is kept as flat arrays: the
items' normalised text once, and for every window its hash and where it stands. A hash hit is
verified by the words themselves.

The set is broadcast only in parts of at most `part_bytes` of these arrays. A larger benchmark is
dealt into parts by item, and the parts are built, broadcast, scanned for and let go one at a
time; each pass keeps only the rows that it hits, which are merged by row at the end.

Defined results: null or empty texts have no words and are never contaminated; null items
have no windows; repeated item ids count once; an empty benchmark or table hits nothing. One
text must fit a task; long ones are scanned alone. Columns of the input named like an output
give way; any other names are allowed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm import textops as X
from skein.scratch import settle

OUT = ("n_words", "n_hit", "spans", "items", "contaminated", "clean_text")


def words(texts: pa.Array):
    """Lower-cased bytes, word starts and ends, the texts' words, and the texts' bytes."""
    data, offsets = X.buffer_of(texts)
    low = X.LOWER[data]
    return low, *X.tokens(low, offsets, X.ALNUM), offsets


def build(names: list[str], texts: pa.Array, n: int) -> dict:
    """By length: distinct windows in order of their hash, where each stands, and its items; and the items' words joined by spaces."""
    low, starts, ends, at, _ = words(texts)
    hashes = X.word_hashes(low, starts, ends)
    sizes = ends - starts
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])  # of each word in the joined text
    joined = np.full(int(begin[-1]), 0x20, np.uint8)
    joined[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = low[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
    lengths, tables = np.minimum(np.diff(at), n), {}
    item_of = np.repeat(np.arange(len(names), dtype=np.int32), np.diff(at))
    for k in np.unique(lengths[lengths > 0]).tolist():
        here = X.windows(at, k)
        here = here[lengths[item_of[here]] == k]
        one, two, item = X.window_hashes(hashes, here, k), X.window_hashes(X.mix(hashes + np.uint64(77)), here, k, 1), item_of[here]
        order = np.lexsort((item, two, one))  # equal windows once, with each item that holds them once
        one, two, item, here = one[order], two[order], item[order], here[order]
        head = np.ones(len(here), bool)
        head[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        fresh = head.copy()
        fresh[1:] |= item[1:] != item[:-1]
        first = here[head]
        item_at = np.append(np.concatenate([[0], np.cumsum(fresh)])[:-1][head], fresh.sum())
        tables[k] = (one[head], begin[first], (begin[first + k] - 1 - begin[first]).astype(np.int32), item_at, item[fresh])
    return {"names": names, "text": joined, "tables": tables}


def index_bytes(index: dict) -> int:
    return index["text"].nbytes + sum(a.nbytes for t in index["tables"].values() for a in t) + sum(64 + len(x) for x in index["names"])


#: Bytes of index that an item of so many bytes can need: its text, 32 bytes a word for words of one letter, and its name.
INDEX_BYTES = (18, 160)


def scan(texts: pa.Array, index: dict):
    """For each text: words, merged spans of hit words, and the items hit."""
    low, starts, ends, at, _ = words(texts)
    hashes = X.word_hashes(low, starts, ends)
    mask = np.zeros(len(starts), bool)
    items: dict[int, set] = {}
    for k, (known, begin, size, item_at, item) in index["tables"].items():
        here = X.windows(at, k)
        if not len(here):
            continue
        got = X.window_hashes(hashes, here, k)
        first = np.searchsorted(known, got)
        hit = known[np.minimum(first, len(known) - 1)] == got
        here, first, last = here[hit], first[hit], np.searchsorted(known, got[hit], side="right")
        sure, seen = [], set()
        for j, d, a, b in zip(here.tolist(), (np.searchsorted(at, here, side="right") - 1).tolist(), first.tolist(), last.tolist()):
            own = low[starts[j] : ends[j + k - 1]] if k == 1 else np.frombuffer(b" ".join(low[starts[i] : ends[i]].tobytes() for i in range(j, j + k)), np.uint8)
            for x in range(a, b):
                if size[x] == len(own) and (index["text"][begin[x] : begin[x] + size[x]] == own).all():
                    sure.append(j)
                    if (d, x) not in seen:
                        seen.add((d, x))
                        items.setdefault(d, set()).update(item[item_at[x] : item_at[x + 1]].tolist())
        if sure:
            mask |= X.covered(len(starts), np.array(sure), k)
    hits = np.concatenate([[0], np.cumsum(mask)])
    for d in range(len(at) - 1):
        a, b = int(at[d]), int(at[d + 1])
        spans = []
        if hits[b] > hits[a]:
            edge = np.diff(np.concatenate([[False], mask[a:b], [False]]).astype(np.int8))
            spans = [[int(x), int(y)] for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
        yield b - a, spans, sorted({index["names"][i] for i in items.get(d, ())})


def merged(spans: list) -> list:
    """Spans in order, those that overlap or touch as one."""
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def cut_spans(raw: bytes, starts: np.ndarray, ends: np.ndarray, spans: list) -> str:
    """raw without the bytes from the first to the last word of each span."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : int(starts[a])])
        at = int(ends[b - 1])
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8", "replace")


_SPANS = pa.list_(pa.list_(pa.int32()))
_FOUND = {"n_words": pa.int64(), "n_hit": pa.int64(), "spans": _SPANS, "items": pa.list_(pa.string()), "clean_text": pa.string()}


def _results(texts: pa.Array, found: list, cut: bool) -> list[pa.Array]:
    """The output columns of rows of (words, spans, items)."""
    cols = [[n for n, _, _ in found], [sum(b - a for a, b in s) for _, s, _ in found], [s for _, s, _ in found], [i for _, _, i in found]]
    if cut:
        low, starts, ends, at, offsets = words(texts)
        data = X.buffer_of(texts)[0]
        cols.append([cut_spans(data[offsets[d] : offsets[d + 1]].tobytes(), starts[at[d] : at[d + 1]] - offsets[d], ends[at[d] : at[d + 1]] - offsets[d], found[d][1]) for d in range(len(found))])
    return [pa.array(c, t) for c, t in zip(cols, _FOUND.values())]


def _mapped(rows: DataFrame, added: list[T.StructField], results) -> DataFrame:
    """rows (whose column `text` is read) plus what results(batch) gives, some MB of text at a time."""

    def run(batches):
        for batch in batches:
            for a, b in X.slices(np.diff(X.buffer_of(batch.column(batch.schema.get_field_index("text")))[1]), 4 << 20):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *results(part)], names=[*part.schema.names, *(f.name for f in added)])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = 13, share: int = 20, cut: bool = False, part_bytes: int = 64 << 20) -> DataFrame:
    """docs plus n_words, n_hit, spans, items, contaminated (n_hit > 0 and share * n_hit >= n_words) and, if cut, clean_text."""
    context = docs.sparkSession.sparkContext
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col("text").cast("string").alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull())
    size = items.agg(F.sum(F.octet_length("t") * INDEX_BYTES[0] + F.octet_length("i") + INDEX_BYTES[1])).first()[0] or 0
    parts = -(-int(size) // part_bytes) or 1
    own = [c for c in docs.columns if c not in OUT]
    kinds = [T.LongType(), T.LongType(), T.ArrayType(T.ArrayType(T.IntegerType())), T.ArrayType(T.StringType()), T.StringType()]
    added = [T.StructField(c, t) for c, t in zip(_FOUND, kinds)][: 5 if cut else 4]
    # the input's columns travel in one struct, so that no name of theirs meets one of these
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col(text_col).cast("string").alias("text"))

    def part(p: int):
        one = items if parts == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == p)
        table = one.toArrow()
        return context.broadcast(build(table.column("i").to_pylist(), table.column("t"), n))

    text = lambda batch: batch.column(batch.schema.get_field_index("text"))
    if parts == 1:
        index = part(0)
        out = _mapped(rows, added, lambda batch: _results(text(batch), list(scan(text(batch), index.value)), cut))
    else:
        rows = settle(rows.withColumn("at", F.monotonically_increasing_id()))
        found = None
        for p in range(parts):
            index = part(p)
            one = _mapped(rows.select("at", "text"), added[2:4], lambda batch, index=index: [pa.array(c, t) for c, t in zip(list(zip(*((s, i) for _, s, i in scan(text(batch), index.value)))) or [(), ()], list(_FOUND.values())[2:4])])
            one = settle(one.where(F.size("spans") > 0).select("at", "spans", "items"))
            index.unpersist()
            found = one if found is None else found.unionByName(one)
        found = found.groupBy("at").agg(F.flatten(F.collect_list("spans")).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("which"))
        met = rows.join(found, "at", "left")

        def finish(batch):
            at = X.tokens(*_low(text(batch)), X.ALNUM)[2]
            all_spans, which = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("all", "which"))
            return _results(text(batch), [(int(n_words), merged(s or []), i or []) for n_words, s, i in zip(np.diff(at), all_spans, which)], cut)

        out = _mapped(met, added, finish)
    return out.select(*(F.col("row").getField(c).alias(c) for c in own), *(f.name for f in added), ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def _low(texts: pa.Array):
    data, offsets = X.buffer_of(texts)
    return X.LOWER[data], offsets


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = contamination(docs.select("doc_id", "text"), benchmark)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM g),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS t FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN g ON dw.k = g.k AND dw.t = g.t),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(its.s, '')) AS items_sha256,
       coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
