"""Substring dedup over words: fixed-block anchors, rolling probes, extension to exact repeats.

A window is `window` consecutive words of one document; each word covered by a window whose
words also start anywhere else, in the same document too, is removed. The longest block that
every window must hold whole, wherever it starts, has b = (window + 1) // 2 words. So:

1. index: the non-overlapping blocks of b words at multiples of b of every document; probe:
   every rolling window of b words of every document. Both go through the group exchange
   as one stream of packed hashes (an index block is a marked probe). A probe is hit where its
   hash is an index block's and occurs more than once.
2. extend: each window of `window` words that holds a hit is a candidate; its 96-bit hash goes
   through a second exchange, and candidates that occur more than once are repeats. Repeats
   that overlap or touch make up the maximal exact repeats, which are removed.

The first exchange may hit falsely (its keys are short), never miss; the second decides.
Linear in the corpus: no pairs of documents are formed, and a passage that a third of the
documents hold costs each group one key a window.

Defined results: null or empty texts have no words; null ids stay null; repeated rows are
separate documents; an empty table gives an empty result. A text of over two MB is a group by itself
and must fit a task, at some 60 bytes a byte. Other columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import exchange as E
from skein.llm import textops as X
from skein.scratch import settle

PROBE_BITS = 26
ASKED = "b int, g long, payload binary"
_ASKED = pa.schema([("b", pa.int32()), ("g", pa.int64()), ("payload", pa.binary())])
OUT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _rolling(data: np.ndarray, offsets: np.ndarray, block: int):
    """Word starts, ends and offsets; word hashes; rolling windows of a block and their hashes."""
    starts, ends, at = X.tokens(data, offsets, X.WORD)
    hashes = X.word_hashes(data, starts, ends)
    here = X.windows(at, block)
    return starts, ends, at, hashes, here, X.window_hashes(hashes, here, block)


def _probes(data, offsets, block, buckets):
    """A group's distinct probe keys in order, and whether each is an index block or comes twice."""
    *_, at, _, here, found = _rolling(data, offsets, block)
    first = at[np.searchsorted(at, here, side="right") - 1]
    aligned = (here - first) % block == 0
    keys = (E.placed(found, buckets, PROBE_BITS) << np.uint64(1)) | aligned.astype(np.uint64)
    keys.sort()
    places, marked = keys >> np.uint64(1), (keys & np.uint64(1)).astype(bool)
    last = np.concatenate([places[1:] != places[:-1], [True]]) if len(places) else np.zeros(0, bool)
    ends = np.flatnonzero(last)
    return places[last], marked[last], np.diff(ends, prepend=-1) > 1


def ask_blocks(docs: DataFrame, block: int, buckets: int, group_bytes: int) -> DataFrame:
    low = np.uint64((1 << PROBE_BITS) - 1)

    def run(batches):
        for g, _, texts in E.groups(batches, group_bytes):
            places, marked, twice = _probes(*X.buffer_of(texts), block, buckets)
            rows = E.split(places, PROBE_BITS)
            payloads = []
            for _, lo, hi in rows:
                flags = E.bits(marked[lo:hi]) + E.bits(twice[lo:hi])
                payloads.append((hi - lo).to_bytes(4, "little") + flags + E.pack_differences(places[lo:hi] & low))
            yield pa.RecordBatch.from_pydict({"b": [r[0] for r in rows], "g": [g] * len(rows), "payload": payloads}, _ASKED)

    return docs.mapInArrow(run, ASKED)


def _answer(keys: list[np.ndarray], twice: list[np.ndarray], marked: list[np.ndarray] | None) -> list[bytes]:
    """A bit for each key that occurs more than once overall and, with marked, is a marked one somewhere."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    group = np.cumsum(head) - 1
    many = np.bincount(group) > 1
    many |= np.bincount(group, np.concatenate(twice)[order]) > 0
    if marked is not None:
        many &= np.bincount(group, np.concatenate(marked)[order]) > 0
    mask = np.empty(len(every), bool)
    mask[order] = many[group]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return [E.bits(m) for m in np.split(mask, cuts)]


def resolve_blocks(payloads: list[bytes], _groups) -> list[bytes]:
    keys, marked, twice = [], [], []
    for p in payloads:
        n = int.from_bytes(p[:4], "little")
        size = -(-n // 8)
        marked.append(E.unbits(p[4 : 4 + size], n))
        twice.append(E.unbits(p[4 + size : 4 + 2 * size], n))
        keys.append(E.unpack_differences(p[4 + 2 * size :]))
    return _answer(keys, twice, marked)


def _candidates(row: dict, told: list[dict], window: int, block: int, buckets: int):
    """The group's candidate windows and their 96-bit hashes, as (bucket, high 64, low 32) in order."""
    ids, null, data, offsets = E.opened(row)
    starts, ends, at, hashes, here, found = _rolling(data, offsets, block)
    places, _, _ = _probes(data, offsets, block, buckets)
    hit = E.gather([t for t in told if t["round"] == 1], E.split(places, PROBE_BITS), len(places))
    mine = hit[np.searchsorted(places, E.placed(found, buckets, PROBE_BITS))] if len(places) else np.zeros(0, bool)
    n = len(starts)
    seen = np.zeros(n + 1, np.int64)
    seen[here[mine] + 1] = 1
    seen = np.cumsum(seen)
    wide = X.windows(at, window)
    wide = wide[seen[wide + window - block + 1] > seen[wide]]
    one, two = X.window_hashes(hashes, wide, window), X.window_hashes(X.mix(hashes + np.uint64(77)), wide, window, 1)
    return ids, null, data, offsets, starts, ends, at, wide, one, two & np.uint64(0xFFFFFFFF)


def _distinct(one: np.ndarray, two: np.ndarray, buckets: int):
    """Order of (bucket, one, two), heads of equal runs, and the bucket runs among the heads."""
    b = (two % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((two, one, b))
    b, one, two = b[order], one[order], two[order]
    head = np.ones(len(b), bool)
    head[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    heads = np.flatnonzero(head)
    cut = np.flatnonzero(np.diff(b[heads])) + 1 if len(heads) else heads
    runs = list(zip(b[heads][np.concatenate([[0], cut])].tolist(), [0, *cut.tolist()], [*cut.tolist(), len(heads)])) if len(heads) else []
    twice = np.diff(np.append(heads, len(b))) > 1
    return order, np.cumsum(head) - 1, heads, runs, one[heads], two[heads], twice


def ask_windows(texts: DataFrame, told: DataFrame, window: int, block: int, buckets: int) -> DataFrame:
    def run(row, got):
        *_, one, two = _candidates(row, got, window, block, buckets)
        *_, runs, high, low, twice = _distinct(one, two, buckets)
        payloads = [(hi - lo).to_bytes(4, "little") + high[lo:hi].tobytes() + low[lo:hi].astype("<u4").tobytes() + E.bits(twice[lo:hi]) for _, lo, hi in runs]
        return pa.Table.from_pydict({"b": [r[0] for r in runs], "g": [row["g"]] * len(runs), "payload": payloads}, _ASKED)

    return E.meet(texts, told, run, ASKED)


def resolve_windows(payloads: list[bytes], _groups) -> list[bytes]:
    pair = np.dtype([("a", "<u8"), ("b", "<u4")])
    keys, twice = [], []
    for p in payloads:
        n = int.from_bytes(p[:4], "little")
        key = np.empty(n, pair)
        key["a"] = np.frombuffer(p, "<u8", n, 4)
        key["b"] = np.frombuffer(p, "<u4", n, 4 + 8 * n)
        keys.append(key)
        twice.append(E.unbits(p[4 + 12 * n :], n))
    every = np.concatenate(keys)
    order = np.lexsort((every["b"], every["a"]))
    a, b = every["a"][order], every["b"][order]
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    rank = np.empty(len(a), np.uint64)
    rank[order] = (np.cumsum(head) - 1).astype(np.uint64)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return _answer(np.split(rank, cuts), twice, None)


def _finish(row: dict, told: list[dict], window: int, block: int, buckets: int, with_text: bool) -> pa.Table:
    ids, null, data, offsets, starts, ends, at, wide, one, two = _candidates(row, told, window, block, buckets)
    order, member, heads, runs, *_ = _distinct(one, two, buckets)
    repeated = E.gather([t for t in told if t["round"] == 2], runs, len(heads))
    again = np.zeros(len(wide), bool)
    again[order] = repeated[member]
    gone = X.covered(len(starts), wide[again], window)
    total = np.concatenate([[0], np.cumsum(gone)])
    opens = np.concatenate([[0], np.cumsum(gone & ~np.concatenate([[False], gone[:-1]]))]) if len(gone) else np.zeros(1, int)
    out = {f.name: [] for f in _OUT}
    raw = data.tobytes()
    for d in range(len(ids)):
        a, b = int(at[d]), int(at[d + 1])
        lost = int(total[b] - total[a])
        words = raw[offsets[d] : offsets[d + 1]].split()
        if lost:
            words = [w for w, x in zip(words, gone[a:b].tolist()) if not x]
        kept = b" ".join(words)
        out["doc_id"].append(None if null[d] else int(ids[d]))
        out["n_words"].append(b - a)
        out["n_removed"].append(lost)
        out["n_spans"].append(int(opens[b] - opens[a]) + int(bool(b > a and a > 0 and gone[a] and gone[a - 1])))
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        out["kept_text"].append(kept.decode("utf-8", "replace") if with_text else None)
    return pa.Table.from_pydict(out, _OUT)


def dedup_passages(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans (maximal removed runs), kept_sha256 and kept_text of every row."""
    block = (window + 1) // 2
    rows = E.scan_order(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    buckets, group_bytes = E.sizing(rows)
    blocks = settle(E.answers(ask_blocks(rows, block, buckets, group_bytes), resolve_blocks).withColumn("round", F.lit(1)))
    texts = E.packed(rows, group_bytes)
    repeats = E.answers(ask_windows(texts, blocks, window, block, buckets), resolve_windows).withColumn("round", F.lit(2))
    return E.meet(texts, blocks.unionByName(repeats), lambda row, told: _finish(row, told, window, block, buckets, with_text), OUT)


def report(docs: DataFrame) -> DataFrame:
    return dedup_passages(docs, with_text=False).drop("kept_text")


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS t FROM (SELECT *, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
r AS (SELECT t FROM g GROUP BY t HAVING count(*) > 1),
h AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM g SEMI JOIN r USING (t))),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
k AS (SELECT x.doc_id, count(h.p) AS n, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE h.p IS NULL) AS s,
             count(*) FILTER (WHERE h.p IS NOT NULL AND b.p IS NULL) AS runs
      FROM x LEFT JOIN h USING (doc_id, p) LEFT JOIN h b ON b.doc_id = x.doc_id AND b.p = x.p - 1 GROUP BY x.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
