"""N-gram Jaccard join by adaptive multi-match prefixes, and the components of its links.

A document's set is its distinct k-word shingles (words lower-cased over A-Z; with fewer than
k words the whole sequence; without words nothing). Two documents link where the sets'
Jaccard similarity is at least `percent` / 100, in whole numbers. Equal sets are one class,
known by its smallest id; links are found between classes.

1. Order: every shingle's document frequency comes from the group exchange (a byte for those
   that more than one document holds), so all sets are sorted alike, rare shingles first. A
   shingle of one document can match nothing: it counts in the size, but is not shipped.
2. Prefixes: of n shingles, n - t + l (t = least overlap that a link needs) hold at least l
   shared ones for every link. Classes whose 1-prefix has no shared shingle are done. The
   others are grouped into coarse blocks, the components of "share a 1-prefix shingle", which
   no link leaves.
3. Join: in a block each class picks its l by estimated cost - the postings that its longer
   prefix reads, and the candidates left when l matches are required - and a pair is
   verified only if it shares min(l, l') shingles of both min(l, l')-prefixes. Verification counts
   the whole sets' overlap. Every pair of classes that links is found and counted; where only
   components are asked for (links=False), pairs already in one component are not verified.

Blocks of more than `block_tokens` shingles are cut into chunks by hash, and every pair of
chunks is a task's input, so a group of thousands of near copies is spread over many tasks;
small blocks share tasks. No pair of documents is shuffled, only sets, spanning links and one
count of links a class and task. Shingles, blocks, hubs and sets that many rows share are
aggregated where they are read or salted where they are joined.

Defined results: null or empty texts have no shingles and link with nothing; rows that repeat a
text are linked copies, those of one id one node; a null id counts as the largest and stays null
where it is its component's smallest; an empty table gives an empty result. A text of over two MB
is a group by itself and must fit a task. Other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import exchange as E
from skein.llm import textops as X
from skein.llm.components import connected, salted
from skein.scratch import settle

KEY_BITS = 30
LONGEST = 5  # largest l
_LAST = 2**63 - 1
ASKED = "b int, g long, payload binary"
_ASKED = pa.schema([("b", pa.int32()), ("g", pa.int64()), ("payload", pa.binary())])
SETS = "doc_id long, n_shingles long, k1 long, k2 long, live boolean, tokens binary"
_POSTINGS = pa.schema([("tok", pa.int64()), ("rep", pa.int64()), ("low", pa.int64())])
_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("live", pa.bool_()), ("tokens", pa.binary())])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their offsets."""
    low = X.LOWER[data]
    starts, ends, at = X.tokens(low, offsets, X.WORD)
    hashes = X.word_hashes(low, starts, ends)
    here = X.windows(at, k)
    found = X.window_hashes(hashes, here, k)
    first = np.searchsorted(here, at)
    lengths = np.diff(at)
    parts, n = [], [0]
    sums = X.range_sums(hashes)
    for d, words in enumerate(lengths.tolist()):
        if words >= k:
            parts.append(np.unique(found[first[d] : first[d + 1]]))
        elif words:
            parts.append(X.mix(X.range_hash(sums, at[d : d + 1], at[d + 1 : d + 2]) + np.uint64(words)))
        else:
            parts.append(np.zeros(0, np.uint64))
        n.append(n[-1] + len(parts[-1]))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(n)


def ask_frequencies(docs: DataFrame, k: int, buckets: int, group_bytes: int) -> DataFrame:
    low = np.uint64((1 << KEY_BITS) - 1)

    def run(batches):
        for g, _, texts in E.groups(batches, group_bytes):
            found, _ = shingle_sets(*X.buffer_of(texts), k)
            places, counts = np.unique(E.placed(found, buckets, KEY_BITS), return_counts=True)
            rows, payloads = E.split(places, KEY_BITS), []
            for _, lo, hi in rows:
                many = counts[lo:hi] > 1
                more = counts[lo:hi][many].astype("<u4")
                payloads.append((hi - lo).to_bytes(4, "little") + len(more).to_bytes(4, "little") + E.bits(many) + more.tobytes() + E.pack_differences(places[lo:hi] & low))
            yield pa.RecordBatch.from_pydict({"b": [r[0] for r in rows], "g": [g] * len(rows), "payload": payloads}, _ASKED)

    return docs.mapInArrow(run, ASKED)


def resolve_frequencies(payloads: list[bytes], _groups) -> list[bytes]:
    """A bit for each key of more than one document, and for each of those 8 * log2 of its documents as a byte."""
    keys, counts = [], []
    for p in payloads:
        n, m = int.from_bytes(p[:4], "little"), int.from_bytes(p[4:8], "little")
        many = E.unbits(p[8 : 8 + -(-n // 8)], n)
        at = 8 + -(-n // 8)
        own = np.ones(n)
        own[many] = np.frombuffer(p, "<u4", m, at)
        counts.append(own)
        keys.append(E.unpack_differences(p[at + 4 * m :]))
    every = np.concatenate(keys)
    _, member = np.unique(every, return_inverse=True)
    total = np.bincount(member, np.concatenate(counts))
    level = np.clip(np.round(8 * np.log2(total)), 0, 255).astype(np.uint8)[member]
    many = (total > 1.5)[member]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return [E.bits(m) + x[m].tobytes() for m, x in zip(np.split(many, cuts), np.split(level, cuts))]


def least_overlap(n, percent: int):
    """Shared shingles that a set of n needs for a link with any set: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def _sets(row: dict, told: list[dict], k: int, percent: int, buckets: int) -> pa.Table:
    ids, null, data, offsets = E.opened(row)
    found, at = shingle_sets(data, offsets, k)
    key = E.placed(found, buckets, KEY_BITS)
    places = np.unique(key)
    level = np.zeros(len(places), np.uint8)
    of = {t["b"]: t["answer"] for t in told}
    for b, lo, hi in E.split(places, KEY_BITS):
        size = -(-(hi - lo) // 8)
        many = E.unbits(of[b][:size], hi - lo)
        part = np.zeros(hi - lo, np.uint8)
        part[many] = np.maximum(np.frombuffer(of[b], np.uint8, offset=size), 1)
        level[lo:hi] = part
    mine = level[np.searchsorted(places, key)] if len(places) else level
    out = {f.name: [] for f in _SETS}
    for d in range(len(ids)):
        a, b = int(at[d]), int(at[d + 1])
        n = b - a
        h, f = found[a:b], mine[a:b]
        live, tokens, k1, k2 = False, None, 0, 0
        if n:
            k1 = int(np.add.reduce(X.mix(h + np.uint64(1)), dtype=np.uint64).astype(np.int64))
            k2 = int(np.bitwise_xor.reduce(X.mix(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))).astype(np.int64))
            shared = np.flatnonzero(f)
            live = n - int(least_overlap(n, percent)) + 1 > n - len(shared)
            if live:
                h, f = h[shared], f[shared]
                tokens = h[np.lexsort((h, f))].tobytes()
        out["doc_id"].append(_LAST if null[d] else int(ids[d]))
        out["n_shingles"].append(n)
        out["k1"].append(k1)
        out["k2"].append(k2)
        out["live"].append(live)
        out["tokens"].append(tokens)
    return pa.Table.from_pydict(out, _SETS)


def _postings(batches, percent: int):
    """The shared shingles of every class's 1-prefix: per batch of rows one (tok, rep, null) a shingle, with the
    smallest class that holds it, and (null, rep, low) for the others. A shingle of a third of all classes is so one row a batch."""
    for batch in batches:
        toks, reps = [], []
        for rep, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            tokens = np.frombuffer(raw.as_py(), np.int64)
            own = tokens[: n - least_overlap(n, percent) + 1 - (n - len(tokens))]
            toks.append(own)
            reps.append(np.full(len(own), rep))
        if toks:
            tok, rep = np.concatenate(toks), np.concatenate(reps)
            order = np.lexsort((rep, tok))
            tok, rep = tok[order], rep[order]
            head = np.ones(len(tok), bool)
            head[1:] = tok[1:] != tok[:-1]
            low = rep[head][np.cumsum(head) - 1]
            links = np.unique(np.stack([rep, low])[:, rep != low], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(tok[head]), pa.array(rep[head]), pa.nulls(int(head.sum()), pa.int64())], schema=_POSTINGS)
            yield pa.RecordBatch.from_arrays([pa.nulls(links.shape[1], pa.int64()), pa.array(links[0]), pa.array(links[1])], schema=_POSTINGS)


def join_block(reps: np.ndarray, sizes: np.ndarray, tokens: list[np.ndarray], side: np.ndarray, percent: int, copies: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spanning links among classes, and how many copies of other classes each links with (if copies
    are given: only then are pairs of one component verified). Where sides differ, pairs of one side are another task's."""
    count = len(reps)
    lengths = np.array([len(t) for t in tokens])
    flat = np.concatenate(tokens)
    _, local = np.unique(flat, return_inverse=True)
    at = np.concatenate([[0], np.cumsum(lengths)])
    frequency = np.bincount(local)
    doc = np.repeat(np.arange(count), lengths)
    # place of each token in its whole sorted set (1-based; unshipped shingles come first), and its level
    place = np.arange(len(flat)) - at[:-1][doc] + 1 + (sizes - lengths)[doc]
    slack = sizes - least_overlap(sizes, percent)
    level = np.maximum(place - slack[doc], 1)
    near = level <= LONGEST
    cost = frequency[local] * near
    # postings read at each l, and the candidates left if each must match l times
    read = np.stack([np.bincount(doc, cost * (level <= x), count) for x in range(1, LONGEST + 1)])
    verify = np.maximum(sizes / 8.0, 4.0)
    price = read + verify * read / np.arange(1, LONGEST + 1)[:, None]
    most = np.clip(least_overlap(sizes, percent), 1, LONGEST)  # no more matches than a link must have
    price = np.where(np.arange(1, LONGEST + 1)[:, None] <= most, price, np.inf)
    wanted = 1 + np.argmin(price, axis=0)
    indexed = np.flatnonzero(level <= wanted[doc])
    order = indexed[np.argsort(local[indexed], kind="stable")]
    list_at = np.concatenate([[0], np.cumsum(np.bincount(local[indexed], minlength=len(frequency)))])
    post_doc, post_level = doc[order], level[order]
    comp, linked = np.arange(count), np.zeros(count, np.int64)
    done = np.zeros(count, bool)
    mixed = side.min() != side.max() if count else False
    mark = np.zeros(len(frequency), bool)
    links = []
    # the most connected first: what they join needs no verification later
    for r in np.argsort(-read[0], kind="stable").tolist():
        own = np.arange(at[r], at[r + 1])
        own = own[level[own] <= wanted[r]]
        done[r] = True
        if not len(own):
            continue
        lows, runs = list_at[local[own]], list_at[local[own] + 1] - list_at[local[own]]
        where = np.repeat(lows - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(int(runs.sum()))
        s, deep = post_doc[where], np.maximum(post_level[where], np.repeat(level[own], runs))
        need = np.minimum(wanted[s], wanted[r])
        got = np.bincount(s[deep <= need], minlength=count)
        ok = (got >= np.minimum(wanted, wanted[r])) & (got > 0)
        ok &= comp != comp[r] if copies is None else ~done
        if mixed:
            ok &= side != side[r]
        ok &= (100 * np.minimum(sizes, sizes[r]) >= percent * np.maximum(sizes, sizes[r]))
        cand = np.flatnonzero(ok)
        if not len(cand):
            continue
        mark[local[at[r] : at[r + 1]]] = True
        runs = lengths[cand]
        where = np.repeat(at[:-1][cand] - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(int(runs.sum()))
        both = np.add.reduceat(mark[local[where]].astype(np.int64), np.concatenate([[0], np.cumsum(runs)[:-1]]))
        mark[local[at[r] : at[r + 1]]] = False
        found = cand[100 * both >= percent * (sizes[cand] + sizes[r] - both)]
        if copies is not None and len(found):
            linked[r] += copies[found].sum()
            linked[found] += copies[r]
        for x in found[comp[found] != comp[r]].tolist():
            if comp[x] != comp[r]:
                links.append((int(reps[r]), int(reps[x])))
                comp[comp == comp[x]] = comp[r]
    return links, linked


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 16, links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and, if links, n_links (how many other rows link) of every row."""
    rows = E.scan_order(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    buckets, group_bytes = E.sizing(rows)
    frequencies = E.answers(ask_frequencies(rows, k, buckets, group_bytes), resolve_frequencies)
    sets = settle(E.meet(E.packed(rows, group_bytes), frequencies, lambda row, told: _sets(row, told, k, percent, buckets), SETS))
    # one row a distinct set; partial aggregation keeps a set that a third of all rows share small
    classes = settle(sets.where("live").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies")))
    size, live = classes.agg(F.sum(F.octet_length("tokens")), F.sum("copies")).first()
    size, live = int(size or 0), int(live or 0)
    postings = settle(classes.select("rep", "n", "tokens").mapInArrow(lambda batches: _postings(batches, percent), "tok long, rep long, low long"))
    shared = postings.where("tok IS NOT NULL").select("tok", "rep")
    least = shared.groupBy("tok").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("tok", "low")
    near = shared.join(least, "tok").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    blocks = connected(near.unionByName(postings.where("tok IS NULL").select(F.col("rep").alias("a"), F.col("low").alias("b"))).distinct())
    blocks = settle(blocks.select(F.col("node").alias("rep"), F.col("label").alias("block")))
    held = settle(classes.select("rep", "n", "tokens", "copies").join(blocks, "rep"))
    weights = held.groupBy("block").agg(F.ceil(F.sum(F.octet_length("tokens")) / (8.0 * block_tokens)).cast("int").alias("chunks"), F.sum(F.octet_length("tokens")).alias("size"))
    bins = max(1, -(-size // (8 * block_tokens)))
    held = salted(held, ["block"], "rep", weights, "size", size).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("block"), F.lit(bins))).otherwise(F.col("block")).alias("x"),
        F.when(F.col("chunks") == 1, -1).otherwise(F.least("chunk", "other")).alias("i"),
        F.when(F.col("chunks") == 1, -1).otherwise(F.greatest("chunk", "other")).alias("j"),
        "chunk", "rep", "n", "tokens", "copies",
    )

    def run(table: pa.Table) -> pa.Table:
        raw = [t.as_py() for t in table.column("tokens")]
        reps, side = np.asarray(table.column("rep")), np.asarray(table.column("chunk")) if table.column("i")[0].as_py() >= 0 else np.zeros(len(raw), int)
        found, linked = join_block(reps, np.asarray(table.column("n")), [np.frombuffer(t, np.int64) for t in raw], side, percent, np.asarray(table.column("copies")) if links else None)
        some = np.flatnonzero(linked)
        a, b, n = [x[0] for x in found], [x[1] for x in found], [None] * len(found)
        return pa.table({"a": pa.array(a + reps[some].tolist(), pa.int64()), "b": pa.array(b + [None] * len(some), pa.int64()), "n": pa.array(n + linked[some].tolist(), pa.int64())})

    found = settle(held.groupBy("x", "i", "j").applyInArrow(run, "a long, b long, n long"))
    members = connected(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("linked"))
    known = classes.select("k1", "k2", "rep", "copies").join(members.withColumnRenamed("node", "rep"), "rep", "left").join(counts.withColumnRenamed("a", "rep"), "rep", "left")
    known = known.where("copies > 1 OR label IS NOT NULL").select("k1", "k2", F.coalesce("label", "rep").alias("component"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    out = sets.drop("tokens")
    out = salted(out.where("live"), ["k1", "k2"], "doc_id", known, "copies", live, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")).unionByName(
        out.where("NOT live").select("doc_id", "n_shingles", F.col("doc_id").alias("component"), F.lit(0).cast("long").alias("n_links"))
    )
    out = out.select(F.nullif("doc_id", F.lit(_LAST)).alias("doc_id"), "n_shingles", F.nullif("component", F.lit(_LAST)).alias("component_id"), "n_links")
    return out if links else out.drop("n_links")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 3], ' ')) AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM g a JOIN g b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * x >= 85 * (p.n + q.n - x)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
f(doc_id, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, f.label FROM f JOIN e ON e.a = f.doc_id WHERE f.label < e.b),
m AS (SELECT doc_id, min(label) AS label FROM f GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.label AS component_id, coalesce(k.links, 0)::BIGINT AS n_links FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
