"""Suffix-array dedup: shard suffix arrays by induced sorting, with permuted common prefixes.

A byte is removed where it lies in a `length`-byte string that also starts in a document with
a smaller id. Suffix arrays are built over shards in which equal strings meet:

1. Every `length`-byte string is known by its anchor, the k-gram of least hash in it (the
   leftmost of equals). Anchors go through the group exchange; one that occurs once in the
   corpus rules its strings out, the rest are candidates.
2. The strings of one anchor are a stretch of text of at most 2 * length - k bytes. Stretches
   go to the shard of their anchor, equal ones of a group once, with the smallest id that holds
   them. A shard's stretches make one text, of which the suffix array is built: suffixes are
   classified, leftmost-S substrings are sorted by inducing and named, the reduced text is
   sorted by recursion, and the suffixes are induced from it in linear passes, bucket by bucket.
   Common prefixes are computed in text order over the permuted array (each suffix against its
   predecessor) and cut it into classes of suffixes with equal first `length` bytes.
3. Each class's smallest id decides which strings go; a group gets one bit a string.

Shards are as many as the exchange has buckets, so they grow in number, not in size; a
passage that a third of the documents hold is one stretch a group and shard. A phrase whose
surroundings differ from copy to copy is not: an anchor with over `hot` distinct stretches (summed
over groups) is split. Its strings are dealt by their own hash, each a stretch of one string, so
equal ones still meet and the others are spread over all shards.

Defined results: a null or empty text has no bytes; null ids count as the largest id, rows of one
id are one document (a string is not removed for another row of the same id); an empty table gives
an empty result. Removed bytes can cut a character: kept text is decoded with replacement. A text
of over two MB is a group by itself and must fit a task, at some 60 bytes a byte; other columns
are not carried.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import exchange as E
from skein.llm import textops as X
from skein.scratch import settle

K = 24
ANCHOR_BITS = 28
HOT = 1 << 15  # distinct stretches of one anchor that a shard may hold
RECURSE = 2048  # largest alphabet whose buckets are worth walking one by one
ASKED = "b int, g long, payload binary"
_ASKED = pa.schema([("b", pa.int32()), ("g", pa.int64()), ("payload", pa.binary())])
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


# ---- suffix array by induced sorting: the text ends in its only smallest symbol ----


def classify(s: np.ndarray) -> np.ndarray:
    """True for S-type suffixes, those smaller than the next; the last one is S."""
    n = len(s)
    differs = np.flatnonzero(s[1:] != s[:-1])  # runs of one symbol take the type of the run's end
    runs = np.diff(np.append(-1, differs))
    kind = np.ones(n, bool)
    kind[:-1] = np.repeat(s[differs] < s[differs + 1], runs)
    return kind


def _places(n: int):
    return np.int32 if n < 2**31 else np.int64


def induce(s: np.ndarray, kind: np.ndarray, lms: np.ndarray, size: int, mark: int = -1) -> np.ndarray:
    """All suffixes in order, induced from the leftmost-S ones in the order given.

    Linear passes over the buckets. Within a bucket suffixes are taken in waves: all that
    stand there, then those that they have induced into the same bucket."""
    n = len(s)
    counts = np.bincount(s, minlength=size)
    tail = np.cumsum(counts)
    head = tail - counts
    first_s = tail - np.bincount(s[kind], minlength=size)
    sa = np.full(n, -1, _places(n))
    symbol = s[lms]
    ordered = lms[np.argsort(symbol, kind="stable")].astype(_places(n))
    group_at = np.concatenate([[0], np.cumsum(np.bincount(symbol, minlength=size))])

    def deal(wave: np.ndarray, small: bool, fill: np.ndarray) -> None:
        """Put the predecessors of type `small` into their buckets, L from the front, S from the back."""
        found = wave[wave > 0] - 1
        found = found[kind[found] == small]
        if not len(found):
            return
        c = s[found]
        order = np.argsort(c, kind="stable")
        c, found = c[order], found[order]
        start = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])
        run = np.diff(np.append(start, len(c)))
        for symbol, a, k in zip(c[start].tolist(), start.tolist(), run.tolist()):
            at = fill[symbol]
            if small:
                sa[at - k : at] = found[a : a + k][::-1]
                fill[symbol] = at - k
            else:
                sa[at : at + k] = found[a : a + k]
                fill[symbol] = at + k

    live = np.flatnonzero(counts).tolist()
    front, stop, start_s = head.tolist(), tail.tolist(), first_s.tolist()
    begin = head.tolist()
    for c in live:
        done = begin[c]
        while done < front[c]:
            done, wave = front[c], sa[done : front[c]]
            deal(wave, False, front)
        deal(ordered[group_at[c] : group_at[c + 1]], False, front)
    back = tail.tolist()
    for c in live[::-1]:
        done = stop[c]
        while done > back[c]:
            done, wave = back[c], sa[back[c] : done][::-1]
            deal(wave, True, back)
        deal(sa[begin[c] : start_s[c]][::-1], True, back)
    if mark >= 0:  # distinct symbols keep the order given
        sa[start_s[mark] : stop[mark]] = ordered[group_at[mark] : group_at[mark + 1]]
    sa[0] = n - 1
    return sa


def doubled(names: np.ndarray) -> np.ndarray:
    """Suffix array by rank doubling: the end of the recursion, where buckets are too many to walk.
    Only ranks that are not yet settled are sorted again."""
    n = len(names)
    sa = np.argsort(names, kind="stable")
    ranked = names[sa]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 1
    while True:
        starts = np.flatnonzero(head)
        sizes = np.diff(np.append(starts, n))
        places = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(places):
            return sa
        who = sa[places]
        after = np.where(who + h < n, rank[np.minimum(who + h, n - 1)] + 1, 0)
        order = np.argsort(rank[who] * (n + 2) + after, kind="stable")
        who, after = who[order], after[order]
        old = rank[who]
        fresh = np.ones(len(who), bool)
        fresh[1:] = (old[1:] != old[:-1]) | (after[1:] != after[:-1])
        sa[places] = who
        head[places] = fresh
        rank[who] = places[np.maximum.accumulate(np.where(fresh, np.arange(len(who)), 0))]
        h *= 2


def suffix_array(s: np.ndarray, size: int, mark: int = -1, depth: int = 0) -> np.ndarray:
    """Suffix array of s, whose last symbol is its only smallest. Places of `mark` count as distinct symbols."""
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable").astype(_places(n))
    kind = classify(s)
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    ordered = induce(s, kind, lms, size, mark)
    chosen = np.zeros(n, bool)
    chosen[lms] = True
    ordered = ordered[chosen[ordered]]  # leftmost-S suffixes in the order of their leftmost-S substrings
    place = np.empty(n, _places(n))
    place[lms] = np.arange(len(lms), dtype=_places(n))
    ends = np.append(lms[1:] + 1, n)
    sums = X.range_sums(X.mix(s.astype(np.uint64) + np.uint64(1)))
    code = X.mix(X.range_hash(sums, lms, ends) + (ends - lms).astype(np.uint64))[place[ordered]]
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (s[ordered[1:]] == mark)
    names = np.empty(len(lms), np.int64)
    names[place[ordered]] = np.cumsum(fresh) - 1
    top = int(names.max()) + 1
    if top < len(lms):
        if top <= RECURSE:
            ordered = lms[suffix_array(names.astype(np.uint16), top, depth=depth + 1)]
        else:
            ordered = lms[doubled(names)]
    return induce(s, kind, ordered, size, mark)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each text position, the common prefix of its suffix with the one before it in order.

    `room` is how far each position is from its stretch's end, which no prefix crosses. A
    position's prefix is its left neighbour's less one, unless the symbols to the left of both
    suffixes differ or a stretch begins; only these irreducible ones are compared, eight bytes
    at a time."""
    n, wide = len(s), s.itemsize
    before = np.full(n, -1, _places(n))
    before[sa[1:]] = sa[:-1]
    start = np.ones(n, bool)
    start[1:] = (before[1:] <= 0) | (room[:-1] == 0) | (s[np.maximum(before[1:] - 1, 0)] != s[:-1])
    at = np.flatnonzero(start)
    padded = np.concatenate([s, np.zeros(16, s.dtype)])
    eight = np.ndarray(n + 8, np.uint64, padded.data, strides=(wide,))  # the symbols from each position on
    step = 8 // wide
    size = np.zeros(len(at), np.int32)
    live = np.flatnonzero(before[at] >= 0)
    a, b, h = at[live], before[at[live]].astype(np.int64), 0
    most = np.minimum(room[a], room[b])
    while len(live):
        x = eight[np.minimum(a + h, n)] ^ eight[np.minimum(b + h, n)]
        equal = np.where(x == 0, step, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // (8 * wide)).astype(np.int32)
        size[live] = np.minimum(h + equal, most)
        h += step
        go = (equal == step) & (most > h)
        live, a, b, most = live[go], a[go], b[go], most[go]
    owner = np.cumsum(start) - 1
    return size[owner] - (np.arange(n) - at[owner]).astype(np.int32)


# ---- anchors and stretches ----


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """First and last string of each run of strings with one anchor, the anchors' hashes, and the byte sums."""
    sums = X.byte_sums(data)
    starts = X.windows(offsets, length)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), sums
    gram = X.mix(X.rolling_hash(sums, k))
    least = gram & np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(len(gram), dtype=np.uint64)
    width, have = length - k + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    anchor = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first, last = np.concatenate([[0], cut]), np.append(cut, len(starts)) - 1
    return starts[first], starts[last], gram[anchor[first]], sums


def stretch_codes(first: np.ndarray, last: np.ndarray, gram: np.ndarray, sums: np.ndarray, length: int) -> np.ndarray:
    """A hash of each stretch's bytes and anchor."""
    ends = last + length
    return X.mix(X.range_hash(sums, first, ends) + (ends - first).astype(np.uint64) + gram)


def ask_anchors(docs: DataFrame, length: int, k: int, buckets: int, group_bytes: int) -> DataFrame:
    """A group's distinct anchors: which come twice, and of those with several distinct stretches how many."""
    low = np.uint64((1 << ANCHOR_BITS) - 1)

    def run(batches):
        for g, _, texts in E.groups(batches, group_bytes):
            first, last, gram, sums = stretches(*X.buffer_of(texts), length, k)
            places, member, counts = np.unique(E.placed(gram, buckets, ANCHOR_BITS), return_inverse=True, return_counts=True)
            again = counts[member] > 1 if len(places) else np.zeros(0, bool)
            kinds = np.unique(np.stack([member[again].astype(np.uint64), stretch_codes(first, last, gram, sums, length)[again]]), axis=1)[0]
            distinct = np.ones(len(places), np.int64)
            distinct[counts > 1] = np.bincount(kinds.astype(np.int64), minlength=len(places))[counts > 1]
            rows, payloads = E.split(places, ANCHOR_BITS), []
            for _, lo, hi in rows:
                several = distinct[lo:hi] > 1
                more = distinct[lo:hi][several].astype("<u4")
                payloads.append((hi - lo).to_bytes(4, "little") + len(more).to_bytes(4, "little") + E.bits(counts[lo:hi] > 1) + E.bits(several) + more.tobytes() + E.pack_differences(places[lo:hi] & low))
            yield pa.RecordBatch.from_pydict({"b": [r[0] for r in rows], "g": [g] * len(rows), "payload": payloads}, _ASKED)

    return docs.mapInArrow(run, ASKED)


def resolve_anchors(payloads: list[bytes], hot: int) -> list[bytes]:
    """Two bits a key: it occurs more than once, and it has over `hot` distinct stretches."""
    keys, twice, distinct = [], [], []
    for p in payloads:
        n, m = int.from_bytes(p[:4], "little"), int.from_bytes(p[4:8], "little")
        size = -(-n // 8)
        twice.append(E.unbits(p[8 : 8 + size], n))
        own = np.ones(n)
        own[E.unbits(p[8 + size : 8 + 2 * size], n)] = np.frombuffer(p, "<u4", m, 8 + 2 * size)
        distinct.append(own)
        keys.append(E.unpack_differences(p[8 + 2 * size + 4 * m :]))
    every = np.concatenate(keys)
    _, member = np.unique(every, return_inverse=True)
    many = ((np.bincount(member) > 1) | (np.bincount(member, np.concatenate(twice)) > 0))[member]
    wide = (np.bincount(member, np.concatenate(distinct)) > hot)[member]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return [E.bits(m) + E.bits(w) for m, w in zip(np.split(many, cuts), np.split(wide, cuts))]


def _candidates(row: dict, told: list[dict], length: int, k: int, buckets: int) -> dict:
    """A group's candidate stretches, and the distinct ones in shard order with their smallest id."""
    ids, null, data, offsets = E.opened(row)
    first, last, gram, sums = stretches(data, offsets, length, k)
    key = E.placed(gram, buckets, ANCHOR_BITS)
    places, member = np.unique(key, return_inverse=True)
    hit, wide = np.zeros(len(places), bool), np.zeros(len(places), bool)
    of = {t["b"]: t["answer"] for t in told if t["round"] == 1}
    for b, lo, hi in E.split(places, ANCHOR_BITS):
        hit[lo:hi] = E.unbits(of[b], hi - lo)
        wide[lo:hi] = E.unbits(of[b][-(-(hi - lo) // 8) :], hi - lo)
    if wide.any():  # the strings of a hot anchor, one by one
        cut = wide[member]
        each = spread(first[cut], last[cut] - first[cut] + 1)
        single = X.mix(X.range_hash(sums, each, each + length) + np.uint64(length))
        keep = hit[member] & ~cut
        first, last, gram = (np.concatenate(x) for x in ((first[keep], each), (last[keep], each), (gram[keep], single)))
        order = np.argsort(first, kind="stable")
        first, last, gram = first[order], last[order], gram[order]
    else:
        mine = hit[member] if len(places) else np.zeros(0, bool)
        first, last, gram = first[mine], last[mine], gram[mine]
    ends = last + length
    shard = (gram >> np.uint64(40)) % np.uint64(buckets)
    code = stretch_codes(first, last, gram, sums, length)
    owner = ids[np.searchsorted(offsets, first, side="right") - 1]
    order = np.lexsort((owner, code, shard))
    head = np.ones(len(order), bool)
    head[1:] = (shard[order][1:] != shard[order][:-1]) | (code[order][1:] != code[order][:-1])
    heads = order[head]
    member = np.empty(len(order), np.int64)
    member[order] = np.cumsum(head) - 1
    cut = np.flatnonzero(np.diff(shard[heads])) + 1 if len(heads) else np.zeros(0, np.int64)
    runs = list(zip(shard[heads][np.concatenate([[0], cut])].tolist(), [0, *cut.tolist()], [*cut.tolist(), len(heads)])) if len(heads) else []
    return {"ids": ids, "null": null, "data": data, "offsets": offsets, "first": first, "ends": ends, "owner": owner, "gram": gram, "heads": heads, "member": member, "runs": runs}


def spread(lows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """low, low + 1, ... of each range, one after the other."""
    total = int(sizes.sum())
    return np.repeat(lows - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total) if total else np.zeros(0, np.int64)


def ask_shards(texts: DataFrame, told: DataFrame, length: int, k: int, buckets: int) -> DataFrame:
    """A row for each shard that a group has stretches for, and one (b = -1) that says where they stand."""

    def run(row, got):
        c = _candidates(row, got, length, k, buckets)
        press = zstandard.ZstdCompressor(level=3)
        payloads = []
        for _, lo, hi in c["runs"]:
            h = c["heads"][lo:hi]
            sizes = c["ends"][h] - c["first"][h]
            body = c["owner"][h].tobytes() + sizes.astype("<u2").tobytes() + c["gram"][h].astype("<u4").tobytes() + c["data"][spread(c["first"][h], sizes)].tobytes()
            payloads.append(len(h).to_bytes(4, "little") + press.compress(body))
        payloads.append(press.compress(pickle.dumps(plan_of(c, length))))
        return pa.Table.from_pydict({"b": [*(r[0] for r in c["runs"]), -1], "g": [row["g"]] * len(payloads), "payload": payloads}, _ASKED)

    return E.meet(texts, told, run, ASKED)


def plan_of(c: dict, length: int) -> dict:
    """What a group needs to read its shards' bits: its stretches, the distinct one of each, and those of a later id."""
    heads, member = c["heads"], c["member"]
    strings = (c["ends"][heads] - c["first"][heads] - length + 1).astype(np.uint16)
    later = c["owner"] > c["owner"][heads][member] if len(member) else np.zeros(0, bool)
    return {"first": np.diff(c["first"], prepend=0).astype(np.uint32), "member": member.astype(np.uint32), "strings": strings, "later": later, "runs": c["runs"]}


def resolve_shard(payloads: list[bytes], length: int) -> list[bytes]:
    """One shard: suffix array and permuted prefixes of its stretches; a bit for each string of which a smaller id holds a copy.

    Equal stretches stand in the text once, and those that are alone in having their anchor not at
    all: a string has one anchor, so theirs can only match their own copies."""
    ids, sizes, grams, parts, count = [], [], [], [], []
    for p in payloads:
        n = int.from_bytes(p[:4], "little")
        body = zstandard.ZstdDecompressor().decompressobj().decompress(p[4:])
        ids.append(np.frombuffer(body, np.int64, n))
        sizes.append(np.frombuffer(body, "<u2", n, 8 * n).astype(np.int64))
        grams.append(np.frombuffer(body, "<u4", n, 10 * n))
        parts.append(np.frombuffer(body, np.uint8, offset=14 * n))
        count.append(n)
    ids, sizes, grams, data = np.concatenate(ids), np.concatenate(sizes), np.concatenate(grams), np.concatenate(parts)
    at = np.concatenate([[0], np.cumsum(sizes)])
    codes = [X.mix(X.range_hash(X.byte_sums(data, w), at[:-1], at[1:], w) + sizes.astype(np.uint64)) for w in (0, 1)]
    order = np.lexsort((ids, codes[1], codes[0]))  # equal stretches once, with their smallest id
    head = np.ones(len(order), bool)
    head[1:] = (codes[0][order][1:] != codes[0][order][:-1]) | (codes[1][order][1:] != codes[1][order][:-1])
    member = np.empty(len(order), np.int64)
    member[order] = np.cumsum(head) - 1
    one = order[head]
    own = ids[one]
    strings = sizes - length + 1
    least = np.repeat(own, strings[one])  # the smallest id that holds each string of each distinct stretch
    string_at = np.concatenate([[0], np.cumsum(strings[one])])
    _, kin = np.unique(grams[one], return_inverse=True)
    shared = np.flatnonzero(np.bincount(kin)[kin] > 1)
    if len(shared):
        size, number = sizes[one][shared], strings[one][shared]
        begin = np.concatenate([[0], np.cumsum(size + 1)])  # each stretch and a separator
        kind = np.uint8 if data.max() < 254 else np.uint16  # no byte of UTF-8 is over 0xF4
        text = np.ones(int(begin[-1]) + 1, kind)
        text[-1] = 0
        places = spread(begin[:-1], size)
        text[places] = data[spread(at[:-1][one[shared]], size)].astype(kind) + kind(2)
        room = np.zeros(len(text), np.int32)
        room[places] = np.repeat(begin[1:] - 1, size) - places
        sa = suffix_array(text, 258, mark=1)
        prefix = permuted_prefixes(text, sa, room)
        holder = np.full(len(text), np.iinfo(np.int64).max)
        holder[places] = np.repeat(own[shared], size)
        starts = np.flatnonzero(prefix[sa] < length)  # classes of suffixes with equal first `length` bytes
        smallest = np.minimum.reduceat(holder[sa], starts)
        best = np.empty(len(text), np.int64)
        best[sa] = np.repeat(smallest, np.diff(np.append(starts, len(sa))))
        least[spread(string_at[:-1][shared], number)] = best[spread(begin[:-1], number)]
    gone = least[spread(string_at[:-1][member], strings)] < np.repeat(ids, strings)
    cuts = np.cumsum(np.add.reduceat(strings, np.concatenate([[0], np.cumsum(count)[:-1]])))[:-1]
    return [E.bits(m) for m in np.split(gone, cuts)]


def _finish(row: dict, told: list[dict], length: int, with_text: bool) -> pa.Table:
    ids, null, data, offsets = E.opened(row)
    of = {a["b"]: a["answer"] for a in told}
    plan = pickle.loads(zstandard.ZstdDecompressor().decompressobj().decompress(of[-1]))
    first, member, strings = np.cumsum(plan["first"].astype(np.int64)), plan["member"].astype(np.int64), plan["strings"].astype(np.int64)
    bit_at = np.concatenate([[0], np.cumsum(strings)])
    flags = np.concatenate([E.unbits(of[b], int(bit_at[hi] - bit_at[lo])) for b, lo, hi in plan["runs"]] or [np.zeros(0, bool)])
    mine = strings[member]
    gone = flags[spread(bit_at[:-1][member], mine)] | np.repeat(plan["later"], mine)
    where = spread(first, mine)[gone]
    lost = X.covered(len(data), where, length) if len(data) else np.zeros(0, bool)
    total = np.concatenate([[0], np.cumsum(lost)])
    out = {f.name: [] for f in _OUT}
    for d in range(len(ids)):
        a, b = int(offsets[d]), int(offsets[d + 1])
        mask = lost[a:b]
        kept = (data[a:b][~mask] if total[b] > total[a] else data[a:b]).tobytes()
        out["doc_id"].append(None if null[d] else int(ids[d]))
        out["n_bytes"].append(b - a)
        out["n_removed"].append(int(total[b] - total[a]))
        out["n_spans"].append(int((mask[1:] & ~mask[:-1]).sum() + mask[0]) if total[b] > total[a] else 0)
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        out["kept_text"].append(kept.decode("utf-8", "replace") if with_text else None)
    return pa.Table.from_pydict(out, _OUT)


def dedup_suffixes(docs: DataFrame, length: int = 50, k: int = K, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept_text of every row."""
    k = min(k, length)
    rows = E.scan_order(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    buckets, group_bytes = E.sizing(rows, 2)
    anchors = settle(E.answers(ask_anchors(rows, length, k, buckets, group_bytes), lambda payloads, _: resolve_anchors(payloads, hot)).withColumn("round", F.lit(1)))
    texts = E.packed(rows, group_bytes)
    asked = settle(ask_shards(texts, anchors, length, k, buckets))
    shards = E.answers(asked.where("b >= 0"), lambda payloads, _: resolve_shard(payloads, length))
    plans = asked.where("b < 0").select("g", "b", F.col("payload").alias("answer"))
    return E.meet(texts, shards.unionByName(plans), lambda row, told: _finish(row, told, length, with_text), OUT)


def report(docs: DataFrame) -> DataFrame:
    return dedup_suffixes(docs, with_text=False).drop("kept_text")


SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS t FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM b WHERE length(h) >= 100)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS first FROM s) WHERE doc_id > first),
n AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM n GROUP BY doc_id, run),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM r),
p AS (SELECT k.doc_id, count(*) AS spans, sum(z - a) AS gone, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || any_value(substr(h, 2 * last + 1)) AS kept
      FROM (SELECT *, max(z) OVER (PARTITION BY doc_id) AS last FROM k) k JOIN b USING (doc_id) GROUP BY k.doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM b LEFT JOIN p USING (doc_id)
"""
