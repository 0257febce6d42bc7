"""Vectorised text primitives over Arrow string buffers.

Every function works on the concatenated UTF-8 bytes of a batch of texts, so no Python
object is made per word or per byte. Hashes are polynomial prefix sums modulo 2**64 over
random per-byte values, which gives the hash of any byte or word range from two look-ups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_TABLES = tuple(np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1) for seed in (11, 23))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
ALNUM = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, -(-n // (1 << 18)) << 18)
        base = _BASES[which]
        inverse = _U(pow(int(base), -1, 2**64))
        out = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        if n > 1 << 23:  # one very long text: not worth keeping
            return out[0][:n], out[1][:n]
        _powers[which] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def buffer_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and len+1 offsets into them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def tokens(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and the len+1 offsets of the texts' words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    m = member[data]
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = m
    after = np.empty(n + 1, bool)
    after[:-1] = m
    after[-1] = False
    before[offsets[offsets < n]] = False
    after[offsets] = False
    starts = np.flatnonzero(m & ~before[:-1])
    ends = np.flatnonzero(m & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def range_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    """len+1 prefix sums of values[i] * base**i, for range_hash()."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.multiply(values, powers(len(values), which)[0], out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of the values in each [start, end), the same wherever they stand."""
    return (sums[ends] - sums[starts]) * powers(len(sums), which)[1][starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, most: int = 1 << 20) -> np.ndarray:
    """A hash of each word, made over runs of words of about `most` bytes, so memory does not follow the text."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        a, b = starts[at:to] - base, ends[at:to] - base
        sums = range_sums(_TABLES[which][data[base : base + int(b[-1])]], which)
        out[at:to] = range_hash(sums, a, b, which) ^ ((b - a).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
        at = to
    return mix(out)


def byte_sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    return range_sums(_TABLES[which][data], which)


def windows(word_offsets: np.ndarray, k: int) -> np.ndarray:
    """Indices of the words that start a window of k words of one text."""
    n = int(word_offsets[-1])
    if n < k:
        return np.zeros(0, np.int64)
    lengths = np.diff(word_offsets)
    late = np.zeros(n, bool)  # items that too few of their text follow
    for i in range(1, min(k, int(lengths.max()) + 1)):
        late[(word_offsets[1:] - i)[lengths >= i]] = True
    return np.flatnonzero(~late)


def rolling_hash(sums: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """range_hash() of [i, i + k) for every i, without gathering."""
    out = sums[k:] - sums[:-k]
    out *= powers(len(out), which)[1]
    return out


def window_hashes(hashes: np.ndarray, at: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    sums = range_sums(hashes, which)
    if len(at) * 3 < len(hashes):
        return mix(range_hash(sums, at, at + k, which))
    return mix(rolling_hash(sums, k, which)[at]) if len(at) else np.zeros(0, np.uint64)


def covered(n: int, starts: np.ndarray, k: int) -> np.ndarray:
    """Mask of n items inside any window [start, start+k); starts are distinct."""
    mark = np.zeros(n + 1, np.int32)
    mark[starts] += 1
    mark[starts + k] -= 1
    return np.cumsum(mark[:-1]) > 0


def slices(lengths: np.ndarray, most: int):
    """Ranges of consecutive items of at most `most` in total, or of one longer item."""
    at, total = 0, 0
    for i, size in enumerate(lengths.tolist()):
        if i > at and total + size > most:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(lengths):
        yield at, len(lengths)
