"""Group exchange: ask the whole corpus about hashed keys without a row per key.

Documents are read in groups of a few MB, in the order of the scan. A group sends its
distinct keys to buckets as packed sorted differences; a bucket sees all groups' keys, and
answers each group with one bit a key (or a bit and a byte). The group then meets its text
again, rebuilds the same sorted keys and reads the bits. What moves is two to four bytes a
key, whatever the hot keys: a key that a third of all documents hold is one entry a group.

A group's number comes from the partition and place of its first row, so `docs` must be read
in the same order each time: a file scan is; anything else is written first (scan_order).
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import textops as X
from skein.scratch import stable

GROUP_BYTES = 2 << 20
PLAIN = 64 << 30
PACKED = "g long, ids binary, lengths binary, blob binary"


def scan_order(docs: DataFrame) -> DataFrame:
    """docs itself if it can be read again in the same order; else its rows written and read."""
    return stable(docs)


def sizing(docs: DataFrame, mb: int = 8) -> tuple[int, int]:
    """How many buckets, and how many bytes of text a group holds.

    Buckets are of about `mb` MB of input, and never fewer than the shuffle has partitions. A
    packed row pays only if it holds some dozens of keys, so beyond PLAIN bytes of input buckets
    grow with a power of it, and groups with the number of buckets: at 100 TB about 150,000
    buckets and groups of 30 MB, for which a task needs some 4 GB."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = (mb << 20) * max(1.0, size / PLAIN) ** 0.6
    buckets = max(partitions, min(int(size / bucket), 1 << 22), 1)
    return buckets, max(GROUP_BYTES, 192 * buckets)


def relieve() -> None:
    """Give freed memory back to the system: a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def groups(batches, group_bytes: int):
    """(g, ids, texts) for runs of consecutive rows; columns are the id and the text."""
    base, n, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0
    for batch in batches:
        sizes = np.diff(X.buffer_of(batch.column(1))[1])
        at = 0
        while at < len(sizes):
            room = np.searchsorted(np.cumsum(sizes[at:]), group_bytes - size, side="right")
            if room == 0 and not size and not ids:
                room = 1
            if room:
                ids.append(batch.column(0).slice(at, room))
                texts.append(batch.column(1).slice(at, room))
                size += int(sizes[at : at + room].sum())
                at += int(room)
            if at < len(sizes):
                yield base + n, pa.concat_arrays(ids), pa.concat_arrays(texts)
                relieve()
                n, ids, texts, size = n + 1, [], [], 0
    if ids:
        yield base + n, pa.concat_arrays(ids), pa.concat_arrays(texts)


def id_array(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as int64 (null: the largest) and which of them are null."""
    null = np.asarray(ids.is_null())
    return np.asarray(ids.fill_null(2**63 - 1)), null


def pack_differences(values: np.ndarray) -> bytes:
    """Sorted values as differences of as few bytes as fit."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    top = int(gaps.max()) if len(gaps) else 0
    width = 2 if top < 1 << 16 else 3 if top < 1 << 24 else 4 if top < 1 << 32 else 8
    raw = np.ascontiguousarray(gaps.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + raw.tobytes()


def unpack_differences(payload: bytes) -> np.ndarray:
    width = payload[0]
    raw = np.frombuffer(payload, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unbits(payload: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(payload, np.uint8), count=n).astype(bool)


def placed(hashes: np.ndarray, buckets: int, width: int) -> np.ndarray:
    """bucket << width | the low `width` bits: what a key is known by in the exchange."""
    return (((hashes >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(width)) | (hashes & np.uint64((1 << width) - 1))


def split(sorted_places: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of one bucket."""
    if not len(sorted_places):
        return []
    b = sorted_places >> np.uint64(width)
    cut = np.flatnonzero(np.diff(b)) + 1
    return list(zip(b[np.concatenate([[0], cut])].tolist(), [0, *cut.tolist()], [*cut.tolist(), len(b)]))


def packed(docs: DataFrame, group_bytes: int) -> DataFrame:
    """The groups' texts again, one compressed row a group."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for g, ids, texts in groups(batches, group_bytes):
            data, offsets = X.buffer_of(texts)
            yield pa.RecordBatch.from_pydict({"g": [g], "ids": [pack_ids(ids)], "lengths": [np.diff(offsets).tobytes()], "blob": [press.compress(data.tobytes())]}, schema)

    schema = pa.schema([("g", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("blob", pa.binary())])
    return docs.mapInArrow(run, PACKED)


def pack_ids(ids: pa.Array) -> bytes:
    values, null = id_array(ids)
    return values.tobytes() + bits(null)


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, null ids, bytes and offsets of a packed row."""
    lengths = np.frombuffer(row["lengths"], np.int64)
    n = len(lengths)
    ids = np.frombuffer(row["ids"], np.int64, count=n)
    null = unbits(row["ids"][8 * n :], n)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=int(lengths.sum()) + 1), np.uint8) if lengths.sum() else np.zeros(0, np.uint8)
    return ids, null, data, np.concatenate([[0], np.cumsum(lengths)])


def answers(asked: DataFrame, resolve) -> DataFrame:
    """asked (b, g, payload) resolved bucket by bucket: resolve(list of payloads) gives one answer each."""

    def run(table: pa.Table) -> pa.Table:
        relieve()
        got = resolve([p.as_py() for p in table.column("payload")], table.column("g").to_pylist())
        return pa.table({"g": table.column("g").cast(pa.int64()), "b": table.column("b").cast(pa.int32()), "answer": pa.array(got, pa.binary())})

    return asked.groupBy("b").applyInArrow(run, "g long, b int, answer binary")


def meet(texts: DataFrame, told: DataFrame, fn, schema: str) -> DataFrame:
    """fn(packed row, answer rows as dicts) -> pa.Table for every group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        relieve()
        return fn(left.to_pylist()[0], right.to_pylist())

    return texts.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(run, schema)


def gather(answers: list[dict], runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """The bits of all buckets' answers, as a mask of a group's n sorted keys."""
    mask = np.zeros(n, bool)
    of = {a["b"]: a["answer"] for a in answers}
    for b, lo, hi in runs:
        mask[lo:hi] = unbits(of[b], hi - lo)
    return mask
