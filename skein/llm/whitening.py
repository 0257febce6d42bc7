"""Embedding whitening: merged covariances, eigenvectors on the driver, and a second pass that verifies the identity.

Components are quantised to integers (floor(scale * c) + offset). A task folds its batches into one
state: count, sums and the scatter about their mean; two states meet by Chan's formula, first in
the task, then in treeReduce. Sums are whole numbers of any size, so the difference of two means
and every centred value are exact before they are rounded once. The driver sees dims x dims
numbers, whatever the number of rows, and finds the eigenvectors; the second pass merges the
covariance of the whitened rows in the same way. Rows are never shuffled; the table is read three
times (fit, check, result). dims x dims doubles must fit a task.

Defined results: rows whose vector is null, or holds a null, NaN or infinite entry, or one whose
integer needs over 62 bits, are dropped; vectors are read over the dimensions of the longest,
missing entries counting 0. Rows that repeat an id, and null ids, are rows like others. Directions
without variance have null in `whitened` and are left out of the check; with no variance at all
`explained` is null; a deviation over 64 bits is null. No rows give no rows. Columns of the
input named like an output give way; any other names are allowed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUT = ("deviation", "whitened")
SAFE = 2.0**62
DEPTH = 3  # of treeReduce: the driver gets the cube root of the number of tasks

State = tuple  # count, sums (whole numbers of any size, or floats), scatter about the mean


@dataclass(frozen=True)
class Model:
    """count rows with these sums; values: falling eigenvalues; vectors: a column a component."""

    count: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: float
    offset: int

    @property
    def live(self) -> np.ndarray:
        """Which components have variance, as far as doubles can tell."""
        return self.values > max(self.values[0], 0.0) * len(self.sums) * 8 * np.finfo(float).eps if len(self.values) else np.zeros(0, bool)

    @property
    def explained(self) -> list[float | None]:
        return [max(float(v), 0.0) / self.trace if self.trace > 0 else None for v in self.values]


def widened(state: State, dims: int, offset: int) -> State:
    count, sums, scatter = state
    more = dims - len(sums)
    if not more:
        return state
    return count, np.concatenate([sums, np.full(more, count * offset, sums.dtype)]), np.pad(scatter, (0, more))


def merged(a: State, b: State, offset: int = 0) -> State:
    """Chan's formula for two disjoint sets of rows."""
    dims = max(len(a[1]), len(b[1]))
    (n, s, m), (k, t, o) = widened(a, dims, offset), widened(b, dims, offset)
    if not n or not k:
        return (k, t, o) if not n else (n, s, m)
    apart = ((t * n - s * k) / (n * k)).astype(float)
    return n + k, s + t, m + o + np.outer(apart, apart) * (n / (n + k) * k)


def nothing(kind=object) -> State:
    return 0, np.zeros(0, kind), np.zeros((0, 0))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: as int64 where that holds it, else as whole numbers of any size."""
    top = float(np.abs(x).max(initial=0)) * n + max((abs(float(s)) for s in sums), default=0.0)
    return x * n - sums.astype(np.int64) if top < SAFE else x.astype(object) * n - sums


def of_integers(x: np.ndarray) -> State:
    n = len(x)
    sums = np.array([int(s) for s in (x.sum(axis=0) if float(np.abs(x).max(initial=0)) * max(n, 1) < SAFE else x.astype(object).sum(axis=0))], object)
    if not n:
        return 0, sums, np.zeros((len(sums), len(sums)))
    c = (centred(x, n, sums) / n).astype(float)
    return n, sums, c.T @ c


def of_floats(z: np.ndarray) -> State:
    sums = z.sum(axis=0)
    c = z - sums / max(len(z), 1)
    return len(z), sums, c.T @ c


def integers(vectors: pa.Array, scale: float, offset: int, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and a row of integers for each of those."""
    there = np.flatnonzero(np.asarray(pc.is_valid(vectors)))
    if len(there) < len(vectors):
        vectors = vectors.take(pa.array(there))
    flat, lengths = np.floor(np.asarray(vectors.flatten(), float) * scale), np.asarray(pc.list_value_length(vectors)).astype(np.int64)
    width = max(int(lengths.max(initial=0)), dims or 0)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    sound = (np.abs(out) < SAFE - abs(offset)).all(axis=1)  # false for NaN too
    return there[sound], out[sound].astype(np.int64) + offset


def _tree(rows: DataFrame, states, start: State, offset: int = 0) -> State:
    """One state a task, merged pairwise in a tree."""

    def run(batches):
        import pickle

        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(reduce(lambda a, b: merged(a, b, offset), (states(b) for b in batches), start))], pa.binary())], names=["state"])

    def read(row):
        import pickle

        return pickle.loads(row[0])

    made = rows.mapInArrow(run, "state binary").rdd.map(read)
    return made.treeReduce(lambda a, b: merged(a, b, offset), DEPTH) if made.getNumPartitions() else start


def _vectors(vectors: DataFrame, vec_col: str, row) -> DataFrame:
    return vectors.select(*([row.alias("row")] if row is not None else []), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))


def fit(vectors: DataFrame, components: int = 32, scale: float = 64.0, offset: int = 1_000_000, vec_col: str = "embedding") -> Model:
    """The first `components` components of all vectors, by falling eigenvalue."""
    rows = _vectors(vectors, vec_col, None)
    count, sums, scatter = _tree(rows, lambda b: of_integers(integers(b.column(0), scale, offset)[1]), nothing(), offset)
    values, found = np.linalg.eigh(scatter / max(count, 1)) if len(sums) else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")[:components]
    return Model(count, sums, values[order], np.ascontiguousarray(found[:, order]), float(np.trace(scatter)) / max(count, 1), scale, offset)


def _whitened(centre: np.ndarray, model: Model) -> np.ndarray:
    """Projections over standard deviations: a column a live component."""
    return (centre / model.count).astype(float) @ (model.vectors[:, model.live] / np.sqrt(model.values[model.live]))


def _deviations(centre: np.ndarray) -> list[int | None]:
    top = float(np.abs(centre).max(initial=0))
    if centre.dtype != object and top * top * max(centre.shape[1], 1) < SAFE:
        return (centre * centre).sum(axis=1).tolist()
    exact = [sum(int(x) ** 2 for x in row) for row in centre]
    return [x if x < 2**63 else None for x in exact]


def identity_error(vectors: DataFrame, model: Model, vec_col: str = "embedding") -> float:
    """The second pass: largest absolute entry of the whitened rows' covariance minus the identity."""
    live = int(model.live.sum())
    if not live:
        return 0.0

    def states(batch):
        _, x = integers(batch.column(0), model.scale, model.offset, len(model.sums))
        return of_floats(_whitened(centred(x, model.count, model.sums), model))

    count, _, scatter = _tree(_vectors(vectors, vec_col, None), states, (0, np.zeros(live), np.zeros((live, live))))
    return float(np.abs(scatter / max(count, 1) - np.eye(live)).max())


def whiten(vectors: DataFrame, model: Model, vec_col: str = "embedding") -> DataFrame:
    """The rows that take part, plus deviation (sum of (n * x - sums)^2) and whitened (an array, a component each)."""
    own = [c for c in vectors.columns if c not in OUT]
    rows = _vectors(vectors, vec_col, F.struct(*(F.col(f"`{c}`") for c in own)))  # one struct: no name of theirs meets one of these
    live, many = model.live, len(model.values)

    def run(batches):
        for batch in batches:
            at, x = integers(batch.column(1), model.scale, model.offset, len(model.sums))
            if not len(at):
                continue
            centre = centred(x, model.count, model.sums)
            z = np.zeros((len(x), many))
            z[:, live] = _whitened(centre, model)
            flat = pa.array(z.ravel(), mask=np.tile(~live, len(x)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * many, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(_deviations(centre), pa.int64()), lists], names=["row", *OUT])

    out = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]))
    return out.select(*(F.col("row").getField(c).alias(c) for c in own), *OUT)


def report(vectors: DataFrame) -> DataFrame:
    rows = vectors.select("vec_id", "embedding")
    model = fit(rows)
    error = identity_error(rows, model)
    explained = F.lit([float("nan") if x is None else x for x in model.explained] or [0.0])
    each = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.count).cast("long").alias("n"), "deviation", "whitened", F.nanvl(F.get(explained, F.col("at")), F.lit(None)).alias("explained"), F.lit(error).alias("identity_error"))
