"""Embedding whitening (operator 13).

Every partition streams its vectors through Welford's update: each vector moves the mean and adds a matrix of rank one to the sum of squared
deviations, so nothing is ever squared before it is centred. Partitions' states (n, mean, matrix, exact sums) are merged by the
parallel update formula, FAN_IN at a time, in tasks; the driver gets the last state alone: numbers for a matrix of dimension times dimension,
whatever the number of vectors. Its eigenvectors come from a symmetric QR: Householder reflections to three diagonals, then implicit
shifted QR steps. A second streaming pass gathers the covariance of the whitened vectors for the error that is reported.

Entries become integers, x = floor(64 c) + 1,000,000; the constant is left out in the sums of squares, where it means nothing. Entries beyond
2**50 / 64 are set to that bound. Sums are exact whatever their size.

Rows are left out whose vector is null or empty, holds null, NaN or an infinity, or has another length than most have (ties: the longer). Repeated
rows count as often as they come; a null vec_id stays. A component without variance (one vector alone, constant or dependent
dimensions) has null `whitened`; `explained` is null where there is no variance at all, `identity_error` where no component has any. A deviation that
no long holds is null. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import common

SCALE, OFFSET = 64.0, 1_000_000
COMPONENTS = 32
#: States that a task merges, and that the driver merges at the end.
FAN_IN = 16
#: Components with less than this share of the greatest eigenvalue have no variance that could be told from rounding.
LEAST_SHARE = 1e-12
_BOUND = float(1 << 50)


# ---------------------------------------------------------------- Welford


@dataclass
class State:
    """Vectors so far: how many, their mean, the sum of outer products of deviations, and each dimension's exact sum."""

    n: int
    mean: np.ndarray
    squares: np.ndarray
    sums: list[int]

    @classmethod
    def empty(cls, size: int) -> State:
        return cls(0, np.zeros(size), np.zeros((size, size)), [0] * size)

    def add(self, vectors: np.ndarray) -> None:
        """One rank-one update a vector."""
        outer = np.empty_like(self.squares)
        for x in vectors:
            self.n += 1
            delta = x - self.mean
            self.mean += delta / self.n
            np.multiply(delta[:, None], delta[None, :] * ((self.n - 1) / self.n), out=outer)
            self.squares += outer

    def add_exact(self, values: np.ndarray) -> None:
        """Adds integers to the sums: blocks of up to 4,096 rows below 2**51 fit 64 bits."""
        for at in range(0, len(values), 4096):
            self.sums = [a + b for a, b in zip(self.sums, values[at : at + 4096].sum(0).tolist(), strict=True)]

    def merge(self, other: State) -> State:
        """The parallel update: the state of both lists of vectors together."""
        n = self.n + other.n
        if not self.n or not other.n:
            return other if other.n else self
        delta = other.mean - self.mean
        mean = self.mean + delta * (other.n / n)
        squares = self.squares + other.squares + np.outer(delta, delta) * (self.n / n * other.n)
        return State(n, mean, squares, [a + b for a, b in zip(self.sums, other.sums, strict=True)])

    def covariance(self) -> np.ndarray:
        v = self.squares / self.n
        return (v + v.T) / 2


_STATE = "part int, n long, mean binary, squares binary, sums array<string>"


def _pack(part: int, s: State) -> pa.RecordBatch:
    cells = [pa.array([part], pa.int32()), pa.array([s.n], pa.int64()), pa.array([s.mean.astype("<f8").tobytes()], pa.binary()), pa.array([s.squares.astype("<f8").tobytes()], pa.binary()), pa.array([[str(x) for x in s.sums]], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(cells, ["part", "n", "mean", "squares", "sums"])


def _unpack(n: int, mean: bytes, squares: bytes, sums: list[str]) -> State:
    size = len(sums)
    return State(n, np.frombuffer(mean, "<f8").copy(), np.frombuffer(squares, "<f8").reshape(size, size).copy(), [int(x) for x in sums])


def merged(states: DataFrame) -> State | None:
    """Merges the states of all partitions, FAN_IN to one in a round, in the order of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]):
        at, own = -1, None
        for batch in batches:
            for part, *cells in zip(*(common.pylist(batch, c) for c in ("part", "n", "mean", "squares", "sums")), strict=True):
                state = _unpack(*cells)
                if part // FAN_IN != at:
                    if own is not None:
                        yield _pack(at, own)
                    at, own = part // FAN_IN, state
                else:
                    own = own.merge(state)
        if own is not None:
            yield _pack(at, own)

    states = common.stage(states, "whitening-states")
    while (top := states.agg(F.max("part")).first()[0]) is not None and top >= FAN_IN:
        groups = top // FAN_IN + 1
        dealt = states.repartitionById(groups, (F.col("part") / FAN_IN).cast("int")).sortWithinPartitions("part")
        following = common.stage(dealt.mapInArrow(run, _STATE), "whitening-states")
        common.drop_stage(states.sparkSession, states)
        states = following
    out = None
    for r in states.orderBy("part").collect():
        state = _unpack(r["n"], bytes(r["mean"]), bytes(r["squares"]), r["sums"])
        out = state if out is None else out.merge(state)
    common.drop_stage(states.sparkSession, states)
    return out


# ---------------------------------------------------------------- symmetric QR


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and q with q @ t @ q.T = a, by Householder reflections."""
    t, n = a.astype(float).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = t[k + 1 :, k]
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        v = x / norm
        v[0] += math.copysign(1.0, v[0])
        v /= np.linalg.norm(v)
        rest = t[k + 1 :, k:]
        rest -= 2 * np.outer(v, v @ rest)
        rest = t[k:, k + 1 :]
        rest -= 2 * np.outer(rest @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(t).copy(), np.diag(t, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    d, e, q = tridiagonal(a)
    vectors, n = np.ascontiguousarray(q.T), len(a)  # a rotation changes two rows
    eps, hi = np.finfo(float).eps, n - 1
    rounds = 0
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0
        if e[hi - 1] == 0:
            hi, rounds = hi - 1, 0
            continue
        rounds += 1
        if rounds > 60:
            raise ArithmeticError("the QR steps don't converge")
        lo = int(np.flatnonzero(e[:hi] == 0)[-1]) + 1 if (e[:hi] == 0).any() else 0
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k + 1 < hi:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            vectors[k : k + 2] = np.array([[c, s], [-s, c]]) @ vectors[k : k + 2]
    order = np.argsort(-d, kind="stable")
    found = vectors[order]
    return d[order], (found / np.linalg.norm(found, axis=1)[:, None]).T


# ---------------------------------------------------------------- vectors


def usual_size(vectors: DataFrame, vector_col: str) -> int:
    """The length that most vectors have; of lengths with as many the longest; 0 where there is none."""
    sizes = vectors.where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("s")).count().orderBy(F.desc("count"), F.desc("s")).limit(1).collect()
    return sizes[0]["s"] if sizes else 0


def integers(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows remain, and their entries without the constant, as integers."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    right = lengths == size
    flat = column.filter(pa.array(right)).flatten()
    data = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, size)
    whole = np.isfinite(data).all(1)
    keep = right.copy()
    keep[right] = whole
    return keep, np.clip(np.floor(SCALE * data[whole]), -_BOUND, _BOUND).astype(np.int64)


def fit(vectors: DataFrame, size: int, vector_col: str) -> State | None:
    def run(batches: Iterator[pa.RecordBatch]):
        state = State.empty(size)
        for batch in batches:
            _, x = integers(batch.column(0), size)
            state.add(x.astype(float))
            state.add_exact(x)
        if state.n:
            yield _pack(TaskContext.get().partitionId(), state)

    return merged(vectors.select(vector_col).mapInArrow(run, _STATE))


@dataclass
class Whitening:
    n: int
    sums: list[int]  # of x without the constant
    components: np.ndarray  # a column each
    scales: np.ndarray  # square roots of eigenvalues; 0 where there is no variance
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """x (without the constant), centred and projected; null components are NaN."""
        mean = np.array([s / self.n for s in self.sums])  # correctly rounded quotients of integers
        with np.errstate(divide="ignore", invalid="ignore"):
            out = ((x - mean) @ self.components) / self.scales
        out[:, self.scales == 0] = np.nan
        return out

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)**2, exact; it is the same with the constant as without."""
        most = max(self.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, self.sums), default=0), 1)
        if most < 1 << 31 and most * most * x.shape[1] < 1 << 63:
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(1).tolist()
        y = self.n * x.astype(object) - np.array(self.sums, object)
        return [t if t < 1 << 63 else None for t in (y * y).sum(1).tolist()]


def solve(state: State, components: int = COMPONENTS) -> Whitening:
    v = state.covariance()
    values, found = symmetric_qr(v)
    k = min(components, len(values))
    values, trace = values[:k], float(np.trace(v))
    scales = np.where(values > max(LEAST_SHARE * values.max(initial=0), 0), np.sqrt(np.maximum(values, 0)), 0)
    return Whitening(state.n, state.sums, found[:, :k], scales, values / trace if trace > 0 else np.full(k, np.nan))


def identity_error(vectors: DataFrame, model: Whitening, size: int, vector_col: str) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over the components with variance."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    live = np.flatnonzero(model.scales > 0)
    if not len(live):
        return None

    def run(batches: Iterator[pa.RecordBatch]):
        state = State.empty(len(live))
        for batch in batches:
            _, x = integers(batch.column(0), size)
            state.add(shared.value.project(x)[:, live])
        if state.n:
            yield _pack(TaskContext.get().partitionId(), state)

    state = merged(vectors.select(vector_col).mapInArrow(run, _STATE))
    return float(np.abs(state.covariance() - np.eye(len(live))).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, model: Whitening, error: float | None, size: int, id_col: str, vector_col: str) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        model, names = shared.value, [c.split()[0] for c in RESULT.split(", ")]
        k = len(model.scales)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keep, x = integers(part.column(1), size)
                ids = part.column(0).filter(pa.array(keep))
                rows = len(x)
                each = pa.array(np.repeat(np.arange(rows), k))
                columns = [
                    ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(each),
                    pa.array(model.project(x).ravel(), from_pandas=True), pa.array(np.tile(model.explained, rows), from_pandas=True), pa.array([error] * (rows * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return vectors.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, RESULT)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining vector and component."""
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    size = usual_size(source, "vector")
    state = fit(source, size, "vector") if size else None
    if state is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    model = solve(state, components)
    return whitened(source, model, identity_error(source, model, size, "vector"), size, "vec_id", "vector")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.table(spark, sf_dir, "embeddings"))
