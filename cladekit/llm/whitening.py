"""Embedding whitening by incremental eigendecomposition.

Entries become whole numbers, so means and deviations are exact. Then, over the distinct vectors (the fit list):

1. each task keeps mean, eigenvalues and eigenvectors of the vectors it has read. A block of vectors is centred and
   replaced by the rows of its triangular factor, which have the same scatter; each of them, and the shift between the two
   means, is one centred rank-one update. An update rotates the eigenvectors by the roots of its secular equation;
   directions it doesn't touch, and equal eigenvalues, are deflated first.
2. Spectra of tasks are combined in groups, level by level: each eigenvector of one is a rank-one update of the other.
3. One more pass projects all vectors on the combined eigenvectors (Rayleigh-Ritz): the small matrix this gives yields the
   final components, free of what the updates have rounded.

What a task or the driver holds is a few matrices of the vectors' length squared, at any number of rows.

Cases: NULL and empty vectors, those with NULL or non-finite entries, and those of another length than the commonest are
left out; repeated vectors count once in the fit and are all returned; a NULL or repeated id is returned as it is; entries
beyond 2^62 count as 2^62; a component without variance (fewer distinct vectors than components) has whitened NULL and
explained 0 or, if nothing varies, NULL; an exact deviation beyond a long is NULL; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .vectors import id_type, matrix, usable

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
BLOCK = 4096  # vectors brought into a triangular factor at once
FAN = 16  # states combined by one task
FLAT = 1e-12  # share of the trace below which a component has no variance
EPS = np.finfo(float).eps

_STATE = "part long, state binary"
_STATE_ARROW = pa.schema([("part", pa.int64()), ("state", pa.binary())])


# -- rank-one updates ---------------------------------------------------------------------------------------------------

def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z^2 / (d - mu)) for rising poles ``d``, and the matrix d_i - mu_j.

    Each root is sought as its distance from the nearer pole, so the differences keep their digits. A step solves
    the equation with two poles kept and the rest held level; a step that leaves the bracket becomes a bisection.
    """
    k = len(d)
    weight = rho * z * z
    upper = np.append(d[1:], d[-1] + weight.sum())
    gap = upper - d
    poles = d[:, None]
    middle = 1 + (weight[:, None] / (poles - (d + gap / 2))).sum(0)
    right = middle < 0
    right[-1] = False
    near = np.where(right, upper, d)
    base = poles - near
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, np.where(middle < 0, gap, gap / 2))
    tau = (low + high) / 2
    left = np.tri(k, k, 0, dtype=bool).T  # pole i <= root j
    at = np.arange(k)
    last = at == k - 1
    for _ in range(80):
        delta = base - tau
        share = weight[:, None] / delta
        slope = share / delta
        psi, dpsi = np.where(left, share, 0).sum(0), np.where(left, slope, 0).sum(0)
        phi, dphi = share.sum(0) - psi, slope.sum(0) - dpsi
        f = 1 + psi + phi
        low, high = np.where(f < 0, tau, low), np.where(f < 0, high, tau)
        done = (np.abs(f) <= 4 * EPS * (1 + k * (np.abs(psi) + np.abs(phi)))) | (high - low <= 2 * EPS * np.abs(tau))
        if done.all():
            break
        here = delta[at, at]
        there = np.where(last, upper[-1] - near - tau, delta[np.minimum(at + 1, k - 1), at])
        s, t = here * here * dpsi, np.where(last, 0.0, there * there * dphi)
        c = f - here * dpsi - np.where(last, 0.0, there * dphi)
        a = c * (here + there) + s + t
        b = c * here * there + s * there + t * here
        with np.errstate(all="ignore"):
            q = (a + np.copysign(np.sqrt(np.maximum(a * a - 4 * b * c, 0)), a)) / 2
            first, second = tau + b / q, tau + q / c
        new = np.where((first > low) & (first < high), first,
                       np.where((second > low) & (second < high), second, (low + high) / 2))
        tau = np.where(done, tau, new)
    return near + tau, base - tau


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors of  vectors diag(values) vectors' + rho v v'  for rho > 0."""
    size = float(v @ v)
    if rho <= 0 or size == 0:
        return values, vectors
    rho, z = rho * size, vectors.T @ (v / np.sqrt(size))
    tol = 8 * EPS * max(float(np.abs(values).max()), rho)
    # equal eigenvalues: one reflection moves all of the update onto one of their vectors
    edges = np.flatnonzero(np.diff(values) > tol) + 1
    if len(edges) + 1 < len(values):
        vectors = vectors.copy()
        for at in np.split(np.arange(len(values)), edges):
            norm = np.linalg.norm(z[at])
            if len(at) == 1 or norm == 0:
                continue
            w = z[at].copy()
            w[-1] += np.copysign(norm, w[-1])
            w /= np.linalg.norm(w)
            vectors[:, at] -= 2 * np.outer(vectors[:, at] @ w, w)
            z[at] = vectors[:, at].T @ (v / np.sqrt(size))
            z[at[:-1]] = 0
    moved = rho * np.abs(z) > tol
    if not moved.any():
        return values, vectors
    d, y = values[moved], z[moved]
    roots, diff = secular_roots(d, y, rho)
    k = len(d)
    # the update whose exact roots these are: its eigenvectors are orthogonal to working precision
    poles = d[:, None] - d[None, :]
    bottom = np.empty((k, k))
    low = np.tri(k, k, -1, dtype=bool)
    bottom[low] = poles[low]
    bottom[:, :-1] = np.where(low[:, :-1], bottom[:, :-1], poles[:, 1:])
    bottom[:, -1] = -rho
    exact = np.sqrt(np.abs(np.prod(diff / bottom, axis=1)))
    turn = np.copysign(exact, y)[:, None] / diff
    turn /= np.linalg.norm(turn, axis=0)
    values, out = values.copy(), vectors.copy()
    values[moved], out[:, moved] = roots, vectors[:, moved] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], out[:, order]


class Spectrum:
    """Count, mean and eigendecomposition of the scatter of the vectors added so far."""

    def __init__(self, size: int):
        self.n, self.mean = 0, np.zeros(size)
        self.values, self.vectors = np.zeros(size), np.eye(size)

    def _add(self, n: int, mean: np.ndarray, terms: Iterator[tuple[float, np.ndarray]]) -> None:
        for rho, v in terms:
            self.values, self.vectors = rank_one(self.values, self.vectors, v, rho)
        if n and self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, mean - self.mean, n * self.n / (n + self.n))
        if n:
            self.mean = self.mean + (mean - self.mean) * (n / (n + self.n))
            self.n += n

    def add_block(self, rows: np.ndarray) -> None:
        mean = rows.mean(0)
        factor = rows - mean
        if len(rows) > rows.shape[1]:
            factor = np.linalg.qr(factor, mode="r")
        self._add(len(rows), mean, ((1.0, r) for r in factor))

    def add(self, other: Spectrum) -> None:
        self._add(other.n, other.mean, zip(other.values.tolist(), other.vectors.T, strict=True))

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.vectors.ravel()]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, size: int) -> Spectrum:
        flat = np.frombuffer(data)
        out = cls(size)
        out.n, out.mean, out.values = int(flat[0]), flat[1 : 1 + size], flat[1 + size : 1 + 2 * size]
        out.vectors = flat[1 + 2 * size :].reshape(size, size)
        return out


# -- passes over the fit list ---------------------------------------------------------------------------------------------

def _blocks(batches, size: int) -> Iterator[np.ndarray]:
    """Blocks of at most BLOCK vectors over the batches' borders."""
    held, n = [], 0
    for batch in batches:
        x = matrix(batch.column(0), size)
        for at in range(0, len(x), BLOCK):
            held.append(x[at : at + BLOCK])
            n += len(held[-1])
            if n >= BLOCK:
                whole = np.concatenate(held)
                yield whole[:BLOCK]
                held, n = [whole[BLOCK:]], n - BLOCK
    if n:
        yield np.concatenate(held)


def _reduced(fit: DataFrame, of_blocks: Callable, combine: Callable, label: str) -> bytes | None:
    """One state per task, combined FAN at a time, level by level; None for an empty table."""

    def run(batches):
        state = of_blocks(batches)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([state], pa.binary())], schema=_STATE_ARROW)

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "state": [combine(rows.sort_values("part")["state"].tolist())]})

    states = stored(fit.mapInArrow(run, _STATE), label)
    while states.count() > 1:
        states = stored(states.withColumn("_to", F.floor(F.col("part") / FAN)).groupBy("_to")
                        .applyInPandas(merge, _STATE), label)
    row = states.first()
    return bytes(row["state"]) if row else None


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""
    schema = pa.schema([("dim", pa.int32()), ("s", pa.decimal128(38, 0))])

    def run(batches):
        n, total = 0, [0] * size
        for x in _blocks(batches, size):
            n += len(x)
            # halves of 31 bits: no sum of a block leaves 64 bits
            total = [t + (int(h) << 31) + int(w) for t, h, w in
                     zip(total, (x >> 31).sum(0), (x & 0x7FFFFFFF).sum(0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, size), pa.int32()), pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))],
                schema=schema)

    rows = fit.mapInArrow(run, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()
    found = {r["dim"]: int(r["s"]) for r in rows}  # one row a dimension
    return found.get(-1, 0), [found.get(k, 0) for k in range(size)]


def _plus(states: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(s) for s in states], axis=0).tobytes()


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: exact count and sums, components by falling variance, and how far the result is from white."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # one column each
    variances: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, the whole part taken off exactly."""
        whole = [round(s / self.n) if abs(s) < 1 << 52 else s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])
        return (x - np.array(whole, np.int64)).astype(float) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column a component; NaN where a component has no variance."""
        flat = self.variances <= FLAT * self.trace
        scale = np.where(flat, np.nan, np.sqrt(np.where(flat, 1.0, self.variances)))
        return self.centred(x) @ self.components / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)^2, exact; None beyond a long."""
        most = float(max(self.n * max(abs(int(x.max())), abs(int(x.min()))), max(map(abs, self.sums)))) if x.size else 0.0
        if 4 * most * most * x.shape[1] < 2.0**62:
            return ((self.n * x - np.array(self.sums)) ** 2).sum(1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1)
        return [v if v < 1 << 63 else None for v in exact]


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors ``x`` of ``rows``; None where there are none."""
    listed = stored(rows.select("x").distinct(), "whitening-fit")
    n, sums = _sums(listed, size)
    if not n:
        return None
    exact = Whitening(n, tuple(sums), np.eye(size), np.ones(size), float(size), 0.0)

    def spectrum(batches):
        state = Spectrum(size)
        for x in _blocks(batches, size):
            state.add_block(exact.centred(x))
        return state.to_bytes() if state.n else None

    def combined(states):
        first = Spectrum.from_bytes(states[0], size)
        for s in states[1:]:
            first.add(Spectrum.from_bytes(s, size))
        return first.to_bytes()

    basis = Spectrum.from_bytes(_reduced(listed, spectrum, combined, "whitening-spectra"), size).vectors
    basis = np.linalg.qr(basis)[0]

    def projected(batches):
        total = None
        for x in _blocks(batches, size):
            p = exact.centred(x) @ basis
            total = p.T @ p if total is None else total + p.T @ p
        return None if total is None else total.tobytes()

    ritz = np.frombuffer(_reduced(listed, projected, _plus, "whitening-ritz")).reshape(size, size) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    top = np.argsort(-values, kind="stable")[:components]
    model = Whitening(n, tuple(sums), basis @ turn[:, top], np.maximum(values[top], 0.0), float(np.trace(ritz)), 0.0)

    def second_moments(batches):
        total = None
        for x in _blocks(batches, size):
            w = np.nan_to_num(model.whitened(x))
            w = np.column_stack([np.ones(len(w)), w])
            total = w.T @ w if total is None else total + w.T @ w
        return None if total is None else total.tobytes()

    moments = np.frombuffer(_reduced(listed, second_moments, _plus, "whitening-check")).reshape(len(top) + 1, -1) / n
    white = model.variances > FLAT * model.trace
    off = moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:]) - np.eye(len(top))
    error = float(np.abs(off[np.ix_(white, white)]).max()) if white.any() else 0.0
    return Whitening(n, tuple(sums), model.components, model.variances, model.trace, error)


def transform(rows: DataFrame, model: Whitening, size: int) -> DataFrame:
    """Columns ``id``, ``deviation`` and ``whitened`` (an array, one entry a component) of every row."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), size)
            w = model.whitened(x)
            flat = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w).ravel())
            starts = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.deviations(x), pa.int64()), pa.ListArray.from_arrays(starts, flat)],
                names=["id", "deviation", "whitened"])

    schema = T.StructType([T.StructField("id", id_type(rows)), *T.StructType.fromDDL("deviation long, whitened array<double>")])
    return rows.mapInArrow(run, schema)


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """One row for each usable row and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Deviations don't depend on what is added to every entry (``OFFSET`` in the query's contract), so it is left out.
    """
    rows, size = usable(df, id_col, vector, scale)
    model = fit(rows, size, components) if size else None
    schema = T.StructType([T.StructField(id_col, id_type(rows)), *T.StructType.fromDDL(
        "component int, n long, deviation long, whitened double, explained double, identity_error double")])
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    share = [float(v) / model.trace if model.trace > 0 else None for v in model.variances]
    return transform(rows, model, size).select("id", "deviation", F.posexplode("whitened").alias("_k", "whitened")).select(
        F.col("id").alias(id_col), (F.col("_k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
        "deviation", "whitened",
        F.get(F.array(*[F.lit(s).cast("double") for s in share]), F.col("_k")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"))
