"""Whitening by incremental eigendecomposition.

Each partition keeps the eigendecomposition of its rows' scatter and applies one centred rank-one
update a row: the new eigenvalues are the roots of the secular equation, after deflation of
coordinates that do not move. Spectra of partitions are combined in a tree, the eigenpairs of
one being successive rank-one updates of the other. Rayleigh-Ritz rounds over all rows then refine
the components to double precision and measure how white the result is.

Vectors are taken as integers, so sums and centred values are exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablewatch.llm.base import slices
from sablewatch.session import materialised

#: Components returned; spectra that meet in one task of a merging round.
COMPONENTS, FAN_IN = 8, 8
#: Rounds end when no entry off the diagonal exceeds this share of the variance (most rounds).
SETTLED, ROUNDS = 1e-13, 4
#: A component with at most this share of the variance has none.
NO_VARIANCE = 1e-12

# --- fixed values: the integers a vector becomes --------------------------------------
SCALE, OFFSET = 1024, 100_000
# --------------------------------------------------------------------------------------

#: Entries whose integer is larger than this are not exact in a double; such rows take no part.
LARGEST = 1 << 52
EPS = float(np.finfo(float).eps)


# --- one rank-one update ------------------------------------------------------------


def _roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(z2 / (d - x))``, one above each of the ascending poles ``d``.

    Returned as the index of the nearest pole and the distance from it, which is exact to the
    last places even where a root all but touches its pole. Each step solves the equation with all
    poles but the two neighbours replaced by a constant; a bracket guards it.
    """
    k = len(d)
    own = np.arange(k)
    gap = np.append(np.diff(d), z2.sum())
    half = gap / 2
    at_half = 1 + (z2 / (d - d[:, None] - half[:, None])).sum(1)
    right = (at_half < 0) & (own < k - 1)
    pole = own + right
    delta = d - d[pole][:, None]
    lower = np.tri(k)
    lo = np.where(right, -half, np.where(at_half < 0, half, 0.0))
    hi = np.where(right, 0.0, np.where(at_half < 0, gap, half))
    left, behind = delta[own, own], np.append(delta[own[:-1], own[1:]], 0.0)
    last = own == k - 1
    x = (lo + hi) / 2
    for _ in range(60):
        off = delta - x[:, None]
        term = z2 / off
        slope = term / off
        f = 1 + term.sum(1)
        total = slope.sum(1)
        before = (slope * lower).sum(1)
        lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
        d1, d2 = left - x, np.where(last, 1.0, behind - x)
        c = f - d1 * before - np.where(last, 0.0, d2 * (total - before))
        a, b = (d1 + d2) * f - d1 * d2 * total, d1 * d2 * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        step = np.where(last, d1 + d1 * d1 * before / c, step)
        new = x + step
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        # A root is found when its step, or the equation's rest, is rounding noise.
        done = (np.abs(new - x) <= 4 * EPS * np.abs(new)) | (np.abs(f) <= 4 * EPS * (1 + np.abs(term).sum(1)))
        x = np.where(done, x, new)
        if done.all():
            break
    return pole, x


@dataclass
class Spectrum:
    """Count, mean and eigendecomposition (ascending) of the scatter around the mean."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim), np.zeros(dim), np.eye(dim))

    def add(self, v: np.ndarray) -> None:
        """One rank-one update: the scatter grows by ``v vT``."""
        z, d = v @ self.vectors, self.values
        norm = float(z @ z)
        tol = 8 * EPS * max(abs(d[-1]), norm)
        if norm <= tol * EPS:
            return
        q, keep = self.vectors, np.abs(z) * math.sqrt(norm) > tol
        live = np.flatnonzero(keep)
        if len(live) > 1:
            near = np.diff(d[live]) * np.abs(z[live[1:]] * z[live[:-1]]) / (z[live[1:]] ** 2 + z[live[:-1]] ** 2) <= tol
            if near.any():
                # Equal values: turn two vectors so that one coordinate vanishes and stays as it is.
                i = live[0]
                for j in live[1:]:
                    size = math.hypot(z[i], z[j])
                    c, s = z[j] / size, z[i] / size
                    if (d[j] - d[i]) * abs(c * s) <= tol:
                        z[i], z[j] = 0.0, size
                        q[:, i], q[:, j] = c * q[:, i] - s * q[:, j], s * q[:, i] + c * q[:, j]
                        keep[i] = False
                    i = j
                live = np.flatnonzero(keep)
        if not len(live):
            return
        at, z2 = d[live], z[live] ** 2
        with np.errstate(all="ignore"):
            pole, x = _roots(at, z2)
            off = (at - at[pole][:, None]) - x[:, None]  # pole i minus root j, by j, i
            between = at - at[:, None]
            np.fill_diagonal(between, 1.0)
            # Coordinates for which the roots found are exact: vectors from them are orthogonal.
            exact = np.sqrt(np.abs(np.prod(off / between, axis=0))) * np.sign(z[live])
            turned = exact / off
        turned /= np.sqrt((turned * turned).sum(1))[:, None]
        q[:, live] = q[:, live] @ turned.T
        d[live] = at[pole] + x
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = d[order], q[:, order]

    def row(self, x: np.ndarray) -> None:
        """One more row: a centred rank-one update."""
        off = x - self.mean
        self.n += 1
        self.mean = self.mean + off / self.n
        if self.n > 1:
            self.add(off * math.sqrt((self.n - 1) / self.n))

    def merge(self, other: Spectrum) -> None:
        """All rows of another spectrum: its eigenpairs one by one, then the way between the means."""
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.add(vector * math.sqrt(value))
        n, off = self.n + other.n, other.mean - self.mean
        self.add(off * math.sqrt(self.n * other.n / n))
        self.mean, self.n = self.mean + off * (other.n / n), n

    def record(self) -> tuple:
        return self.n, *(np.ascontiguousarray(a).tobytes() for a in (self.mean, self.values, self.vectors))

    @classmethod
    def read(cls, n: int, mean: bytes, values: bytes, vectors: bytes) -> Spectrum:
        mean, values, vectors = (np.frombuffer(b).copy() for b in (mean, values, vectors))
        return cls(int(n), mean, values, vectors.reshape(len(mean), len(mean)))


# --- integers of a batch --------------------------------------------------------------


def _integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors of a dimension, and their integers."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), dim)
    with np.errstate(all="ignore"):
        x = np.floor(SCALE * flat) + OFFSET
    good = (np.abs(x) <= LARGEST).all(1)
    return at[good], x[good].astype(np.int64)


def _sums(batches):
    """Rows, sums and largest entry of each dimension in a task."""
    found: dict[int, tuple[int, np.ndarray, int]] = {}
    for batch in slices(batches, 2048):
        for dim in pc.unique(pc.list_value_length(batch.column(0)).drop_null()).to_pylist():
            _, x = _integers(batch.column(0), dim)
            if dim and len(x):
                n, sums, most = found.get(dim, (0, np.zeros(dim, object), 0))
                found[dim] = n + len(x), sums + x.sum(0).astype(object), max(most, int(np.abs(x).max()))
    for dim, (n, sums, most) in found.items():
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array([dim] * dim, pa.int32()), "place": pa.array(range(dim), pa.int32()), "n": pa.array([n] * dim, pa.int64()),
            "total": pa.array([str(s) for s in sums], pa.string()), "most": pa.array([most] * dim, pa.int64()),
        })


@dataclass(frozen=True)
class Moments:
    """Exact size and sums of the fit list."""

    n: int
    sums: tuple[int, ...]
    most: int

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S`` exactly: as longs where they suffice, else as Python integers."""
        if 2 * self.n * (self.most + 1) >= 1 << 62:
            x = x.astype(object)
        return x * self.n - np.array(self.sums, x.dtype)

    def off(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n`` in doubles."""
        return (self.centred(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        off = self.centred(x)
        if off.size and (off.dtype == object or self.dim * int(np.abs(off).max()) ** 2 >= 1 << 63):
            exact = (off.astype(object) ** 2).sum(1)
            return [int(v) if v < 1 << 63 else None for v in exact]
        return (off * off).sum(1).tolist()


def moments(vectors: DataFrame) -> Moments | None:
    """Of the commonest dimension (of equal ones the least); None without a usable vector."""
    own = vectors.mapInArrow(_sums, "dim int, place int, n long, total string, most long")
    dims = own.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("most").alias("most"))
    # One row per place of the commonest dimension.
    counts = dims.where("place = 0").orderBy(F.desc("n"), "dim").limit(1).select("dim")
    rows = dims.join(counts, "dim").orderBy("place").collect()
    return Moments(rows[0].n, tuple(int(r.total) for r in rows), max(r.most for r in rows)) if rows else None


# --- passes over all rows -------------------------------------------------------------

_SPECTRUM = "part long, n long, mean binary, values binary, vectors binary"


def _own_spectrum(dim: int):
    def run(batches):
        own = Spectrum.of(dim)
        for batch in slices(batches, 2048):
            for x in _integers(batch.column(0), dim)[1].astype(float):
                own.row(x)
        if own.n:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int64()),
                **{k: pa.array([v]) for k, v in zip(("n", "mean", "values", "vectors"), own.record())},
            })

    return run


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    own = None
    for r in pdf.sort_values("part").itertuples():
        other = Spectrum.read(r.n, r.mean, r.values, r.vectors)
        if own is None:
            own = other
        else:
            own.merge(other)
    return pd.DataFrame([(pdf["part"].min() // FAN_IN, *own.record())], columns=["part", "n", "mean", "values", "vectors"])


def spectrum(vectors: DataFrame, dim: int, fan_in: int = FAN_IN) -> Spectrum:
    """Incremental eigendecomposition of all rows: by task, then merged ``fan_in`` at a time."""
    parts = materialised(vectors.mapInArrow(_own_spectrum(dim), _SPECTRUM), "whiten-spectra")
    most = parts.agg(F.max("part")).first()[0]
    while most > 0:
        parts = materialised(parts.groupBy(F.floor(F.col("part") / fan_in)).applyInPandas(_merged, _SPECTRUM), "whiten-spectra")
        most //= fan_in
    r = parts.first()
    return Spectrum.read(r.n, r.mean, r["values"], r.vectors)


def projected(vectors: DataFrame, fit: Moments, basis: np.ndarray) -> np.ndarray:
    """Covariance of all rows in a basis; only its entries reach the driver."""
    shared, dim, k = vectors.sparkSession.sparkContext.broadcast(basis), fit.dim, basis.shape[1]

    def run(batches):
        total = np.zeros((k, k))
        for batch in slices(batches, 2048):
            y = fit.off(_integers(batch.column(0), dim)[1]) @ shared.value
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(k * k, dtype=np.int32)), "value": pa.array(total.ravel())})

    out = np.zeros(k * k)
    for r in vectors.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r.place] = r.value
    out = out.reshape(k, k) / fit.n
    return (out + out.T) / 2


def refined(vectors: DataFrame, fit: Moments, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz rounds until the covariance in the basis is diagonal: variances (falling),
    components as columns, and the covariance last measured with them."""
    for _ in range(ROUNDS):
        basis, _ = np.linalg.qr(basis)
        inner = projected(vectors, fit, basis)
        values = np.diag(inner)
        if np.abs(inner - np.diag(values)).max() <= SETTLED * values.sum():
            break
        basis = basis @ np.linalg.eigh(inner)[1][:, ::-1]
    order = np.argsort(-values, kind="stable")
    basis, inner = basis[:, order], inner[np.ix_(order, order)]
    largest = np.abs(basis).argmax(0)
    return values[order], basis * np.sign(basis[largest, range(basis.shape[1])]), inner


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component, as WHITENED says; needs vec_id and embedding.

    Vectors that are null or hold null or non-finite entries take no part. Neither do empty ones,
    those of another dimension than the commonest (of equally common ones the least), or those
    with an entry beyond 2**52 as integer. Repeated rows and ids count and return each time; a null
    vec_id stays null. Components without variance (at most 1e-12 of it) are left out, so equal
    vectors give no rows, like a table without vectors. A deviation too large for a long is null.
    Signs: the largest entry of a component is positive.
    """
    vectors = embeddings.select(F.col("embedding").cast("array<double>").alias("embedding"))
    fit = moments(vectors)
    values = np.zeros(0)
    if fit is not None:
        values, basis, inner = refined(vectors, fit, spectrum(vectors, fit.dim).vectors)
    k = int((values[:components] > NO_VARIANCE * values.sum()).sum()) if len(values) else 0
    if not k:
        return embeddings.sparkSession.createDataFrame([], WHITENED)
    root = np.sqrt(values[:k])
    error = float(np.abs(inner[:k, :k] / root[:, None] / root - np.eye(k)).max())
    onto, share = basis[:, :k] / root, values[:k] / values.sum()
    shared = embeddings.sparkSession.sparkContext.broadcast(onto)

    def run(batches):
        for batch in slices(batches, 2048):
            at, x = _integers(batch.column(1), fit.dim)
            m = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, fit.n)), pa.array([v for v in fit.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array((fit.off(x) @ shared.value).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, WHITENED)
