"""Operator 12: embedding whitening by incremental eigendecomposition.

1. Each usable vector becomes whole numbers x = floor(256 * c); the fit list is
   every distinct x once (one grouped shuffle, so copies of one vector meet as
   one row a task), written.
2. Count n and sums S are added up per task, exactly.
3. Each task walks its rows and keeps the spectrum Q diag(D) Q' of the sum of
   (x - S/n)(x - S/n)'. A row changes it by one rank: the new eigenvalues are the
   roots of the secular equation, after deflation (``update``). Memory is d * d
   numbers whatever the number of rows.
4. Spectra are combined ``FAN`` at a time, each eigenpair of one applied to the
   other as one more rank-one update; a written table ends each round.
5. Rayleigh-Ritz refinement: from the leading vectors Q, tasks sum (x - S/n) y'
   with y = Q'(x - S/n); that gives V Q, the projected covariance Q'VQ and the
   residuals. The Ritz vectors replace Q; while a wanted pair's residual exceeds
   ``TOLERANCE`` of the largest eigenvalue, the residuals join the subspace and
   another pass follows.

Only one row of at most d * d numbers ever comes to the driver.

Defined results: rows whose vector is null or holds null or non-finite entries
are dropped, as are empty vectors and, where lengths differ, all but those of
the commonest length (the longer on a tie), since no covariance spans both.
Repeated rows count once in the fit and are each returned. Components whose
eigenvalue is not above rounding (as with one distinct vector, or fewer than
four dimensions) have no direction and are left out. An entry beyond the 64-bit
range becomes its nearest end, a deviation beyond it is null. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare, slices, table

SCALE = 256
FIT_ROWS = 4096        # rows whose spectrum one task keeps
FAN = 8                # spectra combined by one task
SPARE = 4              # further directions in the refined subspace
TOLERANCE = 1e-14      # residual of a component, relative to the largest eigenvalue
PASSES = 12
_EPS = np.finfo(np.float64).eps


def secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + z z' and the matrix d[i] - root[j] (row j), for rising distinct d and z without zeros.

    Root j lies between d[j] and d[j + 1] (the last within z'z above). It is kept as an
    offset from the nearer of the two, so its small differences to both stay exact.
    """
    m, z2 = len(d), z * z
    gap = np.append(np.diff(d), z2.sum())
    # a root lies nearer to the left end when f at the middle is not negative
    middle = (d[None, :] - d[:, None]) - (gap / 2)[:, None]
    left = 1 + (z2 / middle).sum(1) >= 0
    left[-1] = True
    origin = np.where(left, np.arange(m), np.minimum(np.arange(m) + 1, m - 1))
    delta = d[None, :] - d[origin][:, None]
    low = np.where(left, 0.0, -gap / 2)
    high = np.where(left, gap / 2, 0.0)
    high[-1] = gap[-1]
    tau = (low + high) / 2
    rows, after = np.arange(m), np.minimum(np.arange(m) + 1, m - 1)
    lower = np.tri(m)
    for _ in range(60):
        inverse = 1 / (delta - tau[:, None])
        part = z2 * inverse
        psi, whole = np.einsum("ij,ij->i", part, lower), part.sum(1)
        f = 1 + whole
        done = np.abs(f) <= 4 * _EPS * m * (1 + np.abs(psi) + np.abs(whole - psi))
        if done.all():
            break
        low, high = np.where(f < 0, tau, low), np.where(f < 0, high, tau)
        # two-pole interpolation: exact slopes left and right of the root
        a_, b_ = delta[rows, rows] - tau, delta[rows, after] - tau
        part *= inverse
        dpsi = np.einsum("ij,ij->i", part, lower)
        dphi = part.sum(1) - dpsi
        a = (a_ + b_) * f - a_ * b_ * (dpsi + dphi)
        b = a_ * b_ * f
        c = f - a_ * dpsi - b_ * dphi
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = a_[-1] + dpsi[-1] * a_[-1] ** 2 / (f[-1] - dpsi[-1] * a_[-1])  # the last root has one pole only
        new = tau + step
        inside = np.isfinite(new) & (new > low) & (new < high)
        new = np.where(inside, new, (low + high) / 2)
        if np.array_equal(new, tau):
            break
        tau = np.where(done, tau, new)
    return d[origin] + tau, delta - tau[:, None]


def update(d: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (rising values, vectors) of Q diag(d) Q' + v v'.

    Deflation: equal values take a reflection that gathers their share of v in
    one direction, and directions without a share keep their pair.
    """
    z = q.T @ v
    size = float(z @ z)
    if not size:
        return d, q
    tol = 8 * _EPS * (max(d[-1], 0.0) + size)
    equal = np.diff(d) <= tol
    if equal.any():
        q, z = q.copy(), z.copy()
        starts = np.flatnonzero(~np.concatenate([[False], equal]))
        for a, b in zip(starts, np.append(starts[1:], len(d))):
            share = z[a:b].copy()
            length = float(np.sqrt(share @ share))
            if b - a < 2 or not length:
                continue
            share[-1] += np.copysign(length, share[-1])   # Householder: all of it into the last
            share /= np.sqrt(share @ share)
            z[b - 1] = -np.copysign(length, z[b - 1])
            z[a:b - 1] = 0
            q[:, a:b] -= 2 * np.outer(q[:, a:b] @ share, share)
    live = np.flatnonzero(np.abs(z) * np.sqrt(size) > tol)
    if not len(live):
        return d, q
    values, apart = secular(d[live], z[live])
    # the vector whose exact roots these are: its eigenvectors are orthogonal to rounding
    base = d[live][None, :] - d[live][:, None]
    np.fill_diagonal(base, 1.0)
    ratio = -apart.T / base.T                    # [i, j]: (root j - d i) / (d j - d i)
    exact = np.copysign(np.sqrt(np.abs(ratio.prod(1))), z[live])
    u = exact[:, None] / apart.T
    u /= np.sqrt((u * u).sum(0))
    d, q = d.copy(), q if equal.any() else q.copy()
    d[live], q[:, live] = values, q[:, live] @ u
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _spectrum_row(d: np.ndarray, q: np.ndarray, node: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([d.tolist()], pa.list_(pa.float64())),
                                       pa.array([q.ravel().tolist()], pa.list_(pa.float64()))], ["node", "d", "q"])


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the rows that take part; see the module's text."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)))
    x = F.transform(v, lambda c: F.floor(SCALE * c.cast("double")))
    rows = rows.select(F.col(id_col).alias("vec_id"), x.alias("x"))
    dims = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    return rows.where(F.size("x") == (dims[0].dim if dims else 0))


def sums(fit: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """n and the exact sum of each dimension."""
    def run(batches):
        n, total = 0, np.zeros(dim, dtype=object)
        for b in slices(batches, 4096):
            x = _vectors(b.column(0), dim)
            big = np.abs(x.astype(np.float64)).max(initial=0) >= 2.0 ** 49
            n, total = n + len(x), total + (x.astype(object) if big else x).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(t) for t in total]])], ["n", "s"])

    parts = fit.mapInArrow(run, "n long, s array<string>")
    n = parts.agg(F.sum("n")).first()[0] or 0
    s = parts.select(F.posexplode("s").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return n, np.array([int(r.v) for r in s.orderBy("k").collect()], dtype=object)


def spectrum(fit: DataFrame, n: int, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors of the sum of (x - mean)(x - mean)', by rank-one updates."""
    dim = len(mean)

    def grow(batches):
        d, q = np.zeros(dim), np.eye(dim)
        for b in slices(batches, 1024):
            for z in _vectors(b.column(0), dim) - mean:
                d, q = update(d, q, z)
        from pyspark import TaskContext
        yield _spectrum_row(d, q, TaskContext.get().partitionId())

    def combine(key, some):  # FAN spectra at most
        total = None
        for r in range(some.num_rows):
            d, q = (np.array(some.column(c)[r].as_py()) for c in ("d", "q"))
            q = q.reshape(dim, dim)
            if total is None:
                total = (d, q)
                continue
            for k in np.flatnonzero(d > 0):
                total = update(*total, np.sqrt(d[k]) * q[:, k])
        return pa.Table.from_batches([_spectrum_row(*total, key[0].as_py())])

    shape = "node long, d array<double>, q array<double>"
    parts = max(1, -(-n // FIT_ROWS))
    spectra = materialise(fit.repartition(parts, "x").mapInArrow(grow, shape), "spectra")
    nodes = spectra.agg(F.max("node")).first()[0] + 1
    while nodes > 1:
        spectra = spectra.groupBy(F.floor(F.col("node") / FAN).alias("into")).applyInArrow(combine, shape)
        spectra, nodes = materialise(spectra, "spectra"), -(-nodes // FAN)
    last = spectra.first()
    return np.array(last.d), np.array(last.q).reshape(dim, dim)


def _products(fit: DataFrame, mean: np.ndarray, q: np.ndarray, power) -> np.ndarray:
    """The sum over the fit list of power(x - mean, its shares of q), a matrix, added up by task and then by entry."""
    dim = len(mean)

    def run(batches):
        total = 0.0
        for b in slices(batches, 4096):
            z = _vectors(b.column(0), dim) - mean
            total = total + power(z, z @ q)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["m"])

    cells = fit.mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    return np.array([r.v for r in cells.orderBy("k").collect()])


def refine(fit: DataFrame, n: int, mean: np.ndarray, q: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The leading ``wanted`` eigenpairs of the covariance (falling) and its trace, by Rayleigh-Ritz passes over the fit list."""
    dim = len(mean)
    for _ in range(PASSES):
        basis = np.linalg.qr(q)[0]
        width = basis.shape[1]
        out = _products(fit, mean, basis, lambda z, y: np.vstack([z.T @ y, np.full((1, y.shape[1]), (z * z).sum())]))
        out = out.reshape(dim + 1, width) / n
        vq, trace = out[:-1], float(out[-1, 0])
        inner = basis.T @ vq
        e, r = np.linalg.eigh((inner + inner.T) / 2)
        e, r = e[::-1], r[:, ::-1]
        q, rest = basis @ r, vq @ r
        rest = rest - q * e
        worst = np.sqrt((rest[:, :wanted] ** 2).sum(0)).max()
        if width == dim or worst <= TOLERANCE * max(e[0], 0):
            break
        lengths = np.sqrt((rest ** 2).sum(0))
        extra = rest[:, lengths > 0] / lengths[lengths > 0]
        q = np.hstack([q, extra])[:, :dim]
    return e[:wanted], q[:, :wanted], trace


class Whitening:
    """A fitted whitening: n, sums S, components (columns), their eigenvalues and shares, and the fit's identity error."""

    def __init__(self, fit: DataFrame, dim: int, components: int):
        self.dim = dim
        self.n, self.sums = sums(fit, dim)
        mean = np.array([float(s) / self.n for s in self.sums])
        self.mean, self.spectrum = mean, spectrum(fit, self.n, mean)
        wanted = min(components, dim)
        q = self.spectrum[1][:, ::-1][:, :min(dim, wanted + SPARE)]
        e, q, trace = refine(fit, self.n, mean, q, wanted)
        held = e > dim * _EPS * max(trace, 0.0)
        self.values, self.vectors, self.trace = e[held], q[:, held], trace
        self.error = self._identity_error(fit) if held.any() else 0.0

    def _identity_error(self, fit: DataFrame) -> float:
        k = len(self.values)
        out = _products(fit, self.mean, self.vectors / np.sqrt(self.values),
                        lambda z, w: np.vstack([w.T @ w, w.sum(0)])).reshape(k + 1, k) / self.n
        return float(np.abs(out[:k] - np.outer(out[k], out[k]) - np.eye(k)).max())

    def transform(self, rows: DataFrame) -> DataFrame:
        """vec_id, component, n, deviation, whitened, explained, identity_error of each of ``rows`` (vec_id, x)."""
        n, s, mean, dim = self.n, self.sums, self.mean, self.dim
        turn, share, error, k = self.vectors / np.sqrt(self.values), self.values / self.trace, self.error, len(self.values)
        most = max(abs(int(t)) for t in s)

        def deviations(x):
            small = (n * float(np.abs(x.astype(np.float64)).max(initial=0)) + most) ** 2 * dim < 2.0 ** 62
            off = (x if small else x.astype(object)) * n - (s.astype(np.int64) if small else s)
            total = (off * off).sum(1)
            return [int(t) if t < 2 ** 63 else None for t in total]

        def run(batches):
            for b in slices(batches, 1024):
                x = _vectors(b.column(1), dim)
                m = len(x)
                at = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, n, dtype=np.int64)), pa.array(deviations(x), pa.int64()).take(pa.array(at)),
                     pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        kind = rows.schema["vec_id"].dataType.simpleString()
        return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, "
                                    "explained double, identity_error double")


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4) -> DataFrame:
    """Fit on the distinct vectors of ``rows`` and whiten every usable row; one row for each component."""
    prepare(rows.sparkSession)
    vectors = usable(rows, id_col, vec_col)
    fit = materialise(vectors.select("x").distinct(), "fit-list")
    first = fit.first()
    if first is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, "
                                                     "explained double, identity_error double")
    return Whitening(fit, len(first.x), components).transform(vectors)


def op12_embedding_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
