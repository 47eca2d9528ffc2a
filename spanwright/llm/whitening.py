"""Whitening of embeddings: eigenvectors of their covariance from spectra that grow by rank-one updates.

Vectors are brought to whole numbers, and each different one counts once. A task keeps streams of spectra (count, sums,
eigenvalues, eigenvectors) and takes every vector in as a rank-one update around the running mean: deflation sets aside what the
update can't move, the secular equation gives the new eigenvalues, and the weights that fit them exactly give eigenvectors that
stay orthogonal. Spectra of streams and tasks are joined by a rank-one update for each eigenpair of one and another for the
difference of means, in rounds of a bounded number of spectra a task. Last, Spark sums the covariance of the vectors in the basis
found, and its eigenvectors (Rayleigh-Ritz over the whole space) mend what rounding the updates left.

A spectrum has the size of a square of the dimensions; one comes to the driver.

Defined cases: rows whose vector is null, empty, of another length than most rows' (ties: the longest), or holds a null, a
non-finite entry or one that in steps is beyond 2^53, get no result; equal rows get equal results; an empty table gives none; where fewer
components have variance than asked for, the others have none of their own: ``whitened`` is null there, and ``identity_error``
holds those that have. ``deviation`` is null where it doesn't fit a long. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import table, written

#: Streams of spectra in a task, which numpy updates together; spectra that one task joins; vectors of a task, about, and those for which it has a stream.
STREAMS, JOINED, TASK, ROWS = 16, 8, 8192, 64
EPS = np.finfo(float).eps
#: Eigenvalues this near to each other, against the largest, or weights this small, are set aside.
DEFLATE = 8 * EPS


def _roots(d: np.ndarray, z2: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """(b, n, n): d_j - root_i of 1 + rho sum z_j^2 / (d_j - x), for rising d without repeats where z2 > 0; an entry with z2 = 0 is its own root.

    Root i lies between d_i and the next. It is held as its distance from the nearer end, so that differences to d are exact;
    steps interpolate the poles below and above by one each and fall back on halving, for the roots that still move.
    """
    n = d.shape[1]
    # dead entries move behind the live ones, so that neighbours are neighbours
    order = np.argsort(z2 <= 0, axis=1, kind="stable")
    d, z2 = np.take_along_axis(d, order, 1), np.take_along_axis(z2, order, 1)
    count = (z2 > 0).sum(1)
    out = d[:, None, :] - d[:, :, None]
    at, i = np.nonzero(z2 > 0)
    own, w = d[at], rho[at, None] * z2[at]
    low, last = own[np.arange(len(i)), i], i == count[at] - 1
    gap = np.where(last, w.sum(1), own[np.arange(len(i)), np.minimum(i + 1, n - 1)] - low)
    below = (np.arange(n) <= i[:, None]).astype(float)
    dead = w <= 0
    delta = own - low[:, None]
    delta[dead] = np.inf
    near = ((w / (delta - (gap / 2)[:, None])).sum(1) >= -1) | last
    delta = np.where(near[:, None], delta, delta - gap[:, None])
    delta[np.arange(len(i)), i] = np.where(near, 0.0, -gap)
    beyond = np.flatnonzero(~near)
    delta[beyond, i[beyond] + 1] = 0.0
    end0, end1 = np.where(near, 0.0, -gap), np.where(near, gap, 0.0)
    lo, hi = np.where(near, 0.0, -gap / 2), np.where(last, gap * (1 + 4 * EPS), np.where(near, gap / 2, 0.0))
    x, found = (lo + np.minimum(hi, gap)) / 2, np.zeros(len(i))
    left = np.arange(len(i))
    with np.errstate(all="ignore"):
        for _ in range(100):
            r = 1 / (delta - x[:, None])
            term = w * r
            psi, total = np.einsum("mj,mj->m", term, below), term.sum(1)
            slope = term * r
            dpsi, dall = np.einsum("mj,mj->m", slope, below), slope.sum(1)
            phi, dphi, f = total - psi, dall - dpsi, 1 + total
            found[left] = x
            go = (np.abs(f) > 8 * EPS * (1 + phi - psi)) & (hi - lo > EPS * np.maximum(np.abs(lo), np.abs(hi)))
            if not go.any():
                break
            lo, hi = np.where(f < 0, x, lo), np.where(f > 0, x, hi)
            # psi ~ a + q / (end0 - x) and phi ~ b + s / (end1 - x) with these values and slopes; the last root has no pole above
            t0, t1 = end0 - x, end1 - x
            q, s, c = dpsi * t0 * t0, dphi * t1 * t1, f - dpsi * t0 - dphi * t1
            a1, a0 = -(c * (t0 + t1) + q + s), c * t0 * t1 + q * t1 + s * t0
            root = np.sqrt(np.maximum(a1 * a1 - 4 * c * a0, 0))
            v = -(a1 + np.copysign(root, a1)) / 2
            y1, y2 = x + v / c, x + a0 / v
            y = np.where((y1 > lo) & (y1 < hi) & ~((y2 > lo) & (y2 < hi) & (np.abs(y2 - x) < np.abs(y1 - x))), y1, y2)
            y = np.where(last, x + t0 + q / c, y)
            x = np.where((y > lo) & (y < hi), y, (lo + hi) / 2)
            if go.mean() < 0.7:
                left, delta, w, below, x, lo, hi, end0, end1, last = (v[go] for v in (left, delta, w, below, x, lo, hi, end0, end1, last))
            elif not go.all():
                x = np.where(go, x, found[left])
    base = np.where(near, low, low + gap)
    exact = own - low[:, None]
    exact = np.where(near[:, None], exact, own - np.where(near, low, own[np.arange(len(i)), np.minimum(i + 1, n - 1)])[:, None]) - found[:, None]
    out[at, i] = np.where(dead, own - (base + found)[:, None], exact)
    back = np.argsort(order, axis=1, kind="stable")
    return np.take_along_axis(np.take_along_axis(out, back[:, :, None], 1), back[:, None, :], 2)


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectra (b, n) and (b, n, n; columns) of A + rho v v' from those of A, for rho >= 0; ``values`` rise."""
    z = np.einsum("bij,bi->bj", vectors, v)
    values, vectors, z = values.copy(), vectors.copy(), z.copy()
    rho = np.asarray(rho, float)
    norm2 = (z * z).sum(1)
    tolerance = DEFLATE * np.maximum(np.abs(values).max(1), rho * norm2)
    # deflation: eigenvalues that are equal take the weight in one of them
    small = rho[:, None] * np.abs(z) * np.sqrt(norm2)[:, None] <= tolerance[:, None]
    z[small] = 0.0
    apart = np.diff(values, axis=1) > tolerance[:, None]
    run = np.concatenate([np.zeros((len(z), 1), int), np.cumsum(apart, 1)], 1)
    earlier = np.maximum.accumulate(np.where(z != 0, run, -1), 1)  # the run of the last weight so far
    for b in np.flatnonzero(((z[:, 1:] != 0) & (earlier[:, :-1] == run[:, 1:])).any(1)):
        edges = np.flatnonzero(np.r_[True, apart[b], True])
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            own = z[b, s:e]
            if e - s > 1 and np.count_nonzero(own) > 1:
                # a reflection that brings the run's weights into its last vector
                length = float(np.linalg.norm(own))
                u = own.copy()
                u[-1] += np.copysign(length, own[-1])
                u /= np.linalg.norm(u)
                block = vectors[b][:, s:e]
                vectors[b][:, s:e] = block - 2 * np.outer(block @ u, u)
                sign = -np.copysign(1.0, own[-1])
                z[b, s:e] = 0.0
                z[b, e - 1] = sign * length
    diff = _roots(values, z * z, rho)  # d_j - root_i
    live = z != 0
    n = values.shape[1]
    with np.errstate(all="ignore"):
        # weights for which the roots found are exact: z_j^2 = prod_i (root_i - d_j) / prod_{i != j} (d_i - d_j) / rho
        gaps = values[:, :, None] - values[:, None, :]
        both = live[:, :, None] & live[:, None, :]
        ratio = np.where(both, -diff / np.where(np.eye(n, dtype=bool), 1.0, gaps), 1.0)
        ratio = np.where(np.eye(n, dtype=bool) & live[:, :, None], -diff, ratio)
        fitted = np.sqrt(np.abs(np.exp(np.log(np.abs(ratio)).sum(1)))) / np.sqrt(np.where(rho > 0, rho, 1))[:, None]
        fitted = np.where(live, np.copysign(np.where(np.isfinite(fitted), fitted, 0), z), 0.0)
        q = np.where(both, fitted[:, None, :] / diff, 0.0)  # row i: eigenvector of root i
        q = np.where(live[:, :, None], q, np.eye(n))
        q /= np.linalg.norm(q, axis=2, keepdims=True)
    values = np.where(live, values - np.einsum("bii->bi", diff), values)
    vectors = vectors @ q.transpose(0, 2, 1)
    order = np.argsort(values, axis=1, kind="stable")
    return np.take_along_axis(values, order, 1), np.take_along_axis(vectors, order[:, None, :], 2)


class Spectra:
    """Streams of (count, mean, scatter's eigenpairs), of exact sums too."""

    def __init__(self, streams: int, dims: int) -> None:
        self.n = np.zeros(streams)
        self.mean = np.zeros((streams, dims))
        self.values = np.zeros((streams, dims))
        self.vectors = np.tile(np.eye(dims), (streams, 1, 1))

    def add(self, x: np.ndarray) -> None:
        """A vector for each of the first streams."""
        k = len(x)
        n = self.n[:k]
        apart = x - self.mean[:k]
        self.values[:k], self.vectors[:k] = rank_one(self.values[:k], self.vectors[:k], apart, n / (n + 1))
        self.mean[:k] += apart / (n + 1)[:, None]
        self.n[:k] = n + 1

    def one(self, k: int) -> tuple:
        return self.n[k], self.mean[k], self.values[k], self.vectors[k]


def joined(spectra: list[tuple]) -> tuple:
    """One spectrum of some, pairs of them at a time: of a pair, a rank-one update for each eigenpair of the second and one for the means' difference."""
    spectra = [s for s in spectra if s[0]] or spectra[:1]
    while len(spectra) > 1:
        half = len(spectra) // 2
        (n, mean, values, vectors), (m, other, more, axes) = (tuple(np.stack([s[k] for s in part]) for k in range(4)) for part in (spectra[:half], spectra[half : 2 * half]))
        for k in range(more.shape[1]):
            if (more[:, k] > 0).any():
                values, vectors = rank_one(values, vectors, axes[:, :, k], np.maximum(more[:, k], 0))
        values, vectors = rank_one(values, vectors, other - mean, n * m / (n + m))
        mean = mean + (other - mean) * (m / (n + m))[:, None]
        spectra = [*zip(n + m, mean, values, vectors, strict=True), *spectra[2 * half :]]
    return spectra[0]


SPECTRUM = "n long, sums array<decimal(38,0)>, mean array<double>, `values` array<double>, vectors array<double>"
_SPECTRUM = pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())), ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])


def _as_row(sums: list[int], spectrum: tuple) -> dict:
    n, mean, values, vectors = spectrum
    return {"n": int(n), "sums": [Decimal(s) for s in sums], "mean": mean.tolist(), "values": values.tolist(), "vectors": vectors.ravel().tolist()}


def _as_spectrum(row: dict) -> tuple:
    d = len(row["mean"])
    return float(row["n"]), np.array(row["mean"]), np.array(row["values"]), np.array(row["vectors"]).reshape(d, d)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of longs of up to 53 bits, exactly."""
    high, low = x >> 26, x & ((1 << 26) - 1)
    return [(int(h) << 26) + int(s) for h, s in zip(high.sum(0), low.sum(0), strict=True)]


def spectra(fit: DataFrame, dims: int, streams: int = STREAMS, rows_a_stream: int = ROWS) -> DataFrame:
    """A spectrum of each partition of ``fit`` (x); a task has a stream for every ``rows_a_stream`` vectors of its first batch, up to ``streams``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = None, [0] * dims
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            if not len(x):
                continue
            own = own or Spectra(min(streams, -(-len(x) // rows_a_stream)), dims)
            sums = [a + b for a, b in zip(sums, _exact_sums(x), strict=True)]
            for at in range(0, len(x), len(own.n)):
                own.add(x[at : at + len(own.n)].astype(float))
        if own is not None:
            yield pa.RecordBatch.from_pylist([_as_row(sums, joined([own.one(k) for k in range(len(own.n))]))], schema=_SPECTRUM)

    return fit.select("x").mapInArrow(run, SPECTRUM)


def _join_groups(parts: DataFrame) -> DataFrame:
    """One spectrum for every JOINED of ``parts`` (g, spectrum)."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        sums = [sum(map(int, s)) for s in zip(*(r["sums"] for r in rows), strict=True)]
        return pa.Table.from_pylist([_as_row(sums, joined([_as_spectrum(r) for r in rows]))], schema=_SPECTRUM)

    return parts.groupBy("g").applyInArrow(run, SPECTRUM)


def joined_spectrum(parts: DataFrame) -> tuple[int, list[int], np.ndarray, np.ndarray] | None:
    """Count, exact sums, eigenvalues of the scatter and eigenvectors over all ``parts``, joined in rounds."""
    parts = written(parts, "spectra")
    left = parts.count()
    while left > 1:
        # a row number over rows as large as spectra; there are as few as partitions
        ids = parts.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-left // JOINED))).cast("int"))
        parts = written(_join_groups(ids), "spectra")
        left = parts.count()
    row = parts.first()
    if row is None:
        return None
    _, _, values, vectors = _as_spectrum(row.asDict())
    return row["n"], [int(s) for s in row["sums"]], values, vectors


def covariance(fit: DataFrame, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The covariance of ``fit`` (x) centred and in the axes given as columns, summed in tasks and then over a row a task."""
    dims, k = axes.shape
    shared = fit.sparkSession.sparkContext.broadcast((mean, axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes = shared.value
        n, first, second = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = (_matrix(batch.column("x"), dims) - mean) @ axes
            n, first, second = n + len(y), first + y.sum(0), second + y.T @ y
        if n:
            flat = np.concatenate([[n], first, second.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["i", "v"])

    sums = dict(fit.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect())  # as many as entries
    flat = np.array([sums[i] for i in range(1 + k + k * k)])
    first = flat[1 : k + 1] / flat[0]
    return flat[k + 1 :].reshape(k, k) / flat[0] - np.outer(first, first)


def scaled_vectors(rows: DataFrame, id_col: str, vector_col: str, steps: int) -> tuple[DataFrame, int, int]:
    """(id, x array<long>): the usable rows in whole steps, floor(steps * c); their number of dimensions, and their number."""
    v = F.col(vector_col).cast("array<double>")
    limit = float(1 << 53) / steps
    fine = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < limit)), F.lit(False)) & (F.size(v) > 0)
    rows = rows.select(F.col(id_col).alias("id"), v.alias("v")).where(fine)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return rows.select("id", F.col("v").cast("array<long>").alias("x")), 0, 0
    return rows.where(F.size("v") == lengths["d"]).select("id", F.transform("v", lambda c: F.floor(c * steps).cast("long")).alias("x")), lengths["d"], lengths["count"]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, steps: int = 256) -> DataFrame:
    """For each usable row and each of the first ``components``: n, deviation, whitened, explained, identity_error, under the id column's name."""
    id_type = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable, dims, count = scaled_vectors(rows, id_col, vector_col, steps)
    if not dims:
        return rows.sparkSession.createDataFrame([], schema)
    fit = written(usable.select("x").distinct(), "vectors")
    n, sums, _, basis = joined_spectrum(spectra(fit.repartition(-(-count // TASK)), dims))
    mean = np.array([float(Decimal(s) / n) for s in sums])
    # Rayleigh-Ritz over the basis, twice: the second time near the diagonal
    for _ in range(2):
        values, turn = np.linalg.eigh(covariance(fit, mean, basis))
        basis = basis @ turn
        basis, _ = np.linalg.qr(basis)
    values = np.maximum(values, 0.0)
    k = min(components, dims)
    top = np.argsort(-values, kind="stable")[:k]
    total, values, axes = float(values.sum()), values[top], basis[:, top]
    there = values > DEFLATE * max(total, 1e-300) * dims
    scale = np.where(there, 1 / np.sqrt(np.where(there, values, 1)), np.nan)
    live = np.flatnonzero(there)
    error = float(np.abs(covariance(fit, mean, axes[:, live] * scale[live]) - np.eye(len(live))).max()) if len(live) else 0.0
    explained = values / total if total > 0 else np.zeros(k)
    shared = rows.sparkSession.sparkContext.broadcast((axes * scale, n, sums, mean, explained, error))
    kind = usable.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, n, sums, mean, explained, error = shared.value
        high, low = np.array([s >> 30 for s in sums], object), np.array([s & ((1 << 30) - 1) for s in sums], object)
        square, narrow = sum(s * s for s in sums), max(map(abs, sums)) < 1 << 52 and dims < 1 << 12
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), dims)
            w = (x - mean) @ axes
            if narrow and -(1 << 20) < x.min() and x.max() < 1 << 20:  # longs hold the products' sums
                own = (x * x).sum(1).tolist()
                with_sums = [(int(a) << 30) + int(b) for a, b in zip(x @ high.astype(np.int64), x @ low.astype(np.int64), strict=True)]
            else:
                wide = x.astype(object)
                own, with_sums = (wide * wide).sum(1).tolist(), [(a << 30) + b for a, b in zip(wide @ high, wide @ low, strict=True)]
            apart = [n * n * a - 2 * n * b + square for a, b in zip(own, with_sums, strict=True)]
            apart = pa.array([a if a < 1 << 63 else None for a in apart], pa.int64())
            rows = np.repeat(np.arange(len(x)), k)
            at = pa.array(rows)
            flat = w.ravel()
            arrays = [batch.column("id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), n)), apart.take(at), pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), error))]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.mapInArrow(run, schema)


def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
