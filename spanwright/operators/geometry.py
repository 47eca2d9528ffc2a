"""Anchor selection by matrix geometry: furthest points over row distributions, hull weights, bootstrap tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators.stats import distance_from


def dense_rows(features: DataFrame, n_features: int, prior: float = 1.0) -> DataFrame:
    """(word, n, v): each row's shrunk distribution as an array; n counts. Rows are pulled to the mean by f / (f + n)."""
    sums = features.groupBy("feature").agg(F.sum("value").alias("g"))
    total = sums.agg(F.sum("g").alias("t")).first()["t"] or 1
    glob = np.zeros(n_features)
    for r in sums.collect():  # one row per feature
        glob[r["feature"]] = r["g"] / total
    mean = F.array(*[F.lit(float(x)) for x in glob])
    rows = features.groupBy("word").agg(F.sum("value").alias("n"), F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)) / F.col("n"))
    lam = F.lit(prior * n_features) / (prior * n_features + F.col("n"))
    return rows.select("word", "n", F.zip_with(raw, mean, lambda x, g: (1 - lam) * x + lam * g).alias("v"))


def furthest(rows: DataFrame, basis: list[list[float]], chosen: list[str], ssf: float = 1.0) -> tuple[str, float] | None:
    """The row farthest from the basis' span after the small-sample allowance ssf / sqrt(n); the first by name on a tie."""
    x = distance_from(rows.where(~F.col("word").isin(chosen)) if chosen else rows, basis)
    best = x.select("word", (F.col("distance") - ssf / F.sqrt("n")).alias("d")).orderBy(F.desc("d"), "word").limit(1).collect()
    return (best[0]["word"], best[0]["d"]) if best else None


def orthonormal(vectors: list[np.ndarray]) -> list[list[float]]:
    out: list[np.ndarray] = []
    for v in vectors:
        r = v - sum((float(v @ b) * b for b in out), np.zeros_like(v))
        if np.linalg.norm(r) > 1e-10:
            out.append(r / np.linalg.norm(r))
    return [b.tolist() for b in out]


def greedy_anchors(rows: DataFrame, k: int, first: str | None = None, ssf: float = 1.0, floor: float = 0.0) -> list[tuple[str, float]]:
    """(word, distance when taken) of up to k anchors: each the furthest from the span of those before. One job a step."""
    rows = rows.persist()
    if first is None:
        r = rows.select("word", (F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)) - ssf / F.sqrt("n")).alias("d")).orderBy(F.desc("d"), "word").first()
        first = r["word"]
    out, vectors = [(first, float("inf"))], []
    while True:
        vectors.append(np.array(rows.where(F.col("word") == out[-1][0]).first()["v"]))
        if len(out) >= k:
            break
        nxt = furthest(rows, orthonormal(vectors), [w for w, _ in out], ssf)
        if nxt is None or nxt[1] <= floor:
            break
        out.append(nxt)
    rows.unpersist()
    return out


def hull_weights(y: np.ndarray, basis: np.ndarray, steps: int = 100, tolerance: float = 1e-5) -> np.ndarray:
    """Weights of the point of the hull of ``basis`` (k, d) nearest to y, by Frank-Wolfe with exact line search."""
    w = np.full(len(basis), 1 / len(basis))
    x, last = w @ basis, np.inf
    for _ in range(steps):
        k = int(np.argmin(basis @ (x - y)))
        move = basis[k] - x
        size = float(move @ move)
        if size <= 0:
            break
        t = min(1.0, max(0.0, float(move @ (y - x)) / size))
        if t <= 0:
            break
        w *= 1 - t
        w[k] += t
        x = x + t * move
        d = float(np.linalg.norm(x - y))
        if d < tolerance or last - d < tolerance:
            break
        last = d
    return w


def hull_weights_of(y: np.ndarray, basis: np.ndarray, steps: int = 100, tolerance: float = 1e-5) -> np.ndarray:
    """``hull_weights`` of many rows at once."""
    w = np.full((len(y), len(basis)), 1 / len(basis))
    x, last, go = w @ basis, np.full(len(y), np.inf), np.arange(len(y))
    for _ in range(steps):
        if not len(go):
            break
        k = np.argmin((x[go] - y[go]) @ basis.T, axis=1)
        move = basis[k] - x[go]
        size = (move**2).sum(1)
        t = np.clip((move * (y[go] - x[go])).sum(1) / np.maximum(size, 1e-300), 0, 1)
        t[size <= 0] = 0
        go, k, t, move = go[t > 0], k[t > 0], t[t > 0], move[t > 0]
        w[go] *= (1 - t)[:, None]
        w[go, k] += t
        x[go] += t[:, None] * move
        d = np.linalg.norm(x[go] - y[go], axis=1)
        more = (d >= tolerance) & (last[go] - d >= tolerance)
        last[go] = d
        go = go[more]
    return w


def hull_table(rows: DataFrame, anchors: dict[str, list[float]]) -> DataFrame:
    """(word, anchor, weight, distance) of every row's hull weights; anchors are few and go to the tasks."""
    names = list(anchors)
    basis = np.array([anchors[a] for a in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = np.array(b.column("v").to_pylist(), float)
            w = hull_weights_of(y, basis)
            far = np.linalg.norm(w @ basis - y, axis=1)
            word = b.column("word").take(pa.array(np.repeat(np.arange(len(y)), len(names))))
            yield pa.RecordBatch.from_arrays([word, pa.array(names * len(y), pa.string()), pa.array(w.ravel()), pa.array(np.repeat(far, len(names)))], names=["word", "anchor", "weight", "distance"])

    return rows.select("word", "v").mapInArrow(run, "word string, anchor string, weight double, distance double")


def bootstrap_p(spark, candidate: np.ndarray, n: int, basis: np.ndarray, distance: float, replicates: int = 500, seed: int = 1) -> float:
    """Share of replicates, drawn from the candidate's point of the hull, that lie as far from the basis' span: one task each part."""
    mix = hull_weights(candidate, basis) @ basis
    mix = np.maximum(mix, 0) / np.maximum(mix, 0).sum()
    ortho = np.array(orthonormal(list(basis)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = []
            for k in b.column("id").to_pylist():
                x = np.random.default_rng([seed, k]).multinomial(n, mix) / n
                far.append(float(np.linalg.norm(x - ortho.T @ (ortho @ x)) >= distance))
            yield pa.RecordBatch.from_arrays([pa.array(far)], names=["far"])

    return float(spark.range(replicates).mapInArrow(run, "far double").agg(F.avg("far")).first()[0])
