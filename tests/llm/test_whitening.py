"""Rank-one updates and whitening against numpy's eigenvectors."""

import numpy as np
import pytest

from spanwright.llm import whitening

G = np.random.default_rng(0)
KINDS = {
    "plain": G.integers(-100, 100, (300, 16)),
    "few": np.repeat(G.integers(-100, 100, (9, 16)), 7, 0),
    "ties": np.eye(12, dtype=int)[G.integers(0, 12, 200)],
    "small": G.integers(-1, 2, (300, 5)),
    "scales": (G.standard_normal((300, 16)) * np.logspace(0, -6, 16) * 1e4).astype(int),
    "equal": np.full((20, 6), 3),
    "one dimension": G.integers(-9, 9, (50, 1)),
    "one row": np.array([[1, 2, 3]]),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("streams", [1, 4])
def test_updates_give_the_scatter(kind, streams):
    x = KINDS[kind].astype(float)
    own = whitening.Spectra(streams, x.shape[1])
    for at in range(0, len(x), streams):
        own.add(x[at : at + streams])
    n, mean, values, vectors = whitening.joined([own.one(k) for k in range(streams)])
    scatter = (x - x.mean(0)).T @ (x - x.mean(0))
    assert n == len(x) and np.allclose(mean, x.mean(0), atol=1e-9)
    assert np.abs(vectors.T @ vectors - np.eye(x.shape[1])).max() < 1e-12
    assert np.abs(vectors * values @ vectors.T - scatter).max() <= 1e-11 * max(np.abs(scatter).max(), 1)


def brute(rows, components=4):
    """(id, component) -> (n, deviation, whitened, explained), components of numpy's covariance of the different vectors."""
    good = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}))
    n, sums = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(fit.shape[1], -1))
    values, axes = values[::-1], axes[:, ::-1]
    return n, sums, values, axes, {(i, k + 1): (sum((n * a - int(s)) ** 2 for a, s in zip(x, sums)), (np.array(x) - sums / n) @ axes[:, k] / np.sqrt(values[k]), values[k] / values.sum()) for i, x in good for k in range(min(components, fit.shape[1]))}


def test_whitening_matches_numpy(spark):
    from pyspark.sql import functions as F

    x = G.standard_normal((500, 8)) * np.arange(1, 9)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(1000 + k, [float(c) for c in x[3]]) for k in range(300)]  # a hot vector
    odd = [(2000, None), (2001, []), (2002, [1.0] * 7), (2003, [None] + [1.0] * 7), (2004, [float("nan")] * 8), (2005, [float("inf")] + [0.0] * 7), (2006, [1e300] * 8), (None, [-0.0] * 8), (7, [float(c) for c in x[5]])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit("other") for c in ("id", "x", "v", "g", "n")})
    got = whitening.whiten(df.repartition(7)).collect()
    n, _, _, _, want = brute(rows + [r for r in odd if r[0] in (None, 7)])
    assert len(got) == 4 * (len(rows) + 2)
    signs = {}
    for r in got:
        deviation, whitened, explained = want[r["vec_id"], r["component"]]
        if r["vec_id"] == 7:
            continue  # two vectors have this id
        assert r["n"] == n and r["deviation"] == deviation and abs(r["explained"] / explained - 1) < 1e-9 and r["identity_error"] < 1e-9
        sign = signs.setdefault(r["component"], np.sign(whitened) * np.sign(r["whitened"]))
        assert abs(r["whitened"] - sign * whitened) < 1e-9
    # one spectrum a task and small rounds give the same
    again = {(r["vec_id"], r["component"]): abs(r["whitened"]) for r in whitening.whiten(df.repartition(2)).collect() if r["vec_id"] != 7}
    assert all(abs(again[r["vec_id"], r["component"]] - abs(r["whitened"])) < 1e-9 for r in got if r["vec_id"] != 7)


def test_spectra_join_in_rounds(spark):
    x = G.integers(-50, 50, (400, 6))
    fit = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>")
    n, sums, values, vectors = whitening.joined_spectrum(whitening.spectra(fit.repartition(30), 6, streams=3, rows_a_stream=4))
    assert n == 400 and sums == x.sum(0).tolist()
    scatter = np.cov(x.T, bias=True) * 400
    assert np.abs(vectors * values @ vectors.T - scatter).max() < 1e-8


def test_little_variance_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).collect() == []
    (a, b) = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind), components=1).collect()
    assert a["whitened"] is None and a["n"] == 1 and a["deviation"] == 0 and a["identity_error"] == 0
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], kind)).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)}
    big = whitening.whiten(spark.createDataFrame([(k, [1e12 * k, 0.0]) for k in range(5)], "vec_id long, embedding array<double>"), components=1).collect()
    assert {r["deviation"] for r in big} == {None, 0}  # too wide for a long
