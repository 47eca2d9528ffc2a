"""Grammars from anchor words: the search for anchors with its stopping tests, rule weights by anchors, and the grammars they make.

Corpus-sized work (features, contexts, pair features, hull weights, bootstrap replicates) are Spark jobs. What the driver holds has
a row for each anchor: their vectors, and the rules between them. The start has no word; its row is that of a word which is a
sentence by itself, boundary left and right.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators import geometry, stats, word_rows
from spanwright.operators import grammar as G
from spanwright.operators import tokens as T
from spanwright.operators.lineage import cut

START = "S"


def start_vector(stride: int) -> np.ndarray:
    """Distribution of the start over marginal features: the boundary on either side."""
    v = np.zeros(2 * stride)
    v[[0, stride]] = 0.5
    return v


def joint_start_vector(stride: int) -> np.ndarray:
    """The same over joint features."""
    v = np.zeros(stride * stride)
    v[0] = 1.0
    return v


def chi2_sf(x: float, df: int) -> float:
    """Chance of a chi-square value of ``df`` degrees of freedom above x: the regularised upper incomplete gamma function."""
    if x <= 0 or df <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series of the lower function
        term = total = 1 / a
        for k in range(1, 100_000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - front * total)
    tiny = 1e-300  # continued fraction, from its front
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 100_000):
        n = -k * (k - a)
        b += 2
        d = n * d + b
        c = b + n / c
        d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def chi2_median(df: int) -> float:
    """The value that half of the draws exceed."""
    lo, hi = 0.0, float(df + 10)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_sf(mid, df) > 0.5 else (lo, mid)
    return lo


@dataclass
class Distinctness:
    """A candidate's contexts against those of the anchors: greatest p, least effect size, and which anchor decides."""

    distinct: bool = True
    max_p: float = 0.0
    min_v: float = math.inf
    closest: str | None = None


def distinct_from(contexts: DataFrame, candidate: str, anchors: list[str], p: float = 0.001, v: float = 0.05) -> Distinctness:
    """Whether a word's neighbours (word, side, ctx, n) differ from every anchor's, by test and by effect size."""
    own = cut(contexts.where(F.col("word").isin([candidate, *anchors])))  # read for each of the test's tables
    mine, others = own.where(F.col("word") == candidate), own.where(F.col("word") != candidate)
    rows = stats.chi2_pairs(mine.unionByName(others), focus=candidate).collect()  # a row for each anchor
    out = Distinctness()
    by_p = by_v = None
    for r in sorted(rows, key=lambda r: anchors.index(r["b"] if r["a"] == candidate else r["a"])):
        other, tail = r["b"] if r["a"] == candidate else r["a"], chi2_sf(r["chi2"], r["df"])
        if tail > out.max_p:
            out.max_p, by_p = tail, other
        if r["v"] < out.min_v:
            out.min_v, by_v = r["v"], other
    out.distinct = out.max_p < p and out.min_v >= v
    out.closest = by_p if out.max_p >= p else by_v
    return out


def bootstrap_p(spark, weights: np.ndarray, raw: np.ndarray, shrunk: np.ndarray, counts: list[int], n: int, glob: np.ndarray, distance: float, replicates: int = 500, seed: int = 1) -> float:
    """Share of replicates that lie as far from the anchors' span as the candidate does.

    A replicate draws each anchor's row anew (the start, which is first, stays), mixes the raw rows by the candidate's hull weights,
    draws the candidate's ``n`` counts from the mixture, and shrinks all rows as the data were. Replicates are dealt over tasks.
    """
    f = len(glob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = []
            for k in b.column("id").to_pylist():
                rng = np.random.default_rng([seed, k])
                drawn, basis = raw.copy(), shrunk.copy()
                for j in range(1, len(raw)):
                    if counts[j] > 0:
                        drawn[j] = rng.multinomial(counts[j], raw[j] / raw[j].sum()) / counts[j]
                    lam = f / (f + counts[j])
                    basis[j] = (1 - lam) * drawn[j] + lam * glob
                mix = np.maximum(weights @ drawn, 0)
                x = rng.multinomial(n, mix / mix.sum()) / n
                lam = f / (f + n)
                x = (1 - lam) * x + lam * glob
                q = np.array(geometry.orthonormal(list(basis)))
                far.append(float(np.linalg.norm(x - q.T @ (q @ x)) >= distance))
            yield pa.RecordBatch.from_arrays([pa.array(far, pa.float64())], names=["far"])

    return float(spark.range(replicates).mapInArrow(run, "far double").agg(F.avg("far")).first()[0])


@dataclass
class Kernels:
    """Anchors with the start first, their rows, and what the tests said of each candidate."""

    words: list[str] = field(default_factory=lambda: [START])
    shrunk: list[np.ndarray] = field(default_factory=list)
    raw: list[np.ndarray] = field(default_factory=list)
    counts: list[int] = field(default_factory=lambda: [10**8])
    distances: list[float] = field(default_factory=lambda: [math.inf])
    log: list[dict] = field(default_factory=list)
    reason: str = ""


def shrunk_rows(features: DataFrame, n_features: int, start: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(word, n, raw, v): rows as they are and pulled to the mean of all, the start's own counts among them; and that mean."""
    total = np.zeros(n_features)
    for r in features.groupBy("feature").agg(F.sum("value").alias("g")).collect():  # a row for each feature
        total[r["feature"]] = r["g"]
    total += (start > 0).astype(float)  # the start's row counts once on either side
    mean = total / total.sum()
    rows = features.groupBy("word").agg(F.sum("value").alias("n"), F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)) / F.col("n"))
    lam = F.lit(float(n_features)) / (n_features + F.col("n"))
    glob = F.array(*[F.lit(float(x)) for x in mean])
    return rows.select("word", "n", raw.alias("raw")).withColumn("v", F.zip_with("raw", glob, lambda x, g: (1 - lam) * x + lam * g)), mean


def find_kernels(features: DataFrame, contexts: DataFrame, n_features: int, start: np.ndarray, number: int | None = None, least: int = 2, most: int = 20, floor: float = 0.0, boot_p: float = 0.01, min_v: float = 0.05, ssf: float = 1.0, replicates: int = 500, seed: int = 1) -> Kernels:
    """Anchors one after the other, each farthest from the span of those before. With ``number`` that many; else until a candidate
    is nearer than ``floor``, lies where chance puts it, has the contexts of an anchor, or there are ``most``."""
    rows, mean = shrunk_rows(features, n_features, start)
    rows = rows.persist()
    out = Kernels(shrunk=[start], raw=[start])
    spark = features.sparkSession
    while len(out.words) < (number or most):
        basis = geometry.orthonormal(out.shrunk)
        nxt = geometry.furthest(rows, basis, out.words[1:], ssf)
        if nxt is None:
            out.reason = "exhausted"
            break
        word = nxt[0]
        r = rows.where(F.col("word") == word).first()
        v, q = np.array(r["v"]), np.array(basis)
        distance = float(np.linalg.norm(v - q.T @ (q @ v)))
        if number is None and len(out.words) >= least:
            note = {"step": len(out.words), "word": word, "count": int(r["n"]), "distance": distance}
            out.log.append(note)
            if floor > 0 and nxt[1] < floor:
                out.reason = note["stop_reason"] = "distance"
                break
            weights = geometry.hull_weights(v, np.array(out.shrunk))
            note["boot_p"] = bootstrap_p(spark, weights, np.array(out.raw), np.array(out.shrunk), out.counts, int(r["n"]), mean, distance, replicates, seed)
            if note["boot_p"] > boot_p:
                out.reason = note["stop_reason"] = "bootstrap"
                break
            d = distinct_from(contexts, word, out.words[1:], v=min_v)
            note |= {"max_p": d.max_p, "min_v": d.min_v, "closest": d.closest, "distinct": d.distinct}
            if not d.distinct:
                out.reason = note["stop_reason"] = "word_ctx"
                break
        out.words.append(word)
        out.shrunk.append(v)
        out.raw.append(np.array(r["raw"]))
        out.counts.append(int(r["n"]))
        out.distances.append(nxt[1])
    rows.unpersist()
    out.reason = out.reason or "max_nt"
    return out


def given_kernels(features: DataFrame, words: list[str], n_features: int, start: np.ndarray) -> Kernels:
    """Rows of anchors that are known already; the start is first."""
    rows, _ = shrunk_rows(features, n_features, start)
    got = {r["word"]: r for r in rows.where(F.col("word").isin(words[1:])).collect()}
    out = Kernels(shrunk=[start], raw=[start])
    for w in words[1:]:
        out.words.append(w)
        out.shrunk.append(np.array(got[w]["v"]))
        out.raw.append(np.array(got[w]["raw"]))
        out.counts.append(int(got[w]["n"]))
        out.distances.append(math.nan)
    return out


def significance(rows: list[tuple[float, float, np.ndarray]], candidate: int, n_bases: int) -> dict[str, float]:
    """How far a candidate stands out among (count, distance, row) of all words: scaled chi-square statistic and the chance that the
    greatest of as many null draws exceeds it. Over a bounded table."""
    df = len(rows[0][2]) - 1 - n_bases if rows else 0
    of = lambda r: r[0] * r[1] ** 2 / (1 - float(r[2] @ r[2]))
    known = [of(r) for r in rows if r[0] > 0 and float(r[2] @ r[2]) < 1]
    none = {"survival": 1.0, "stat": 0.0, "null_max": 0.0, "ratio": 0.0, "df": df, "scale": 1.0}
    if df <= 0 or len(known) < 2:
        return none
    scale = float(np.median(known)) / chi2_median(df)
    c = rows[candidate]
    if scale <= 0 or c[0] <= 0 or float(c[2] @ c[2]) >= 1:
        return none | {"scale": scale}
    stat, m = of(c) / scale, len(known)
    top = df + 2 * math.sqrt(df * 2 * math.log(m)) + 2 * math.log(m)
    return {"survival": -math.expm1(m * math.log1p(-min(chi2_sf(stat, df), 1 - 1e-16))), "stat": stat, "null_max": top, "ratio": stat / top, "df": df, "scale": scale}


def vertex_clusters(rows: DataFrame, kernels: Kernels) -> DataFrame:
    """(word, kernel): words within half the distance of an anchor to its nearest other anchor; the nearest one where several fit."""
    m = np.array(kernels.shrunk)
    apart = np.linalg.norm(m[:, None] - m, axis=2)
    np.fill_diagonal(apart, np.inf)
    near = []
    for w, v, d in zip(kernels.words, m, apart.min(1) / 2, strict=True):
        gap = F.sqrt(F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in v]), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        near.append(F.struct(gap.alias("d"), F.lit(w).alias("kernel"), F.lit(float(d)).alias("reach")))
    best = F.array_min(F.filter(F.array(*near), lambda s: s["d"] < s["reach"]))
    return rows.select("word", best.alias("b")).where("b is not null").select("word", F.col("b.kernel").alias("kernel"))


def word_weights(rows: DataFrame, kernels: Kernels) -> DataFrame:
    """(word, n, weights): occurrences of every word of ``word_rows.marginal_rows``, and the hull weights of its raw row over the anchors."""
    basis = np.array(kernels.shrunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = b.column("at"), b.column("n")
            x = np.zeros((b.num_rows, basis.shape[1]))
            x[np.repeat(np.arange(b.num_rows), at.value_lengths().to_numpy()), at.flatten().to_numpy()] = n.flatten().to_numpy()
            w = geometry.hull_weights_of(x / x.sum(1, keepdims=True), basis)
            ends = pa.array(np.arange(b.num_rows + 1) * len(basis), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(x[:, : basis.shape[1] // 2].sum(1).astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], names=["word", "n", "weights"])

    return rows.mapInArrow(run, "word string, n long, weights array<double>")


def unary_parameters(weights: DataFrame, kernels: Kernels, n_sentences: int) -> DataFrame:
    """(kernel, word, weight, xi): the rows of ``word_weights``, and the weights times E(word)."""
    e = T.expectations(weights, weights.sparkSession.createDataFrame([(n_sentences,)], "total long"))
    x = e.select("word", "e", F.posexplode("weights").alias("k", "weight"))
    return x.select(F.get(F.array(*map(F.lit, kernels.words)), "k").alias("kernel"), "word", "weight", (F.col("weight") * F.col("e")).alias("xi"))


def kernel_map(spark, kernels: list[str], unary: DataFrame | None = None, threshold: float = 0.9) -> DataFrame:
    """(word, kernel): the anchors themselves, and with ``unary`` every word that stands for one by more than ``threshold``."""
    own = spark.createDataFrame([(w, w) for w in kernels[1:]] or [("", "")], "word string, kernel string").where("word <> ''")
    if unary is None:
        return F.broadcast(own)  # a row for each anchor: the corpus is not shuffled to meet them
    taken = unary.where((F.col("weight") > threshold) & (F.col("kernel") != kernels[0])).groupBy("word").agg(F.max_by("kernel", F.struct("weight", "kernel")).alias("kernel"))
    return taken.join(F.broadcast(own.select("word")), "word", "left_anti").unionByName(own)


def _standing(quads: DataFrame, members: DataFrame, counts: DataFrame, head: int) -> DataFrame:
    """(l, r, b, c) of the neighbours u and v that stand for anchors b and c. For the ``head`` words of the most occurrences (a list of fixed size)
    that is looked up where they stand, and most pairs have one that stands for none; pairs of others are shuffled to meet ``members``."""
    few = counts.orderBy(F.desc("n"), "word").limit(head).select("word")
    known = F.broadcast(few.join(members, "word", "left"))
    for c, out in (("u", "b"), ("v", "c")):
        own = known.select(F.col("word").alias(c), F.col("kernel").alias(out), F.lit(True).alias(f"__{c}"))
        quads = quads.join(own, c, "left").where(F.col(f"__{c}").isNull() | F.col(out).isNotNull()).drop(f"__{c}")
    if counts.limit(head + 1).count() > head:
        for c, out in (("u", "b"), ("v", "c")):
            # rows whose word is known are dealt by a number: they would meet in few tasks
            key = F.when(F.col(out).isNull(), F.col(c)).otherwise(F.concat(F.lit("\0"), F.xxhash64("l", "u", "v", "r").cast("string")))
            own = members.select(F.col("word").alias("__key"), F.col("kernel").alias("__out"))
            quads = quads.withColumn("__key", key).join(own, "__key", "left").withColumn(out, F.coalesce(out, "__out")).drop("__key", "__out").where(F.col(out).isNotNull())
    return quads.where("b IS NOT NULL AND c IS NOT NULL").select("l", "r", "b", "c")


def pair_features(sents: DataFrame, members: DataFrame, clusters: DataFrame, n_clusters: int, counts: DataFrame | None = None, head: int = T.FIRST_IDS) -> DataFrame:
    """(b, c, feature, value): marginal features of neighbours that stand for anchors b and c. With the words' ``counts``, ``members`` may be of any
    number, and the words beside them are turned into clusters before they are counted."""
    p, n = T._padded(F.col("w")), F.size("w") - 1
    quads = sents.where(F.size("w") > 1).select(F.explode(F.arrays_zip(F.slice(p, 1, n).alias("l"), F.slice(p, 2, n).alias("u"), F.slice(p, 3, n).alias("v"), F.slice(p, 4, n).alias("r"))).alias("q")).select("q.*")
    of = lambda c, out: members.select(F.col("word").alias(c), F.col("kernel").alias(out))
    if counts is not None:
        met = _standing(quads, members, counts, head)
        side = lambda k, c: F.struct("b", "c", F.lit(k).alias("side"), F.col(c).alias("other"))
        x = T.by_cluster(met.select(F.inline(F.array(side(0, "l"), side(1, "r")))), ["other"], clusters, counts)
        return x.select("b", "c", (F.col("other") + F.col("side") * (n_clusters + 1)).alias("feature"), F.col("n").alias("value"))
    counted = quads.join(of("u", "b"), "u").join(of("v", "c"), "v").groupBy("b", "c", "l", "r").agg(F.count(F.lit(1)).alias("n"))
    left = T._cid(counted, clusters, "l", "x").select("b", "c", F.col("x").alias("feature"), "n")
    right = T._cid(counted, clusters, "r", "x").select("b", "c", (F.col("x") + n_clusters + 1).alias("feature"), "n")
    return left.unionByName(right).groupBy("b", "c", "feature").agg(F.sum("n").alias("value"))


def binary_renyi(features: DataFrame, pairs: DataFrame, kernels: list[str], n_sentences: int, n_clusters: int, alpha: float = 5.0) -> DataFrame:
    """(a, b, c, xi): exp(-D) E(bc) / (E(b) E(c)), D the greater of both sides' Renyi divergence of a's features from the pair's, the
    latter with one more of each. ``features`` (word, feature, value) has the anchors' rows; tables here are of anchors, not words."""
    spark, stride = features.sparkSession, n_clusters + 1
    start = spark.createDataFrame([(kernels[0], 0, 1), (kernels[0], stride, 1)], "word string, feature int, value long")
    own = start.unionByName(features.where(F.col("word").isin(kernels[1:])).select("word", F.col("feature").cast("int").alias("feature"), F.col("value").cast("long").alias("value")))
    own = own.withColumn("side", (F.col("feature") >= stride).cast("int"))
    x = own.join(own.groupBy("word", "side").agg(F.sum("value").alias("t")), ["word", "side"]).select(F.col("word").alias("a"), "side", "feature", (F.col("value") / F.col("t")).alias("x"))
    seen = pairs.withColumn("side", (F.col("feature") >= stride).cast("int"))
    mass = seen.where("side = 0").groupBy("b", "c").agg(F.sum("value").alias("t"))  # as many on the other side
    lefts, rights = mass.groupBy("b").agg(F.sum("t").alias("tb")), mass.groupBy("c").agg(F.sum("t").alias("tc"))
    grid = x.crossJoin(F.broadcast(mass)).join(seen.select("b", "c", "side", "feature", "value"), ["b", "c", "side", "feature"], "left")
    y = (F.coalesce("value", F.lit(0)) + 1) / (F.col("t") + stride)
    d = grid.groupBy("a", "b", "c", "side").agg((F.ln(F.sum(F.col("x") * F.pow(F.col("x") / y, alpha - 1))) / (alpha - 1)).alias("d"))
    n = float(n_sentences)
    out = d.groupBy("a", "b", "c").agg(F.max("d").alias("d")).join(F.broadcast(mass), ["b", "c"]).join(F.broadcast(lefts), "b").join(F.broadcast(rights), "c")
    return out.select("a", "b", "c", (F.exp(-F.col("d")) * (F.col("t") / n) / ((F.col("tb") / n) * (F.col("tc") / n))).alias("xi"))


def binary_hull(pairs: DataFrame, kernels: Kernels, expectations: DataFrame, n_sentences: int) -> DataFrame:
    """(a, b, c, xi): E(bc) / (E(b) E(c)) dealt over the anchors by the pair's hull weights."""
    n = len(kernels.shrunk[0])
    rows = pairs.groupBy("b", "c").agg(F.sum("value").alias("t"), F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    raw = rows.select(F.to_json(F.struct("b", "c")).alias("word"), "b", "c", (F.col("t") / 2 / n_sentences).alias("ebc"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)) / F.col("t")).alias("v"))
    table = geometry.hull_table(raw.select("word", "v"), {w: v.tolist() for w, v in zip(kernels.words, kernels.shrunk, strict=True)})
    e = expectations.where(F.col("word").isin(kernels.words[1:]))
    x = table.join(raw.drop("v"), "word").join(F.broadcast(e.select(F.col("word").alias("b"), F.col("e").alias("eb"))), "b").join(F.broadcast(e.select(F.col("word").alias("c"), F.col("e").alias("ec"))), "c")
    return x.select(F.col("anchor").alias("a"), "b", "c", (F.col("weight") * F.col("ebc") / (F.col("eb") * F.col("ec"))).alias("xi"))


def label(kernel, start: str = START):
    """Nonterminal of an anchor: S for the start, else NT_word."""
    return F.when(kernel == start, F.lit("S")).otherwise(F.concat(F.lit("NT_"), kernel))


def raw_wcfg(unary: DataFrame, binary: DataFrame, kernels: list[str], unary_floor: float = 0.0, binary_floor: float = 0.0) -> DataFrame:
    """(lhs, r1, r2, p): all rules over the anchors' nonterminals, weights raised to the floors, without zeros."""
    spark = unary.sparkSession
    k = spark.createDataFrame([(w,) for w in kernels], "k string")
    below = k.where(F.col("k") != kernels[0])
    grid = k.select(F.col("k").alias("a")).crossJoin(below.select(F.col("k").alias("b"))).crossJoin(below.select(F.col("k").alias("c"))).join(F.broadcast(binary), ["a", "b", "c"], "left")
    two = grid.select(label(F.col("a"), kernels[0]).alias("lhs"), label(F.col("b"), kernels[0]).alias("r1"), label(F.col("c"), kernels[0]).alias("r2"), F.greatest(F.coalesce("xi", F.lit(0.0)), F.lit(binary_floor)).alias("p"))
    two = cut(two)  # a row for each three anchors
    one = unary.select(label(F.col("kernel"), kernels[0]).alias("lhs"), F.col("word").alias("r1"), F.lit(None).cast("string").alias("r2"), F.greatest("xi", F.lit(unary_floor)).alias("p"))
    return one.unionByName(two).where("p > 0")


def to_pcfg(rules: DataFrame) -> DataFrame:
    """A consistent grammar of the same conditional distribution: scaled down where it diverges, then renormalised. ``rules`` are read once
    for each of the algebra's tables, so they lie over checkpoints."""
    return G.by_partition(rules if G.is_convergent(rules) else G.scaled_if_divergent(rules))


@dataclass
class Learned:
    kernels: Kernels
    wcfg: DataFrame

    def pcfg(self) -> DataFrame:
        return to_pcfg(self.wcfg)


def learn(sents: DataFrame, clusters: DataFrame, n_clusters: int, kernels: list[str] | None = None, number: int | None = None, min_count: int = 100, binary: str = "renyi", alpha: float = 5.0, threshold: float = 0.9, seed: int = 1, counted: tuple[DataFrame, int] | None = None) -> Learned:
    """From sentences and word clusters to a grammar: anchors (unless given), rule weights, and the weighted grammar that these make.

    ``sents`` is read several times and not kept, as it is the largest table; ``counted`` are its ``tokens.counted``. What is kept has
    a row for each word.
    """
    stride = n_clusters + 1
    clusters = cut(clusters)
    counts, n = T.counted(sents) if counted is None else counted
    rows = cut(word_rows.marginal_rows(sents, clusters, counts, n_clusters))
    features = rows.select("word", F.inline(F.arrays_zip(F.col("at").alias("feature"), F.col("n").alias("value"))))
    tokens, types = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    start = start_vector(stride)
    if kernels is None:
        often = counts.where(F.col("n") >= min_count).select("word")
        bigrams = cut(T.bigram_counts(sents))  # every candidate's test reads the anchors' neighbours
        found = find_kernels(features.join(often, "word", "left_semi"), T.word_contexts(bigrams, often), 2 * stride, start, number, seed=seed)
    else:
        found = given_kernels(features, kernels, 2 * stride, start)
    unary = unary_parameters(cut(word_weights(rows, found)), found, n)
    members = cut(kernel_map(sents.sparkSession, found.words, unary, threshold))
    pairs = cut(pair_features(sents, members, clusters, n_clusters, counts))
    if binary == "renyi":
        two = binary_renyi(features, pairs, found.words, n, n_clusters, alpha)
    else:
        two = binary_hull(pairs, found, T.expectations(counts, sents.sparkSession.createDataFrame([(n,)], "total long")), n)
    rules = raw_wcfg(unary, two, found.words, 1 / (tokens * types), 1 / (tokens * len(found.words) ** 2))
    return Learned(found, rules)
