"""Why an anchor was taken: a word's row against what its true nonterminals predict; and how divergences grow with the lexicon."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators import anchors as A
from spanwright.operators import contextmodels as M
from spanwright.operators import geometry, induction, sampling
from spanwright.operators import grammar as G
from spanwright.operators.lineage import cut


def _mixed(weights: str, kernels: induction.Kernels):
    """Sum of the anchors' rows by an array of weights in their order."""
    basis = F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in kernels.shrunk])
    nothing = F.array(*[F.lit(0.0)] * len(kernels.shrunk[0]))
    parts = F.zip_with(F.col(weights), basis, lambda w, v: F.transform(v, lambda x: x * w))
    return F.aggregate(parts, nothing, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))


def true_weights(posteriors: DataFrame, kernels: induction.Kernels, of: dict[str, str]) -> DataFrame:
    """(word, truth): each word's posteriors of the anchors' nonterminals (anchor -> nonterminal in ``of``), in the anchors' order,
    to sum to one. Anchors that share a nonterminal share its weight; words of none of these nonterminals have no row."""
    names = [of.get(w) for w in kernels.words]
    has = posteriors.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("nt", "posterior"))).alias("m"))
    own = [F.lit(0.0) if a is None else F.coalesce(F.try_element_at("m", F.lit(a)), F.lit(0.0)) / names.count(a) for a in names]
    x = has.select("word", F.array(*own).alias("w")).withColumn("t", F.aggregate("w", F.lit(0.0), lambda s, y: s + y)).where("t > 0")
    return x.select("word", F.transform("w", lambda y: y / F.col("t")).alias("truth"))


def diagnosed(features: DataFrame, posteriors: DataFrame, kernels: induction.Kernels, of: dict[str, str], n_features: int, start: np.ndarray) -> DataFrame:
    """(word, n, distance, hull, truth, l2_hull, l2_true, kl_true, nt, posterior, actual, predicted) of every word that has a row.

    ``hull`` are the word's own weights over the anchors and ``truth`` those of ``posteriors`` (word, nt, posterior); ``predicted`` is
    the row that the true weights give. Where predicted and actual rows agree but the distance is large, sampling noise made it; where
    they differ though the weights are true, the anchors' rows don't make up the word's. Words without true weights go.
    """
    rows, _ = induction.shrunk_rows(features, n_features, start)
    rows = cut(rows.select("word", "n", F.col("v").alias("v")))
    basis = {w: v.tolist() for w, v in zip(kernels.words, kernels.shrunk, strict=True)}
    order = F.array(*[F.lit(w) for w in kernels.words])
    hull = geometry.hull_table(rows, basis).groupBy("word").agg(F.max("distance").alias("distance"), F.map_from_entries(F.collect_list(F.struct("anchor", "weight"))).alias("m"))
    hull = hull.select("word", "distance", F.transform(order, lambda a: F.element_at("m", a)).alias("hull"))
    best = G.best_lhs(posteriors.select("word", "nt", "posterior"))
    x = rows.join(hull, "word").join(true_weights(posteriors, kernels, of), "word").join(best, "word")
    x = x.withColumn("predicted", _mixed("truth", kernels)).withColumn("by_hull", _mixed("hull", kernels))
    apart = lambda a: F.sqrt(F.aggregate(F.zip_with("v", a, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, y: s + y))
    kl = F.aggregate(F.zip_with("v", "predicted", lambda p, q: F.when((p > 0) & (q > 0), p * F.ln(p / q)).otherwise(0.0)), F.lit(0.0), lambda s, y: s + y)
    return x.select("word", "n", "distance", "hull", "truth", apart("by_hull").alias("l2_hull"), apart("predicted").alias("l2_true"), kl.alias("kl_true"), "nt", "posterior", F.col("v").alias("actual"), "predicted")


def spurious(found: DataFrame, kernels: induction.Kernels, number: int = 15) -> DataFrame:
    """(rank, word, ...): the ``number`` words farthest from the anchors' hull that are no anchors, of ``diagnosed``: those that a
    search would take next."""
    far = found.where(~F.col("word").isin(kernels.words)).orderBy(F.desc("distance"), "word").limit(number)
    ranked = far.agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), *far.columns))).alias("r"))  # ``number`` rows
    return ranked.select(F.posexplode("r")).select((F.col("pos") + 1).alias("rank"), *[F.col(f"col.{c}").alias(c) for c in far.columns])


def by_feature(found: DataFrame) -> DataFrame:
    """(word, feature, actual, predicted, share): what each feature has of the squared distance between a word's row and the row that
    its true nonterminals predict."""
    x = found.select("word", "l2_true", F.posexplode(F.arrays_zip("actual", "predicted")).alias("feature", "p"))
    gap = F.col("p.actual") - F.col("p.predicted")
    return x.select("word", "feature", F.col("p.actual").alias("actual"), F.col("p.predicted").alias("predicted"), F.when(F.col("l2_true") > 0, gap * gap / (F.col("l2_true") * F.col("l2_true"))).otherwise(0.0).alias("share"))


def by_anchor(found: DataFrame, kernels: induction.Kernels) -> DataFrame:
    """(word, anchor, truth, hull, gap): true weights against the hull's."""
    names = F.array(*[F.lit(w) for w in kernels.words])
    x = found.select("word", F.explode(F.arrays_zip(names.alias("anchor"), "truth", "hull")).alias("w")).select("word", "w.*")
    return x.withColumn("gap", F.col("hull") - F.col("truth"))


def shared_shapes(rules: DataFrame, n: int, seed: int, start: str = "S") -> DataFrame:
    """(sample, nts): preterminals of sampled trees, to which lexicons of any size can give words."""
    bare = G.lexical(rules).groupBy("lhs").agg(F.sum("p").alias("p")).select("lhs", F.col("lhs").alias("r1"), F.lit(None).cast("string").alias("r2"), "p")
    drawn = sampling.sample_trees(bare.unionByName(G.binary(rules).select(*G.RULE, "p")), n, seed, start)
    return sampling.yields(drawn).withColumnRenamed("w", "nts")


def worded(shapes: DataFrame, rules: DataFrame, seed: int) -> DataFrame:
    """(sample, w): a word for every preterminal by the lexical rules of ``rules``. A sample's draws are the same for every lexicon,
    so corpora over different lexicons differ in these alone. The lexicon goes to the tasks."""
    by: dict[str, tuple[list[str], np.ndarray]] = {}
    lex = G.lexical(rules).groupBy("lhs").agg(F.array_sort(F.collect_list(F.struct("r1", "p"))).alias("own"))
    for r in lex.collect():  # a row for each nonterminal
        c = np.cumsum([x["p"] for x in r["own"]])
        by[r["lhs"]] = [x["r1"] for x in r["own"]], c / c[-1]
    shared = shapes.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, nts in zip(b.column("sample").to_pylist(), b.column("nts").to_pylist(), strict=True):
                u = np.random.default_rng([seed, k, 1]).random(len(nts))  # not the draws that made the tree
                own = [shared.value[a] for a in nts]
                out.append([w[min(int(np.searchsorted(c, x, "right")), len(w) - 1)] for (w, c), x in zip(own, u, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("sample"), pa.array(out, pa.list_(pa.string()))], names=["sample", "w"])

    return shapes.select("sample", "nts").mapInArrow(run, "sample long, w array<string>")


def classified(sents: DataFrame, rules: DataFrame, candidates: int = 300, alpha: float = 2.0, start: str = "S") -> DataFrame:
    """(a, b, same, d_ab, d_ba, c_ab, c_ba, corrected): pairs a < b of the most frequent words with the divergences of their contexts
    both ways, these less their noise, the smaller of the two, and whether both words most likely come from the same nonterminal.

    The noise of a pair is the difference of two halves of the sentences, and no less than what ``anchors.NoiseFit`` gives for the
    rarer word's count. The list of candidates is bounded, so its pairs are.
    """
    words = cut(M.word_table(sents, candidates))
    one, two = A.halves(sents)
    full, x, y = (cut(M.pair_divergences(s, words, alpha)) for s in (sents, one, two))
    counts = {r["word"]: r["n"] for r in words.collect()}
    fit = A.NoiseFit.of(A.divergence_table(x), A.divergence_table(y), counts)
    n = lambda c: words.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    both = full.join(x.withColumnRenamed("d", "x"), ["a", "b"]).join(y.withColumnRenamed("d", "y"), ["a", "b"]).join(n("a"), "a").join(n("b"), "b")
    noise = F.greatest(F.abs(F.col("x") - F.col("y")), fit.a + fit.b / F.sqrt(F.least("n_a", "n_b")))
    way = both.select("a", "b", "d", (F.col("d") - noise).alias("c"))
    back = way.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("d").alias("d_ba"), F.col("c").alias("c_ba"))
    pairs = way.where("a < b").withColumnsRenamed({"d": "d_ab", "c": "c_ab"}).join(back, ["a", "b"])
    best = cut(G.best_lhs(G.terminal_posteriors(rules, G.expectation_frame(rules, start))))
    of = lambda c: best.select(F.col("word").alias(c), F.col("nt").alias(f"nt_{c}"))
    named = pairs.join(of("a"), "a").join(of("b"), "b")
    return named.select("a", "b", (F.col("nt_a") == F.col("nt_b")).alias("same"), "d_ab", "d_ba", "c_ab", "c_ba", F.least("c_ab", "c_ba").alias("corrected"))


def lexicon_growth(rules: DataFrame, sizes: list[int], n: int, seed: int, candidates: int = 300, alpha: float = 2.0, start: str = "S") -> DataFrame:
    """(terminals, same, pairs, median, mean, sd, least, greatest, p05, p95): corrected divergences of word pairs of one nonterminal
    and of two, for lexicons of several sizes over the same binary rules and the same n sampled trees."""
    shapes = cut(shared_shapes(rules, n, seed, start))
    out = []
    for k in sizes:
        g = cut(sampling.with_terminals(rules, k, seed))
        pairs = classified(cut(worded(shapes, g, seed).select("w")), g, candidates, alpha, start)
        at = lambda p: F.percentile("corrected", p)
        out.append(pairs.groupBy(F.lit(k).alias("terminals"), "same").agg(
            F.count(F.lit(1)).alias("pairs"), at(0.5).alias("median"), F.avg("corrected").alias("mean"), F.stddev_pop("corrected").alias("sd"), F.min("corrected").alias("least"), F.max("corrected").alias("greatest"), at(0.05).alias("p05"), at(0.95).alias("p95")))
    all_sizes = out[0]
    for x in out[1:]:
        all_sizes = all_sizes.unionByName(x)
    return cut(all_sizes)
