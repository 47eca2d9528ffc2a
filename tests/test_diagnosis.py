"""Exact contexts of grammars, anchors of labelled trees, diagnosis of anchors, and divergences over growing lexicons."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.operators import diagnosis, evaluation, experiments, induction, sampling, targets, trees
from spanwright.operators import grammar as G
from spanwright.operators import tokens as T

RULES = "lhs string, r1 string, r2 string, p double"
PAIRS = [("S", "A", "B", 0.6), ("S", "B", "A", 0.2), ("S", "B", "C", 0.2), ("A", "C", "B", 0.2), ("B", "A", "C", 0.1), ("C", "C", "A", 0.15)]
CLEAN = {"A": {"a1": 0.7, "a2": 0.3}, "B": {"b1": 0.6, "b2": 0.4}, "C": {"c1": 0.6, "c2": 0.4}}
SKEWED = {"A": {"a1": 0.8, "x": 0.2}, "B": {"b1": 0.9, "x": 0.1}, "C": {"c1": 0.3, "x": 0.7}}
OVERLAP = {"A": {"x": 0.6, "y": 0.3, "z": 0.1}, "B": {"x": 0.1, "y": 0.6, "z": 0.3}, "C": {"x": 0.3, "y": 0.1, "z": 0.6}}


def grammar(spark, lexicon):
    share = {a: 1 - sum(p for x, *_, p in PAIRS if x == a) for a in lexicon}
    return spark.createDataFrame(PAIRS + [(a, w, None, share[a] * p) for a, own in lexicon.items() for w, p in own.items()], RULES)


def each_its_own(spark, lexicon):
    words = sorted({w for own in lexicon.values() for w in own})
    return spark.createDataFrame([(w, k) for k, w in enumerate(words, 1)], "word string, cid int"), words


def brute_bigrams(rows, depth):
    """Expected neighbours of all trees up to a depth, by joining what is below each node: (first, last, pairs) in expectation."""
    nts = sorted({r[0] for r in rows})
    first, last, pairs, mass = ({a: {} for a in nts} for _ in range(4))
    mass = dict.fromkeys(nts, 0.0)
    add = lambda d, k, v: d.__setitem__(k, d.get(k, 0.0) + v)
    for _ in range(depth):
        f, l, b, m = ({a: {} for a in nts} for _ in range(4))
        m = dict.fromkeys(nts, 0.0)
        for a, x, y, p in rows:
            if y is None:
                add(f[a], x, p)
                add(l[a], x, p)
                m[a] += p
                continue
            m[a] += p * mass[x] * mass[y]
            for w, v in first[x].items():
                add(f[a], w, p * v * mass[y])
            for w, v in last[y].items():
                add(l[a], w, p * v * mass[x])
            for k, v in pairs[x].items():
                add(b[a], k, p * v * mass[y])
            for k, v in pairs[y].items():
                add(b[a], k, p * v * mass[x])
            for (u, s), (w, t) in itertools.product(last[x].items(), first[y].items()):
                add(b[a], (u, w), p * s * t)
        first, last, pairs, mass = f, l, b, m
    return first["S"], last["S"], pairs["S"]


@pytest.mark.parametrize("lexicon", [CLEAN, SKEWED, OVERLAP])
def test_exact_features_match_summed_trees(spark, lexicon):
    g = grammar(spark, lexicon)
    clusters, words = each_its_own(spark, lexicon)
    n = len(words)
    cid = {w: k for k, w in enumerate(words, 1)}
    first, last, pairs = brute_bigrams([tuple(r) for r in g.collect()], 60)
    want = {}
    for w, v in first.items():
        want[w, 0] = v
    for w, v in last.items():
        want[w, n + 1] = v
    for (u, w), v in pairs.items():
        want[w, cid[u]] = want.get((w, cid[u]), 0) + v
        want[u, cid[w] + n + 1] = want.get((u, cid[w] + n + 1), 0) + v
    got = {(r["word"], r["feature"]): r["value"] for r in targets.features(g, clusters, n).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_words_without_cluster_and_without_use(spark):
    g = grammar(spark, CLEAN).unionByName(spark.createDataFrame([("A", "never", None, 0.0)], RULES))
    clusters = spark.createDataFrame([("a1", 1)], "word string, cid int")
    x = targets.features(g, clusters, 1)
    assert x.where("word = 'never'").count() == 0
    sums = {r["word"]: r["v"] for r in x.groupBy("word").agg(F.sum("value").alias("v")).collect()}
    e = {r["word"]: r["e"] for r in G.terminal_expectations(g, G.expectation_frame(g)).collect()}
    assert all(abs(sums[w] - 2 * e[w]) < 1e-9 for w in sums)  # something stands on either side of every word


def test_anchors_of_exact_contexts(spark):
    for lexicon, own in ((CLEAN, True), (SKEWED, True), (OVERLAP, False)):
        g = grammar(spark, lexicon)
        clusters, words = each_its_own(spark, lexicon)
        found = [w for w, _ in targets.anchors(g, clusters, len(words))]
        assert found[0] == "S" and len(found) == 4  # as many as there are nonterminals
        score = evaluation.kernel_scores(g, found)
        assert score["coverage"] == 1.0
        assert (abs(score["min_posterior"] - 1) < 1e-9) == own


def test_labelled_trees(spark):
    for lexicon in (CLEAN, SKEWED, OVERLAP):
        g = grammar(spark, lexicon)
        read = trees.read_trees(sampling.sample_trees(g, 3000, 2).where("tree is not null"), "tree").cache()
        kernels = targets.labelled_kernels(targets.labelled_posteriors(trees.productions(read)), 20)
        assert kernels == evaluation.gold_kernels(g)
        own = targets.supervised(read)
        assert targets.smoothed_kl(g, own) < 0.05
        short = targets.supervised(read, 2)
        assert short.where("r2 is not null and lhs <> 'S'").count() == 0  # two words are one pair
        assert targets.smoothed_kl(g, short) > targets.smoothed_kl(g, own)
    assert targets.labelled_kernels(targets.labelled_posteriors(trees.productions(read).limit(0))) == ["S"]


def test_methods_compared(spark):
    g = grammar(spark, CLEAN)
    rows = {r["method"]: r for r in experiments.compared(g, experiments.Settings(sentences=1500, n_clusters=6, min_count=5, number=4), ("exact", "supervised", "target")).collect()}
    assert all(r["error"] is None for r in rows.values())
    assert rows["target"]["kl"] == 0 and rows["target"]["length"] == 0
    assert 0 <= rows["supervised"]["kl"] < 0.05
    assert rows["exact"]["anchors"] == 4 and rows["exact"]["accuracy"] == 1.0
    assert abs(rows["supervised"]["expected_length"] - rows["target"]["expected_length"]) < 0.3


def test_diagnosis_matches_dense_sums(spark):
    g = grammar(spark, SKEWED)
    clusters, words = each_its_own(spark, SKEWED)
    n = len(words)
    s = sampling.yields(sampling.sample_trees(g, 2000, 3)).select("w").cache()
    f = T.marginal_features(T.bigram_counts(s), clusters, n).cache()
    start, width = induction.start_vector(n + 1), 2 * (n + 1)
    kernels = induction.given_kernels(f, evaluation.gold_kernels(g), width, start)
    posteriors = G.terminal_posteriors(g, G.expectation_frame(g)).cache()
    of = dict(zip(kernels.words, "SABC", strict=True))
    found = diagnosis.diagnosed(f, posteriors, kernels, of, width, start).cache()
    post = {(r["word"], r["nt"]): r["posterior"] for r in posteriors.collect()}
    rows = {r["word"]: np.array(r["v"]) for r in induction.shrunk_rows(f, width, start)[0].collect()}
    got = {r["word"]: r for r in found.collect()}
    assert got.keys() == set(words)
    for w, r in got.items():
        truth = np.array([post.get((w, a), 0.0) for a in "SABC"])
        predicted = truth @ np.array(kernels.shrunk)
        assert np.allclose(r["truth"], truth) and np.allclose(r["predicted"], predicted)
        assert abs(r["l2_true"] - np.linalg.norm(rows[w] - predicted)) < 1e-12
        assert abs(r["l2_hull"] - r["distance"]) < 1e-9 and r["l2_hull"] <= r["l2_true"] + 1e-4  # the hull's point is the nearest
        assert abs(r["kl_true"] - (rows[w] * np.log(rows[w] / predicted)).sum()) < 1e-9
    parts = diagnosis.by_feature(found).groupBy("word").agg(F.sum("share").alias("s")).where("word = 'x'").first()["s"]
    assert abs(parts - 1) < 1e-9
    gaps = {r["anchor"]: r for r in diagnosis.by_anchor(found, kernels).where("word = 'x'").collect()}
    assert gaps.keys() == set(kernels.words) and all(abs(r["hull"] - r["truth"] - r["gap"]) < 1e-12 for r in gaps.values())
    assert [(r["rank"], r["word"]) for r in diagnosis.spurious(found, kernels).collect()] == [(1, "x")]


def test_anchors_of_one_nonterminal_share_its_weight(spark):
    posteriors = spark.createDataFrame([("w", "A", 0.6), ("w", "B", 0.4), ("lone", "Z", 1.0)], "word string, nt string, posterior double")
    k = induction.Kernels(words=["S", "a", "a2", "b", "other"])
    rows = {r["word"]: r["truth"] for r in diagnosis.true_weights(posteriors, k, {"S": "S", "a": "A", "a2": "A", "b": "B"}).collect()}
    assert rows.keys() == {"w"} and np.allclose(rows["w"], [0, 0.3, 0.3, 0.4, 0])


def test_growing_lexicons_share_their_trees(spark):
    g = grammar(spark, CLEAN)
    shapes = diagnosis.shared_shapes(g, 800, 4).cache()
    small, large = (sampling.with_terminals(g, k, 4).cache() for k in (12, 24))
    x, y = ({r["sample"]: r["w"] for r in diagnosis.worded(shapes, h, 4).collect()} for h in (small, large))
    nts = {r["sample"]: r["nts"] for r in shapes.collect()}
    assert x.keys() == y.keys() == nts.keys() and all(len(x[k]) == len(y[k]) == len(nts[k]) for k in nts)
    mass = {(r["lhs"], r["r1"]): r["p"] for r in G.lexical(small).collect()}
    total = {a: sum(p for (b, _), p in mass.items() if b == a) for a in "ABC"}
    seen = [(a, w) for k in nts for a, w in zip(nts[k], x[k], strict=True)]
    for a, w in {p for p in seen if mass[p] / total[p[0]] > 0.1}:
        assert abs(seen.count((a, w)) / sum(b == a for b, _ in seen) - mass[a, w] / total[a]) < 0.06
    grown = {(r["terminals"], r["same"]): r for r in diagnosis.lexicon_growth(g, [12, 24], 800, 4).collect()}
    assert {k for k, _ in grown} == {12, 24}
    for r in grown.values():
        assert r["least"] <= r["p05"] <= r["median"] <= r["p95"] <= r["greatest"] and r["pairs"] > 0
    one = diagnosis.classified(diagnosis.worded(shapes, small, 4).select("w"), small)
    assert one.count() == sum(r["pairs"] for (k, _), r in grown.items() if k == 12)
