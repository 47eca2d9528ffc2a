"""The flow from gap models to a grammar, against sums gap by gap and on grammars of known classes."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from spanwright.operators import gap_learner
from spanwright.operators import grammar as G
from spanwright.operators import neural, recurrent
from spanwright.operators import tokens as T


def clean(n, seed=1):
    """Sentences of a grammar of three classes with words of their own: S -> A B | A B C | B C."""
    r = random.Random(seed)
    words = {"A": ["a1", "a2", "a3"], "B": ["b1", "b2"], "C": ["c1", "c2", "c3"]}
    return [[r.choice(words[x]) for x in r.choice(["AB", "ABC", "ABC", "BC"])] for _ in range(n)]


@pytest.fixture(scope="module")
def sents(spark):
    return spark.createDataFrame([(k, w) for k, w in enumerate(clean(700))] + [(9001, []), (9002, None)], "sid long, w array<string>")


@pytest.fixture(scope="module")
def coded(spark, sents):
    v = T.special_vocabulary(T.word_counts(sents))
    return T.encoded(sents, v), {r["word"]: r["id"] for r in v.collect()}


def test_training_over_tasks_learns(spark, coded):
    rows, v = coded
    model, losses = gap_learner.train_together(recurrent.ClozeModel, rows, len(v), rounds=8, share=200, batch=16, rate=1e-2, embed=8, hidden=12)
    driver, _ = recurrent.train(recurrent.ClozeModel, rows, len(v), epochs=6, embed=8, hidden=12)
    assert losses[-1] < 0.75 * losses[0]
    new = [np.array([1, *(v[w] for w in s), 2]) for s in clean(80, seed=9)]

    def loss(m):
        left, right, words, _ = m.contexts(new)
        return -float(np.mean(m.log_probs(left, right)[np.arange(len(words)), [w[0] for w in words]]))

    assert loss(model) < 1.15 * loss(driver)
    none, history = gap_learner.train_together(recurrent.ClozeModel, rows.limit(0), len(v))
    assert history == [] and none.t == 0


def test_language_models_learn_over_tasks(spark, coded):
    rows, v = coded
    model, losses = gap_learner.train_together(recurrent.LanguageModel, rows, len(v), rounds=8, share=200, batch=16, rate=1e-2, embed=8, hidden=12)
    driver, _ = recurrent.train(recurrent.LanguageModel, rows, len(v), epochs=6, embed=8, hidden=12)
    new = [np.array([1, *(v[w] for w in s), 2]) for s in clean(80, seed=9)]
    assert losses[-1] < losses[0] and model.log_probabilities(new).mean() > 1.15 * driver.log_probabilities(new).mean()


@pytest.mark.parametrize("kind", ["bow", "positional"])
def test_feed_forward_nets_learn_over_tasks(spark, sents, kind):
    ids = T.vocabulary(T.word_counts(sents))
    rows = neural.gap_rows(sents.where(F.size("w") > 0), ids).cache()
    size = ids.count() + 1
    model, losses = neural.train_together(rows, size, kind=kind, rounds=30, batch=16, share=max(1, rows.count() // 3))
    driver, _ = neural.train(rows, size, kind=kind, epochs=10, batch=16)  # as many steps as a task makes
    assert losses[-1] < losses[0] and neural.perplexity(neural.score(rows, model)) < 1.15 * neural.perplexity(neural.score(rows, driver))
    none, history = neural.train_together(rows.limit(0), size, kind=kind)
    assert history == [] and none.p.keys() == model.p.keys()


@pytest.mark.parametrize("alpha", [1, 2.0, 5.0, math.inf])
def test_sums_match_gaps_one_by_one(spark, coded, alpha):
    rows, v = coded
    single, gapped = (recurrent.ClozeModel(len(v), 6, 8, seed=k, gap=k) for k in (1, 2))
    anchors = [v["a1"], v["b1"], v["c2"]]
    got = {(r["a"], r["b"], r["c"]): (r["n"], r["total"]) for r in gap_learner.gap_sums(rows.repartition(5), single, anchors, None, gapped, alpha).collect()}
    want = {}
    join = max if alpha == math.inf else lambda x, y: x + y

    def put(key, ratio):
        x = ratio if alpha in (1, math.inf) else math.exp((alpha - 1) * ratio)
        n, t = want.get(key, (0, -math.inf if alpha == math.inf else 0.0))
        want[key] = n + 1, join(t, x)

    for r in rows.collect():
        ids = r["ids"]
        for i in range(1, len(ids) - 1):
            if ids[i] in anchors:
                left, right = [np.array(ids[:i])], [np.array(ids[i + 1 :][::-1])]
                lp = single.log_probs(left, right)[0]
                for b in range(len(v)):
                    put((ids[i], b, None), lp[ids[i]] - lp[b])
                for b in anchors:
                    for c in anchors:
                        put((ids[i], b, c), lp[ids[i]] - recurrent.pair_log_probs(single, gapped, left, right, b, c)[0])
    assert got.keys() == want.keys()
    for key, (n, t) in want.items():
        assert got[key][0] == n and got[key][1] == pytest.approx(t), key
    e = spark.createDataFrame([(i, 0.1 + 0.01 * i) for i in range(len(v))], "id long, e double")
    pairs = spark.createDataFrame([(v["a1"], v["b1"], 0.3)], "b long, c long, e double")
    d = {(r["a"], r["b"], r["c"]): r["d"] for r in gap_learner.divergences(gap_learner.gap_sums(rows, single, anchors, None, gapped, alpha), e, pairs, alpha).collect()}
    key = (v["c2"], v["a1"], v["b1"])
    n, t = want[key]
    raw = t / n if alpha == 1 else t if alpha == math.inf else math.log(t / n) / (alpha - 1)
    assert d[key] == pytest.approx(raw - math.log(0.1 + 0.01 * v["c2"]) + math.log(0.3))
    assert sum(c is not None for _, _, c in d) == 3


def test_learns_the_classes(spark, sents):
    out = gap_learner.learn(sents, n_candidates=8, rounds=8, share=250, batch=16, rate=1e-2, embed=8, hidden=12)
    assert {"single", "first half", "second half", "gapped"} == out.losses.keys()
    assert len(set(w[0] for w in out.ordered.anchors)) == len(out.ordered.anchors) == 3  # one word of each class
    best = {}
    for r in out.wcfg.where("r2 IS NULL AND lhs <> 'S'").collect():
        best.setdefault(r["r1"], []).append((r["p"], r["lhs"]))
    assert all(max(x)[1][3] == w[0] for w, x in best.items())
    pcfg = out.pcfg()
    assert G.is_normalised(pcfg, 1e-6)
    given = gap_learner.learn(sents, anchors=["a1", "b1", "c1", "unseen"], rounds=1, embed=4, hidden=4)
    assert given.wcfg.where("lhs = 'NT_unseen' OR r1 = 'NT_unseen'").count() == 0
