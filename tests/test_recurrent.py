import math

import numpy as np
import pytest

from spanwright.operators import recurrent
from spanwright.operators import tokens as T


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    s = [(k, ["the", str(rng.choice(["a", "aa"])), "b"] if k % 2 else ["no", "b", str(rng.choice(["a", "aa"])), "c"]) for k in range(300)]
    df = spark.createDataFrame(s, "sid long, w array<string>")
    v = T.special_vocabulary(T.word_counts(df)).cache()
    return T.encoded(df, v).cache(), {r["word"]: r["id"] for r in v.collect()}


def numeric(model, rows, name, at, loss):
    p, eps = model.parameters()[name], 1e-5
    old, p[at] = p[at], p[at] + eps
    up = loss()
    p[at] = old - eps
    down = loss()
    p[at] = old
    return (up - down) / (2 * eps)


@pytest.mark.parametrize("kind", [recurrent.LanguageModel, recurrent.ClozeModel])
def test_gradients(kind):
    model = kind(9, 4, 5, seed=2)
    sents = [np.array([1, 4, 5, 6, 2]), np.array([1, 7, 2]), np.array([1, 8, 4, 4, 5, 2])]
    caught = {}
    model.update = lambda g, rate: caught.update(g)
    loss = lambda: model.step(sents, 0.0)
    loss()
    grads = {k: v.copy() for k, v in caught.items()}
    assert set(grads) == set(model.parameters())
    rng = np.random.default_rng(1)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in g.shape)
            assert g[at] == pytest.approx(numeric(model, sents, name, at, loss), abs=1e-6), name


def test_language_model(spark, rows, tmp_path):
    ids, v = rows
    model, history = recurrent.train(recurrent.LanguageModel, ids, len(v), epochs=12)
    assert history[-1] < 0.6 * history[0]
    scored = recurrent.score(ids, model)
    assert recurrent.perplexity(scored) < 2.2 and scored.count() == 300
    one = np.array([1, v["the"], v["a"], v["b"], 2])
    assert model.log_probabilities([one])[0] > model.log_probabilities([one[[0, 3, 2, 1, 4]]])[0] + 2
    # padding changes nothing
    assert model.log_probabilities([one, np.array([1, *([v["b"]] * 9), 2])])[0] == pytest.approx(model.log_probabilities([one])[0])
    model.save(str(tmp_path / "m.npz"))
    again = recurrent.LanguageModel.load(str(tmp_path / "m.npz"))
    assert again.log_probabilities([one])[0] == pytest.approx(model.log_probabilities([one])[0])
    with pytest.raises(ValueError):
        recurrent.ClozeModel.load(str(tmp_path / "m.npz"))


def test_cloze_model(spark, rows):
    ids, v = rows
    model, history = recurrent.train(recurrent.ClozeModel, ids, len(v), epochs=12)
    assert history[-1] < 0.6 * history[0]
    left, right = [np.array([1, v["the"]])], [np.array([2, v["b"]])]
    p = np.exp(model.log_probs(left, right)[0])
    assert p.sum() == pytest.approx(1) and p[v["a"]] + p[v["aa"]] > 0.9
    gapped, _ = recurrent.train(recurrent.ClozeModel, ids, len(v), epochs=12, gap=2)
    both = recurrent.pair_log_probs(model, gapped, [np.array([1, v["the"]])], [np.array([2])], v["a"], v["b"])
    assert math.exp(both[0]) > 0.2
    wanted = [v[w] for w in ("a", "aa", "b")]
    probs = recurrent.gap_log_probs(ids, model, wanted)
    assert probs.count() == 600 * 3
    e = spark.createDataFrame([(v["a"], 0.5), (v["aa"], 0.5), (v["b"], 1.0)], "id long, e double")
    d = {(r["a"], r["b"]): r["d"] for r in recurrent.gap_divergences(probs, e).collect()}
    assert abs(d[v["a"], v["aa"]]) < 0.5 < d[v["a"], v["b"]] and len(d) == 6
