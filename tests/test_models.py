import math

import numpy as np
import pytest

from spanwright import cli
from spanwright.operators import anchors, neural
from spanwright.operators import tokens as T

SENTS = "doc_id long, sno int, w array<string>"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(400):
        a, b = rng.choice(["a", "aa", "aaa"]), rng.choice(["b", "bb"])
        rows.append((0, k, ["the", a, b] if k % 2 else ["no", b, a]))
    return spark.createDataFrame(rows, SENTS).cache()


@pytest.mark.parametrize(("kind", "gap"), [("bow", 1), ("positional", 1), ("positional", 2)])
def test_context_model_learns(spark, corpus, tmp_path, kind, gap):
    ids = T.vocabulary(T.word_counts(corpus))
    rows = neural.gap_rows(corpus, ids, 2, gap).cache()
    assert rows.agg({"n": "sum"}).first()[0] == 400 * (4 - gap)
    model, history = neural.train(rows, ids.count() + 1, kind=kind, pair=gap == 2, epochs=40, batch=64)
    assert history[-1] < history[0] and neural.perplexity(neural.score(rows, model)) < (6 if gap == 1 else 20)
    lp = model.log_probs(np.zeros((3, 4), int))
    assert np.exp(lp).sum(1) == pytest.approx(np.ones(3))
    model.save(str(tmp_path / "m.npz"))
    assert np.allclose(neural.ContextModel.load(str(tmp_path / "m.npz")).log_probs(np.zeros((1, 4), int)), lp[:1])


def test_anchors(spark, corpus):
    found = anchors.select(corpus, 7)
    assert len(found.anchors) >= 2 and all(d.word for d in found.log)
    d = {("a", "b"): 2.0, ("b", "a"): 2.0, ("a", "c"): 0.1, ("c", "a"): 0.1, ("b", "c"): 1.5, ("c", "b"): 1.5}
    assert anchors.max_min(d, ["a", "b", "c"]) == ["a", "b"]
    assert anchors.minimal({k: (0.9 if v > 1 else 0.01) for k, v in d.items()}, {"a": 50, "b": 40, "c": 30}) == ["a", "b"]
    w = anchors.binary_weights(corpus, ["a", "b"])
    assert all(x > 0 for *_, x in w) and {(b, c) for _, b, c, _ in w} == {("a", "b"), ("b", "a")}
    assert anchors.NoiseFit.of({("a", "b"): 1.0}, {("a", "b"): 1.1}, {"a": 4, "b": 9})(4) == 0.0
    assert math.isclose(anchors.violation_threshold(1.0, 10**12, 1.0), 0.1587, abs_tol=1e-3)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "g").write_text("1.0 S -> A A\n0.5 A -> a\n0.5 A -> b\n")
    go = lambda *x: cli.main([str(tmp_path / y[1:]) if y.startswith("@") else y for y in x])
    go("sample", "@g", "@c", "--n", "50")
    go("em", "@c", "@fit", "--grammar", "@g", "--rounds", "2")
    go("ngrams", "@c", "@b")
    go("to-preterminal", "@g", "@m")
    go("from-preterminal", "@m", "@g2")
    go("sample", "@g", "@t", "--n", "30", "--trees")
    go("treebank", "@t", "@tb")
    go("yields", "@t", "@y")
    go("evaluate", "@g", "--grammar", "@g2")
    assert '"missing": 0' in capsys.readouterr().out
    go("normalise", "@g", "@n")
    go("score", "@c", "@s", "--grammar", "@fit")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 50


def test_experiments_and_commands(spark, tmp_path, capsys):
    import json

    from spanwright.operators import experiments, induction, sampling
    from spanwright.operators import grammar as G
    from spanwright.sources import sinks, text

    rows = [("S", "D", "N", 0.5), ("S", "N", "V", 0.5), *[(c.upper(), f"{c}{k}", None, 0.25) for c in "dnv" for k in range(4)]]
    g = spark.createDataFrame(rows, "lhs string, r1 string, r2 string, p double").cache()
    s = experiments.Settings(sentences=1500, n_clusters=4, min_count=10)
    got = experiments.run(spark, s, g)
    assert got["error"] is None and got["true"] == 4 and got["accuracy"] > 0.5
    bad = experiments.run(spark, s, g.withColumn("p", g.p * 2))
    assert bad["error"]
    table = experiments.run_grid(spark, [s], g)
    assert experiments.summary(table, "sentences").first()["runs"] == 1 and len(experiments.grid(sentences=[1, 2], mode=["joint", "marginal"])) == 4
    log = [{"step": 2, "distance": 0.5, "boot_p": 0.0, "min_v": 0.4, "max_p": 0.0}, {"step": 3, "distance": 0.4, "boot_p": 0.3, "min_v": 0.4, "max_p": 0.0}]
    assert experiments.replay(log, 0.01, 0.05) == (3, "bootstrap") and experiments.replay(log, 0.5, 0.05) == (4, "exhausted") and experiments.replay(log, 0.5, 0.05, floor=0.45) == (3, "distance") and experiments.replay(log, 0.5, 0.5) == (2, "word_ctx")
    out, kl = experiments.gold(g, s)
    assert len(out.kernels.words) == 4 and 0 <= kl["string"] < 1.5
    assert experiments.difficulty(g)["least_anchor"] == pytest.approx(1)
    fitted = experiments.sweep(g, experiments.corpus(g, 50, 2), [0.5], [1, 2])
    assert fitted.count() == 2 and fitted.where("parsed = 50").count() == 2
    sinks.write_grammar(g, str(tmp_path / "g"))
    for argv in (["count", str(tmp_path / "g")], ["inspect", str(tmp_path / "g"), "d1"], ["gold-kernels", str(tmp_path / "g"), str(tmp_path / "k")], ["evaluate-kernels", str(tmp_path / "g"), "--kernels", '["S", "d0", "n0", "v0"]'], ["terminals", str(tmp_path / "g"), str(tmp_path / "t")], ["compare", str(tmp_path / "g"), "--grammar", str(tmp_path / "g"), "--n", "30"]):
        cli.main(argv)
    said = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith(("{", "["))]
    assert said[0] == {"nonterminals": 4, "terminals": 12} and said[1] == [["D", 1.0]] and said[2]["accuracy"] == 1 and abs(said[3]["string"]["kl"]) < 1e-9
    sinks.write_corpus(experiments.corpus(g, 300, 4).select("w"), str(tmp_path / "c"))
    cli.main(["learn", str(tmp_path / "c"), str(tmp_path / "l"), "--n-clusters", "4", "--kernels", json.dumps(out.kernels.words)])
    assert G.is_normalised(text.read_grammar(spark, str(tmp_path / "l")), 1e-3)
    cli.main(["random-grammar", str(tmp_path / "r"), "--nonterminals", "3", "--terminals", "10"])
    assert text.read_grammar(spark, str(tmp_path / "r")).count() > 10 and induction.START == "S" and sampling is not None
