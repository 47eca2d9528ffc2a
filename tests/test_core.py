import math

import numpy as np
import pytest

from spanwright.operators import charts as C
from spanwright.operators import clustering, evaluation, geometry, sampling, stats, trees
from spanwright.operators import grammar as G
from spanwright.operators import tokens as T
from spanwright.operators import training
from spanwright.sources import sinks, text

RULES = "lhs string, r1 string, r2 string, p double"
SIMPLE = [("S", "A", "A", 1.0), ("A", "a", None, 0.5), ("A", "b", None, 0.5)]
AMBIGUOUS = [("S", "A", "A", 1.0), ("A", "A", "A", 0.5), ("A", "a", None, 0.5)]
THREE = [("S", "A", "B", 0.6), ("S", "B", "A", 0.4), ("A", "a", None, 0.7), ("A", "c", None, 0.3), ("B", "b", None, 0.8), ("B", "c", None, 0.2)]


def rules(spark, rows):
    return spark.createDataFrame(rows, RULES)


def as_dict(frame):
    return {(r["lhs"], r["r1"], r["r2"]): r["p"] for r in frame.collect()}


def sents(spark, rows):
    return spark.createDataFrame([(k, w) for k, w in enumerate(rows)], "sid long, w array<string>")


@pytest.mark.parametrize("w", [["a", "a"], ["a", "b"], ["b", "a"], ["b", "b"]])
def test_inside_simple(w):
    assert math.exp(C.Chart(SIMPLE).log_probability(w)) == pytest.approx(0.25)


def test_inside_edge_cases():
    c = C.Chart(AMBIGUOUS)
    assert math.exp(c.log_probability(["a", "a"])) == pytest.approx(0.25)
    assert c.trees(["a", "a", "a"]) == 2 and c.log_probability([]) is None and c.log_probability(["x"]) is None
    assert math.exp(C.Chart(THREE).log_probability(["a", "b"])) == pytest.approx(0.336)
    assert math.exp(C.Chart(SIMPLE).log_probability(["*", "a"], wildcard="*")) == pytest.approx(0.5)


def test_counts_are_posteriors(spark):
    found = C.Chart(SIMPLE).counts(["a", "b"])[1]
    assert found == pytest.approx({("S", "A", "A"): 1.0, ("A", "a", None): 1.0, ("A", "b", None): 1.0})
    got = {(r["lhs"], r["r1"], r["r2"]): r["n"] for r in C.expected_counts(sents(spark, [["a", "a"], ["a", "b"], ["q"], [], None]), C.Chart(SIMPLE)).collect()}
    assert got[None, "sentences", None] == 2 and got["A", "a", None] == pytest.approx(3)


def test_inside_equals_sum_of_trees():
    """Long sentences need scaling; the best tree is no heavier than all together."""
    c = C.Chart(AMBIGUOUS)
    lp, tree = c.best(["a"] * 12)
    assert lp <= c.log_probability(["a"] * 12) + 1e-9 and tree.count("(A a)") == 12
    assert c.trees(["a"] * 12) == trees.catalan(11)
    assert c.log_probability(["a"] * 12) == pytest.approx(lp + math.log(trees.catalan(11)))


def test_algebra(spark):
    g = rules(spark, SIMPLE)
    assert G.is_normalised(g)
    assert G.partition_function(g) == pytest.approx({"S": 1.0, "A": 1.0})
    assert G.partition_function(g, "fixpoint") == pytest.approx({"S": 1.0, "A": 1.0})
    assert G.nonterminal_expectations(g) == pytest.approx({"S": 1.0, "A": 2.0})
    assert {r["lhs"]: r["entropy"] for r in G.entropies(g).collect()}["A"] == pytest.approx(math.log(2))
    assert [p for _, p in G.length_distribution(g, 3)] == pytest.approx([0, 1, 0])
    with pytest.raises(G.Divergent):
        G.partition_function(rules(spark, [("S", "S", "S", 0.9), ("S", "a", None, 0.9)]))


def test_xi_round_trip(spark):
    g = rules(spark, THREE)
    back = as_dict(G.by_partition(G.to_xi(g, G.expectation_frame(g))))
    assert back == pytest.approx({(a, b, c): p for a, b, c, p in THREE}, abs=1e-10)


def test_kl_and_smoothing(spark):
    g, h = rules(spark, THREE), rules(spark, THREE[1:2] + THREE[2:])
    e = G.expectation_frame(g)
    assert G.labelled_kl(g, g, e).first()[0] == 0
    assert G.labelled_kl(g, h, e).first()[0] == math.inf
    words = spark.createDataFrame([("a",), ("b",), ("c",)], "word string")
    assert 0 < G.labelled_kl(g, G.smoothed(h, words, 1e-6), e).first()[0] < math.inf
    assert G.missing_rules(g, h).count() == 1 and G.missing_rules(h, g).count() == 0


def test_useful_and_truncated(spark):
    g = rules(spark, [*SIMPLE, ("X", "X", "A", 1.0), ("S", "X", "A", 0.0)])
    assert G.useful(g).count() == 3 and G.coreachable(g) == {"S", "A"}


def test_em_raises_likelihood(spark):
    s = sents(spark, [["a", "a", "a"], ["a", "a"], ["a", "b"], ["b", "b", "a"]])
    start = rules(spark, [("S", "A", "A", 1.0), ("A", "A", "A", 0.3), ("A", "a", None, 0.35), ("A", "b", None, 0.35)])
    fitted, history = training.em(start, s, rounds=4)
    assert all(y >= x - 1e-9 for x, y in zip(history, history[1:])) and G.is_normalised(fitted)
    assert G.is_normalised(training.minibatch_em(start, s, 2, 0.3))
    assert training.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-8)


def test_streaming_em(spark, tmp_path):
    from spanwright.streaming.minibatch import StreamingEM

    for k, w in enumerate([["a", "a"], ["a", "b"]]):
        sents(spark, [w]).write.mode("append").parquet(str(tmp_path / "in"))
    em = StreamingEM(rules(spark, SIMPLE), step=0.5, update="linear")
    stream = spark.readStream.schema("sid long, w array<string>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    em.start_on(stream, str(tmp_path / "ck")).awaitTermination()
    assert G.is_normalised(em.rules) and as_dict(em.rules)["A", "a", None] > 0.5


def test_trees(spark):
    t = spark.createDataFrame([("(S (A a) (B (C c) (D d)))",), ("(S (A a)",), ("",), (None,)], "value string")
    x = trees.read_trees(t).withColumns({"y": trees.leaf_words("nodes"), "s": trees.unlabelled_spans("nodes"), "p": trees.preterminals("nodes")}).collect()
    assert x[0]["y"] == ["a", "c", "d"] and [tuple(s) for s in x[0]["s"]] == [(1, 3)] and x[0]["p"] == ["A", "C", "D"] and x[1]["nodes"] is None
    assert trees.brackets([n.asDict() for n in x[0]["nodes"]]) == "(S (A a) (B (C c) (D d)))"
    assert {tuple(r) for r in trees.productions(trees.read_trees(t)).collect()} == {("S", "A", "B"), ("B", "C", "D"), ("A", "a", None), ("C", "c", None), ("D", "d", None)}
    assert [trees.catalan(n) for n in range(6)] == [1, 1, 2, 5, 14, 42]
    assert trees.parse_tree(trees.random_tree(list("abcdef"), ["S", "X"], np.random.default_rng(1))) is not None


def test_sampling(spark):
    x = sampling.sample_trees(rules(spark, SIMPLE), 400, seed=5)
    w = [r["w"] for r in sampling.yields(x).collect()]
    assert len(w) == 400 and all(len(s) == 2 for s in w) and 0.4 < np.mean([s[0] == "a" for s in w]) < 0.6
    assert x.collect() == sampling.sample_trees(rules(spark, SIMPLE), 400, seed=5).collect()


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (3, 3), (4, 6), (5, 5)]:
        g = rng.random((n, m))
        best = max(sum(g[i, p[i]] for i in range(n)) for p in permutations(range(m), n))
        assert sum(g[i, j] for i, j in enumerate(evaluation.assignment(g))) == pytest.approx(best)


def test_exchange_raises_objective(spark):
    s = spark.createDataFrame([(0, k, w.split()) for k, w in enumerate(["a x", "b x", "a y", "b y", "c z", "d z", "c z", "d z"] * 3)], "doc_id long, sno int, w array<string>")
    b, c = T.bigram_counts(s), T.hashed_clusters(T.word_counts(s), 4, 1)
    better = clustering.exchange(b, c, 4)
    score = lambda x: clustering.objective(clustering.cluster_table(b, x, 4))
    assert score(better) >= score(c)
    assert {r["word"] for r in better.collect()} == set("abcdxyz")


def test_geometry(spark):
    assert geometry.hull_weights(np.array([0.5, 0.5]), np.eye(2)) == pytest.approx([0.5, 0.5], abs=0.05)
    f = spark.createDataFrame([("a", 0, 90), ("b", 1, 90), ("c", 0, 45), ("c", 1, 45)], "word string, feature int, value long")
    rows = geometry.dense_rows(f, 2, prior=0.0)
    found = geometry.greedy_anchors(rows, 2, first="a", ssf=0.1)
    assert [w for w, _ in found] == ["a", "b"]
    assert geometry.bootstrap_p(spark, np.array([0.5, 0.5]), 50, np.eye(2), 0.5, 50) == 0.0


def test_good_turing(spark):
    c = spark.createDataFrame([(f"w{k}", n) for k, n in enumerate([1] * 20 + [2] * 8 + [3] * 4 + [5] * 2 + [9])], "word string, n long")
    for mode in ("loglinear", "switch"):
        got = stats.good_turing(c, mode).collect()
        assert sum(r["p"] * r["nr"] for r in got) + got[0]["p0"] == pytest.approx(1, abs=1e-6)


def test_text_round_trip(spark, tmp_path):
    g = rules(spark, THREE)
    sinks.write_grammar(g, str(tmp_path / "g"), ["made here"])
    assert as_dict(text.read_grammar(spark, str(tmp_path / "g"))) == pytest.approx({(a, b, c): p for a, b, c, p in THREE})
    sinks.write_preterminal_grammar(g, str(tmp_path / "m"))
    assert as_dict(text.read_preterminal_grammar(spark, str(tmp_path / "m"))) == pytest.approx({(a, b, c): p for a, b, c, p in THREE}, abs=1e-5)
    b = spark.createDataFrame([("a", "b", 3), ("<s>", "a", 1)], "w1 string, w2 string, n long")
    sinks.write_ngrams(b, str(tmp_path / "b"))
    assert sorted(map(tuple, text.read_bigrams(spark, str(tmp_path / "b")).collect())) == sorted(map(tuple, b.collect()))
    sinks.write_clusters(spark.createDataFrame([("a", 3)], "word string, cid int"), str(tmp_path / "c"), n_clusters=10, seed=4)
    frame, meta = text.read_clusters(spark, str(tmp_path / "c"))
    assert tuple(frame.first()) == ("a", 3) and meta == {"n_clusters": 10, "seed": 4}
    sinks.write_anchors(spark, ["S", "x"], str(tmp_path / "k"), as_json=True)
    assert text.read_anchors(spark, str(tmp_path / "k"))[0] == ["S", "x"]
    (tmp_path / "corpus").write_text("a b\n\n c \n")
    assert [r["w"] for r in text.read_corpus(spark, str(tmp_path / "corpus")).orderBy("sid").collect()] == [["a", "b"], ["c"]]
    (tmp_path / "y").write_text("3.0 a b a\nq r\n")
    assert sorted((r["weight"], r["w"]) for r in text.read_weighted_yields(spark, str(tmp_path / "y")).collect()) == [(1.0, ["q", "r"]), (3.0, ["a", "b", "a"])]
