import collections
import itertools
import math

import numpy as np
import pytest

from spanwright.operators import charts as C
from spanwright.operators import clustering, contextmodels, evaluation, geometry, induction, sampling, stats, trees
from spanwright.operators import grammar as G
from spanwright.operators import tokens as T

RULES = "lhs string, r1 string, r2 string, p double"
AMBIGUOUS = [("S", "A", "A", 1.0), ("A", "A", "A", 0.4), ("A", "a", None, 0.4), ("A", "b", None, 0.2)]
LESS = [("S", "A", "A", 1.0), ("A", "A", "A", 0.3), ("A", "a", None, 0.3), ("A", "b", None, 0.2)]


def rules(spark, rows):
    return spark.createDataFrame(rows, RULES)


@pytest.fixture(scope="module")
def corpus(spark):
    """Sentences of a grammar whose three classes of words stand in different places."""
    g = rules(spark, [("S", "D", "N", 0.5), ("S", "N", "V", 0.5), *[("D", f"d{k}", None, 0.25) for k in range(4)], *[("N", f"n{k}", None, 0.25) for k in range(4)], *[("V", f"v{k}", None, 0.25) for k in range(4)]])
    words = sampling.yields(sampling.sample_trees(g, 2000, 5)).select("sample", "w").collect()
    return spark.createDataFrame([(0, r["sample"], r["w"]) for r in words], "doc_id long, sno long, w array<string>").cache()


def brute_chi2(x, y, least=5):
    keep = (x + y) > least
    x, y = x[keep].astype(float), y[keep].astype(float)
    if len(x) < 2 or not x.sum() or not y.sum():
        return None
    n, yates = x.sum() + y.sum(), 0.5 if len(x) == 2 else 0.0
    total = 0.0
    for o, r in ((x, x.sum()), (y, y.sum())):
        e = r * (x + y) / n
        total += (np.maximum(np.abs(o - e) - yates, 0) ** 2 / e).sum()
    return total, int(n), len(x) - 1


def test_chi2_pairs_match_brute_force(spark):
    rng = np.random.default_rng(3)
    table = {w: rng.poisson(4, 30) * (rng.random(30) < 0.4) for w in "abcdef"} | {"g": np.array([9, 7] + [0] * 28), "h": np.array([8, 0, 9] + [0] * 27), "i": np.array([3, 9] + [0] * 28)}
    rows = [(w, "left" if k % 2 else "right", f"c{k // 2}", int(n)) for w, x in table.items() for k, n in enumerate(x) if n]
    df = spark.createDataFrame(rows, "word string, side string, ctx string, n long")
    got = {(r["a"], r["b"]): r for r in stats.chi2_pairs(df).collect()}
    for a, b in itertools.combinations(sorted(table), 2):
        want = brute_chi2(table[a], table[b])
        assert (want is None) == ((a, b) not in got), (a, b)
        if want:
            assert got[a, b]["chi2"] == pytest.approx(want[0], abs=1e-5) and (got[a, b]["n"], got[a, b]["df"]) == want[1:]
    one = {(r["a"], r["b"]): r["chi2"] for r in stats.chi2_pairs(df, focus="c").collect()}
    assert one == {k: r["chi2"] for k, r in got.items() if "c" in k}


def test_pair_tables_match_dense_sums(spark):
    rng = np.random.default_rng(4)
    p = {w: rng.dirichlet(np.ones(6)) for w in "xyz"}
    p["z"][2] = 0
    p = {w: v / v.sum() for w, v in p.items()}
    df = spark.createDataFrame([(w, k, float(v)) for w, x in p.items() for k, v in enumerate(x) if v], "word string, feature int, p double")
    pairs = stats.pair_table(df)
    for alpha in (1, 2.0, 5.0):
        got = {(r["a"], r["b"]): r["d"] for r in stats.renyi(pairs, alpha).collect()}
        for a, b in itertools.permutations("xyz", 2):
            x, y = p[a], p[b]
            if ((x > 0) & (y == 0)).any():
                assert got[a, b] == math.inf
                continue
            ok = x > 0
            want = (x[ok] * np.log(x[ok] / y[ok])).sum() if alpha == 1 else math.log((x[ok] * (x[ok] / y[ok]) ** (alpha - 1)).sum()) / (alpha - 1)
            assert got[a, b] == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("alpha", [1, 2.0, 3.0, float("inf")])
def test_context_divergences_match_dense_sums(spark, alpha):
    r = np.random.default_rng(5)
    sents = [[str(r.choice(list("abcdz"))) for _ in range(r.integers(1, 6))] for _ in range(60)]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sents)], "sid long, w array<string>")
    words = T.word_counts(df).where("word <> 'z'")
    n = {x["word"]: x["n"] for x in words.collect()}
    seen = collections.defaultdict(collections.Counter)
    for s in sents:
        q = ["<s>", *s, "<s>"]
        for i, w in enumerate(s):
            if w in n:
                seen[w][q[i], q[i + 2]] += 1
    got = {(x["a"], x["b"]): x["d"] for x in contextmodels.pair_divergences(df, words, alpha).collect()}
    assert len(got) == len(n) * (len(n) - 1)
    for (a, b), d in got.items():
        ratio = np.array([(seen[a][c] + 0.1) / (seen[b][c] + 0.1) * n[b] / n[a] for c in seen[a]])
        w = np.array([k / sum(seen[a].values()) for k in seen[a].values()])
        want = (w * np.log(ratio)).sum() if alpha == 1 else math.log(ratio.max()) if alpha == float("inf") else math.log((w * ratio ** (alpha - 1)).sum()) / (alpha - 1)
        assert d == pytest.approx(want)


def test_vocabulary_ids_follow_counts(spark):
    rng = np.random.default_rng(6)
    rows = [(f"{chr(97 + k % 26)}{k}", int(n)) for k, n in enumerate(rng.zipf(1.5, 500).clip(1, 5000))] + [("é", 1), ("", 1), ("a", 1)]
    got = {r["word"]: r["id"] for r in T.vocabulary(spark.createDataFrame(rows, "word string, n long")).collect()}
    want = sorted(rows, key=lambda x: (-x[1], x[0].encode()))
    assert got == {w: k + 1 for k, (w, _) in enumerate(want)}


def test_special_vocabulary_round_trip(spark):
    s = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["q"]), (3, [])], "sid long, w array<string>")
    v = T.special_vocabulary(T.word_counts(s).where("word <> 'q'"))
    rows = {r["sid"]: r["ids"] for r in T.encoded(s, v).collect()}
    assert rows == {1: [1, 4, 5, 4, 2], 2: [1, 3, 2], 3: [1, 2]}
    assert {r["sid"]: r["w"] for r in T.decoded(T.encoded(s, v), v).collect()} == {1: ["a", "b", "a"], 2: ["<unk>"], 3: []}


def test_chi2_tail():
    assert induction.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and induction.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert induction.chi2_sf(0, 3) == 1 and induction.chi2_sf(1e4, 3) == 0 and induction.chi2_median(2) == pytest.approx(2 * math.log(2))


def test_kernels_of_known_classes(spark, corpus):
    b = T.bigram_counts(corpus)
    counts = T.counts_of(b)
    own = spark.createDataFrame([(f"{c}{k}", i + 1) for i, c in enumerate("dnv") for k in range(4)], "word string, cid int")
    f = T.marginal_features(b, own, 4)
    found = induction.find_kernels(f, T.word_contexts(b), 10, induction.start_vector(5), replicates=100)
    assert found.words[0] == "S" and {w[0] for w in found.words[1:]} == set("dnv") and len(found.words) == 4 and found.reason in ("bootstrap", "word_ctx")
    three = induction.find_kernels(f, T.word_contexts(b), 10, induction.start_vector(5), number=3)
    assert len(three.words) == 3 and three.reason == "max_nt" and not three.log
    near = {r["word"]: r["kernel"] for r in induction.vertex_clusters(induction.shrunk_rows(f, 10, induction.start_vector(5))[0], found).collect()}
    assert all(k[0] == w[0] for w, k in near.items()) and len(near) == 12
    for mode in ("renyi", "hull"):
        out = induction.learn(corpus, own, 4, kernels=found.words, binary=mode)
        g = out.pcfg().collect()
        sums = collections.Counter()
        for r in g:
            sums[r["lhs"]] += r["p"]
        assert all(v == pytest.approx(1, abs=1e-6) for v in sums.values())
        lex = {(r["lhs"], r["r1"]): r["p"] for r in g if r["r2"] is None}
        noun = next(w for w in found.words if w[0] == "n")
        assert sum(p for (a, w), p in lex.items() if a == f"NT_{noun}" and w[0] == "n") > 0.8 * sum(p for (a, _), p in lex.items() if a == f"NT_{noun}")
    assert counts.count() == 12


def test_hull_weights_of_many_rows():
    rng = np.random.default_rng(7)
    basis, y = rng.dirichlet(np.ones(8), 4), rng.dirichlet(np.ones(8), 30)
    assert np.allclose(geometry.hull_weights_of(y, basis), [geometry.hull_weights(v, basis) for v in y])


def test_significance():
    rng = np.random.default_rng(8)
    rows = [(200.0, float(d), rng.dirichlet(np.ones(20))) for d in rng.uniform(0.01, 0.05, 40)] + [(200.0, 0.9, rng.dirichlet(np.ones(20)))]
    assert induction.significance(rows, 40, 2)["survival"] < 0.01 < 0.5 < induction.significance(rows, 0, 2)["survival"]


def test_weighted_algebra(spark):
    g = rules(spark, LESS)
    z = (1 - math.sqrt(1 - 4 * 0.3 * 0.5)) / 0.6
    got = {r["nt"]: r for r in G.all_scores(g).collect()}
    assert got["A"]["inside"] == pytest.approx(z) and got["S"]["inside"] == pytest.approx(z * z) and got["A"]["outside"] == pytest.approx(2 * z / (1 - 0.6 * z))
    e = {(r["lhs"], r["r1"]): r["e"] for r in G.weighted_expectations(g, G.all_scores(g)).collect()}
    assert e["A", "a"] == pytest.approx(got["A"]["outside"] * 0.3) and e["S", "A"] == pytest.approx(z * z)
    assert G.is_convergent(g) and not G.is_consistent(g) and G.is_consistent(rules(spark, AMBIGUOUS)) and not G.is_convergent(rules(spark, [("S", "S", "S", 2.0), ("S", "a", None, 2.0)]))
    assert G.recursive_parts(rules(spark, [("S", "A", "B", 1.0), ("A", "B", "B", 0.5), ("B", "A", "A", 0.1), ("A", "x", None, 0.5), ("B", "y", None, 0.9)])) == [["A", "B"], ["S"]]
    assert G.partition_function(G.containing(rules(spark, AMBIGUOUS), "b"))["Sx01"] == pytest.approx(0.75)
    assert {(r["nt"], r["word"]): r["e"] for r in G.expected_words(rules(spark, AMBIGUOUS)).collect()}["S", "a"] == pytest.approx(4)
    assert G.is_convergent(G.lexically_scaled(rules(spark, [("S", "S", "S", 2.0), ("S", "a", None, 2.0)])))
    assert G.length_kl(rules(spark, AMBIGUOUS), rules(spark, AMBIGUOUS), 8) == pytest.approx(0) and G.length_kl(rules(spark, AMBIGUOUS), rules(spark, LESS), 8) > 0


def test_bracketed_sums_and_labellings():
    c = C.Chart([("S", "A", "B", 0.6), ("S", "B", "A", 0.4), ("A", "a", None, 0.7), ("A", "c", None, 0.3), ("B", "b", None, 0.8), ("B", "c", None, 0.2)])
    nodes = trees.parse_tree("(X (X c) (X c))")
    assert math.exp(c.bracketed(nodes)[0]) == pytest.approx(0.3 * 0.2) and c.bracketed(nodes, True) == (pytest.approx(math.log(0.6 * 0.06)), "(S (A c) (B c))")
    assert c.bracketed(trees.parse_tree("(X (X a) (X q))")) is None and c.bracketed([]) is None
    d = C.Chart(AMBIGUOUS)
    words = ["a", "b", "a", "a"]
    shapes = ["(X (X a) (X (X b) (X (X a) (X a))))", "(X (X a) (X (X (X b) (X a)) (X a)))", "(X (X (X a) (X b)) (X (X a) (X a)))", "(X (X (X a) (X (X b) (X a))) (X a))", "(X (X (X (X a) (X b)) (X a)) (X a))"]
    assert sum(math.exp(d.bracketed(trees.parse_tree(s))[0]) for s in shapes) == pytest.approx(math.exp(d.log_probability(words)))


def test_samples_and_evaluation(spark):
    g, h = rules(spark, AMBIGUOUS), rules(spark, [("S", "A", "A", 1.0), ("A", "A", "A", 0.3), ("A", "a", None, 0.3), ("A", "b", None, 0.4)])
    scored = sampling.scored_samples(g, 80, 2, 12, models={"h": h}).cache()
    for r in scored.collect():
        uses = collections.Counter(r["tree"][i + 1 : i + 4] for i in range(len(r["tree"])) if r["tree"][i] == "(")
        assert r["target_tree"] == pytest.approx(uses["A a"] * math.log(0.4) + uses["A b"] * math.log(0.2) + uses["A ("] * math.log(0.4)) and r["target_tree"] <= r["target_string"] + 1e-9
    kl = {(r["model"], r["kind"]): r["kl"] for r in evaluation.sampled_divergences(scored, ["h"]).collect()}
    assert kl["h", "tree"] > 0 and kl["h", "conditional"] == pytest.approx(kl["h", "tree"] - kl["h", "string"])
    assert sampling.string_entropy(scored).first()["ambiguity"] > 0 and sampling.string_density(g, 3, 20, 1) == 1.0
    r = sampling.random_grammar(spark, 4, 30, 1)
    assert G.is_normalised(r) and G.is_consistent(r) and sampling.with_terminals(r, 50, 2).where("r2 is null").select("r1").distinct().count() == 50
    gold = evaluation.gold_kernels(r)
    s = evaluation.kernel_scores(r, gold)
    assert s["accuracy"] == 1 and s["injective"] and s["coverage"] == 1 and s["product"] == pytest.approx(evaluation.kernel_product(r, gold))
    worse = evaluation.kernel_scores(r, [gold[0], gold[1], gold[1], gold[2]])
    assert worse["mean_posterior"] < s["mean_posterior"] and evaluation.kernel_product(r, gold[:-1]) == 0
    read = trees.read_trees(scored.select("sample", "tree"), "tree")
    assert evaluation.bijection_by_parses(g, rules(spark, [(a.replace("A", "Z"), b.replace("A", "Z"), c and c.replace("A", "Z"), p) for a, b, c, p in AMBIGUOUS]), read) == {"S": "S", "A": "Z"}


def test_tree_helpers():
    n = trees.parse_tree("(S (A a) (A (A b) (A a)))")
    assert trees.depth(n) == 3 and trees.depth(trees.parse_tree("(A a)")) == 1 and trees.depth(None) == 0
    assert trees.simplified("(S1 (S (A (PREA x)) (B (PREB y))))") == "(S (A x) (B y))" and trees.max_entropy(4) == pytest.approx(math.log(5))
    assert len(set(trees.made_words(800, np.random.default_rng(1), 2))) == 800


def test_exchange_raises_the_objective(spark, corpus):
    b = T.bigram_counts(corpus).cache()
    start = T.hashed_clusters(T.counts_of(b), 4, 1)
    found = clustering.exchange_together(b, start, 4)
    assert clustering.objective(clustering.cluster_table(b, found, 4)) > clustering.objective(clustering.cluster_table(b, start, 4)) and found.count() == 12


def test_exchange_reaches_a_local_optimum(spark):
    r = np.random.default_rng(3)
    words = [f"w{k}" for k in range(30)]
    sents = spark.createDataFrame([(0, k, [words[(3 * r.integers(10) + j + int(r.integers(2))) % 30] for j in range(int(r.integers(1, 7)))]) for k in range(400)], "doc_id long, sno int, w array<string>")
    b = T.bigram_counts(sents).cache()
    start = T.hashed_clusters(T.word_counts(sents), 5, 1)
    table = clustering.cluster_table(b, start, 5)
    cid = {x["word"]: x["cid"] for x in start.collect()}
    moves = {x["word"]: x for x in clustering.best_moves(b, start, table).collect()}
    assert set(moves) == set(cid)
    pairs = [(x["w1"], x["w2"], x["n"]) for x in b.collect()]

    def worth(c):
        t = np.zeros((5, 5))
        for a, z, n in pairs:
            t[c.get(a, 0), c.get(z, 0)] += n
        return clustering.objective(t)

    for w, x in moves.items():  # gains equal those of tables counted anew
        plain = [worth(cid | {w: k}) - worth(cid) for k in range(1, 5)]
        assert x["gain"] == pytest.approx(max(plain), abs=1e-6) and plain[x["to"] - 1] == pytest.approx(max(plain), abs=1e-6)
    found = {x["word"]: x["cid"] for x in clustering.exchange_together(b, start, 5).collect()}
    assert all(worth(found | {w: k}) <= worth(found) + 1e-5 for w in found for k in range(1, 5))
    one_by_one = {x["word"]: x["cid"] for x in clustering.exchange(b, start, 5).collect()}
    assert worth(found) >= worth(one_by_one)
    none = b.where("n < 0")
    assert clustering.exchange_together(none, start, 5).count() == len(cid)


@pytest.mark.parametrize("head", [5, 1000])
def test_words_outside_the_clusters_move_as_one(spark, head):
    r = np.random.default_rng(6)
    drawn = [[f"w{x}" for x in r.zipf(1.3, int(r.integers(1, 9))) if x < 90] or ["w1"] for _ in range(300)]
    sents = spark.createDataFrame([(0, k, w) for k, w in enumerate(drawn)], "doc_id long, sno int, w array<string>")
    counts = T.word_counts(sents)
    known = {x["word"] for x in counts.where("n >= 8").collect()}
    plain = spark.createDataFrame([(0, k, [x if x in known else clustering.UNKNOWN for x in w]) for k, w in enumerate(drawn)], sents.schema)
    start = T.hashed_clusters(T.word_counts(plain), 4, 1)
    assert clustering.UNKNOWN in {x["word"] for x in start.collect()} and len(known) > 5
    rows = lambda x: sorted(map(tuple, x.select("word", "cid").collect()))
    found = clustering.exchange_together(T.bigrams(sents), start, 4, counts=counts, head=head, unknown=True)
    assert rows(found) == rows(clustering.exchange_together(T.bigram_counts(plain), start, 4))


def test_kernels_are_sought_over_exchanged_clusters(spark, tmp_path, monkeypatch):
    """No single move gains, that of all rare words together included, and the search's features count these clusters."""
    from spanwright.plans import corpus_queries as W
    from spanwright.plans import induction_queries as Q

    r = np.random.default_rng(4)
    word = lambda j: f"w{chr(97 + j)}" if r.random() < 0.95 else "r" + "".join(chr(97 + int(x)) for x in r.integers(0, 26, 2))
    drawn = [[[word((5 * int(r.integers(3)) + j + int(r.integers(3))) % 15) for j in range(int(r.integers(1, 8)))] for _ in range(5)] for _ in range(160)]
    spark.createDataFrame([(k, ". ".join(map(" ".join, d))) for k, d in enumerate(drawn)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    monkeypatch.setattr(W, "N_CLUSTERS", 4)
    monkeypatch.setattr(induction, "find_kernels", lambda features, *a, **k: seen.append(features) or induction.Kernels())
    Q.find_kernels(spark, str(tmp_path))
    b = T.bigram_counts(W._sents(spark, str(tmp_path)))
    cid = {x["word"]: x["cid"] for x in W.exchanged(b, T.counts_of(b)).collect()}
    n = collections.Counter(w for d in drawn for s in d for w in s)
    assert set(cid) == {w for w in n if n[w] >= 10} | {clustering.UNKNOWN} and min(n.values()) < 10

    def clusters(c):
        return [[0, *(c[w if w in c else clustering.UNKNOWN] for w in s), 0] for d in drawn for s in d]

    def worth(c):
        t = np.zeros((4, 4))
        for s in clusters(c):
            np.add.at(t, (s[:-1], s[1:]), 1)
        return clustering.objective(t)

    best = worth(cid)
    assert all(worth(cid | {w: k}) <= best + 1e-4 for w in cid for k in range(1, 4))
    want = collections.Counter()
    for s, c in zip((s for d in drawn for s in d), clusters(cid), strict=True):
        for k, w in enumerate(s):
            if n[w] >= 100:
                want.update([(w, c[k]), (w, 5 + c[k + 2])])
    assert {(x["word"], x["feature"]): x["value"] for x in seen[0].collect()} == want


def test_antichain_with_its_order(spark):
    r = np.random.default_rng(8)
    for trial in range(3):
        words = [f"w{k}" for k in range(9)]
        sets = {w: set(np.flatnonzero(r.random(5) < 0.5 + 0.1 * trial)) | {0} for w in words}
        d = [(a, b, 0.1 if sets[a] <= sets[b] else 5.0) for a in words for b in words if a != b]
        related = contextmodels.relations(spark.createDataFrame(d, "a string, b string, d double"), 1.0)
        rows = [tuple(x) for x in related.collect()]
        assert set(rows) == {(a, b, "=" if sets[a] == sets[b] else "<" if sets[a] < sets[b] else ">" if sets[a] > sets[b] else "|") for a in words for b in words if a != b}
        want = {(a, b) for a in words for b in words if sets[a] < sets[b] and not any(sets[a] < sets[c] < sets[b] for c in words)}
        assert {tuple(x) for x in contextmodels.covers(related).collect()} == want
        log = contextmodels.antichain_log(rows, words)
        kept = log[-1]["kept"]
        smallest = [w for w in words if not any(sets[v] < sets[w] for v in words)]
        assert {frozenset(sets[w]) for w in kept} == {frozenset(sets[w]) for w in smallest} and len(kept) == len({frozenset(sets[w]) for w in kept})
        assert [x["word"] for x in log] == words and all(x["reason"] in x["kept"] for x in log if x["action"] in ("equal", "larger"))
        assert contextmodels.antichain(rows, words, frozenset(words)) == [] == contextmodels.antichain([], [])
