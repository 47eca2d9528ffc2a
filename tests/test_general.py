"""Grammars and trees of any arity against enumeration of trees, and training that never falls."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright import cli
from spanwright.operators import general, nary
from spanwright.operators import grammar as G
from spanwright.sources import sinks, text

KIND = "lhs string, rhs array<string>, p double"
#: A pair of unary rules that lead into each other, a rule of three and one of four.
RULES = [("S", ["A", "B"], 0.5), ("S", ["A", "B", "A"], 0.2), ("S", ["A", "B", "A", "B"], 0.1), ("S", ["A"], 0.2), ("A", ["a"], 0.5), ("A", ["B"], 0.3), ("A", ["c"], 0.1), ("A", ["A", "B", "B"], 0.1), ("B", ["b"], 0.6), ("B", ["A"], 0.2), ("B", ["c"], 0.2)]


def chains(most=60):
    """All unary chains by (top, bottom), as counts of their rules with their weight."""
    unary = [(a, r[0], p) for a, r, p in RULES if len(r) == 1 and r[0].isupper()]
    out = [((a, a), 1.0, {}) for a in "SAB"]
    level = out
    for _ in range(most):
        level = [((t, c), w * p, {**used, (a, c): used.get((a, c), 0) + 1}) for (t, b), w, used in level for a, c, p in unary if a == b]
        out = out + level
    return out


def brute(words):
    """Weight of all trees, and of all trees times their uses of each rule, by sums over spans and chains."""
    nts = "SAB"
    closed = {(a, b): 0.0 for a in nts for b in nts}
    chain_uses = {}
    for (a, b), w, used in chains():
        closed[a, b] += w
        for r, n in used.items():
            chain_uses.setdefault((a, b), {}).setdefault(r, 0.0)
            chain_uses[a, b][r] += w * n
    memo = {}

    def span(i, j, a):
        """(weight, uses) of trees of a over words[i:j]."""
        if (i, j, a) in memo:
            return memo[i, j, a]
        total, uses = 0.0, {}
        for b in nts:
            w, u = below(i, j, b)
            if w:
                total += closed[a, b] * w
                for r, n in chain_uses.get((a, b), {}).items():
                    uses["chain", r] = uses.get(("chain", r), 0.0) + n * w
                for r, n in u.items():
                    uses[r] = uses.get(r, 0.0) + closed[a, b] * n
        memo[i, j, a] = total, uses
        return memo[i, j, a]

    def below(i, j, b):
        total, uses = 0.0, {}
        for lhs, rhs, p in RULES:
            if lhs != b or (len(rhs) == 1 and rhs[0].isupper()):
                continue
            if len(rhs) == 1:
                if j == i + 1 and rhs[0] == words[i]:
                    total += p
                    uses[lhs, tuple(rhs)] = uses.get((lhs, tuple(rhs)), 0.0) + p
                continue
            for cuts in itertools.combinations(range(i + 1, j), len(rhs) - 1):
                edges = (i, *cuts, j)
                parts = [span(edges[k], edges[k + 1], c) for k, c in enumerate(rhs)]
                w = p * math.prod(x for x, _ in parts)
                if not w:
                    continue
                total += w
                uses[lhs, tuple(rhs)] = uses.get((lhs, tuple(rhs)), 0.0) + w
                for x, u in parts:
                    for r, n in u.items():
                        uses[r] = uses.get(r, 0.0) + w / x * n
        return total, uses

    w, u = span(0, len(words), "S")
    flat = {}
    for r, n in u.items():
        key = (r[1][0], (r[1][1],)) if r[0] == "chain" else r
        flat[key] = flat.get(key, 0.0) + n
    return w, flat


def sentences(n=25, most=5):
    r = random.Random(4)
    return [[r.choice("abc") for _ in range(r.randint(1, most))] for _ in range(n)] + [["a", "zzz"], [], None]


@pytest.fixture(scope="module")
def grammar(spark):
    return spark.createDataFrame(RULES, KIND)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(k, w, 1.0 + k % 3) for k, w in enumerate(sentences())], "sid long, w array<string>, weight double")


def test_inside_and_counts_match_enumeration(spark, grammar, corpus):
    got = {r["sid"]: r["lp"] for r in general.inside_log_probability(grammar, corpus).collect()}
    uses, sums = {}, [0.0, 0.0, 0.0]
    for k, w in enumerate(sentences()):
        total, own = brute(w) if w and "zzz" not in w else (0.0, {})
        assert (got[k] is None) == (total == 0) and (total == 0 or abs(got[k] - math.log(total)) < 1e-9), w
        if total:
            weight = 1.0 + k % 3
            sums = [a + weight * b for a, b in zip(sums, (1, math.log(total), len(w)))]
            for r, n in own.items():
                uses[r] = uses.get(r, 0.0) + weight * n / total
    counts = {(r["lhs"], tuple(r["rhs"])): r["n"] for r in general.expected_counts(grammar, corpus).collect()}
    assert [counts.pop((None, (x,))) for x in ("sentences", "log_probability", "tokens")] == pytest.approx(sums)
    assert counts == pytest.approx({r: n for r, n in uses.items() if n > 0})


def test_closure_sums_chains():
    u = np.array([[0.0, 0.3, 0.0], [0.2, 0.1, 0.4], [0.0, 0.0, 0.0]])
    assert np.allclose(general.closure(u), sum(np.linalg.matrix_power(u, k) for k in range(200)))
    assert general.closure(np.zeros((0, 0))).shape == (0, 0)
    with pytest.raises(G.Divergent):
        general.closure(np.array([[0.0, 2.0], [0.5, 0.0]]))


@pytest.mark.parametrize("side", ["left", "right"])
def test_grammar_round_trip(spark, grammar, side):
    two = general.binarised(grammar, side)
    rows = {(r["lhs"], tuple(r["rhs"])): r["p"] for r in two.collect()}
    assert max(len(r) for _, r in rows) == 2
    shared = ("A|B", ("A", "B")) if side == "left" else ("B|A|B", ("B", "A|B"))
    assert rows[shared] == 1.0 and sum("|" in a for a, _ in rows) == (2 + 1 if side == "left" else 3 + 1) - (side == "left")
    back = {(r["lhs"], tuple(r["rhs"]), r["p"]) for r in general.unbinarised(two).collect()}
    assert back == {(a, tuple(r), p) for a, r, p in RULES}
    with pytest.raises(Exception, match="separator"):
        general.binarised(spark.createDataFrame([("S", ["A|B", "C", "C"], 1.0)], KIND), side).collect()
    with pytest.raises(ValueError, match="words in longer rules"):
        general.chart_of(spark.createDataFrame([("S", ["A", "word"], 1.0), ("A", ["a"], 1.0)], KIND))


def test_repeated_rules_add_up(spark, grammar, corpus):
    halves = grammar.withColumn("p", F.col("p") / 2)
    a, b = ({r["sid"]: r["lp"] for r in general.inside_log_probability(g, corpus).collect()} for g in (grammar, halves.unionByName(halves)))
    assert a == pytest.approx(b)


def test_em_rises_and_entropic_never_falls(spark, grammar, corpus):
    fit = general.em(grammar, corpus, rounds=3)
    assert all(a <= b + 1e-9 for a, b in zip(fit.objective, fit.objective[1:]))
    as_dict = lambda rules: {(r["lhs"], tuple(r["rhs"])): r["p"] for r in rules.collect()}
    once = general.entropic(grammar, corpus, 0.0, rounds=1)
    assert as_dict(once.rules) == pytest.approx(as_dict(general.em(grammar, corpus, rounds=1).rules))
    sharp, flat = general.entropic(grammar, corpus, 8.0, rounds=3), general.entropic(grammar, corpus, -8.0, rounds=3)
    for f in (once, sharp, flat):
        assert all(a <= b + 1e-9 for a, b in zip(f.objective, f.objective[1:]))
        for t in f.rules.groupBy("lhs").agg(F.sum("p").alias("t")).collect():
            assert t["t"] == pytest.approx(1)
    assert general.entropies(sharp.rules) < general.entropies(flat.rules)


def test_em_options(spark, grammar, corpus):
    stopped = general.em(grammar, corpus, rounds=9, tolerance=0.5)
    assert len(stopped.objective) == 1
    jittered = general.em(grammar, corpus, rounds=1, jitter=0.5, bias=0.1, variational=True, prune=1e-4, anneal=(2.0, 1.0, 3), max_length=4)
    assert jittered.bits[0] > 0 and jittered.rules.count() <= len(RULES)
    nothing = general.em(grammar, corpus.where("w IS NULL"), rounds=3)
    assert nothing.objective == [] and nothing.rules.count() == len(RULES)
    x = spark.createDataFrame([(v,) for v in (0.3, 1.0, 7.5, 40.0, 0.0)], "x double").select("x", general.psi(F.col("x")).alias("y")).collect()
    for r in x:
        h = 1e-5
        want = None if r["x"] == 0 else (math.lgamma(r["x"] + h) - math.lgamma(r["x"] - h)) / (2 * h)
        assert r["y"] is None if want is None else abs(r["y"] - want) < 1e-5


# trees -----------------------------------------------------------------------------------------------------------------------


def made(r, depth=0):
    if depth > 3 or r.random() < 0.25:
        return f"({r.choice('XYZ')} w{r.randint(0, 3)})"
    return f"({r.choice('XYZS')} {' '.join(made(r, depth + 1) for _ in range(r.choice([1, 2, 3, 4, 5])))})"


@pytest.mark.parametrize("side", ["left", "right", "down"])
def test_trees_round_trip(spark, side):
    r = random.Random(2)
    texts = [made(r) for _ in range(60)] + ["(A " * 3000 + "(B b)" + ")" * 3000, "(S a b c d)"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, value string")
    two = nary.mapped(df, lambda t: nary.binarised(t, side), "value", "two")
    assert max(len(x["rhs"]) for x in nary.productions(two.select("id", F.col("two").alias("value"))).collect()) <= 2
    assert [x["back"] for x in nary.mapped(two, nary.unbinarised, "two", "back").orderBy("id").collect()] == texts


def test_binary_labels():
    t = "(S (A a) (B b) (C c) (D d))"
    show = lambda side: nary.write(nary.binarised(nary.read(t), side))
    assert show("right") == "(S (A a) (B|C|D (B b) (C|D (C c) (D d))))"
    assert show("down") == "(S (A a) (S|A (B b) (S|A|B (C c) (D d))))"
    assert show("left") == "(S (A|B|C (A|B (A a) (B b)) (C c)) (D d))"
    assert nary.write(nary.collapsed(nary.read("(S (S (S (A (A a)) b)))"))) == "(S (A a) b)"


@pytest.mark.parametrize("bad", [None, "", "(", "(A", "(A a", "A a)", "((A a))", "(A)", "()", "(A a) (B b)", "(A (B))", "a"])
def test_no_trees(bad):
    assert nary.read(bad) is None


def test_tree_weights_survive(spark):
    r = random.Random(7)
    df = spark.createDataFrame([(k, made(r)) for k in range(50)] + [(99, None)], "id long, value string")
    prods = nary.productions(df)
    rules = nary.rules_of(prods)
    want = {x["id"]: x["lp"] for x in nary.log_weights(prods, rules, ["id"]).collect()}
    for side in ("left", "right"):
        two = nary.mapped(df, lambda t, side=side: nary.binarised(t, side))
        got = nary.log_weights(nary.productions(two), general.binarised(rules, side), ["id"])
        assert {x["id"]: x["lp"] for x in got.collect()} == pytest.approx(want)
    gone = nary.log_weights(prods, rules.where("lhs <> 'X'"), ["id"])
    assert gone.where("lp IS NULL").count() > 0


def test_command_line(spark, grammar, corpus, tmp_path):
    sinks.write_general_grammar(grammar, str(tmp_path / "g"))
    (tmp_path / "c").write_text("".join(f"{1 + k % 3} {' '.join(w)}\n" for k, w in enumerate(sentences()) if w))
    for extra in ([], ["--factor", "2"]):
        cli.main(["train-general", str(tmp_path / "c"), str(tmp_path / f"out{len(extra)}"), "--grammar", str(tmp_path / "g"), "--rounds", "2", *extra])
        fitted = text.read_general_grammar(spark, str(tmp_path / f"out{len(extra)}"))
        assert fitted.groupBy("lhs").agg(F.round(F.sum("weight"), 3).alias("t")).where("t <> 1").count() == 0
    (tmp_path / "t").write_text("(S (A a) (B b) (C c))\n")
    cli.main(["binarise-trees", str(tmp_path / "t"), str(tmp_path / "t2"), "--side", "right"])
    cli.main(["unbinarise-trees", str(tmp_path / "t2"), str(tmp_path / "t3")])
    assert spark.read.text(str(tmp_path / "t3")).first()[0] == "(S (A a) (B b) (C c))"
