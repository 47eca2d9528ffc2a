"""Weighted grammars as rule tables (lhs, r1, r2, p); r2 is null for lexical rules. Algebra over them in joins and aggregations.

A grammar is small beside a corpus, but its rule table may be large through its lexicon; what is solved on the driver has one row
per nonterminal only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

RULE = ["lhs", "r1", "r2"]


def lexical(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("r2").isNull())


def binary(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("r2").isNotNull())


def normalised(rules: DataFrame) -> DataFrame:
    """p over the sum of its left-hand side."""
    return rules.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("lhs")))


def lhs_sums(rules: DataFrame) -> DataFrame:
    return rules.groupBy("lhs").agg(F.sum("p").alias("total"))


def is_normalised(rules: DataFrame, epsilon: float = 1e-5) -> bool:
    return bool(lhs_sums(rules).agg(F.coalesce(F.bool_and(F.abs(F.col("total") - 1) <= epsilon), F.lit(True))).first()[0])


def trim_zeros(rules: DataFrame, threshold: float = 0.0) -> DataFrame:
    return rules.where(F.col("p") > threshold)


def entropies(rules: DataFrame) -> DataFrame:
    """(lhs, entropy) of each nonterminal's rules."""
    return rules.where("p > 0").groupBy("lhs").agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy"))


def unary_collapse(rules: DataFrame) -> DataFrame:
    """All lexical rules of a nonterminal as one, to ``<A>``."""
    lex = lexical(rules).groupBy("lhs").agg(F.sum("p").alias("p")).select("lhs", F.concat(F.lit("<"), "lhs", F.lit(">")).alias("r1"), F.lit(None).cast("string").alias("r2"), "p")
    return lex.unionByName(binary(rules).select(*RULE, "p"))


def unkify(rules: DataFrame, frequent: DataFrame, unk: str = "unk") -> DataFrame:
    """Lexical mass of words that are not in ``frequent`` (word) goes to one rule per nonterminal."""
    lex = lexical(rules).join(frequent.select(F.col("word").alias("r1"), F.lit(True).alias("keep")), "r1", "left")
    lex = lex.withColumn("r1", F.when(F.col("keep"), F.col("r1")).otherwise(unk)).groupBy("lhs", "r1", "r2").agg(F.sum("p").alias("p"))
    return lex.select(*RULE, "p").unionByName(binary(rules).select(*RULE, "p"))


def relabel(rules: DataFrame, mapping: DataFrame) -> DataFrame:
    """Nonterminals renamed by ``mapping`` (old, new); others keep their names, words are never touched."""
    out = rules
    for c in ("lhs", "r1", "r2"):
        m = mapping.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}"))
        is_nt = F.lit(True) if c != "r1" else F.col("r2").isNotNull()
        out = out.join(F.broadcast(m), c, "left").withColumn(c, F.when(is_nt, F.coalesce(f"new_{c}", c)).otherwise(F.col(c))).drop(f"new_{c}")
    return out


def nonterminals(rules: DataFrame) -> list[str]:
    return sorted(r["lhs"] for r in rules.select("lhs").distinct().collect())  # one row per nonterminal


def _reduced(rules: DataFrame) -> tuple[list[str], np.ndarray, list[tuple[int, int, int, float]]]:
    """Nonterminals, their lexical mass, and the binary rules, whose number does not depend on the lexicon."""
    nts = nonterminals(rules)
    at = {a: k for k, a in enumerate(nts)}
    mass = np.zeros(len(nts))
    for r in lexical(rules).groupBy("lhs").agg(F.sum("p").alias("p")).collect():
        mass[at[r["lhs"]]] = r["p"]
    rows = [(at[r["lhs"]], at[r["r1"]], at[r["r2"]], r["p"]) for r in binary(rules).collect() if r["r1"] in at and r["r2"] in at]
    return nts, mass, rows


class Divergent(ValueError):
    """The grammar's partition function has no finite value."""


def partition_function(rules: DataFrame, method: str = "newton", steps: int = 100) -> dict[str, float]:
    """z(A) = sum of A's trees' weights, by Newton's method from 0 or by fixed-point steps."""
    nts, mass, rows = _reduced(rules)
    n, z = len(nts), np.zeros(len(nts))
    if method == "fixpoint":
        for _ in range(steps):
            new = mass.copy()
            for a, b, c, p in rows:
                new[a] += p * z[b] * z[c]
            if (new > 1e100).any():
                raise Divergent("fixed-point steps grow without bound")
            z = new
        return dict(zip(nts, z.tolist(), strict=True))
    for _ in range(steps):
        f, jac = mass - z, -np.eye(n)
        for a, b, c, p in rows:
            f[a] += p * z[b] * z[c]
            jac[a, b] += p * z[c]
            jac[a, c] += p * z[b]
        try:
            step = np.linalg.solve(jac, -f)
        except np.linalg.LinAlgError as e:
            raise Divergent("singular Jacobian") from e
        z = z + step
        if np.abs(step).sum() < 1e-10:
            if (z < -1e-9).any():
                break
            return dict(zip(nts, z.tolist(), strict=True))
    raise Divergent("Newton's method does not converge")


def nonterminal_expectations(rules: DataFrame, start: str = "S") -> dict[str, float]:
    """Expected uses of each nonterminal in a tree, of a consistent grammar: row of (I - T)^-1 for the start."""
    nts, _, rows = _reduced(rules)
    t = np.zeros((len(nts), len(nts)))
    for a, b, c, p in rows:
        t[a, b] += p
        t[a, c] += p
    e = np.linalg.solve((np.eye(len(nts)) - t).T, np.eye(len(nts))[nts.index(start)])
    return dict(zip(nts, e.tolist(), strict=True))


def _values(rules: DataFrame, values: dict[str, float], name: str) -> DataFrame:
    return rules.sparkSession.createDataFrame(sorted(values.items()), f"nt string, {name} double")


def expectation_frame(rules: DataFrame, start: str = "S") -> DataFrame:
    """(nt, e)."""
    return _values(rules, nonterminal_expectations(rules, start), "e")


def _with(rules: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """``rules`` with a nonterminal table's value at lhs, r1 and r2 (1 for words and absent children)."""
    out = rules
    for c in ("lhs", "r1", "r2"):
        v = values.select(F.col("nt").alias(c), F.col(value).alias(f"{value}_{c}"))
        out = out.join(F.broadcast(v), c, "left")
    lex = F.col("r2").isNull()
    return out.withColumn(f"{value}_r1", F.when(lex, 1.0).otherwise(F.col(f"{value}_r1"))).withColumn(f"{value}_r2", F.when(lex, 1.0).otherwise(F.col(f"{value}_r2")))


def rule_expectations(rules: DataFrame, e: DataFrame) -> DataFrame:
    """(lhs, r1, r2, e): p times the expectation of the left-hand side."""
    return _with(rules, e, "e").select(*RULE, (F.col("p") * F.col("e_lhs")).alias("e"))


def terminal_expectations(rules: DataFrame, e: DataFrame) -> DataFrame:
    return lexical(rule_expectations(rules, e)).groupBy(F.col("r1").alias("word")).agg(F.sum("e").alias("e"))


def terminal_posteriors(rules: DataFrame, e: DataFrame) -> DataFrame:
    """(word, nt, posterior): which nonterminal a word comes from."""
    x = lexical(rule_expectations(rules, e))
    return x.select(F.col("r1").alias("word"), F.col("lhs").alias("nt"), (F.col("e") / F.sum("e").over(Window.partitionBy("r1"))).alias("posterior"))


def best_lhs(posteriors: DataFrame) -> DataFrame:
    """(word, nt, posterior) of the likeliest nonterminal, the first by name on a tie."""
    best = F.min(F.struct((-F.col("posterior")).alias("m"), "nt")).alias("b")
    return posteriors.groupBy("word").agg(best).select("word", F.col("b.nt").alias("nt"), (-F.col("b.m")).alias("posterior"))


def to_xi(rules: DataFrame, e: DataFrame) -> DataFrame:
    """Bottom-up weights: p E(A) / (E(B) E(C)), lexical p E(A)."""
    return _with(rules, e, "e").select(*RULE, (F.col("p") * F.col("e_lhs") / (F.col("e_r1") * F.col("e_r2"))).alias("p"))


def by_partition(rules: DataFrame, z: dict[str, float] | None = None) -> DataFrame:
    """Chi and Zhang's renormalisation: p z(B) z(C) / z(A), lexical p / z(A); also turns bottom-up weights into probabilities."""
    values = _values(rules, z if z is not None else partition_function(rules), "z")
    x = _with(rules, values, "z").where("z_lhs > 0")
    return x.select(*RULE, (F.col("p") * F.col("z_r1") * F.col("z_r2") / F.col("z_lhs")).alias("p")).where("p > 0")


def scaled_if_divergent(rules: DataFrame) -> DataFrame:
    """All weights over the greatest left-hand sum, where that exceeds 1."""
    beta = lhs_sums(rules).agg(F.greatest(F.max("total"), F.lit(1.0)).alias("beta"))
    return rules.crossJoin(F.broadcast(beta)).select(*RULE, (F.col("p") / F.col("beta")).alias("p"))


def partition_step(rules: DataFrame, z: DataFrame) -> DataFrame:
    """(nt, z) after one fixed-point step from (nt, z)."""
    b = binary(rules).join(F.broadcast(z.select(F.col("nt").alias("r1"), F.col("z").alias("z1"))), "r1").join(F.broadcast(z.select(F.col("nt").alias("r2"), F.col("z").alias("z2"))), "r2")
    both = lexical(rules).select("lhs", "p").unionByName(b.select("lhs", (F.col("p") * F.col("z1") * F.col("z2")).alias("p")))
    return both.groupBy(F.col("lhs").alias("nt")).agg(F.sum("p").alias("z"))


def smoothed(rules: DataFrame, words: DataFrame, epsilon: float, start: str = "S") -> DataFrame:
    """epsilon added to every rule A -> B C without the start below, and to every A -> word, then normalised."""
    nts = rules.select(F.col("lhs").alias("a")).distinct()
    below = nts.where(F.col("a") != start)
    grid = nts.join(below.select(F.col("a").alias("r1"))).join(below.select(F.col("a").alias("r2"))).select(F.col("a").alias("lhs"), "r1", "r2")
    lex = nts.join(words.select(F.col("word").alias("r1")).distinct()).select(F.col("a").alias("lhs"), "r1", F.lit(None).cast("string").alias("r2"))
    extra = grid.unionByName(lex).withColumn("p", F.lit(epsilon))
    return normalised(rules.select(*RULE, "p").unionByName(extra).groupBy(*RULE).agg(F.sum("p").alias("p")))


def matched(a: DataFrame, b: DataFrame, how: str = "left") -> DataFrame:
    """Rules of ``a`` with p, and of ``b`` with q."""
    x, y = a.select(*RULE, "p").alias("x"), b.select(*RULE, F.col("p").alias("q")).alias("y")
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in RULE]
    keep = [F.coalesce(F.col(f"x.{c}"), F.col(f"y.{c}")).alias(c) for c in RULE] if how == "full" else [F.col(f"x.{c}").alias(c) for c in RULE]
    return x.join(y, on, how).select(*keep, "p", "q")


def labelled_kl(target: DataFrame, hypothesis: DataFrame, e: DataFrame) -> DataFrame:
    """One row, kl: sum of E(rule) ln(p / q); infinite if a used rule is missing."""
    x = matched(rule_expectations(target, e).withColumnRenamed("e", "p"), hypothesis).withColumnRenamed("p", "e")
    x = matched(target, hypothesis).join(x.select(*[F.col(c).alias(f"k_{c}") for c in RULE], "e"), F.col("lhs").eqNullSafe(F.col("k_lhs")) & F.col("r1").eqNullSafe(F.col("k_r1")) & F.col("r2").eqNullSafe(F.col("k_r2")))
    missing = F.max(((F.col("e") > 0) & F.col("q").isNull()).cast("int"))
    return x.agg(F.when(missing == 1, F.lit(float("inf"))).otherwise(F.round(F.sum(F.when(F.col("p") > 0, F.col("e") * (F.ln("p") - F.ln("q")))), 9)).alias("kl"))


def missing_rules(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rules of ``a`` that ``b`` lacks: none, both ways, of isomorphic grammars."""
    y = b.select(*[F.col(c).alias(f"y_{c}") for c in RULE])
    return a.join(y, F.col("lhs").eqNullSafe(F.col("y_lhs")) & F.col("r1").eqNullSafe(F.col("y_r1")) & F.col("r2").eqNullSafe(F.col("y_r2")), "left_anti").select(*RULE)


def truncated(rules: DataFrame, e: DataFrame, least_nt: float = 0.1, least_rule: float = 1e-5) -> DataFrame:
    """Without nonterminals of expectation up to ``least_nt`` and rules below ``least_rule``; normalised."""
    gone = e.where(F.col("e") <= least_nt).select("nt")
    x = rule_expectations(rules, e)
    kept = x.where(F.col("e") >= least_rule)
    for c in ("lhs", "r1", "r2"):
        kept = kept.join(F.broadcast(gone.select(F.col("nt").alias(c))), c, "left_anti")
    return normalised(matched(kept.withColumnRenamed("e", "p"), rules).select(*RULE, F.col("q").alias("p")))


def length_distribution(rules: DataFrame, most: int, start: str = "S") -> list[tuple[int, float]]:
    """Probability of each yield length up to ``most``: the length chart over collapsed words, on the driver."""
    nts, mass, rows = _reduced(rules)
    table = np.zeros((most + 1, len(nts)))
    table[1] = mass
    for w in range(2, most + 1):
        for a, b, c, p in rows:
            table[w, a] += p * float(table[1:w, b] @ table[w - 1 : 0 : -1, c])
    s = nts.index(start)
    return [(w, float(table[w, s])) for w in range(1, most + 1)]


def coreachable(rules: DataFrame) -> set[str]:
    """Nonterminals that derive a string."""
    nts, mass, rows = _reduced(rules)
    good = {k for k in range(len(nts)) if mass[k] > 0}
    while new := {a for a, b, c, _ in rows if a not in good and b in good and c in good}:
        good |= new
    return {nts[k] for k in good}


def useful(rules: DataFrame, start: str = "S") -> DataFrame:
    """Rules that some tree of the start uses."""
    good = coreachable(rules)
    nts, _, rows = _reduced(rules)
    reach, todo = {start} & good, [start] if start in good else []
    while todo:
        a = todo.pop()
        for x, b, c, _ in rows:
            if nts[x] == a and nts[b] in good and nts[c] in good:
                for y in (nts[b], nts[c]):
                    if y not in reach:
                        reach.add(y)
                        todo.append(y)
    keep = rules.sparkSession.createDataFrame([(x,) for x in sorted(reach)] or [("",)], "nt string")
    lex = lexical(rules).join(F.broadcast(keep.select(F.col("nt").alias("lhs"))), "lhs", "left_semi").select(*RULE, "p")
    bins = binary(rules)
    for c in RULE:
        bins = bins.join(F.broadcast(keep.select(F.col("nt").alias(c))), c, "left_semi")
    return lex.unionByName(bins.select(*RULE, "p"))


def linear_step(rules: DataFrame, counts: DataFrame, step: float) -> DataFrame:
    """(1 - step) p + step times the counts' relative frequency; a left-hand side without counts keeps its weights."""
    x = matched(rules, counts.withColumnRenamed("n", "p")).withColumn("q", F.coalesce("q", F.lit(0.0)))
    total = F.sum("q").over(Window.partitionBy("lhs"))
    ml = F.when(total > 0, F.try_divide(F.col("q"), total)).otherwise(F.col("p"))
    return trim_zeros(normalised(x.select(*RULE, ((1 - step) * F.col("p") + step * ml).alias("p"))))


def exponentiated_step(rules: DataFrame, counts: DataFrame, rate: float, n_sentences: float, least: float = 1e-20) -> DataFrame:
    """p exp(clamp(rate n / (N p), +-10)), normalised, floored and normalised again."""
    x = matched(rules, counts.withColumnRenamed("n", "p")).withColumn("q", F.coalesce("q", F.lit(0.0)))
    move = F.greatest(F.least(rate * F.col("q") / (n_sentences * F.col("p")), F.lit(10.0)), F.lit(-10.0))
    once = normalised(x.select(*RULE, (F.col("p") * F.exp(move)).alias("p")))
    return normalised(once.withColumn("p", F.greatest("p", F.lit(least))))


def treebank_rules(productions: DataFrame) -> DataFrame:
    """(lhs, r1, r2, n, p) from a row per production of a treebank: relative frequencies."""
    c = productions.groupBy(*RULE).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lhs")))


def derivation_scores(productions: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lp): log weight of each tree from a row per production (keys, lhs, r1, r2); null where the grammar lacks a rule of it."""
    y = rules.select(*[F.col(c).alias(f"y_{c}") for c in RULE], "p")
    on = F.col("lhs").eqNullSafe(F.col("y_lhs")) & F.col("r1").eqNullSafe(F.col("y_r1")) & F.col("r2").eqNullSafe(F.col("y_r2"))
    x = productions.groupBy(*keys, *RULE).agg(F.count(F.lit(1)).alias("n")).join(y, on, "left")
    lacks = F.max((F.coalesce("p", F.lit(0.0)) <= 0).cast("int"))
    return x.groupBy(*keys).agg(F.when(lacks == 0, F.sum(F.when(F.col("p") > 0, F.col("n") * F.ln("p")))).alias("lp"))


def recursive_parts(rules: DataFrame) -> list[list[str]]:
    """Nonterminals that reach each other, set by set in the order of their first members; over a table of nonterminals."""
    nts, _, rows = _reduced(rules)
    reach = np.eye(len(nts), dtype=bool)
    for a, b, c, _ in rows:
        reach[a, [b, c]] = True
    while True:  # squared until nothing is added
        more = reach @ reach
        if (more == reach).all():
            break
        reach = more
    both = reach & reach.T
    return [[nts[k] for k in np.flatnonzero(both[i])] for i in range(len(nts)) if not both[i, :i].any()]


def outside_scores(rules: DataFrame, z: dict[str, float], start: str = "S") -> dict[str, float]:
    """Sum of the weights of all that may stand around each nonterminal, of a convergent weighted grammar; the start's own use counts 1."""
    nts, _, rows = _reduced(rules)
    t, i = np.zeros((len(nts), len(nts))), np.array([z[a] for a in nts])
    for a, b, c, p in rows:
        t[b, a] += p * i[c]
        t[c, a] += p * i[b]
    o = np.linalg.solve(np.eye(len(nts)) - t, np.eye(len(nts))[nts.index(start)])
    return dict(zip(nts, o.tolist(), strict=True))


def all_scores(rules: DataFrame, start: str = "S") -> DataFrame:
    """(nt, inside, outside, io) of a convergent weighted grammar: sums over its trees, its contexts, and both together."""
    z = partition_function(rules)
    o = outside_scores(rules, z, start)
    return rules.sparkSession.createDataFrame([(a, z[a], o[a], z[a] * o[a]) for a in sorted(z)], "nt string, inside double, outside double, io double")


def weighted_expectations(rules: DataFrame, scores: DataFrame) -> DataFrame:
    """(lhs, r1, r2, e): weight of all trees, each times its uses of the rule: outside of the left side, p, insides of the children."""
    x = _with(_with(rules, scores.select("nt", "inside"), "inside"), scores.select("nt", "outside"), "outside")
    return x.select(*RULE, (F.col("p") * F.col("outside_lhs") * F.col("inside_r1") * F.col("inside_r2")).alias("e"))


def expected_words(rules: DataFrame) -> DataFrame:
    """(nt, word, e): expected number of each word below each nonterminal of a consistent grammar."""
    nts, _, rows = _reduced(rules)
    t = np.zeros((len(nts), len(nts)))
    for a, b, c, p in rows:
        t[a, b] += p
        t[a, c] += p
    uses = np.linalg.inv(np.eye(len(nts)) - t)
    table = rules.sparkSession.createDataFrame([(a, b, float(uses[i, j])) for i, a in enumerate(nts) for j, b in enumerate(nts) if uses[i, j] > 0], "nt string, lhs string, u double")
    return lexical(rules).join(F.broadcast(table), "lhs").groupBy("nt", F.col("r1").alias("word")).agg(F.sum(F.col("p") * F.col("u")).alias("e"))


def is_convergent(rules: DataFrame, start: str = "S") -> bool:
    """Whether the start's trees have a finite sum: fixed-point steps from 0, which only rise, neither leave all bounds nor go on rising."""
    try:
        return bool(np.isfinite(partition_function(rules, "fixpoint", 1000)[start]))
    except Divergent:
        return False


def is_consistent(rules: DataFrame, epsilon: float = 1e-5, start: str = "S") -> bool:
    try:
        return abs(partition_function(rules, "fixpoint", 5000)[start] - 1) < epsilon
    except Divergent:
        return False


def lexically_scaled(rules: DataFrame) -> DataFrame:
    """Lexical weights times 1 / (8 words x greatest binary weight x greatest lexical weight): convergent, of the same conditional distribution."""
    top = rules.agg(F.countDistinct(F.when(F.col("r2").isNull(), F.col("r1"))).alias("w"), F.max(F.when(F.col("r2").isNotNull(), F.col("p"))).alias("b"), F.max(F.when(F.col("r2").isNull(), F.col("p"))).alias("l"))
    return rules.crossJoin(F.broadcast(top)).select(*RULE, F.when(F.col("r2").isNull(), F.col("p") / (8 * F.col("w") * F.col("b") * F.col("l"))).otherwise(F.col("p")).alias("p"))


def containing(rules: DataFrame, word: str, start: str = "S") -> DataFrame:
    """The grammar of the strings that hold ``word``: nonterminals are pairs of states before and after its first place.

    ``Ax00`` has no such word, ``Ax01`` its first, ``Ax11`` stands behind it and is free; only what the new start reaches stays.
    """
    tag = lambda c, x: F.concat(c, F.lit(x))
    lex, two = lexical(rules), binary(rules)
    hit = F.col("r1") == word
    parts = [lex.select(tag("lhs", "x01").alias("lhs"), "r1", "r2", "p").where(hit), lex.select(tag("lhs", "x00").alias("lhs"), "r1", "r2", "p").where(~hit), lex.select(tag("lhs", "x11").alias("lhs"), "r1", "r2", "p")]
    for a, b, c in (("x00", "x00", "x00"), ("x01", "x00", "x01"), ("x01", "x01", "x11"), ("x11", "x11", "x11")):
        parts.append(two.select(tag("lhs", a).alias("lhs"), tag("r1", b).alias("r1"), tag("r2", c).alias("r2"), "p"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return useful(out, f"{start}x01")


def lexical_posteriors(rules: DataFrame, word: str, start: str = "S") -> list[tuple[str, float]]:
    """Nonterminals that a word may come from, the likeliest first."""
    post = terminal_posteriors(rules, expectation_frame(rules, start)).where(F.col("word") == word)
    return [(r["nt"], r["posterior"]) for r in post.orderBy(F.desc("posterior"), "nt").collect()]


def bottom_up_step(rules: DataFrame, counts: DataFrame, n: float) -> DataFrame:
    """Binary bottom-up weights estimated anew from expected counts of n sentences: E(rule) / (E(B) E(C)); lexical ones stay."""
    e = counts.groupBy("lhs").agg((F.sum("n") / n).alias("e"))
    x = matched(rules, counts.select(*RULE, F.col("n").alias("p")))
    x = x.join(F.broadcast(e.select(F.col("lhs").alias("r1"), F.col("e").alias("e1"))), "r1", "left").join(F.broadcast(e.select(F.col("lhs").alias("r2"), F.col("e").alias("e2"))), "r2", "left")
    return x.select(*RULE, F.when(F.col("r2").isNull(), F.col("p")).otherwise(F.coalesce(F.try_divide(F.coalesce("q", F.lit(0.0)) / n, F.col("e1") * F.col("e2")), F.lit(0.0))).alias("p"))


def length_kl(target: DataFrame, hypothesis: DataFrame, most: int) -> float:
    """Divergence of yield lengths up to ``most``, all longer ones as one."""
    p, q = (dict(length_distribution(g, most)) for g in (target, hypothesis))
    out, rest_p, rest_q = 0.0, 1.0, 1.0
    for n, x in p.items():
        rest_p, rest_q = rest_p - x, rest_q - q[n]
        if x > 0:
            if q[n] <= 0:
                return float("inf")
            out += x * float(np.log(x / q[n]))
    if rest_p > 0:
        if rest_q <= 0:
            return float("inf")
        out += rest_p * float(np.log(rest_p / rest_q))
    return out
