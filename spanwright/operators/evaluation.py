"""Tree and grammar comparison: spans, parse scores, optimal label assignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.operators import charts, trees
from spanwright.operators import grammar as G


def _spans(n: Column, start, end) -> Column:
    """Spans of the inner nodes below the root, numbered 1 .. n - 2."""
    numbers = F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda k: F.struct(start(k).cast("int").alias("i"), end(k).cast("int").alias("j")))


def right_spans(n: Column) -> Column:
    """Unlabelled spans of the right-branching tree over n words, the root and single words left out."""
    return _spans(n, lambda k: k, lambda k: n)


def left_spans(n: Column) -> Column:
    return _spans(n, lambda k: F.lit(0), lambda k: n - k)


def span_overlap(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """``rows`` with the number of common spans and of spans of the first tree."""
    return rows.withColumn("common", F.size(F.array_intersect(a, b))).withColumn("size", F.size(a))


def assignment(gain: np.ndarray) -> list[int]:
    """Column of each row in a one-to-one assignment of the greatest total gain (rows <= columns), by shortest augmenting paths."""
    cost = gain.max() - np.asarray(gain, float)
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = slack < least[free]
            least[free[better]], way[free[better]] = slack[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def best_bijection(pairs: DataFrame, a: str = "a", b: str = "b", n: str = "n") -> dict[str, str]:
    """Labels of ``a`` to labels of ``b`` that agree most often, from counts of pairs (one row per pair of labels)."""
    rows = pairs.groupBy(a, b).agg(F.sum(n).alias("n")).collect()
    left, right = sorted({r[a] for r in rows}), sorted({r[b] for r in rows})
    gain = np.zeros((len(left), max(len(left), len(right))))
    for r in rows:
        gain[left.index(r[a]), right.index(r[b])] = r["n"]
    return {left[i]: right[j] for i, j in enumerate(assignment(gain)) if j < len(right)}


def kernel_scores(rules: DataFrame, kernels: list[str], start: str = "S") -> dict:
    """How well anchors (the start first) stand for a grammar's nonterminals: the one-to-one assignment of the greatest summed
    posteriors, and what follows from it. Over tables of anchors and nonterminals."""
    e = {r["nt"]: r["e"] for r in G.expectation_frame(rules, start).collect()}
    own = G.terminal_posteriors(rules, G.expectation_frame(rules, start)).where(F.col("word").isin(kernels)).collect()
    post = {(r["word"], r["nt"]): r["posterior"] for r in own}
    best = lambda w, nts: max(nts, key=lambda a: (post.get((w, a), 0.0), [-ord(c) for c in a])) if any(x == w for x, _ in post) else None
    nts, below = sorted(e), sorted(a for a in e if a != start)
    known = any(x == kernels[0] for x, _ in post)
    assigned, value = {kernels[0]: start}, {kernels[0]: post.get((kernels[0], start), 0.0) if known else 1.0}
    greedy = {kernels[0]: best(kernels[0], nts) if known else start} | {w: best(w, below) for w in kernels[1:]}
    n = max(len(kernels) - 1, len(below))
    gain = np.zeros((n, n))
    for i, w in enumerate(kernels[1:]):
        for j, a in enumerate(below):
            gain[i, j] = post.get((w, a), 0.0)
    columns = assignment(gain) if n else []
    for i, w in enumerate(kernels[1:]):
        j = columns[i]
        assigned[w], value[w] = (below[j], float(gain[i, j])) if j < len(below) else (None, 0.0)
    right = {w: assigned[w] is not None and assigned[w] == greedy[w] for w in kernels}
    weight = {w: e.get(greedy[w], 1.0) if greedy[w] else 1.0 for w in kernels}
    used = [a for a in assigned.values() if a is not None]
    return {
        "n_kernels": len(kernels), "n_nonterminals": len(nts), "accuracy": sum(right.values()) / len(kernels), "weighted_accuracy": sum(weight[w] for w in kernels if right[w]) / sum(weight.values()),
        "mean_posterior": float(np.mean(list(value.values()))), "min_posterior": min(value.values()), "product": float(np.prod(list(value.values()))), "injective": len(used) == len(set(used)),
        "coverage": len(set(used)) / len(nts), "start_correct": right[kernels[0]], "assignment": assigned, "posterior": value, "greedy": greedy,
    }


def kernel_product(rules: DataFrame, kernels: list[str], start: str = "S") -> float:
    """Product of the anchors' greatest posteriors where these name all nonterminals once; else 0."""
    best = {r["word"]: r for r in G.best_lhs(G.terminal_posteriors(rules, G.expectation_frame(rules, start)).where(F.col("word").isin(kernels[1:]))).collect()}
    nts = G.nonterminals(rules)
    own = [best[w]["nt"] for w in kernels[1:] if w in best]
    if len(kernels) != len(nts) or len(own) != len(kernels) - 1 or start in own or len(set(own)) != len(own):
        return 0.0
    return float(np.prod([best[w]["posterior"] for w in kernels[1:]]))


def gold_kernels(rules: DataFrame, start: str = "S") -> list[str]:
    """The start, and for each other nonterminal the word that most surely comes from it (the more frequent one on a tie)."""
    x = G.terminal_posteriors(rules, G.expectation_frame(rules, start)).join(G.terminal_expectations(rules, G.expectation_frame(rules, start)), "word")
    best = x.where(F.col("nt") != start).groupBy("nt").agg(F.min(F.struct((-F.round("posterior", 9)).alias("p"), (-F.col("e")).alias("e"), "word")).alias("b")).orderBy("nt")
    return [start, *(r["b"]["word"] for r in best.collect())]


def bijection_by_parses(target: DataFrame, hypothesis: DataFrame, read: DataFrame) -> dict[str, str]:
    """Nonterminals of ``target`` to those of ``hypothesis`` that agree most often on the nodes of trees (sample, nodes) and of the
    hypothesis' heaviest labellings of their shapes."""
    learned = trees.read_trees(charts.bracketed_scores(read.select("sample", "nodes"), charts.chart_of(hypothesis)).where("best is not null").select("sample", F.col("best.tree").alias("value"))).select("sample", F.col("nodes").alias("other"))
    both = read.select("sample", "nodes").join(learned, "sample").select(F.explode(F.arrays_zip(F.transform("nodes", lambda n: n["label"]).alias("a"), F.transform("other", lambda n: n["label"]).alias("b"))).alias("x")).select("x.*")
    return best_bijection(both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))


def sampled_divergences(scored: DataFrame, names: list[str]) -> DataFrame:
    """(model, kind, failures, kl): mean log ratio of the target to each model over ``scored_samples``, for strings, brackets and
    trees, infinite where a sample fails, and for trees given their strings (conditional)."""
    gaps = {}
    for m in names:
        for kind in ("string", "bracket", "tree"):
            gaps[m, kind] = F.col(f"{m}_{kind}").isNull(), F.col(f"target_{kind}") - F.col(f"{m}_{kind}")
        gap = (F.col("target_tree") - F.col(f"{m}_tree")) - (F.col("target_string") - F.col(f"{m}_string"))
        gaps[m, "conditional"] = gap.isNull(), gap
    # all of them from one pass over the samples
    sums = scored.agg(*(x for k, (lacks, gap) in enumerate(gaps.values()) for x in (F.count_if(lacks).alias(f"n{k}"), F.avg(gap).alias(f"g{k}"))))
    kl = lambda k: F.when(F.col(f"n{k}") > 0, F.lit(float("inf"))).otherwise(F.col(f"g{k}"))
    rows = [F.struct(F.lit(m).alias("model"), F.lit(kind).alias("kind"), F.col(f"n{k}").alias("failures"), kl(k).alias("kl")) for k, (m, kind) in enumerate(gaps)]
    return sums.select(F.inline(F.array(*rows)))


def parse_scores(gold: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """One row of sums over trees (keys, value, nodes): exact matches with and without labels, common and all spans of both kinds."""
    shape = lambda c: trees.unlabelled(F.col(c))
    x = gold.select(*keys, F.col("value").alias("g"), F.col("nodes").alias("gn")).join(other.select(*keys, F.col("value").alias("o"), F.col("nodes").alias("on")), keys)
    common = lambda f: F.size(F.array_intersect(f(F.col("gn")), f(F.col("on"))))
    return x.agg(
        F.count(F.lit(1)).alias("trees"), F.count_if(F.col("g") == F.col("o")).alias("exact"), F.count_if(shape("gn") == shape("on")).alias("exact_unlabelled"),
        F.sum(common(trees.labelled_spans)).cast("long").alias("labelled"), F.sum(F.size(trees.labelled_spans(F.col("gn")))).cast("long").alias("labelled_all"),
        F.sum(common(trees.unlabelled_spans)).cast("long").alias("unlabelled"), F.sum(F.size(trees.unlabelled_spans(F.col("gn")))).cast("long").alias("unlabelled_all"),
    )
