"""What a known grammar says of its words' contexts, exactly, and what labelled trees say: anchors and grammars without a search.

Contexts come from sums over the grammar, not from samples: which preterminals are neighbours is solved on the binary rules, a table
of nonterminals; words and clusters are joined to it by their lexical rules, so no pair of words is made.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators import geometry, induction, stats, trees
from spanwright.operators import grammar as G
from spanwright.operators.lineage import cut


def preterminal_bigrams(rules: DataFrame, start: str = "S") -> DataFrame:
    """(n1, n2, e): expected number of times in a tree that words of n1 and n2 are neighbours; null is the sentence's end on either side.

    Of a consistent grammar. Neighbours meet in one node A -> B C: the last word below B and the first below C. The chances of a corner
    word's preterminal solve corner = lexical share + child table * corner.
    """
    nts, mass, rows = G._reduced(rules)
    at = {a: k for k, a in enumerate(nts)}
    left, right = np.zeros((len(nts), len(nts))), np.zeros((len(nts), len(nts)))
    for a, b, c, p in rows:
        left[a, b] += p
        right[a, c] += p
    first, last = (np.linalg.solve(np.eye(len(nts)) - t, np.diag(mass)) for t in (left, right))
    e = G.nonterminal_expectations(rules, start)
    inner = np.zeros_like(first)
    for a, b, c, p in rows:
        inner += e[nts[a]] * p * np.outer(last[b], first[c])
    out = [(x, y, float(inner[i, j])) for i, x in enumerate(nts) for j, y in enumerate(nts)]
    out += [(None, y, float(first[at[start], j])) for j, y in enumerate(nts)] + [(x, None, float(last[at[start], i])) for i, x in enumerate(nts)]
    return rules.sparkSession.createDataFrame([r for r in out if r[2] > 0], "n1 string, n2 string, e double")


def features(rules: DataFrame, clusters: DataFrame, n_clusters: int, start: str = "S") -> DataFrame:
    """(word, feature, value): expected marginal features of every word in a sentence, numbered as ``tokens.marginal_features`` does.

    A sentence's end and words without a cluster have 0. Words that the grammar never uses have no rows.
    """
    lex = G.lexical(rules).groupBy("lhs", F.col("r1").alias("word")).agg(F.sum("p").alias("p"))
    lex = lex.join(lex.groupBy("lhs").agg(F.sum("p").alias("t")), "lhs").select(F.col("lhs").alias("nt"), "word", (F.col("p") / F.col("t")).alias("p")).where("p > 0")
    of = lex.join(clusters.select("word", "cid"), "word", "left").groupBy("nt", F.coalesce("cid", F.lit(0)).alias("cid")).agg(F.sum("p").alias("m"))
    pairs = cut(preterminal_bigrams(rules, start))
    ends = lambda df, c: df.where(F.col(c).isNull())
    sides = []
    for own, other, shift in (("n2", "n1", 0), ("n1", "n2", n_clusters + 1)):
        met = pairs.where(F.col(own).isNotNull())
        inner = met.join(of.withColumnRenamed("nt", other), other).select(F.col(own).alias("nt"), (F.col("cid") + shift).alias("feature"), (F.col("e") * F.col("m")).alias("e"))
        sides.append(inner.unionByName(ends(met, other).select(F.col(own).alias("nt"), F.lit(shift).alias("feature"), "e")))
    around = sides[0].unionByName(sides[1]).groupBy("nt", "feature").agg(F.sum("e").alias("e"))
    return lex.join(around, "nt").groupBy("word", "feature").agg(F.sum(F.col("p") * F.col("e")).alias("value"))


def anchors(rules: DataFrame, clusters: DataFrame, n_clusters: int, number: int | None = None, floor: float = 1e-6, start: str = "S") -> list[tuple[str, float]]:
    """(word, distance) of the anchors that the exact contexts give, the start first: always the word farthest from the span of those
    before, down to ``floor``. Exact rows lie in the hull of the nonterminals' rows, so there are no more anchors than nonterminals."""
    width = 2 * (n_clusters + 1)
    own = features(rules, clusters, n_clusters, start).groupBy("word").agg(F.sum("value").alias("t"), F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    rows = cut(own.select("word", F.lit(1).alias("n"), F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)) / F.col("t")).alias("v")))
    out, vectors = [(start, float("inf"))], [induction.start_vector(n_clusters + 1)]
    while number is None or len(out) < number:
        far = stats.distance_from(rows, geometry.orthonormal(vectors)).orderBy(F.desc(F.round("distance", 9)), "word").first()  # equal rows go by name
        if far is None or far["distance"] < floor:
            break
        out.append((far["word"], far["distance"]))
        vectors.append(np.array(far["v"]))
    return out


def labelled_posteriors(productions: DataFrame) -> DataFrame:
    """(word, nt, n, posterior): how often each nonterminal has a word in a treebank's productions (lhs, r1, r2)."""
    c = productions.where("r2 IS NULL").groupBy(F.col("r1").alias("word"), F.col("lhs").alias("nt")).agg(F.count(F.lit(1)).alias("n"))
    return c.join(c.groupBy("word").agg(F.sum("n").alias("t")), "word").select("word", "nt", "n", (F.col("n") / F.col("t")).alias("posterior"))


def labelled_kernels(posteriors: DataFrame, least: int = 1, start: str = "S") -> list[str]:
    """The start, and for each other nonterminal of a labelled table the word that it most surely has, of those counted ``least`` times
    or more; the more frequent one, then the first by name, on a tie."""
    often = posteriors.join(posteriors.groupBy("word").agg(F.sum("n").alias("t")).where(F.col("t") >= least), "word")
    best = often.where(F.col("nt") != start).groupBy("nt").agg(F.min(F.struct((-F.round("posterior", 9)).alias("p"), (-F.col("t")).alias("t"), "word")).alias("b")).orderBy("nt")
    return [start, *(r["b"]["word"] for r in best.collect())]  # a row for each nonterminal


def supervised(read: DataFrame, max_length: int | None = None) -> DataFrame:
    """(lhs, r1, r2, p): relative frequencies of the trees (nodes) of up to ``max_length`` words."""
    kept = read if max_length is None else read.where(F.size(trees.leaf_words(F.col("nodes"))) <= max_length)
    return G.treebank_rules(trees.productions(kept)).select(*G.RULE, "p")


def smoothed_kl(target: DataFrame, hypothesis: DataFrame, epsilon: float = 1e-6, start: str = "S") -> float:
    """Divergence of trees from a target of the same nonterminals, the hypothesis with ``epsilon`` added to every rule."""
    words = G.lexical(target).select(F.col("r1").alias("word"))
    e = G.expectation_frame(target, start)
    return float(G.labelled_kl(target, G.smoothed(hypothesis, words, epsilon, start), e).first()["kl"])
