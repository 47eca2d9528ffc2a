"""Context models: smoothed counts by SQL, and the divergence tables and rule weights that anchor selection takes from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanwright.operators.tokens import contexts, word_counts


def pair_divergences(sents: DataFrame, words: DataFrame, alpha: float = 2.0, k: int = 1, smoothing: float = 0.1) -> DataFrame:
    """(a, b, d): Renyi divergence of a's contexts against b's: ln sum w (P(a|c) E(b) / (P(b|c) E(a)))^(alpha - 1) / (alpha - 1).

    P is the counts' share with ``smoothing`` added to every candidate word (word, n), so P(a|c) / P(b|c) is the ratio of smoothed
    counts: what b lacks is a's own sum, and only contexts that both have are met pair by pair.
    """
    if alpha != float("inf"):
        return _finite_divergences(sents, words, alpha, k, smoothing)
    c = contexts(sents, words, k)
    own = c.withColumn("s", F.col("n") + F.lit(smoothing))
    held = own.groupBy("ctx").agg(F.collect_list(F.struct("word", "s")).alias("held"))  # as long as the candidate list
    pairs = F.flatten(F.transform("held", lambda u: F.transform(F.filter("held", lambda v: v["word"] != u["word"]), lambda v: F.struct(u["word"].alias("a"), v["word"].alias("b"), (u["s"] / v["s"]).alias("r")))))
    met = held.where(F.size("held") > 1).select(F.explode(pairs).alias("p")).select("p.*")
    e = words.select("word", F.ln(F.col("n").cast("double")).alias("e"))
    grid = e.select(F.col("word").alias("a"), F.col("e").alias("ea")).join(e.select(F.col("word").alias("b"), F.col("e").alias("eb")), F.col("a") != F.col("b"))
    # the greatest ratio of a context of a's that b lacks is the first, in falling order, that is not among the shared ones
    ranked = own.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("s", "ctx")), False).alias("mine")).select(F.col("word").alias("a"), "mine")
    shared = c.select(F.col("word").alias("b"), F.col("ctx")).groupBy("b").agg(F.collect_set("ctx").alias("has"))
    top = met.groupBy("a", "b").agg(F.max("r").alias("r"))
    lone = grid.join(ranked, "a").join(shared, "b").select("a", "b", (F.array_max(F.transform(F.filter("mine", lambda x: ~F.array_contains("has", x["ctx"])), lambda x: x["s"])) / F.lit(smoothing)).alias("r0"))
    return grid.join(lone, ["a", "b"]).join(top, ["a", "b"], "left").select("a", "b", (F.ln(F.greatest("r", "r0")) + F.col("eb") - F.col("ea")).alias("d"))


#: Contexts of more words than this go through a matrix product, others pair by pair.
FEW_HOLDERS = 16


def context_sums(k: np.ndarray, n: np.ndarray, sizes: np.ndarray, m: int, alpha: float, smoothing: float) -> np.ndarray:
    """(m, m + 1) sums over contexts, of ``sizes`` words each, that word k[i] of m has n[i] times.

    [a, a] is sum n f(s / smoothing), what a's contexts give against a word without any; [a, b] is sum n (f(s_a / s_b) - f(s_a / smoothing))
    over those that b has too; [a, m] is sum n. f is ln for alpha 1, else the power alpha - 1, so the ratio's f parts into a's and b's.
    """
    s, out = n + smoothing, np.zeros((m, m + 1))
    if alpha == 1:
        u, v, lone = n, np.log(smoothing) - np.log(s), n * np.log(s / smoothing)
    else:
        u, v, lone = n * s ** (alpha - 1), s ** (1 - alpha) - smoothing ** (1 - alpha), n * (s / smoothing) ** (alpha - 1)
    h = np.repeat(sizes, sizes)
    first, held = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(len(sizes)), sizes)
    i = np.flatnonzero((h > 1) & (h <= FEW_HOLDERS))
    one = np.repeat(i, h[i])
    two = np.repeat(first[i] - np.cumsum(h[i]) + h[i], h[i]) + np.arange(len(one))
    out[:, :m] = np.bincount(k[one] * m + k[two], u[one] * v[two], m * m).reshape(m, m)
    i = np.flatnonzero(h > FEW_HOLDERS)
    if len(i):
        row = np.unique(held[i], return_inverse=True)[1]
        for low in range(0, row[-1] + 1, 4096):
            part, at = i[(row >= low) & (row < low + 4096)], row[(row >= low) & (row < low + 4096)] - low
            left, right = np.zeros((2, at[-1] + 1, m))
            left[at, k[part]], right[at, k[part]] = u[part], v[part]
            out[:, :m] += left.T @ right
    out[np.arange(m), np.arange(m)] = np.bincount(k, lone, m)
    out[:, m] = np.bincount(k, n, m)
    return out


def _finite_divergences(sents: DataFrame, words: DataFrame, alpha: float, k: int, smoothing: float) -> DataFrame:
    """Every context's words meet in one row; tasks add up what they give each pair, so no pair of a context is a row of its own."""
    spark = sents.sparkSession
    rows = words.select("word", F.ln(F.col("n").cast("double")).alias("e")).collect()  # a bounded list
    m = len(rows)
    listed = spark.createDataFrame([(i, r["word"], r["e"]) for i, r in enumerate(rows)], "k int, word string, e double")
    c = contexts(sents, listed, k).join(F.broadcast(listed.select("word", "k")), "word").select("ctx", "k", "n")
    held = c.repartition("ctx").groupBy("ctx").agg(F.collect_list(F.struct("k", "n")).alias("held")).select("held")  # as long as the candidate list

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, m + 1))
        for b in batches:
            x = b.column("held")
            flat = x.flatten()
            if len(flat):
                total += context_sums(flat.field("k").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(float), x.value_lengths().to_numpy(), m, alpha, smoothing)
        a, b = np.nonzero(total)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b])], names=["a", "b", "x"])

    sums = held.mapInArrow(run, "a int, b int, x double").groupBy("a", "b").agg(F.sum("x").alias("x"))
    of = sums.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", "x"))).alias("x"))  # a row for each word
    pairs = of.select("a", "x", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("b")).where("a <> b")
    at = lambda i: F.coalesce(F.try_element_at("x", i), F.lit(0.0))
    total = (at(F.col("a")) + at(F.col("b"))) / at(F.lit(m))
    d = total if alpha == 1 else F.ln(total) / (alpha - 1)
    end = lambda c: F.broadcast(listed.select(F.col("k").alias(c), F.col("word").alias(f"w{c}"), F.col("e").alias(f"e{c}")))
    return pairs.withColumn("d", d).join(end("a"), "a").join(end("b"), "b").select(F.col("wa").alias("a"), F.col("wb").alias("b"), (F.col("d") + F.col("eb") - F.col("ea")).alias("d"))


def relations(divergences: DataFrame, near: float) -> DataFrame:
    """(a, b, relation) of every pair in ``divergences`` (a, b, d): '<' where a's contexts lie within b's (a divergence under ``near``) and not the other way, '>', '=' where both do, '|' where neither does."""
    x = divergences.select("a", "b", (F.col("d") < near).alias("within"))
    both = x.join(x.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("within").alias("holds")), ["a", "b"])
    return both.select("a", "b", F.when(F.col("within") & F.col("holds"), "=").when(F.col("within"), "<").when(F.col("holds"), ">").otherwise("|").alias("relation"))


def covers(related: DataFrame) -> DataFrame:
    """(a, b) of ``relations`` with a < b and no word between them."""
    less = related.where("relation = '<'").select("a", "b")
    between = less.withColumnRenamed("b", "c").join(less.withColumnRenamed("a", "c"), "c").select("a", "b")
    return less.join(between, ["a", "b"], "left_anti")


def antichain_log(related: list[tuple[str, str, str]], order: list[str], whole: frozenset[str] = frozenset()) -> list[dict]:
    """What is decided on each word in order: step, word, action, reason, replaces, kept (the words kept after it).

    The words of the smallest contexts stay, none within another's: a word equal to a kept one is skipped, and so is one whose contexts
    hold a kept one's, or that stands for sentences (``whole``); one within kept ones' replaces these; any other is added.
    Over a bounded list of candidates.
    """
    of = {(a, b): r for a, b, r in related}
    kept: list[str] = []
    log = []
    for step, w in enumerate(order, 1):
        by = {r: [k for k in kept if of.get((w, k), "|") == r] for r in "=><"}
        replaces: list[str] = []
        if by["="]:
            action, reason = "equal", by["="][0]
        elif w in whole or by[">"]:
            action, reason = "larger", None if w in whole else by[">"][0]
        else:
            action, reason, replaces = "replaces" if by["<"] else "added", None, by["<"]
            kept = [k for k in kept if k not in replaces] + [w]
        log.append({"step": step, "word": w, "action": action, "reason": reason, "replaces": replaces, "kept": list(kept)})
    return log


def antichain(related: list[tuple[str, str, str]], order: list[str], whole: frozenset[str] = frozenset()) -> list[str]:
    """The words that ``antichain_log`` keeps at last."""
    log = antichain_log(related, order, whole)
    return log[-1]["kept"] if log else []


def lexical_weights(divergences: DataFrame, expectations: DataFrame) -> DataFrame:
    """(a, b, xi): E(b) exp(-D(a, b)): the weight of the rule that rewrites anchor a's category as word b."""
    return divergences.join(expectations.select(F.col("word").alias("b"), "e"), "b").select("a", "b", (F.col("e") * F.exp(-F.col("d"))).alias("xi"))


def word_table(sents: DataFrame, n: int) -> DataFrame:
    """The n most frequent words with counts."""
    return word_counts(sents).orderBy(F.desc("n"), "word").limit(n)
