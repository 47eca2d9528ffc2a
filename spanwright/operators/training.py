"""Expectation maximisation over a corpus: the E-step is a Spark job, the M-step a small rule table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanwright.operators import grammar as G
from spanwright.operators.charts import chart_of, expected_counts


def e_step(rules: DataFrame, sents: DataFrame, max_length: int | None = None, start: str = "S") -> tuple[DataFrame, float, float]:
    """Rule counts, number of parsed sentences, and the sum of their log probabilities. The result is a table of a grammar's size."""
    if max_length is not None:
        sents = sents.where(F.size("w") <= max_length)
    rows = [tuple(r) for r in expected_counts(sents, chart_of(rules, start)).collect()]  # one row per rule
    totals = {r1: n for lhs, r1, _, n in rows if lhs is None}
    counts = rules.sparkSession.createDataFrame([r for r in rows if r[0] is not None], "lhs string, r1 string, r2 string, n double")
    return counts, totals.get("sentences", 0.0), totals.get("log_probability", 0.0)


def m_step(counts: DataFrame) -> DataFrame:
    """Relative frequencies."""
    return G.trim_zeros(G.normalised(counts.select("lhs", "r1", "r2", F.col("n").alias("p"))))


def digamma(x: float) -> float:
    """Psi by recurrence to 7 and the asymptotic series."""
    out = 0.0
    while x < 7:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def variational_m_step(counts: DataFrame, bias: float = 0.0) -> DataFrame:
    """exp(psi(n + bias) - psi(sum)), floored at 0: sub-normalised weights that push rare rules down."""
    spark = counts.sparkSession
    rows = counts.withColumn("n", F.greatest(F.col("n") + bias, F.lit(0.0))).withColumn("t", F.sum("n").over(Window.partitionBy("lhs"))).where("n > 0").collect()
    return spark.createDataFrame([(r["lhs"], r["r1"], r["r2"], math.exp(digamma(r["n"]) - digamma(r["t"]))) for r in rows], "lhs string, r1 string, r2 string, p double")


def em(rules: DataFrame, sents: DataFrame, rounds: int = 5, max_length: int | None = None, start: str = "S", prune: float = 0.0, anneal: float = 1.0) -> tuple[DataFrame, list[float]]:
    """Batch EM: the fitted rules, and the log likelihood before each round. ``anneal`` < 1 flattens the weights of each E-step."""
    history = []
    sents = sents.persist()
    for _ in range(rounds):
        use = rules if anneal == 1.0 else rules.withColumn("p", F.pow("p", F.lit(anneal)))
        counts, parsed, lp = e_step(use, sents, max_length, start)
        history.append(lp)
        if not parsed:
            break
        rules = G.normalised(G.trim_zeros(m_step(counts), prune))
        rules = rules.sparkSession.createDataFrame([tuple(r) for r in rules.select("lhs", "r1", "r2", "p").collect()], "lhs string, r1 string, r2 string, p double")
    sents.unpersist()
    return rules, history


def minibatch_em(rules: DataFrame, sents: DataFrame, batches: int, step: float = 0.5, max_length: int | None = None, update: str = "exponentiated", start: str = "S", seed: int = 0) -> DataFrame:
    """Stochastic EM: sentences are dealt into ``batches`` by hash, and each batch moves the weights once."""
    keys = [c for c in sents.columns if c != "w"]
    dealt = sents.withColumn("__b", F.pmod(F.xxhash64(*keys, "w", F.lit(seed)), F.lit(batches))).persist()
    for b in range(batches):
        counts, parsed, _ = e_step(rules, dealt.where(F.col("__b") == b).drop("__b"), max_length, start)
        if not parsed:
            continue
        rules = G.linear_step(rules, counts, step) if update == "linear" else G.exponentiated_step(rules, counts, step, parsed)
        rules = rules.sparkSession.createDataFrame([tuple(r) for r in rules.select("lhs", "r1", "r2", "p").collect()], "lhs string, r1 string, r2 string, p double")
    dealt.unpersist()
    return rules
