"""Experiments over known grammars: sampled corpora, anchors found in them, grammars learned from them, and how near these come.

An experiment is a driver's loop over Spark jobs; its results are a row each. Corpora, features and scores stay DataFrames.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators import clustering, evaluation, induction, sampling, targets, training, trees
from spanwright.operators import grammar as G
from spanwright.operators import tokens as T
from spanwright.operators.lineage import cut


@dataclass
class Settings:
    """Of one experiment; ``number`` None lets the tests stop the search."""

    nonterminals: int = 4
    terminals: int = 200
    sentences: int = 2000
    grammar_seed: int = 1
    corpus_seed: int = 1
    n_clusters: int = 10
    min_cluster: int = 1
    min_count: int = 20
    number: int | None = None
    mode: str = "marginal"
    binary: str = "renyi"
    max_length: int = 20


def corpus(rules: DataFrame, n: int, seed: int) -> DataFrame:
    """(sid, w): yields of sampled trees."""
    return sampling.yields(sampling.sample_trees(rules, n, seed)).select(F.col("sample").alias("sid"), "w")


def prepared(sents: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Word counts, clusters after the exchange, features of the chosen mode, and neighbours."""
    b = cut(T.bigram_counts(sents))
    counts = cut(T.counts_of(b))
    clusters = clustering.exchange_together(b, T.hashed_clusters(counts, s.n_clusters, s.min_cluster), s.n_clusters)
    features = T.joint_features(T.trigram_counts(sents), clusters, s.n_clusters) if s.mode == "joint" else T.marginal_features(b, clusters, s.n_clusters)
    return counts, clusters, features, T.word_contexts(b)


def detect(sents: DataFrame, s: Settings) -> induction.Kernels:
    """Anchors of a corpus: as many as the tests find, or ``number``."""
    counts, _, features, contexts = prepared(sents, s)
    stride = s.n_clusters + 1
    often = counts.where(F.col("n") >= s.min_count).select("word")
    start, width = (induction.joint_start_vector(stride), stride * stride) if s.mode == "joint" else (induction.start_vector(stride), 2 * stride)
    return induction.find_kernels(features.join(often, "word", "left_semi"), contexts, width, start, s.number, replicates=200)


def run(spark: SparkSession, s: Settings, rules: DataFrame | None = None) -> dict[str, Any]:
    """One row: a grammar (drawn unless given), its corpus, the anchors found, and their scores; an error is a value."""
    out: dict[str, Any] = {k: getattr(s, k) for k in s.__dataclass_fields__} | {"error": None}
    try:
        g = rules if rules is not None else sampling.random_grammar(spark, s.nonterminals, s.terminals, s.grammar_seed)
        found = detect(cut(corpus(g, s.sentences, s.corpus_seed)), s)
        score = evaluation.kernel_scores(g, found.words)
        out |= {"found": len(found.words), "true": len(G.nonterminals(g)), "reason": found.reason} | {k: score[k] for k in ("accuracy", "mean_posterior", "min_posterior", "coverage")}
        out["exact"] = out["found"] == out["true"]
    except (ValueError, G.Divergent) as e:
        out["error"] = str(e)
    return out


def grid(**choices: list) -> list[Settings]:
    """Every combination of the choices."""
    return [Settings(**dict(zip(choices, x, strict=True))) for x in itertools.product(*choices.values())]


RESULT = (
    "nonterminals int, terminals int, sentences int, grammar_seed int, corpus_seed int, n_clusters int, min_cluster int, min_count int, number int, mode string, binary string, max_length int, error string, "
    "found int, true int, reason string, accuracy double, mean_posterior double, min_posterior double, coverage double, exact boolean"
)


def run_grid(spark: SparkSession, settings: list[Settings], rules: DataFrame | None = None) -> DataFrame:
    """A row for each setting."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in (run(spark, s, rules) for s in settings)], RESULT)


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Per group: runs, failures, share of right numbers, mean difference, mean scores."""
    ok = F.col("error").isNull()
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~ok).alias("failed"), F.avg(F.when(ok, F.col("exact").cast("double"))).alias("exact"), F.avg(F.when(ok, (F.col("found") - F.col("true")).cast("double"))).alias("difference"),
        F.avg("accuracy").alias("accuracy"), F.avg("mean_posterior").alias("mean_posterior"),
    )


def replay(log: list[dict], boot_p: float, min_v: float, floor: float = 0.0, least: int = 2) -> tuple[int, str]:
    """Number of anchors and reason to stop that other thresholds would have given, from a search's notes on its candidates."""
    kept = least
    for note in sorted(log, key=lambda x: x["step"]):
        if floor > 0 and note["distance"] < floor:
            return kept, "distance"
        if note.get("boot_p") is not None and note["boot_p"] > boot_p:
            return kept, "bootstrap"
        if note.get("min_v") is not None and (note["min_v"] < min_v or note["max_p"] >= 0.001):
            return kept, "word_ctx"
        kept = note["step"] + 1
    return kept, "exhausted"


def learn_from(rules: DataFrame, s: Settings, kernels: list[str] | None = None) -> tuple[induction.Learned, dict[str, float]]:
    """A grammar learned from a corpus of ``rules``, by found or given anchors, and its divergences from these."""
    sents = cut(corpus(rules, s.sentences, s.corpus_seed))
    _, clusters, _, _ = prepared(sents, s)
    out = induction.learn(sents, clusters, s.n_clusters, kernels=kernels, number=s.number, min_count=s.min_count, binary=s.binary)
    own = cut(out.pcfg())
    scored = sampling.scored_samples(rules, min(s.sentences, 500), s.corpus_seed + 1, s.max_length, models={"own": own})
    kl = {r["kind"]: r["kl"] for r in evaluation.sampled_divergences(scored, ["own"]).where("kind in ('string', 'bracket')").collect()}
    return out, kl | {"length": G.length_kl(rules, own, 10)}


def gold(rules: DataFrame, s: Settings) -> tuple[induction.Learned, dict[str, float]]:
    """The same from the grammar's own best anchors."""
    return learn_from(rules, s, evaluation.gold_kernels(rules))


METHODS = ("found", "gold", "exact", "labelled", "supervised", "target")


def method(rules: DataFrame, s: Settings, name: str) -> dict[str, Any]:
    """One row: a grammar learned from anchors (found in the corpus, the grammar's own best, those of its exact contexts, those of
    labelled trees), counted from labelled trees, or the target itself, and how far it is from the target."""
    out: dict[str, Any] = {"method": name, "error": None}
    read = trees.read_trees(sampling.sample_trees(rules, s.sentences, s.corpus_seed).where("tree is not null"), "tree").where("nodes is not null")
    try:
        if name in ("target", "supervised"):
            own = rules if name == "target" else cut(targets.supervised(read, s.max_length))
            out["kl"] = targets.smoothed_kl(rules, own) if name == "supervised" else 0.0
            out["length"] = G.length_kl(rules, own, 10)
        else:
            kernels = None
            if name == "gold":
                kernels = evaluation.gold_kernels(rules)
            elif name == "labelled":
                kernels = targets.labelled_kernels(targets.labelled_posteriors(trees.productions(read)), s.min_count)
            elif name == "exact":
                words = G.lexical(rules).select(F.col("r1").alias("word")).distinct().withColumn("n", F.lit(1))
                kernels = [w for w, _ in targets.anchors(rules, T.hashed_clusters(words, s.n_clusters, 1), s.n_clusters, s.number)]
            learned, far = learn_from(rules, s, kernels)
            own = cut(learned.pcfg())
            out |= {"anchors": len(learned.kernels.words), "accuracy": evaluation.kernel_scores(rules, learned.kernels.words)["accuracy"], "kl": far.get("string"), "length": far["length"]}
        out |= {"terminals": G.lexical(own).select("r1").distinct().count(), "expected_length": G.terminal_expectations(own, G.expectation_frame(own)).agg(F.sum("e")).first()[0]}
    except (ValueError, KeyError, G.Divergent) as e:
        out["error"] = repr(e)
    return out


def compared(rules: DataFrame, s: Settings, names: tuple[str, ...] = METHODS) -> DataFrame:
    """(method, anchors, accuracy, kl, length, terminals, expected_length, error): a row for each method; ``kl`` is that of strings,
    of trees for the counted grammar, whose nonterminals are the target's."""
    rows = [method(rules, s, m) for m in names]
    columns = "method string, anchors int, accuracy double, kl double, length double, terminals long, expected_length double, error string"
    return rules.sparkSession.createDataFrame([tuple(r.get(c.split()[0]) for c in columns.split(", ")) for r in rows], columns)


def sweep(rules: DataFrame, sents: DataFrame, steps: list[float], batches: list[int], max_length: int = 15) -> DataFrame:
    """(step, batches, log_probability, parsed): stochastic EM of every step and number of batches, scored on all sentences."""
    rows = []
    for step, n in itertools.product(steps, batches):
        fitted = training.minibatch_em(rules, sents, n, step, max_length)
        _, parsed, lp = training.e_step(fitted, sents, max_length)
        rows.append((float(step), int(n), float(lp), float(parsed)))
    return rules.sparkSession.createDataFrame(rows, "step double, batches int, log_probability double, parsed double")


def difficulty(rules: DataFrame) -> dict[str, float]:
    """How hard a grammar's nonterminals are to tell apart: the least sure of the best anchors, and entropies."""
    e = G.expectation_frame(rules)
    best = G.terminal_posteriors(rules, e).where("nt <> 'S'").groupBy("nt").agg(F.max("posterior").alias("p")).agg(F.min("p"), F.avg("p")).first()
    h = G.entropies(rules).join(e.withColumnRenamed("nt", "lhs"), "lhs").agg(F.sum(F.col("entropy") * F.col("e"))).first()[0]
    least = e.agg(F.min("e")).first()[0]
    return {"least_anchor": best[0], "mean_anchor": best[1], "derivation_entropy": h, "least_expectation": least}
