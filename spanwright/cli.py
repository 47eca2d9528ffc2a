"""Command line: conversions, counts, sampling, EM and evaluation of grammars and corpora."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanwright.operators import charts, clustering, diagnosis, evaluation, experiments, gap_learner, general, induction, nary, recurrent, sampling, targets, training, trees
from spanwright.operators import grammar as G
from spanwright.operators import tokens as T
from spanwright.sources import sinks, text


def _corpus(spark: SparkSession, path: str):
    return text.read_corpus(spark, path).select(F.lit(0).cast("long").alias("doc_id"), F.col("sid").alias("sno"), "w")


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    a = args
    if a.command == "ngrams":
        s = _corpus(spark, a.input)
        sinks.write_ngrams(T.bigram_counts(s) if a.n == 2 else T.trigram_counts(s), a.output)
    elif a.command == "to-preterminal":
        sinks.write_preterminal_grammar(text.read_grammar(spark, a.input), a.output)
    elif a.command == "from-preterminal":
        sinks.write_grammar(text.read_preterminal_grammar(spark, a.input), a.output)
    elif a.command == "normalise":
        sinks.write_grammar(G.by_partition(G.scaled_if_divergent(text.read_grammar(spark, a.input))), a.output)
    elif a.command == "treebank":
        sinks.write_grammar(G.treebank_rules(trees.productions(trees.read_trees(spark.read.text(a.input)).where("nodes is not null"))), a.output)
    elif a.command == "yields":
        sinks.write_corpus(trees.read_trees(spark.read.text(a.input)).where("nodes is not null").select(trees.leaf_words(F.col("nodes")).alias("w")), a.output)
    elif a.command == "sample":
        t = sampling.sample_trees(text.read_grammar(spark, a.input), a.n, a.seed)
        if a.trees:
            t.where("tree is not null").select(F.col("tree").alias("value")).write.text(a.output)
        else:
            sinks.write_corpus(sampling.yields(t).select("w"), a.output)
    elif a.command == "em":
        fitted, history = training.em(text.read_grammar(spark, a.grammar), text.read_corpus(spark, a.input), a.rounds, a.max_length)
        sinks.write_grammar(fitted, a.output, [f"log_likelihood={x:.6f}" for x in history])
    elif a.command == "evaluate":
        target, own = text.read_grammar(spark, a.input), text.read_grammar(spark, a.grammar)
        e = G.expectation_frame(target)
        out = {"kl": G.labelled_kl(target, own, e).first()[0], "missing": G.missing_rules(target, own).count(), "extra": G.missing_rules(own, target).count(), "normalised": G.is_normalised(own)}
        print(json.dumps(out))
    elif a.command == "score":
        c = charts.chart_of(text.read_grammar(spark, a.grammar))
        charts.inside_log_probability(text.read_corpus(spark, a.input), c).write.parquet(a.output)


    else:
        _more(spark, a)


_SEARCH = [("clusters", str, None), ("n-clusters", int, 10), ("min-count", int, 100), ("number", int, None)]
#: Further commands: name, positional arguments, options with types and defaults (... for none).
MORE = [
    ("clusters", "input output", [("clusters", str, None), ("n-clusters", int, 10)]),
    ("find-kernels", "input output", _SEARCH),
    ("learn", "input output", [*_SEARCH, ("kernels", str, None), ("binary", str, "renyi"), ("weighted", bool, None)]),
    ("learn-neural", "input output", [("candidates", int, 60), ("kernels", str, None), ("min-count", int, 1), ("alpha", float, 2.0), ("rounds", int, 5), ("rate", float, 5e-3), ("batch", int, 64), ("embed", int, 32), ("hidden", int, 48), ("weighted", bool, None)]),
    ("gold-kernels", "input output", []),
    ("exact-kernels", "input output", [("clusters", str, ...), ("n-clusters", int, 10), ("number", int, None)]),
    ("compare-methods", "input output", [("methods", str, None), ("sentences", int, 2000), ("seed", int, 1), ("n-clusters", int, 10), ("min-count", int, 20), ("number", int, None), ("max-length", int, 20)]),
    ("lexicon-growth", "input output", [("sizes", str, "[100, 200, 400, 800]"), ("n", int, 10000), ("seed", int, 1), ("candidates", int, 300), ("alpha", float, 2.0)]),
    ("evaluate-kernels", "input", [("kernels", str, ...)]),
    ("inspect", "input word", []),
    ("terminals", "input output", []),
    ("count", "input", []),
    ("unkify", "input output", [("corpus", str, ...), ("min-count", int, 10)]),
    ("smooth", "input output", [("grammar", str, ...), ("epsilon", float, 1e-6)]),
    ("relabel", "input output", [("grammar", str, ...), ("n", int, 1000), ("seed", int, 1)]),
    ("simplify-trees", "input output", []),
    ("random-grammar", "output", [("nonterminals", int, 4), ("terminals", int, 200), ("seed", int, 1)]),
    ("sgd", "input output", [("grammar", str, ...), ("batches", int, 10), ("step", float, 0.5), ("max-length", int, 15), ("update", str, "exponentiated")]),
    ("compare", "input", [("grammar", str, ...), ("n", int, 1000), ("seed", int, 1), ("max-length", int, 20)]),
    ("train-lm", "input output", [("min-count", int, 1), ("epochs", int, 5)]),
    ("evaluate-lm", "input model", []),
    ("grid", "input output", []),
    ("train-general", "input output", [("grammar", str, ...), ("start", str, "S"), ("rounds", int, 5), ("least-rounds", int, 1), ("tolerance", float, 0.0), ("prune", float, 0.0), ("bias", float, 0.0), ("variational", bool, None), ("jitter", float, 0.0), ("seed", int, 0), ("hot", float, 1.0), ("cold", float, 1.0), ("anneal", int, 0), ("max-length", int, None), ("factor", float, 0.0)]),
    ("binarise-trees", "input output", [("side", str, "right")]),
    ("unbinarise-trees", "input output", []),
]


def _clusters(spark: SparkSession, a: argparse.Namespace, sents):
    """Word clusters of a file, or after the exchange."""
    if a.clusters:
        return text.read_clusters(spark, a.clusters)
    b = T.bigram_counts(sents).persist()
    return clustering.exchange_together(b, T.hashed_clusters(T.counts_of(b), a.n_clusters, 1), a.n_clusters)


def _more(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "clusters":
        s = _corpus(spark, a.input)
        sinks.write_clusters(_clusters(spark, a, s), a.output, n_clusters=a.n_clusters)
    elif a.command == "find-kernels":
        s = _corpus(spark, a.input)
        b = T.bigram_counts(s).persist()
        often = T.counts_of(b).where(F.col("n") >= a.min_count).select("word")
        features = T.marginal_features(b, _clusters(spark, a, s), a.n_clusters).join(often, "word", "left_semi")
        found = induction.find_kernels(features, T.word_contexts(b), 2 * (a.n_clusters + 1), induction.start_vector(a.n_clusters + 1), a.number)
        sinks.write_anchors(spark, found.words, a.output, as_json=True)
        print(json.dumps({"kernels": found.words, "reason": found.reason, "log": found.log}))
    elif a.command == "learn":
        s = _corpus(spark, a.input)
        out = induction.learn(s, _clusters(spark, a, s), a.n_clusters, kernels=json.loads(a.kernels) if a.kernels else None, number=a.number, min_count=a.min_count, binary=a.binary)
        sinks.write_grammar(out.wcfg if a.weighted else out.pcfg(), a.output)
    elif a.command == "learn-neural":
        out = gap_learner.learn(_corpus(spark, a.input), a.candidates, anchors=json.loads(a.kernels) if a.kernels else None, min_count=a.min_count, alpha=a.alpha, rounds=a.rounds, rate=a.rate, batch=a.batch, embed=a.embed, hidden=a.hidden)
        sinks.write_grammar(out.wcfg if a.weighted else out.pcfg(), a.output)
        print(json.dumps({"anchors": out.ordered.anchors, "threshold": out.ordered.threshold, "log": [vars(x) for x in out.ordered.log], "losses": out.losses}))
    elif a.command == "gold-kernels":
        sinks.write_anchors(spark, evaluation.gold_kernels(text.read_grammar(spark, a.input)), a.output, as_json=True)
    elif a.command == "exact-kernels":
        found = targets.anchors(text.read_grammar(spark, a.input), text.read_clusters(spark, a.clusters), a.n_clusters, a.number)
        sinks.write_anchors(spark, [w for w, _ in found], a.output, as_json=True)
    elif a.command == "compare-methods":
        s = experiments.Settings(sentences=a.sentences, corpus_seed=a.seed, n_clusters=a.n_clusters, min_count=a.min_count, number=a.number, max_length=a.max_length)
        experiments.compared(text.read_grammar(spark, a.input), s, tuple(json.loads(a.methods)) if a.methods else experiments.METHODS).write.json(a.output)
    elif a.command == "lexicon-growth":
        diagnosis.lexicon_growth(text.read_grammar(spark, a.input), json.loads(a.sizes), a.n, a.seed, a.candidates, a.alpha).write.json(a.output)
    elif a.command == "evaluate-kernels":
        print(json.dumps(evaluation.kernel_scores(text.read_grammar(spark, a.input), json.loads(a.kernels))))
    elif a.command == "inspect":
        print(json.dumps(G.lexical_posteriors(text.read_grammar(spark, a.input), a.word)))
    elif a.command == "terminals":
        G.lexical(text.read_grammar(spark, a.input)).select(F.col("r1").alias("value")).distinct().orderBy("value").coalesce(1).write.text(a.output)
    elif a.command == "count":
        g = text.read_grammar(spark, a.input)
        print(json.dumps({"nonterminals": len(G.nonterminals(g)), "terminals": G.lexical(g).select("r1").distinct().count()}))
    elif a.command == "unkify":
        words = _corpus(spark, a.corpus)
        frequent = T.word_counts(words).where(F.col("n") >= a.min_count).select("word")
        sinks.write_grammar(G.unkify(text.read_grammar(spark, a.input), frequent), a.output)
    elif a.command == "smooth":
        g = text.read_grammar(spark, a.input)
        sinks.write_grammar(G.smoothed(g, G.lexical(text.read_grammar(spark, a.grammar)).select(F.col("r1").alias("word")), a.epsilon), a.output)
    elif a.command == "relabel":
        target, own = text.read_grammar(spark, a.grammar), text.read_grammar(spark, a.input)
        read = trees.read_trees(sampling.sample_trees(target, a.n, a.seed).where("tree is not null"), "tree").where("nodes is not null")
        pairs = [(b, x) for x, b in evaluation.bijection_by_parses(target, own, read).items()]
        sinks.write_grammar(G.relabel(own, spark.createDataFrame(pairs, "old string, new string")).select(*G.RULE, "p"), a.output)
    elif a.command == "simplify-trees":
        simple = F.udf(trees.simplified, "string")  # a line at a time; conversion is no hot path
        spark.read.text(a.input).select(simple("value").alias("value")).write.text(a.output)
    elif a.command == "random-grammar":
        sinks.write_grammar(sampling.random_grammar(spark, a.nonterminals, a.terminals, a.seed), a.output)
    elif a.command == "sgd":
        fitted = training.minibatch_em(text.read_grammar(spark, a.grammar), text.read_corpus(spark, a.input), a.batches, a.step, a.max_length, a.update)
        sinks.write_grammar(fitted, a.output)
    elif a.command == "compare":
        target, own = text.read_grammar(spark, a.input), text.read_grammar(spark, a.grammar)
        scored = sampling.scored_samples(target, a.n, a.seed, a.max_length, models={"own": own})
        out = {r["kind"]: {"kl": r["kl"], "failures": r["failures"]} for r in evaluation.sampled_divergences(scored, ["own"]).collect()}
        print(json.dumps(out | {"length": G.length_kl(target, own, a.max_length)}))
    elif a.command == "train-lm":
        s = _corpus(spark, a.input)
        v = T.special_vocabulary(T.word_counts(s), a.min_count).persist()
        model, history = gap_learner.train_together(recurrent.LanguageModel, T.encoded(s, v), v.count(), a.epochs)
        model.save(a.output)
        v.write.parquet(a.output + ".vocabulary")
        print(json.dumps({"losses": history}))
    elif a.command == "evaluate-lm":
        scored = recurrent.score(T.encoded(_corpus(spark, a.input), spark.read.parquet(a.model + ".vocabulary")), recurrent.LanguageModel.load(a.model))
        print(json.dumps({"perplexity": recurrent.perplexity(scored)}))
    elif a.command == "train-general":
        g = text.read_general_grammar(spark, a.grammar, a.bias).select("lhs", "rhs", F.col("weight").alias("p"))
        s = text.read_weighted_yields(spark, a.input).select(F.monotonically_increasing_id().alias("sid"), "w", "weight")
        if a.factor:
            fit = general.entropic(g, s, a.factor, a.rounds, a.start, a.prune, a.tolerance, max_length=a.max_length)
        else:
            fit = general.em(g, s, a.rounds, a.start, a.least_rounds, a.tolerance, a.prune, a.bias, a.variational, a.jitter, (a.hot, a.cold, a.anneal), a.max_length, a.seed)
        sinks.write_general_grammar(fit.rules, a.output)
        print(json.dumps({"objective": fit.objective, "bits": fit.bits}))
    elif a.command in ("binarise-trees", "unbinarise-trees"):
        side = getattr(a, "side", None)
        change = (lambda t: nary.binarised(nary.collapsed(t), side)) if side else nary.unbinarised
        nary.mapped(spark.read.text(a.input), change).where("value IS NOT NULL").write.text(a.output)
    elif a.command == "grid":
        results = experiments.run_grid(spark, experiments.grid(**json.load(open(a.input, encoding="utf-8"))))
        results.write.parquet(a.output)
        print("\n".join(experiments.summary(spark.read.parquet(a.output), "nonterminals", "sentences", "mode").orderBy("nonterminals", "sentences", "mode").toJSON().collect()))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="spanwright")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ngrams", "to-preterminal", "from-preterminal", "normalise", "treebank", "yields", "sample", "em", "evaluate", "score"):
        s = sub.add_parser(name)
        s.add_argument("input")
        if name != "evaluate":
            s.add_argument("output")
        if name in ("em", "evaluate", "score"):
            s.add_argument("--grammar", required=True)
        if name == "ngrams":
            s.add_argument("--n", type=int, default=2, choices=(2, 3))
        if name == "sample":
            s.add_argument("--n", type=int, default=1000)
            s.add_argument("--seed", type=int, default=1)
            s.add_argument("--trees", action="store_true")
        if name == "em":
            s.add_argument("--rounds", type=int, default=5)
            s.add_argument("--max-length", type=int, default=10)
    for name, files, options in MORE:
        s = sub.add_parser(name)
        for f in files.split():
            s.add_argument(f)
        for o, kind, default in options:
            if kind is bool:
                s.add_argument(f"--{o}", action="store_true")
            else:
                s.add_argument(f"--{o}", type=kind, default=default, required=default is ...)
    run(SparkSession.builder.appName("spanwright").getOrCreate(), p.parse_args(argv))


if __name__ == "__main__":
    main()
