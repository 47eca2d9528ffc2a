"""Queries for trees, expectations, training, sampling, geometry and context models, over corpora and grammars from the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanwright.operators import charts as C
from spanwright.operators import bigram_scores, clustering, contextmodels, evaluation, geometry, sampling, training, trees
from spanwright.operators import grammar as G
from spanwright.operators import stats as S
from spanwright.operators import tokens as T
from spanwright.operators.lineage import cut
from spanwright.plans import corpus_queries as W
from spanwright.plans import grammar_queries as E


#: Least count of a word whose row may become an anchor.
MIN_ROWS = 100


def _r(frame, *cols, digits=9):
    return E._r(frame, *cols, digits=digits)


def treebank(spark, sf):
    """(user_id, chunk, n, value): the right-branching trees as bracket text."""
    x = E.leaves(spark, sf)
    leaf = F.concat(F.lit("("), "pre", F.lit(" "), "word", F.lit(")"))
    lhs = F.when(F.col("pos") == 0, F.lit("S")).otherwise(F.concat(F.lit("V"), (F.col("pos") % 2).cast("string")))
    part = F.when(F.col("pos") < F.col("n") - 1, F.concat(F.lit("("), lhs, F.lit(" "), leaf, F.lit(" "))).otherwise(leaf)
    grouped = x.select("user_id", "chunk", "n", F.struct("pos", part.alias("part")).alias("x")).groupBy("user_id", "chunk", "n").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return grouped.select("user_id", "chunk", "n", F.concat(F.array_join(F.transform("x", lambda y: y["part"]), ""), F.repeat(F.lit(")"), (F.col("n") - 1).cast("int"))).alias("value"))


def read_treebank(spark, sf):
    return trees.read_trees(treebank(spark, sf))


def tree_shapes(spark, sf):
    x = read_treebank(spark, sf)
    return x.select("user_id", "chunk", F.array_join(trees.leaf_words(F.col("nodes")), " ").alias("words"), F.size(trees.unlabelled_spans(F.col("nodes"))).cast("long").alias("spans"), F.size(trees.labelled_spans(F.col("nodes"))).cast("long").alias("labelled"))


def nonterminal_expectations(spark, sf):
    return _r(G.expectation_frame(E.rules(spark, sf)), "e", digits=6)


def partition_function(spark, sf):
    z = G.partition_function(E.rules(spark, sf).withColumn("p", F.col("p") * 0.8))
    return spark.createDataFrame(sorted((a, round(v, 6)) for a, v in z.items()), "nt string, z double")


def derivation_entropy(spark, sf):
    h = G.entropies(E.rules(spark, sf)).withColumnRenamed("lhs", "nt").join(E.expectation(spark, sf), "nt")
    return h.agg(F.round(F.sum(F.col("entropy") * F.col("e")), 9).alias("entropy"))


def expected_bigrams(spark, sf):
    """Expected neighbour pairs that are a constituent of two words."""
    r, e = E.rules(spark, sf), E.expectation(spark, sf)
    lex = G.lexical(r).groupBy("lhs").agg(F.sum("p").alias("m"))
    b = G.binary(G.rule_expectations(r, e)).join(lex.select(F.col("lhs").alias("r1"), F.col("m").alias("m1")), "r1").join(lex.select(F.col("lhs").alias("r2"), F.col("m").alias("m2")), "r2")
    return b.agg(F.round(F.sum(F.col("e") * F.col("m1") * F.col("m2")), 9).alias("expected"))


def parseval(spark, sf):
    """Best trees of the treebank's grammar against the treebank: exact matches and common spans."""
    gold = read_treebank(spark, sf).select("user_id", "chunk", F.col("value").alias("gold"), trees.labelled_spans(F.col("nodes")).alias("gold_spans"))
    best = C.viterbi(E.sents(spark, sf), C.chart_of(E.rules(spark, sf))).select("user_id", "chunk", F.col("best.tree").alias("value")).where("value is not null")
    best = trees.read_trees(best).select("user_id", "chunk", "value", trees.labelled_spans(F.col("nodes")).alias("spans"))
    both = gold.join(best, ["user_id", "chunk"])
    common = F.size(F.array_intersect("gold_spans", "spans"))
    return both.agg(F.count(F.lit(1)).alias("trees"), F.sum((F.col("gold") == F.col("value")).cast("long")).alias("exact"), F.sum(common).alias("common"), F.sum(F.size("gold_spans")).alias("spans"))


def label_bijection(spark, sf):
    """Users' event types against preterminals: the one-to-one assignment of the greatest agreement."""
    pairs = E.leaves(spark, sf).groupBy(F.col("pre").alias("a"), F.col("word").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame(sorted(evaluation.best_bijection(pairs).items()), "a string, b string")


def em_round(spark, sf):
    fitted, _ = training.em(E.rules(spark, sf), E.sents(spark, sf), rounds=1, max_length=E.LENGTH)
    return _r(fitted, "p", digits=6)


def minibatch(spark, sf):
    return _r(training.minibatch_em(E.rules(spark, sf), E.sents(spark, sf), 3, 0.3), "p", digits=6)


def sample_trees(spark, sf):
    """As many sampled trees as the corpus has sentences."""
    return sampling.sample_trees(E.rules(spark, sf), E.sents(spark, sf).count(), seed=1)


def row_features(spark, sf):
    """Marginal features of the words whose rows may become anchors, as a checkpoint: the search reads it often, the text and its bigrams once."""
    b = T.bigram_counts(W._sents(spark, sf))
    counts = T.counts_of(b)
    features = T.marginal_features(b, W._clusters(counts), W.N_CLUSTERS)
    return cut(features.join(counts.where(F.col("n") >= MIN_ROWS).select("word"), "word", "left_semi"))


def _rows(spark, sf):
    return cut(geometry.dense_rows(row_features(spark, sf), 2 * (W.N_CLUSTERS + 1)))


def greedy_kernels(spark, sf):
    found = geometry.greedy_anchors(_rows(spark, sf), 5)
    return spark.createDataFrame([(k, w, None if d == float("inf") else round(d, 6)) for k, (w, d) in enumerate(found)], "rank int, word string, distance double")


def _anchors(rows, k=4):
    names = [w for w, _ in geometry.greedy_anchors(rows, k)]
    return {r["word"]: r["v"] for r in rows.where(F.col("word").isin(names)).collect()}


def hull_weights(spark, sf):
    rows = _rows(spark, sf)
    return _r(geometry.hull_table(rows, _anchors(rows)), "weight", "distance", digits=6)


def bootstrap_null(spark, sf):
    """Bootstrap p of the next anchor after four."""
    rows = _rows(spark, sf)
    basis = _anchors(rows)
    word, _ = geometry.furthest(rows, geometry.orthonormal([np.array(v) for v in basis.values()]), list(basis))
    r = rows.where(F.col("word") == word).first()
    m = np.array(list(basis.values()))
    ortho = np.array(geometry.orthonormal(list(m)))
    v = np.array(r["v"])
    p = geometry.bootstrap_p(spark, v, int(r["n"]), m, float(np.linalg.norm(v - ortho.T @ (ortho @ v))))
    return spark.createDataFrame([(word, p)], "word string, p double")


def exchange(spark, sf):
    """Words of ten occurrences or more, from a start by hash, until no single move gains a hundred-thousandth of the objective."""
    counts, clusters = W._vocabulary(spark, sf)
    return clustering.exchange_together(T.bigrams(W._sents(spark, sf)), clusters, W.N_CLUSTERS, 1e-5, counts)


def context_divergences(spark, sf):
    s, top = W._sents(spark, sf), W._top(spark, sf)
    return _r(contextmodels.pair_divergences(s, top), "d")


def lexical_xi_counts(spark, sf):
    s, top = W._sents(spark, sf), W._top(spark, sf)
    d = contextmodels.pair_divergences(s, top)
    return _r(contextmodels.lexical_weights(d, T.expectations(top, T.sentence_count(s))), "xi")


#: Divergence under which a word's contexts lie within another's; share of a word's occurrences from which it stands for sentences.
NEAR, WHOLE = 1.0, 1e-3


def _related(spark, sf):
    return contextmodels.relations(_r(contextmodels.pair_divergences(W._sents(spark, sf), W._top(spark, sf)), "d"), NEAR)


def _decisions(spark, sf):
    """The candidates' list and their relations come to the driver: 300 words."""
    words = W._top(spark, sf)
    alone = T.of_length(W._sents(spark, sf), 1).select("word", F.col("n").alias("m"))
    whole = frozenset(r["word"] for r in words.join(alone, "word").where(F.col("m") / F.col("n") > WHOLE).collect())
    order = [r["word"] for r in words.orderBy(F.desc("n"), "word").collect()]
    related = [(r["a"], r["b"], r["relation"]) for r in _related(spark, sf).where("relation <> '|'").collect()]
    return contextmodels.antichain_log(related, order, whole)


def antichain(spark, sf):
    log = _decisions(spark, sf)
    return spark.createDataFrame(list(enumerate(log[-1]["kept"] if log else [])), "rank int, word string")


def antichain_log(spark, sf):
    rows = [(x["step"], x["word"], x["action"], x["reason"], " ".join(x["replaces"]), len(x["kept"])) for x in _decisions(spark, sf)]
    return spark.createDataFrame(rows, "step int, word string, action string, reason string, replaces string, size int")


def threshold_replay(spark, sf):
    """How many of the frequent words, in order, come before the first whose share of the top count is under each threshold."""
    top = W._top(spark, sf, 200)
    steps = top.withColumn("step", F.row_number().over(Window.orderBy(F.desc("n"), "word"))).crossJoin(F.broadcast(top.agg(F.max("n").alias("most"))))
    grid = F.explode(F.array(*[F.lit(x) for x in (0.5, 0.2, 0.1, 0.05, 0.02)])).alias("threshold")
    return steps.select("step", "n", "most", grid).groupBy("threshold").agg(F.coalesce(F.min(F.when(F.col("n") / F.col("most") < F.col("threshold"), F.col("step"))) - 1, F.max("step")).cast("long").alias("kept"))


def encode_sentences(spark, sf):
    """(doc_id, sno, ids): sentences as vocabulary ids, 0 for rare words."""
    s = W._sents(spark, sf)
    x = T.numbered(s, cut(T.vocabulary(T.word_counts(s), 5)))
    return x.select("doc_id", "sno", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def bigram_model(spark, sf):
    """Add-one bigram log probability of every sentence, the boundary on both sides."""
    s = W._sents(spark, sf)
    return bigram_scores.sentence_scores(s, T.word_counts(s).count() + 1).select("doc_id", "sno", F.round("lp", 6).alias("lp"))


QUERIES = {
    "check_normalisation": lambda sp, sf: _r(G.lhs_sums(E.rules(sp, sf)), "total"),
    "rule_kinds": lambda sp, sf: E.rules(sp, sf).agg(F.count_if(F.col("r2").isNull()).alias("lexical"), F.count_if(F.col("r2").isNotNull()).alias("binary"), F.countDistinct("lhs").alias("nonterminals")),
    "production_expectations": lambda sp, sf: _r(G.rule_expectations(E.rules(sp, sf), E.expectation(sp, sf)), "e"),
    "terminal_expectations": lambda sp, sf: _r(G.terminal_expectations(E.rules(sp, sf), E.expectation(sp, sf)), "e"),
    "nonterminal_expectations": nonterminal_expectations,
    "partition_function": partition_function,
    "derivation_entropy": derivation_entropy,
    "expected_length": lambda sp, sf: G.terminal_expectations(E.rules(sp, sf), E.expectation(sp, sf)).agg(F.round(F.sum("e"), 9).alias("length")),
    "expected_bigrams_constituent": expected_bigrams,
    "treebank_from_text": lambda sp, sf: _r(G.treebank_rules(trees.productions(read_treebank(sp, sf))), "p"),
    "treebank_wcfg": lambda sp, sf: _r(trees.treebank_wcfg(E.productions(sp, sf)).select(*G.RULE, "p"), "p"),
    "tree_shapes": tree_shapes,
    "m_step": lambda sp, sf: _r(training.m_step(G.treebank_rules(E.productions(sp, sf))), "p"),
    "parseval": parseval,
    "label_bijection": label_bijection,
    "em_round": em_round,
    "minibatch_em": minibatch,
    "sample_trees": sample_trees,
    "greedy_kernels": greedy_kernels,
    "hull_weights": hull_weights,
    "bootstrap_null": bootstrap_null,
    "exchange_clusters": exchange,
    "context_divergences": context_divergences,
    "lexical_xi_counts": lexical_xi_counts,
    "anchor_relations": _related,
    "anchor_covers": lambda sp, sf: contextmodels.covers(cut(_related(sp, sf))),
    "antichain": antichain,
    "antichain_log": antichain_log,
    "threshold_replay": threshold_replay,
    "encode_sentences": encode_sentences,
    "bigram_model": bigram_model,
    "good_turing_switch": lambda sp, sf: S.good_turing(W._counts(sp, sf), "switch"),
}

_DIV = f"""{W.TOPQ}, c AS MATERIALIZED (SELECT word, array_to_string([p[i], p[i+2]], ' ') AS ctx, count(*) AS n FROM (SELECT p, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM padded) WHERE word IN (SELECT word FROM top) GROUP BY ALL),
o AS MATERIALIZED (SELECT word, ctx, n / sum(n) OVER (PARTITION BY word) AS wt, n + 0.1::DOUBLE AS s FROM c),
bs AS (SELECT word AS a, sum(wt * s / 0.1::DOUBLE) AS base FROM o GROUP BY word),
xt AS (SELECT x.word AS a, y.word AS b, sum(x.wt * (x.s / y.s - x.s / 0.1::DOUBLE)) AS extra FROM o x JOIN o y USING (ctx) WHERE x.word <> y.word GROUP BY ALL),
dv AS (SELECT ta.word AS a, tb.word AS b, ln((base + coalesce(extra, 0)) * tb.n / ta.n) AS d FROM top ta JOIN top tb ON ta.word <> tb.word JOIN bs ON bs.a = ta.word LEFT JOIN xt ON xt.a = ta.word AND xt.b = tb.word)"""
_REL = f""", wi AS (SELECT a, b, round(d, 9) < {NEAR} AS within FROM dv), rl AS MATERIALIZED (SELECT x.a, x.b, CASE WHEN x.within AND y.within THEN '=' WHEN x.within THEN '<' WHEN y.within THEN '>' ELSE '|' END AS relation FROM wi x JOIN wi y ON x.a = y.b AND x.b = y.a)"""
ORACLES = {
    "check_normalisation": E._q("SELECT lhs, round(sum(p), 9) AS total FROM g GROUP BY lhs"),
    "rule_kinds": E._q("SELECT count(*) FILTER (r2 IS NULL) AS lexical, count(*) FILTER (r2 IS NOT NULL) AS \"binary\", count(DISTINCT lhs) AS nonterminals FROM g"),
    "production_expectations": E._q("SELECT lhs, r1, r2, round(p * e, 9) AS e FROM g JOIN ex ON nt = lhs"),
    "terminal_expectations": E._q("SELECT word, round(sum(e), 9) AS e FROM te GROUP BY word", E.POST),
    "nonterminal_expectations": E._q("SELECT nt, round(e, 6) AS e FROM ex"),
    "partition_function": E._q(
        "SELECT nt, round(z, 6) AS z FROM st120", ", st0 AS (SELECT DISTINCT lhs AS nt, 0.0::DOUBLE AS z FROM g), pg AS (SELECT lhs, r1, r2, 0.8::DOUBLE * p AS p FROM g)"
        + "".join(f", st{k + 1} AS MATERIALIZED (SELECT lhs AS nt, sum(p * coalesce(a.z, CASE WHEN r2 IS NULL THEN 1 ELSE 0 END) * coalesce(b.z, 1)) AS z FROM pg LEFT JOIN st{k} a ON a.nt = pg.r1 AND pg.r2 IS NOT NULL LEFT JOIN st{k} b ON b.nt = pg.r2 GROUP BY lhs)" for k in range(120))),
    "derivation_entropy": E._q("SELECT round(sum(h * e), 9) AS entropy FROM (SELECT lhs, -sum(p * ln(p)) AS h FROM g GROUP BY lhs) JOIN ex ON nt = lhs"),
    "expected_length": E._q("SELECT round(sum(e), 9) AS length FROM te", E.POST),
    "expected_bigrams_constituent": E._q("SELECT round(sum(p * e * a.m * b.m), 9) AS expected FROM g JOIN ex ON nt = lhs JOIN lx a ON a.lhs = r1 JOIN lx b ON b.lhs = r2", ", lx AS (SELECT lhs, sum(p) AS m FROM g WHERE r2 IS NULL GROUP BY lhs)"),
    "treebank_from_text": E.ORACLES["treebank_mle"],
    "treebank_wcfg": E._q(
        "SELECT mle.lhs, mle.r1, mle.r2, round(CASE WHEN mle.r2 IS NULL THEN n / tt::DOUBLE ELSE n * tt::DOUBLE / (a.m * b.m) END, 9) AS p FROM mle LEFT JOIN mm a ON a.lhs = mle.r1 LEFT JOIN mm b ON b.lhs = mle.r2, (SELECT count(*) AS tt FROM prod WHERE lhs = 'S')",
        ", mm AS (SELECT lhs, count(*) AS m FROM prod GROUP BY lhs)"),
    "tree_shapes": E._q("SELECT user_id, chunk, string_agg(word, ' ' ORDER BY pos) AS words, max(n) - 2 AS spans, max(n) - 1 AS labelled FROM lv GROUP BY ALL"),
    "m_step": E._q("SELECT lhs, r1, r2, round(p, 9) AS p FROM g"),
    "context_divergences": f"WITH {W.SENT}{_DIV} SELECT a, b, round(d, 9) AS d FROM dv",
    "lexical_xi_counts": f"WITH {W.SENT}{_DIV} SELECT a, b, round(round(n / total::DOUBLE, 9) * exp(-d), 9) AS xi FROM dv JOIN top ON top.word = b, total",
    "anchor_relations": f"WITH {W.SENT}{_DIV}{_REL} SELECT a, b, relation FROM rl",
    "anchor_covers": f"WITH {W.SENT}{_DIV}{_REL}, ls AS MATERIALIZED (SELECT a, b FROM rl WHERE relation = '<') SELECT a, b FROM ls EXCEPT SELECT x.a, y.b FROM ls x JOIN ls y ON x.b = y.a",
    "threshold_replay": f"""WITH {W.SENT}, tp AS (SELECT n, row_number() OVER (ORDER BY n DESC, word) AS step FROM (SELECT word, n FROM cnt ORDER BY n DESC, word LIMIT 200)), g(threshold) AS (VALUES (0.5::DOUBLE), (0.2), (0.1), (0.05), (0.02))
SELECT threshold, coalesce(min(CASE WHEN n / (SELECT max(n) FROM tp) < threshold THEN step END) - 1, max(step)) AS kept FROM tp, g GROUP BY threshold""",
    "encode_sentences": f"""WITH {W.SENT}, v AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS id FROM cnt WHERE n >= 5)
SELECT doc_id, sno::INTEGER AS sno, string_agg(coalesce(id, 0)::VARCHAR, ' ' ORDER BY pos) AS ids FROM tok LEFT JOIN v USING (word) GROUP BY ALL""",
    "bigram_model": f"""WITH {W.SENT}{W.BI}, l AS (SELECT w1, sum(n) AS m FROM bi GROUP BY w1), z AS (SELECT count(*) + 1 AS v FROM cnt), lg AS (SELECT w1, w2, ln((n + 1) / (m + v)::DOUBLE) AS lp FROM bi JOIN l USING (w1), z),
pp AS (SELECT doc_id, sno, unnest(list_zip(p[:-2], p[2:])) AS b FROM padded) SELECT doc_id, sno::INTEGER AS sno, round(sum(lp), 6) AS lp FROM pp JOIN lg ON w1 = b[1] AND w2 = b[2] GROUP BY ALL""",
}
