"""Queries over an ambiguous grammar that Spark derives from the events, and over grammars learned from the word corpus.

The ambiguous grammar: event types fall into classes X and Y by the rank of their counts, but every type may come from both;
pairs of classes have the weights of neighbouring events. The start S makes pairs only, X and Y words or pairs, so a sentence has
as many trees as shapes, each with many labellings.
"""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanwright.operators import charts as C
from spanwright.operators import grammar as G
from spanwright.operators import induction as I
from spanwright.operators import evaluation as V
from spanwright.operators import clustering, gap_learner, sampling, training, trees, word_rows
from spanwright.operators import tokens as T
from spanwright.operators.lineage import cut
from spanwright.plans import corpus_queries as W
from spanwright.plans import grammar_queries as E
from spanwright.plans import model_queries as M

SHARE, KERNELS, SAMPLES = 0.4, 4, 200


def classes(spark, sf):
    """(word, n, odd): event types with counts, and the parity of their rank."""
    n = E._t(spark, sf, "events").groupBy(F.col("event_type").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("odd", F.row_number().over(Window.orderBy(F.desc("n"), "word")) % 2)  # a row for each type


def ambiguous(spark, sf):
    """(lhs, r1, r2, p)."""
    k = classes(spark, sf)
    nts = spark.createDataFrame([("X", 1), ("Y", 0)], "lhs string, own int")
    lex = k.crossJoin(nts).select("lhs", F.col("word").alias("r1"), F.lit(None).cast("string").alias("r2"), (F.col("n") * F.when(F.col("odd") == F.col("own"), 3.0).otherwise(1.0)).alias("w"))
    of = lambda c, out: F.broadcast(k.select(F.col("word").alias(c), F.when(F.col("odd") == 1, "X").otherwise("Y").alias(out)))
    bi = T.inner_bigrams(E.sents(spark, sf)).join(of("w1", "r1"), "w1").join(of("w2", "r2"), "w2").groupBy("r1", "r2").agg(F.sum("n").alias("n"))
    lefts = spark.createDataFrame([("S",), ("X",), ("Y",)], "lhs string")
    two = bi.crossJoin(lefts).select("lhs", "r1", "r2", (F.col("n") * F.when(F.col("lhs") == F.col("r1"), 2.0).otherwise(1.0)).alias("w"))
    share = F.when(F.col("r2").isNull(), 1 - SHARE).when(F.col("lhs") == "S", 1.0).otherwise(SHARE)
    both = lex.unionByName(two)
    return both.select(*G.RULE, (share * F.col("w") / F.sum("w").over(Window.partitionBy("lhs", F.col("r2").isNull()))).alias("p"))


def _less(rules):
    """Nine tenths of every weight: a weighted grammar whose trees don't sum to one."""
    return rules.withColumn("p", F.col("p") * 0.9)


def _sents(spark, sf):
    return E.sents(spark, sf)


def expected(spark, sf):
    return E._r(C.expected_counts(_sents(spark, sf), C.chart_of(ambiguous(spark, sf))).where("lhs is not null"), "n", digits=6)


def shapes(spark, sf):
    """All labellings of the right-branching shape of every sentence of two words or more."""
    x = M.read_treebank(spark, sf).select("user_id", "chunk", "nodes")
    return C.bracketed_scores(x, C.chart_of(ambiguous(spark, sf))).select("user_id", "chunk", F.round("lp", 9).alias("lp"), F.round("best.lp", 9).alias("best"))


def derivations(spark, sf):
    """Log probability of every tree of the treebank under the grammar of the even users' trees."""
    w = E.leaves(spark, sf).withColumn("next", F.lead("pre").over(Window.partitionBy("user_id", "chunk").orderBy("pos")))
    lex = w.select("user_id", "chunk", F.col("pre").alias("lhs"), F.col("word").alias("r1"), F.lit(None).cast("string").alias("r2"))
    v = lambda p: F.concat(F.lit("V"), (p % 2).cast("string"))
    two = w.where(F.col("pos") < F.col("n") - 1).select("user_id", "chunk", F.when(F.col("pos") == 0, F.lit("S")).otherwise(v(F.col("pos"))).alias("lhs"), F.col("pre").alias("r1"), F.when(F.col("pos") == F.col("n") - 2, F.col("next")).otherwise(v(F.col("pos") + 1)).alias("r2"))
    return E._r(G.derivation_scores(lex.unionByName(two), E._half(spark, sf, 0).select(*G.RULE, "p"), ["user_id", "chunk"]), "lp")


def scores(spark, sf):
    return E._r(G.all_scores(_less(ambiguous(spark, sf))), "inside", "outside", "io", digits=6)


def rare_word(spark, sf):
    return classes(spark, sf).orderBy("n", F.desc("word")).first()["word"]


def contains(spark, sf):
    """Probability that a string has the rarest word, by the grammar of the strings that hold it."""
    g = ambiguous(spark, sf)
    z = G.partition_function(G.containing(g, rare_word(spark, sf)))
    return spark.createDataFrame([(round(z["Sx01"], 6),)], "p double")


def lengths(spark, sf):
    return spark.createDataFrame([(n, round(p, 9)) for n, p in G.length_distribution(ambiguous(spark, sf), E.LENGTH)], "len int, p double")


def em_ambiguous(spark, sf):
    fitted, _ = training.em(ambiguous(spark, sf), _sents(spark, sf), rounds=1, max_length=E.LENGTH)
    return E._r(fitted, "p", digits=6)


def words_below(spark, sf):
    return E._r(G.expected_words(ambiguous(spark, sf)), "e", digits=6)


def bottom_up(spark, sf):
    counts, n, _ = training.e_step(ambiguous(spark, sf), _sents(spark, sf))
    return E._r(G.bottom_up_step(ambiguous(spark, sf), counts, n), "p", digits=6)


def samples(spark, sf):
    """Samples of the ambiguous grammar, scored by it and by a flattened one, compared."""
    g = ambiguous(spark, sf)
    flat = G.normalised(g.withColumn("p", F.sqrt("p")))
    n = max(SAMPLES, _sents(spark, sf).count())
    return V.sampled_divergences(sampling.scored_samples(g, n, 1, 20, models={"flat": flat}), ["flat"]).withColumn("kl", F.round("kl", 6))


def parses(spark, sf):
    """Best trees of the ambiguous grammar against those of a flattened one over all sentences."""
    g = ambiguous(spark, sf)
    flat = G.normalised(g.withColumn("p", F.sqrt("p")))
    read = lambda c: trees.read_trees(C.viterbi(_sents(spark, sf), C.chart_of(c)).where("best is not null").select("user_id", "chunk", F.col("best.tree").alias("value")))
    return V.parse_scores(read(g), read(flat), ["user_id", "chunk"])


def _corpus(spark, sf):
    s = W._sents(spark, sf)
    b = T.bigram_counts(s)
    counts = T.counts_of(b)
    return s, counts, W._clusters(counts), T.marginal_features(b, W._clusters(counts), W.N_CLUSTERS), b


def _given(spark, sf, counts=None):
    return [I.START, *(r["word"] for r in W._top(spark, sf, KERNELS, counts).collect())]


def pair_features(spark, sf):
    s, _, clusters, _, _ = _corpus(spark, sf)
    return I.pair_features(s, I.kernel_map(spark, _given(spark, sf)), clusters, W.N_CLUSTERS)


def binary_xi(spark, sf):
    s, _, clusters, features, _ = _corpus(spark, sf)
    k = _given(spark, sf)
    pairs = cut(I.pair_features(s, I.kernel_map(spark, k), clusters, W.N_CLUSTERS))
    return E._r(I.binary_renyi(features, pairs, k, s.count(), W.N_CLUSTERS), "xi")


def find_kernels(spark, sf):
    s = W._sents(spark, sf)
    b = cut(T.bigram_counts(s))  # every candidate's test reads the anchors' neighbours
    counts = cut(T.counts_of(b))
    clusters = cut(W.exchanged(b, counts))
    rare = clusters.where(F.col("word") == clustering.UNKNOWN).first()["cid"]
    often = counts.where(F.col("n") >= M.MIN_ROWS).select("word")
    rows = word_rows.marginal_rows(s, clusters, counts, W.N_CLUSTERS, unknown=rare).join(often, "word", "left_semi")
    features = cut(rows.select("word", F.inline(F.arrays_zip(F.col("at").alias("feature"), F.col("n").alias("value")))))
    found = I.find_kernels(features, T.word_contexts(b, often), 2 * (W.N_CLUSTERS + 1), I.start_vector(W.N_CLUSTERS + 1), replicates=200)
    return spark.createDataFrame([(k, w, None if d == float("inf") else round(d, 6), found.reason) for k, (w, d) in enumerate(zip(found.words, found.distances, strict=True))], "rank int, word string, distance double, reason string")


def neural(spark, sf):
    """The grammar of recurrent gap models over the events' sentences, whose every type is a candidate. Digits are few, as sums of floats differ in their last ones."""
    learned = gap_learner.learn(_sents(spark, sf), rounds=3, embed=16, hidden=24)
    return E._r(learned.pcfg(), "p", digits=4)


def _learned(spark, sf):
    s = W._sents(spark, sf)
    counts, n = T.counted(s)
    return I.learn(s, W._clusters(counts), W.N_CLUSTERS, kernels=_given(spark, sf, counts), counted=(counts, n))


QUERIES = {
    "ambiguous_rules": lambda sp, sf: E._r(ambiguous(sp, sf), "p"),
    "ambiguous_inside": lambda sp, sf: C.inside_log_probability(_sents(sp, sf), C.chart_of(ambiguous(sp, sf))).select("user_id", "chunk", F.round("lp", 9).alias("lp")),
    "ambiguous_viterbi": lambda sp, sf: C.viterbi(_sents(sp, sf), C.chart_of(ambiguous(sp, sf))).select("user_id", "chunk", F.round("best.lp", 9).alias("lp")),
    "ambiguous_parse_counts": lambda sp, sf: C.tree_counts(_sents(sp, sf), C.chart_of(ambiguous(sp, sf))).select("user_id", "chunk", F.col("n_trees").cast("long").alias("n_trees")),
    "ambiguous_rule_counts": expected,
    "ambiguous_em_round": em_ambiguous,
    "bracketed_scores": shapes,
    "derivation_scores": derivations,
    "grammar_scores": scores,
    "containing_word": contains,
    "ambiguous_lengths": lengths,
    "expected_words": words_below,
    "bottom_up_step": bottom_up,
    "lexically_scaled": lambda sp, sf: E._r(G.lexically_scaled(ambiguous(sp, sf)), "p"),
    "sampled_divergences": samples,
    "parse_scores": parses,
    "pair_features": pair_features,
    "binary_xi_renyi": binary_xi,
    "find_kernels": find_kernels,
    "raw_wcfg": lambda sp, sf: E._r(_learned(sp, sf).wcfg, "p", digits=9),
    "neural_learned_pcfg": neural,
    "learned_pcfg": lambda sp, sf: E._r(_learned(sp, sf).pcfg(), "p", digits=9),
}

# the ambiguous grammar stands where the treebank's stood, so the charts' statements serve both
AMB = f"""
ev AS (SELECT user_id, event_id, event_type AS word, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
lv0 AS (SELECT user_id, k // {E.LENGTH} AS chunk, k % {E.LENGTH} AS pos, word FROM ev),
cls AS (SELECT event_type AS word, count(*) AS n, CASE WHEN row_number() OVER (ORDER BY count(*) DESC, event_type) % 2 = 1 THEN 'X' ELSE 'Y' END AS c FROM events GROUP BY event_type),
nxt AS (SELECT word AS w1, lead(word) OVER (PARTITION BY user_id, chunk ORDER BY pos) AS w2 FROM lv0),
bi AS (SELECT a.c AS r1, b.c AS r2, count(*) AS n FROM nxt JOIN cls a ON a.word = w1 JOIN cls b ON b.word = w2 GROUP BY ALL),
ww AS (SELECT nt AS lhs, word AS r1, NULL::VARCHAR AS r2, n * CASE WHEN c = nt THEN 3.0::DOUBLE ELSE 1 END AS w FROM cls, (VALUES ('X'), ('Y')) t(nt)
  UNION ALL SELECT nt, r1, r2, n * CASE WHEN nt = r1 THEN 2.0::DOUBLE ELSE 1 END FROM bi, (VALUES ('S'), ('X'), ('Y')) t(nt)),
g AS (SELECT lhs, r1, r2, CASE WHEN r2 IS NULL THEN {1 - SHARE}::DOUBLE WHEN lhs = 'S' THEN 1 ELSE {SHARE}::DOUBLE END * w / sum(w) OVER (PARTITION BY lhs, r2 IS NULL) AS p FROM ww)"""


def _q(body: str, extra: str = "") -> str:
    return f"WITH {AMB}{extra} {body}"


def _inside_outside() -> str:
    """Insides c1 .. cL as the charts have them, outsides o1 .. oL from the widest on, and the rules' expected uses."""
    n, out = E.LENGTH, E._chart("sum(v)", "", "x.v * y.v * g.p", "p")
    out += ", z AS (SELECT sn.user_id, sn.chunk, sn.n, v AS z FROM sn JOIN tops ON tops.user_id = sn.user_id AND tops.chunk = sn.chunk AND tops.n = sn.n WHERE v > 0)"
    for w in range(n, 0, -1):
        parts = [f"SELECT user_id, chunk, 0 AS i, {w} AS j, 'S' AS a, 1.0::DOUBLE AS v FROM z WHERE n = {w}"]
        for wide in range(w + 1, n + 1):
            k = wide - w
            parts.append(f"SELECT o.user_id, o.chunk, o.i, o.i + {w}, g.r1, o.v * g.p * s.v FROM o{wide} o JOIN g ON g.lhs = o.a AND g.r2 IS NOT NULL JOIN c{k} s ON s.user_id = o.user_id AND s.chunk = o.chunk AND s.i = o.i + {w} AND s.a = g.r2")
            parts.append(f"SELECT o.user_id, o.chunk, o.j - {w}, o.j, g.r2, o.v * g.p * s.v FROM o{wide} o JOIN g ON g.lhs = o.a AND g.r2 IS NOT NULL JOIN c{k} s ON s.user_id = o.user_id AND s.chunk = o.chunk AND s.i = o.i AND s.a = g.r1")
        out += f", o{w} AS (SELECT user_id, chunk, i, j, a, sum(v) AS v FROM ({' UNION ALL '.join(parts)}) GROUP BY user_id, chunk, i, j, a)"
    uses = ["SELECT g.lhs, g.r1, g.r2, o.v * g.p / z.z AS n FROM o1 o JOIN sx ON sx.user_id = o.user_id AND sx.chunk = o.chunk AND sx.i = o.i JOIN g ON g.lhs = o.a AND g.r1 = sx.word AND g.r2 IS NULL JOIN z ON z.user_id = o.user_id AND z.chunk = o.chunk"]
    for w in range(2, n + 1):
        uses += [f"SELECT g.lhs, g.r1, g.r2, o.v * g.p * x.v * y.v / z.z FROM o{w} o JOIN g ON g.lhs = o.a JOIN c{k} x ON x.user_id = o.user_id AND x.chunk = o.chunk AND x.i = o.i AND x.a = g.r1 JOIN c{w - k} y ON y.user_id = o.user_id AND y.chunk = o.chunk AND y.i = x.j AND y.a = g.r2 JOIN z ON z.user_id = o.user_id AND z.chunk = o.chunk" for k in range(1, w)]
    return out + f", uses AS (SELECT lhs, r1, r2, sum(n) AS n FROM ({' UNION ALL '.join(uses)}) GROUP BY ALL)"


def _steps(scale: str, drop: str = "") -> str:
    """Fixed-point steps of the insides of X and Y and of the outsides, weights times ``scale`` and without a word."""
    b = lambda a, x, y: f"(SELECT {scale} * p FROM g WHERE lhs = '{a}' AND r1 = '{x}' AND r2 = '{y}')"
    lex = lambda a: f"(SELECT {scale} * coalesce(sum(p), 0) FROM g WHERE lhs = '{a}' AND r2 IS NULL{drop})"
    names = [f"{a}{x}{y}" for a in "SXY" for x in "XY" for y in "XY"]
    co = ", ".join(f"{b(*n)} AS b{n}" for n in names)
    step = lambda a: f"l{a} + bXX".replace("bXX", f"b{a}XX * x * x + (b{a}XY + b{a}YX) * x * y + b{a}YY * y * y")
    # what stands around X: as a left or as a right child of A, beside the other child's inside
    around = lambda c: " + ".join(f"{o} * (b{a}{c}X * x + b{a}{c}Y * y + b{a}X{c} * x + b{a}Y{c} * y)" for a, o in (("S", "1"), ("X", "u"), ("Y", "v")))
    return f""", co AS MATERIALIZED (SELECT {lex('X')} AS lX, {lex('Y')} AS lY, {co}),
it AS (WITH RECURSIVE r(k, x, y, u, v) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT k + 1, {step('X')}, {step('Y')}, {around('X')}, {around('Y')} FROM r, co WHERE k < 400) SELECT * FROM r WHERE k = 400),
zz AS (SELECT x, y, u, v, bSXX * x * x + (bSXY + bSYX) * x * y + bSYY * y * y AS s FROM it, co)"""


def _right(agg: str, times: str, leaf: str) -> str:
    """Suffixes of every sentence under the right-branching shape."""
    out = f", sx AS (SELECT user_id, chunk, pos AS i, word, count(*) OVER (PARTITION BY user_id, chunk) AS n FROM lv0), lf AS (SELECT user_id, chunk, i, n, lhs AS a, {leaf} AS v FROM sx JOIN g ON r1 = word AND r2 IS NULL), d1 AS (SELECT * FROM lf WHERE i = n - 1)"
    for w in range(2, E.LENGTH + 1):
        out += f", d{w} AS (SELECT l.user_id, l.chunk, l.i, l.n, g.lhs AS a, {agg.replace('v', times, 1)} AS v FROM lf l JOIN d{w - 1} r ON r.user_id = l.user_id AND r.chunk = l.chunk AND r.i = l.i + 1 JOIN g ON g.r1 = l.a AND g.r2 = r.a GROUP BY ALL)"
    return out + ", dd AS (" + " UNION ALL ".join(f"SELECT user_id, chunk, v FROM d{w} WHERE i = 0 AND a = 'S'" for w in range(2, E.LENGTH + 1)) + ")"


def _tops(column: str) -> str:
    return f"SELECT sn.user_id, sn.chunk, {column} FROM sn LEFT JOIN tops ON tops.user_id = sn.user_id AND tops.chunk = sn.chunk AND tops.n = sn.n"


def _kept(body: str, extra: str) -> str:
    """A query over the treebank's grammar, each of whose tables is computed once."""
    return re.sub(r"\b(mle|g|lv0|lv|sx|z|c\d|o\d|l\d) AS \((?!VALUES)", r"\1 AS MATERIALIZED (", E._q(body, extra))


_IO = _inside_outside()
_LEN = ", l1 AS (SELECT lhs AS a, sum(p) AS v FROM g WHERE r2 IS NULL GROUP BY lhs)" + "".join(
    f", l{w} AS (SELECT a, sum(v) AS v FROM ({' UNION ALL '.join(f'SELECT g.lhs AS a, p * x.v * y.v AS v FROM g JOIN l{k} x ON x.a = g.r1 JOIN l{w - k} y ON y.a = g.r2' for k in range(1, w))}) GROUP BY a)" for w in range(2, E.LENGTH + 1))
_LENGTHS = "SELECT w::INTEGER AS len, round(coalesce(v, 0), 9) AS p FROM (VALUES " + ", ".join(f"({w})" for w in range(1, E.LENGTH + 1)) + ") t(w) LEFT JOIN (" + " UNION ALL ".join(f"SELECT {w} AS k, v FROM l{w} WHERE a = 'S'" for w in range(1, E.LENGTH + 1)) + ") ON k = w"
_PAIRS = f""", kr AS (SELECT word FROM cnt ORDER BY n DESC, word LIMIT {KERNELS}), qd AS (SELECT unnest(list_zip(p[:-4], p[2:-3], p[3:-2], p[4:])) AS q FROM padded WHERE len(w) > 1),
qc AS (SELECT q[2] AS b, q[3] AS c, q[1] AS l, q[4] AS r, count(*) AS n FROM qd WHERE q[2] IN (SELECT word FROM kr) AND q[3] IN (SELECT word FROM kr) GROUP BY ALL),
pf AS MATERIALIZED (SELECT b, c, feature, sum(n)::BIGINT AS value FROM (SELECT b, c, coalesce(cid, 0) AS feature, n FROM qc LEFT JOIN cl ON cl.word = l UNION ALL SELECT b, c, coalesce(cid, 0) + {W.N_CLUSTERS + 1}, n FROM qc LEFT JOIN cl ON cl.word = r) GROUP BY ALL)"""
_ST = W.N_CLUSTERS + 1
# (nt, a, e): expected uses of a below nt
UZ = (
    ", kid AS MATERIALIZED (SELECT lhs AS a, c, sum(p) AS m FROM (SELECT lhs, r1 AS c, p FROM g WHERE r2 IS NOT NULL UNION ALL SELECT lhs, r2, p FROM g WHERE r2 IS NOT NULL) GROUP BY ALL), tm AS MATERIALIZED (SELECT "
    + ", ".join(f"coalesce((SELECT m FROM kid WHERE a = '{a}' AND c = '{c}'), 0) AS m{a}{c}" for a in "SXY" for c in "XY")
    + "), iv AS (SELECT *, (1 - mXX) * (1 - mYY) - mXY * mYX AS det FROM tm), uz AS (SELECT 'X' AS nt, 'X' AS a, (1 - mYY) / det AS e FROM iv UNION ALL SELECT 'X', 'Y', mXY / det FROM iv UNION ALL SELECT 'Y', 'X', mYX / det FROM iv UNION ALL SELECT 'Y', 'Y', (1 - mXX) / det FROM iv "
    "UNION ALL SELECT 'S', 'X', (mSX * (1 - mYY) + mSY * mYX) / det FROM iv UNION ALL SELECT 'S', 'Y', (mSX * mXY + mSY * (1 - mXX)) / det FROM iv)"
)
ORACLES = {
    # the treebank's grammar under the same statements
    "expected_rule_counts": _kept("SELECT lhs, r1, r2, round(n, 6) AS n FROM uses UNION ALL SELECT NULL, 'sentences', NULL, count(*) FROM z UNION ALL SELECT NULL, 'log_probability', NULL, round(sum(ln(z)), 6) FROM z", _IO),
    "em_round": _kept("SELECT lhs, r1, r2, round(n / sum(n) OVER (PARTITION BY lhs), 6) AS p FROM uses WHERE n > 0", _IO),
    "length_distribution": _kept(_LENGTHS, _LEN),
    "ambiguous_rules": _q("SELECT lhs, r1, r2, round(p, 9) AS p FROM g"),
    "ambiguous_inside": _q(_tops("round(ln(v), 9) AS lp"), E._chart("sum(v)", "", "x.v * y.v * g.p", "p")),
    "ambiguous_viterbi": _q(_tops("round(v, 9) AS lp"), E._chart("max(v)", "", "x.v + y.v + ln(g.p)", "ln(p)")),
    "ambiguous_parse_counts": _q(_tops("coalesce(v, 0)::BIGINT AS n_trees"), E._chart("sum(v)", "", "x.v * y.v", "1")),
    "ambiguous_rule_counts": _q("SELECT lhs, r1, r2, round(n, 6) AS n FROM uses", _IO),
    "ambiguous_em_round": _q("SELECT lhs, r1, r2, round(n / sum(n) OVER (PARTITION BY lhs), 6) AS p FROM uses", _IO),
    "bottom_up_step": _q(
        "SELECT g.lhs, g.r1, g.r2, round(CASE WHEN g.r2 IS NULL THEN g.p ELSE coalesce(u.n, 0) / t.n / (b.e * c.e) END, 6) AS p FROM g LEFT JOIN uses u ON u.lhs = g.lhs AND u.r1 = g.r1 AND u.r2 IS NOT DISTINCT FROM g.r2 LEFT JOIN ee b ON b.a = g.r1 LEFT JOIN ee c ON c.a = g.r2, t",
        _IO + ", t AS (SELECT count(*)::DOUBLE AS n FROM z), ee AS (SELECT lhs AS a, sum(uses.n) / max(t.n) AS e FROM uses, t GROUP BY lhs)"),
    "bracketed_scores": _q("SELECT user_id, chunk, round(ln(x.v), 9) AS lp, round(y.v, 9) AS best FROM dd x JOIN best y USING (user_id, chunk)", _right("sum(v)", "l.v * r.v * g.p", "p") + ", best AS (WITH " + _right("max(v)", "l.v + r.v + ln(g.p)", "ln(p)")[2:] + " SELECT * FROM dd)"),
    "derivation_scores": f"WITH {E.TB}{E.HALF}, pr2 AS (SELECT user_id, chunk, pre AS lhs, word AS r1, NULL::VARCHAR AS r2 FROM lv UNION ALL SELECT user_id, chunk, CASE WHEN pos = 0 THEN 'S' ELSE 'V' || (pos % 2) END, pre, CASE WHEN pos = n - 2 THEN nx ELSE 'V' || ((pos + 1) % 2) END FROM lv WHERE pos < n - 1) "
    "SELECT user_id, chunk, CASE WHEN bool_or(p IS NULL) THEN NULL ELSE round(sum(ln(p)), 9) END AS lp FROM pr2 LEFT JOIN h0 ON h0.lhs = pr2.lhs AND h0.r1 = pr2.r1 AND h0.r2 IS NOT DISTINCT FROM pr2.r2 GROUP BY ALL",
    "grammar_scores": _q("SELECT nt, round(a, 6) AS inside, round(b, 6) AS outside, round(a * b, 6) AS io FROM (SELECT 'S' AS nt, s AS a, 1.0::DOUBLE AS b FROM zz UNION ALL SELECT 'X', x, u FROM zz UNION ALL SELECT 'Y', y, v FROM zz)", _steps("0.9::DOUBLE")),
    "containing_word": _q("SELECT round(1 - s, 6) AS p FROM zz", _steps("1.0::DOUBLE", " AND r1 <> (SELECT word FROM cls ORDER BY n, word DESC LIMIT 1)")),
    "ambiguous_lengths": _q(_LENGTHS, _LEN),
    "expected_words": _q(
        "SELECT nt, r1 AS word, round(sum(e * p), 6) AS e FROM uz JOIN g ON g.lhs = a AND r2 IS NULL WHERE e > 0 GROUP BY ALL",
        UZ),
    "lexically_scaled": _q("SELECT lhs, r1, r2, round(CASE WHEN r2 IS NULL THEN p / (8 * w * b * l) ELSE p END, 9) AS p FROM g, (SELECT count(DISTINCT r1) FILTER (r2 IS NULL) AS w, max(p) FILTER (r2 IS NOT NULL) AS b, max(p) FILTER (r2 IS NULL) AS l FROM g)"),
    "pair_features": f"WITH {W.SENT}{W.CL}{_PAIRS} SELECT * FROM pf",
    "binary_xi_renyi": f"""WITH {W.SENT}{W.BI}{W.CL}{W.MARG}{_PAIRS}, ow AS (SELECT word AS a, feature, value::DOUBLE AS value FROM marg WHERE word IN (SELECT word FROM kr) UNION ALL SELECT 'S', f, 1 FROM (VALUES (0), ({_ST})) t(f)),
xs AS (SELECT a, feature, feature >= {_ST} AS side, value / sum(value) OVER (PARTITION BY a, feature >= {_ST}) AS x FROM ow), ms AS (SELECT b, c, sum(value)::DOUBLE AS t FROM pf WHERE feature < {_ST} GROUP BY ALL), tb AS (SELECT b, sum(t) AS tb FROM ms GROUP BY b), tc AS (SELECT c, sum(t) AS tc FROM ms GROUP BY c),
dv AS (SELECT a, ms.b, ms.c, side, ln(sum(x * (x / ((coalesce(value, 0) + 1) / (t + {_ST}))) ** 4)) / 4 AS d FROM xs CROSS JOIN ms LEFT JOIN pf ON pf.b = ms.b AND pf.c = ms.c AND pf.feature = xs.feature GROUP BY ALL),
dm AS (SELECT a, b, c, max(d) AS d FROM dv GROUP BY ALL) SELECT a, dm.b, dm.c, round(exp(-d) * t * total / (tb * tc), 9) AS xi FROM dm JOIN ms ON ms.b = dm.b AND ms.c = dm.c JOIN tb ON tb.b = dm.b JOIN tc ON tc.c = dm.c, total""",
}
