"""Queries over the contexts that a grammar gives exactly, and over what lies between words' rows and their true nonterminals.

The grammar is the ambiguous one of ``induction_queries``; every event type is a cluster by itself, numbered by its count.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanwright.operators import diagnosis, evaluation, induction, targets
from spanwright.operators import grammar as G
from spanwright.operators import tokens as T
from spanwright.operators.lineage import cut
from spanwright.plans import grammar_queries as E
from spanwright.plans import induction_queries as Q

SIZES = [50, 100, 200]


def clusters(spark, sf):
    """(word, cid) of every event type, and their number."""
    k = Q.classes(spark, sf)
    ranked = cut(k.select("word", F.row_number().over(Window.orderBy(F.desc("n"), "word")).alias("cid")))  # a row for each type
    return ranked, ranked.count()


def exact_features(spark, sf):
    c, n = clusters(spark, sf)
    return E._r(targets.features(Q.ambiguous(spark, sf), c, n).withColumn("feature", F.col("feature").cast("long")), "value")


def exact_anchors(spark, sf):
    c, n = clusters(spark, sf)
    found = targets.anchors(Q.ambiguous(spark, sf), c, n)
    return spark.createDataFrame([(k, w, round(d, 9)) for k, (w, d) in enumerate(found[1:], 1)], "rank int, word string, distance double")


def labelled(spark, sf):
    """Anchors of the treebank's preterminals."""
    words = targets.labelled_kernels(targets.labelled_posteriors(E.productions(spark, sf)))
    return spark.createDataFrame(list(enumerate(words)), "rank int, word string")


def _diagnosed(spark, sf):
    g = cut(Q.ambiguous(spark, sf))
    c, n = clusters(spark, sf)
    features = cut(T.marginal_features(T.bigram_counts(E.sents(spark, sf)), c, n))
    start, width = induction.start_vector(n + 1), 2 * (n + 1)
    kernels = induction.given_kernels(features, evaluation.gold_kernels(g), width, start)
    posteriors = cut(G.terminal_posteriors(g, G.expectation_frame(g)))
    of = {w: nt for w, nt in zip(kernels.words, ["S", *sorted(a for a in G.nonterminals(g) if a != "S")], strict=True)}
    return diagnosis.diagnosed(features, posteriors, kernels, of, width, start), kernels


def diagnosis_by_feature(spark, sf):
    found, _ = _diagnosed(spark, sf)
    return E._r(diagnosis.by_feature(found).withColumn("feature", F.col("feature").cast("long")), "actual", "predicted", "share")


def diagnosis_words(spark, sf):
    found, _ = _diagnosed(spark, sf)
    return E._r(found.select("word", "n", "nt", "posterior", "l2_true", "kl_true"), "posterior", "l2_true", "kl_true")


def spurious(spark, sf):
    """The words that a search would take next, with their true and their hull's weights."""
    found, kernels = _diagnosed(spark, sf)
    return E._r(diagnosis.spurious(found, kernels).select("rank", "word", "n", "nt", "posterior", "distance", "l2_hull", "l2_true", "kl_true", F.transform("truth", lambda x: F.round(x, 6)).alias("truth"), F.transform("hull", lambda x: F.round(x, 6)).alias("hull")), "posterior", "distance", "l2_hull", "l2_true", "kl_true", digits=6)


def growth(spark, sf):
    """Lexicons of several sizes over the ambiguous grammar's pairs of classes, and as many sampled trees as the events have sentences."""
    n = max(Q.SAMPLES, E.sents(spark, sf).count())
    return E._r(diagnosis.lexicon_growth(Q.ambiguous(spark, sf), SIZES, n, 1, candidates=100), "median", "mean", "sd", "least", "greatest", "p05", "p95", digits=6)


QUERIES = {
    "target_features": exact_features,
    "target_anchors": exact_anchors,
    "labelled_anchors": labelled,
    "anchor_diagnosis": diagnosis_by_feature,
    "anchor_diagnosis_words": diagnosis_words,
    "spurious_anchors": spurious,
    "lexicon_growth": growth,
}

LEX = f"{1 - Q.SHARE}::DOUBLE"


def _corner(name: str, child: str) -> str:
    """(a, c, v): chance that the corner word below a comes from c; (I - T)^-1 of two classes in closed form."""
    mass = ", ".join(f"(SELECT coalesce(sum(p), 0) FROM g WHERE lhs = '{a}' AND {child} = '{c}' AND r2 IS NOT NULL) AS {a}{c}" for a in "SXY" for c in "XY")
    v = {"XX": "1 - YY", "XY": "XY", "YX": "YX", "YY": "1 - XX", "SX": "SX * (1 - YY) + SY * YX", "SY": "SX * XY + SY * (1 - XX)"}
    rows = " UNION ALL ".join(f"SELECT '{k[0]}' AS a, '{k[1]}' AS c, ({e}) / ((1 - XX) * (1 - YY) - XY * YX) * {LEX} AS v FROM {name}m" for k, e in v.items())
    return f", {name}m AS MATERIALIZED (SELECT {mass}), {name} AS MATERIALIZED ({rows})"


RANK = ", rk AS MATERIALIZED (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS cid FROM cls), kk AS (SELECT count(*) AS k FROM rk)"
EXACT = Q.UZ + RANK + _corner("fst", "r1") + _corner("lst", "r2") + """,
eu AS (SELECT 'S' AS a, 1.0::DOUBLE AS e UNION ALL SELECT a, e FROM uz WHERE nt = 'S'),
nb AS MATERIALIZED (SELECT l.c AS n1, f.c AS n2, sum(e * p * l.v * f.v) AS e FROM g JOIN eu ON eu.a = g.lhs JOIN lst l ON l.a = g.r1 JOIN fst f ON f.a = g.r2 WHERE g.r2 IS NOT NULL GROUP BY ALL),
lx AS MATERIALIZED (SELECT lhs AS nt, r1 AS word, p / sum(p) OVER (PARTITION BY lhs) AS p FROM g WHERE r2 IS NULL),
tf AS MATERIALIZED (SELECT word, feature, sum(value) AS value FROM (
  SELECT w.word, cid AS feature, e * w.p * u.p AS value FROM nb JOIN lx u ON u.nt = n1 JOIN lx w ON w.nt = n2 JOIN rk ON rk.word = u.word
  UNION ALL SELECT w.word, cid + k + 1, e * w.p * u.p FROM nb JOIN lx u ON u.nt = n2 JOIN lx w ON w.nt = n1 JOIN rk ON rk.word = u.word, kk
  UNION ALL SELECT w.word, 0, v * w.p FROM fst JOIN lx w ON w.nt = c WHERE a = 'S'
  UNION ALL SELECT w.word, k + 1, v * w.p FROM lst JOIN lx w ON w.nt = c, kk WHERE a = 'S') GROUP BY ALL)"""
ROWS = Q.UZ + RANK + """,
wd AS (SELECT word, lag(word) OVER w AS l, lead(word) OVER w AS r FROM lv0 WINDOW w AS (PARTITION BY user_id, chunk ORDER BY pos)),
ft AS MATERIALIZED (SELECT wd.word, coalesce(cid, 0) AS feature, count(*) AS v FROM wd LEFT JOIN rk ON rk.word = l GROUP BY ALL UNION ALL SELECT wd.word, coalesce(cid, 0) + any_value(k) + 1, count(*) FROM wd LEFT JOIN rk ON rk.word = r, kk GROUP BY wd.word, coalesce(cid, 0)),
gl AS (SELECT f AS feature, (coalesce(sum(v), 0) + CASE WHEN f IN (0, any_value(k) + 1) THEN 1 ELSE 0 END)::DOUBLE / ((SELECT sum(v) FROM ft) + 2) AS m FROM (SELECT k, unnest(range(2 * (k + 1))) AS f FROM kk) LEFT JOIN ft ON feature = f GROUP BY f),
nw AS (SELECT word, sum(v)::DOUBLE AS n FROM ft GROUP BY word),
ro AS MATERIALIZED (SELECT nw.word, gl.feature, n, 2.0::DOUBLE * (k + 1) / (2 * (k + 1) + n) AS lam, (1 - lam) * coalesce(v, 0) / n + lam * m AS x FROM nw CROSS JOIN gl CROSS JOIN kk LEFT JOIN ft ON ft.word = nw.word AND ft.feature = gl.feature),
po AS MATERIALIZED (SELECT r1 AS word, lhs AS nt, e * p / sum(e * p) OVER (PARTITION BY r1) AS q FROM g JOIN uz ON nt = 'S' AND a = lhs WHERE r2 IS NULL),
pd AS (SELECT po.word, ro.feature, sum(q * x) AS y FROM po JOIN rk ON cid = CASE WHEN nt = 'X' THEN 1 ELSE 2 END JOIN ro ON ro.word = rk.word GROUP BY ALL),
dg AS MATERIALIZED (SELECT ro.word, ro.feature, n, x, y, (x - y) ** 2 AS s FROM ro JOIN pd ON pd.word = ro.word AND pd.feature = ro.feature)"""
DOTS = """, tn AS (SELECT word, feature, value / sum(value) OVER (PARTITION BY word) AS v FROM tf), st AS (SELECT word, sum(v * CASE WHEN feature IN (0, k + 1) THEN sqrt(0.5::DOUBLE) ELSE 0 END) AS q, sum(v * v) AS vv FROM tn, kk GROUP BY word),
a1 AS MATERIALIZED (SELECT word, q, vv, sqrt(greatest(vv - q * q, 0)) AS d FROM st ORDER BY round(sqrt(greatest(vv - q * q, 0)), 9) DESC, word LIMIT 1),
a2 AS (SELECT st.word, sqrt(greatest(st.vv - st.q ** 2 - ((d.o - st.q * a1.q) / a1.d) ** 2, 0)) AS d FROM st JOIN (SELECT x.word, sum(x.v * y.v) AS o FROM tn x JOIN tn y ON y.feature = x.feature JOIN a1 ON a1.word = y.word GROUP BY x.word) d ON d.word = st.word, a1 ORDER BY round(sqrt(greatest(st.vv - st.q ** 2 - ((d.o - st.q * a1.q) / a1.d) ** 2, 0)), 9) DESC, st.word LIMIT 1)"""
ORACLES = {
    "target_features": Q._q("SELECT word, feature, round(value, 9) AS value FROM tf", EXACT),
    "target_anchors": Q._q("SELECT 1 AS rank, word, round(d, 9) AS distance FROM a1 UNION ALL SELECT 2, word, round(d, 9) FROM a2", EXACT + DOTS),
    "labelled_anchors": f"WITH {E.TB}, c AS (SELECT r1 AS word, lhs AS nt, count(*) AS n FROM prod WHERE r2 IS NULL GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY word) AS q, sum(n) OVER (PARTITION BY word) AS t FROM c), "
    "b AS (SELECT nt, word FROM p QUALIFY row_number() OVER (PARTITION BY nt ORDER BY round(q, 9) DESC, t DESC, word) = 1) SELECT 0 AS rank, 'S' AS word UNION ALL SELECT row_number() OVER (ORDER BY nt), word FROM b",
    "anchor_diagnosis": Q._q("SELECT word, feature, round(x, 9) AS actual, round(y, 9) AS predicted, round(s / sum(s) OVER (PARTITION BY word), 9) AS share FROM dg", ROWS),
    "anchor_diagnosis_words": Q._q("SELECT dg.word, any_value(n)::BIGINT AS n, any_value(nt) AS nt, round(any_value(q), 9) AS posterior, round(sqrt(sum(s)), 9) AS l2_true, round(sum(x * ln(x / y)), 9) AS kl_true FROM dg JOIN (SELECT word, nt, q FROM po QUALIFY row_number() OVER (PARTITION BY word ORDER BY q DESC, nt) = 1) b ON b.word = dg.word GROUP BY dg.word", ROWS),
}
