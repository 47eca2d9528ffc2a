"""Queries over a treebank and grammars that Spark derives from the events table, and their DuckDB twins.

Each user's events in time order, cut into chunks of six, are sentences over the event types. Every sentence of two or more has
a right-branching tree: inner nodes are S at the top and V0 / V1 by depth below, leaves are P0 / P1 by a hash of the event.
Relative frequencies of the productions are a grammar.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from spanwright.operators import charts as C
from spanwright.operators import evaluation as E
from spanwright.operators import grammar as G
from spanwright.operators import tokens as T

LENGTH = 6
EPS = 1e-6


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def leaves(spark, sf):
    """(user_id, chunk, pos, n, word, pre): the sentences' tokens with their preterminals; n is the sentence's length."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.row_number().over(w) - 1
    pre = F.concat(F.lit("P"), (F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("long") % 2).cast("string"))
    e = _t(spark, sf, "events").select("user_id", k.alias("k"), F.col("event_type").alias("word"), pre.alias("pre"))
    e = e.select("user_id", F.floor(F.col("k") / LENGTH).cast("long").alias("chunk"), (F.col("k") % LENGTH).alias("pos"), "word", "pre")
    return e.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id", "chunk"))).where("n >= 2")


def productions(spark, sf):
    x = leaves(spark, sf).withColumn("next", F.lead("pre").over(Window.partitionBy("user_id", "chunk").orderBy("pos")))
    lex = x.select("user_id", F.col("pre").alias("lhs"), F.col("word").alias("r1"), F.lit(None).cast("string").alias("r2"))
    v = lambda p: F.concat(F.lit("V"), (p % 2).cast("string"))
    lhs = F.when(F.col("pos") == 0, F.lit("S")).otherwise(v(F.col("pos")))
    r2 = F.when(F.col("pos") == F.col("n") - 2, F.col("next")).otherwise(v(F.col("pos") + 1))
    return lex.unionByName(x.where(F.col("pos") < F.col("n") - 1).select("user_id", lhs.alias("lhs"), F.col("pre").alias("r1"), r2.alias("r2")))


def rules(spark, sf):
    return G.treebank_rules(productions(spark, sf)).select(*G.RULE, "p")


def _half(spark, sf, k):
    return G.treebank_rules(productions(spark, sf).where(F.col("user_id") % 2 == k))


def expectation(spark, sf):
    """(nt, e): uses per tree in the treebank, which the relative-frequency grammar reproduces."""
    p = productions(spark, sf)
    total = p.where("lhs = 'S'").agg(F.count(F.lit(1)).alias("t"))
    return p.groupBy(F.col("lhs").alias("nt")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("nt", (F.col("n") / F.col("t")).alias("e"))


def sents(spark, sf):
    return T.sequences(_t(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", LENGTH)


def _r(frame, *cols, digits=9):
    for c in cols:
        frame = frame.withColumn(c, F.round(c, digits))
    return frame


def inside(spark, sf):
    x = C.inside_log_probability(sents(spark, sf), C.chart_of(rules(spark, sf)))
    return x.select("user_id", "chunk", F.round("lp", 9).alias("lp"))


def viterbi(spark, sf):
    x = C.viterbi(sents(spark, sf), C.chart_of(rules(spark, sf)))
    return x.select("user_id", "chunk", F.round("best.lp", 9).alias("lp"))


def parse_counts(spark, sf):
    x = C.tree_counts(sents(spark, sf), C.chart_of(rules(spark, sf)))
    return x.select("user_id", "chunk", F.col("n_trees").cast("long").alias("n_trees"))


def expected_rule_counts(spark, sf):
    return _r(C.expected_counts(sents(spark, sf), C.chart_of(rules(spark, sf))), "n", digits=6)


def length_distribution(spark, sf):
    return spark.createDataFrame([(n, round(p, 9)) for n, p in G.length_distribution(rules(spark, sf), LENGTH)], "len int, p double")


def partition_step(spark, sf):
    r = rules(spark, sf)
    z = G.lexical(r).groupBy(F.col("lhs").alias("nt")).agg(F.sum("p").alias("z"))
    return _r(G.partition_step(r, z), "z")


def xi(spark, sf):
    return _r(G.to_xi(rules(spark, sf), expectation(spark, sf)), "p")


def chi_zhang(spark, sf):
    """Halved rules, brought back to probabilities through their partition function."""
    r = rules(spark, sf).withColumn("p", F.col("p") * F.when(F.col("r2").isNull(), 0.5).otherwise(1.0))
    return _r(G.by_partition(r), "p")


def kl(spark, sf):
    p = productions(spark, sf).where("user_id % 2 = 0")
    total = p.where("lhs = 'S'").agg(F.count(F.lit(1)).alias("t"))
    e = p.groupBy(F.col("lhs").alias("nt")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("nt", (F.col("n") / F.col("t")).alias("e"))
    words = leaves(spark, sf).select("word").distinct()
    smooth = G.smoothed(_half(spark, sf, 1).select(*G.RULE, "p"), words, EPS)
    return G.labelled_kl(_half(spark, sf, 0).select(*G.RULE, "p"), smooth, e)


def relabel(spark, sf):
    m = spark.createDataFrame([("V0", "A"), ("V1", "B"), ("P0", "X"), ("P1", "Y")], "old string, new string")
    return _r(G.relabel(rules(spark, sf), m).select(*G.RULE, "p"), "p")


def span_overlap(spark, sf):
    """Unlabelled spans that the right-branching trees share with trees that branch right once and left for the rest."""
    s = leaves(spark, sf).select("user_id", "chunk", "n").distinct().withColumn("n", F.col("n").cast("int"))
    middle = F.flatten(F.array(F.slice(E.right_spans(F.col("n")), 1, 1), F.slice(E.left_spans(F.col("n")), 1, F.col("n"))))
    return E.span_overlap(s, E.right_spans(F.col("n")), middle).select("user_id", "chunk", "n", "common", "size")


def unkify(spark, sf):
    frequent = _t(spark, sf, "events").groupBy(F.col("event_type").alias("word")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "word").limit(3)
    return _r(G.unkify(rules(spark, sf), frequent), "p")


def e_steps(spark, sf, step):
    counts = _half(spark, sf, 0).select(*G.RULE, F.col("n").cast("double").alias("n"))
    if step == "linear":
        return _r(G.linear_step(rules(spark, sf), counts, 0.3).select(*G.RULE, "p"), "p")
    total = _half(spark, sf, 0).where("lhs = 'S'").agg(F.sum("n")).first()[0]
    return _r(G.exponentiated_step(rules(spark, sf), counts, 0.1, float(total)).select(*G.RULE, "p"), "p")


QUERIES = {
    "treebank_mle": lambda sp, sf: _r(G.treebank_rules(productions(sp, sf)), "p"),
    "normalise_rules": lambda sp, sf: _r(G.normalised(G.treebank_rules(productions(sp, sf)).select(*G.RULE, F.col("n").alias("p"))), "p"),
    "rule_entropy": lambda sp, sf: _r(G.entropies(rules(sp, sf)), "entropy"),
    "terminal_posterior": lambda sp, sf: _r(G.terminal_posteriors(rules(sp, sf), expectation(sp, sf)), "posterior"),
    "best_lhs": lambda sp, sf: _r(G.best_lhs(G.terminal_posteriors(rules(sp, sf), expectation(sp, sf))), "posterior"),
    "top_terminals": lambda sp, sf: _r(G.terminal_expectations(rules(sp, sf), expectation(sp, sf)).orderBy(F.desc("e"), "word").limit(3), "e"),
    "unary_collapse": lambda sp, sf: _r(G.unary_collapse(rules(sp, sf)), "p"),
    "unkify_grammar": unkify,
    "smooth_full": lambda sp, sf: _r(G.smoothed(rules(sp, sf), leaves(sp, sf).select("word"), EPS), "p", digits=12),
    "labeled_kl_exact": kl,
    "cfg_morphism": lambda sp, sf: G.missing_rules(rules(sp, sf), G.treebank_rules(productions(sp, sf).where("user_id % 50 = 1"))).unionByName(G.missing_rules(_half(sp, sf, 0), G.truncated(rules(sp, sf), expectation(sp, sf), 0.1, 0.2))),
    "partition_step": partition_step,
    "pi_to_xi": xi,
    "xi_to_pi": lambda sp, sf: _r(G.by_partition(G.to_xi(rules(sp, sf), expectation(sp, sf))), "p"),
    "chi_zhang_renormalise": chi_zhang,
    "relabel_rules": relabel,
    "truncate_grammar": lambda sp, sf: _r(G.truncated(rules(sp, sf), expectation(sp, sf), 0.1, 0.2).select(*G.RULE, "p"), "p"),
    "scale_divergent": lambda sp, sf: _r(G.scaled_if_divergent(rules(sp, sf).withColumn("p", F.col("p") * 2)), "p"),
    "inside_probability": inside,
    "viterbi_score": viterbi,
    "parse_counts": parse_counts,
    "expected_rule_counts": expected_rule_counts,
    "length_distribution": length_distribution,
    "linear_step": lambda sp, sf: e_steps(sp, sf, "linear"),
    "exponentiated_step": lambda sp, sf: e_steps(sp, sf, "exponentiated"),
    "span_overlap": span_overlap,
}

TB = f"""
ev AS (SELECT user_id, event_id, event_type AS word, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
lv0 AS (SELECT user_id, k // {LENGTH} AS chunk, k % {LENGTH} AS pos, word, 'P' || (('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 2) AS pre FROM ev),
lv AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY user_id, chunk) AS n, lead(pre) OVER (PARTITION BY user_id, chunk ORDER BY pos) AS nx FROM lv0) WHERE n >= 2),
prod AS (SELECT user_id, pre AS lhs, word AS r1, NULL::VARCHAR AS r2 FROM lv UNION ALL
  SELECT user_id, CASE WHEN pos = 0 THEN 'S' ELSE 'V' || (pos % 2) END, pre, CASE WHEN pos = n - 2 THEN nx ELSE 'V' || ((pos + 1) % 2) END FROM lv WHERE pos < n - 1),
mle AS (SELECT lhs, r1, r2, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY lhs) AS p FROM prod GROUP BY lhs, r1, r2),
g AS (SELECT lhs, r1, r2, p FROM mle),
ex AS (SELECT lhs AS nt, count(*) / (SELECT count(*) FROM prod WHERE lhs = 'S')::DOUBLE AS e FROM prod GROUP BY lhs)"""
HALF = "".join(f", h{k} AS (SELECT lhs, r1, r2, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY lhs) AS p FROM prod WHERE user_id % 2 = {k} GROUP BY lhs, r1, r2)" for k in (0, 1))
POST = ", te AS (SELECT r1 AS word, lhs AS nt, p * e AS e FROM g JOIN ex ON nt = lhs WHERE r2 IS NULL), post AS (SELECT word, nt, e / sum(e) OVER (PARTITION BY word) AS posterior FROM te)"
XI = ", xi AS (SELECT g.lhs, g.r1, g.r2, g.p * a.e / (coalesce(b.e, 1) * coalesce(c.e, 1)) AS p FROM g JOIN ex a ON a.nt = g.lhs LEFT JOIN ex b ON b.nt = g.r1 AND g.r2 IS NOT NULL LEFT JOIN ex c ON c.nt = g.r2)"


def _smooth(source: str, out: str) -> str:
    return f""", sm0 AS (SELECT lhs, r1, r2, p FROM {source} UNION ALL
  SELECT a.lhs, b.lhs, c.lhs, {EPS} FROM (SELECT DISTINCT lhs FROM {source}) a, (SELECT DISTINCT lhs FROM {source} WHERE lhs <> 'S') b, (SELECT DISTINCT lhs FROM {source} WHERE lhs <> 'S') c
  UNION ALL SELECT a.lhs, w.word, NULL, {EPS} FROM (SELECT DISTINCT lhs FROM {source}) a, (SELECT DISTINCT word FROM lv) w),
sm1 AS (SELECT lhs, r1, r2, sum(p) AS p FROM sm0 GROUP BY ALL), {out} AS (SELECT lhs, r1, r2, p / sum(p) OVER (PARTITION BY lhs) AS p FROM sm1)"""


def _chart(agg: str, weight: str, times: str, leaf: str) -> str:
    """One statement per width: spans of sentences with each nonterminal's value."""
    out = f""", sx AS (SELECT user_id, chunk, pos AS i, word, count(*) OVER (PARTITION BY user_id, chunk) AS n FROM lv0),
c1 AS (SELECT user_id, chunk, i, i + 1 AS j, lhs AS a, {leaf} AS v FROM sx JOIN g ON r1 = word AND r2 IS NULL)"""
    for w in range(2, LENGTH + 1):
        parts = " UNION ALL ".join(f"SELECT x.user_id, x.chunk, x.i, y.j, g.lhs AS a, {times} AS v FROM c{k} x JOIN c{w - k} y ON x.user_id = y.user_id AND x.chunk = y.chunk AND x.j = y.i JOIN g ON g.r1 = x.a AND g.r2 = y.a" for k in range(1, w))
        out += f", c{w} AS (SELECT user_id, chunk, i, j, a, {agg} AS v FROM ({parts}) GROUP BY user_id, chunk, i, j, a)"
    tops = " UNION ALL ".join(f"SELECT user_id, chunk, j AS n, v FROM c{w} WHERE i = 0 AND a = 'S'" for w in range(1, LENGTH + 1))
    return f"{out}, sn AS (SELECT user_id, chunk, max(n) AS n FROM sx GROUP BY ALL), tops AS ({tops})"


def _q(body: str, extra: str = "") -> str:
    return f"WITH {TB}{extra} {body}"


_RP = "SELECT lhs, r1, r2, round(p, 9) AS p FROM"
ORACLES = {
    "treebank_mle": _q("SELECT lhs, r1, r2, n, round(p, 9) AS p FROM mle"),
    "normalise_rules": _q("SELECT lhs, r1, r2, round(n / sum(n) OVER (PARTITION BY lhs), 9) AS p FROM mle"),
    "rule_entropy": _q("SELECT lhs, round(-sum(p * ln(p)), 9) AS entropy FROM g GROUP BY lhs"),
    "terminal_posterior": _q("SELECT word, nt, round(posterior, 9) AS posterior FROM post", POST),
    "best_lhs": _q("SELECT word, nt, round(posterior, 9) AS posterior FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY posterior DESC, nt) AS k FROM post) WHERE k = 1", POST),
    "top_terminals": _q("SELECT word, round(sum(e), 9) AS e FROM te GROUP BY word ORDER BY sum(e) DESC, word LIMIT 3", POST),
    "unary_collapse": _q("SELECT lhs, '<' || lhs || '>' AS r1, NULL::VARCHAR AS r2, round(sum(p), 9) AS p FROM g WHERE r2 IS NULL GROUP BY lhs UNION ALL SELECT lhs, r1, r2, round(p, 9) FROM g WHERE r2 IS NOT NULL"),
    "unkify_grammar": _q(
        "SELECT lhs, CASE WHEN r1 IN (SELECT event_type FROM fr) THEN r1 ELSE 'unk' END AS r1, NULL::VARCHAR AS r2, round(sum(p), 9) AS p FROM g WHERE r2 IS NULL GROUP BY 1, 2 UNION ALL SELECT lhs, r1, r2, round(p, 9) FROM g WHERE r2 IS NOT NULL",
        ", fr AS (SELECT event_type FROM events GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 3)"),
    "smooth_full": _q("SELECT lhs, r1, r2, round(p, 12) AS p FROM sm", _smooth("g", "sm")),
    "labeled_kl_exact": _q(
        "SELECT round(sum(h0.p * e * (ln(h0.p) - ln(sm.p))), 9) AS kl FROM h0 JOIN e0 ON nt = h0.lhs JOIN sm ON sm.lhs = h0.lhs AND sm.r1 = h0.r1 AND sm.r2 IS NOT DISTINCT FROM h0.r2",
        HALF + ", e0 AS (SELECT lhs AS nt, count(*) / (SELECT count(*) FROM prod WHERE lhs = 'S' AND user_id % 2 = 0)::DOUBLE AS e FROM prod WHERE user_id % 2 = 0 GROUP BY lhs)" + _smooth("h1", "sm")),
    "cfg_morphism": _q(
        "(SELECT lhs, r1, r2 FROM g EXCEPT SELECT lhs, r1, r2 FROM prod WHERE user_id % 50 = 1) UNION ALL (SELECT lhs, r1, r2 FROM h0 EXCEPT SELECT lhs, r1, r2 FROM t)",
        HALF + ", bad AS (SELECT nt FROM ex WHERE e <= 0.1), t AS (SELECT g.* FROM g JOIN ex ON nt = lhs WHERE p * e >= 0.2 AND lhs NOT IN (SELECT nt FROM bad) AND r1 NOT IN (SELECT nt FROM bad) AND coalesce(r2, '') NOT IN (SELECT nt FROM bad))"),
    "partition_step": _q(
        "SELECT lhs AS nt, round(sum(v), 9) AS z FROM (SELECT lhs, p AS v FROM g WHERE r2 IS NULL UNION ALL SELECT g.lhs, g.p * a.z * b.z FROM g JOIN z0 a ON a.nt = g.r1 JOIN z0 b ON b.nt = g.r2) GROUP BY lhs",
        ", z0 AS (SELECT lhs AS nt, sum(p) AS z FROM g WHERE r2 IS NULL GROUP BY lhs)"),
    "pi_to_xi": _q(f"{_RP} xi", XI),
    "xi_to_pi": _q(f"{_RP} g"),
    "relabel_rules": _q(
        "SELECT coalesce(a.nw, lhs) AS lhs, CASE WHEN r2 IS NULL THEN r1 ELSE coalesce(b.nw, r1) END AS r1, coalesce(c.nw, r2) AS r2, round(p, 9) AS p FROM g LEFT JOIN m a ON a.old = lhs LEFT JOIN m b ON b.old = r1 LEFT JOIN m c ON c.old = r2",
        ", m(old, nw) AS (VALUES ('V0', 'A'), ('V1', 'B'), ('P0', 'X'), ('P1', 'Y'))"),
    "truncate_grammar": _q(
        "SELECT lhs, r1, r2, round(p / sum(p) OVER (PARTITION BY lhs), 9) AS p FROM t",
        ", bad AS (SELECT nt FROM ex WHERE e <= 0.1), t AS (SELECT g.* FROM g JOIN ex ON nt = lhs WHERE p * e >= 0.2 AND lhs NOT IN (SELECT nt FROM bad) AND r1 NOT IN (SELECT nt FROM bad) AND coalesce(r2, '') NOT IN (SELECT nt FROM bad))"),
    "scale_divergent": _q("SELECT lhs, r1, r2, round(2 * p / (SELECT greatest(max(s), 1) FROM (SELECT sum(2 * p) AS s FROM g GROUP BY lhs)), 9) AS p FROM g"),
    "inside_probability": _q("SELECT sn.user_id, sn.chunk, round(ln(v), 9) AS lp FROM sn LEFT JOIN tops ON tops.user_id = sn.user_id AND tops.chunk = sn.chunk AND tops.n = sn.n", _chart("sum(v)", "", "x.v * y.v * g.p", "p")),
    "viterbi_score": _q("SELECT sn.user_id, sn.chunk, round(v, 9) AS lp FROM sn LEFT JOIN tops ON tops.user_id = sn.user_id AND tops.chunk = sn.chunk AND tops.n = sn.n", _chart("max(v)", "", "x.v + y.v + ln(g.p)", "ln(p)")),
    "parse_counts": _q("SELECT sn.user_id, sn.chunk, coalesce(v, 0)::BIGINT AS n_trees FROM sn LEFT JOIN tops ON tops.user_id = sn.user_id AND tops.chunk = sn.chunk AND tops.n = sn.n", _chart("sum(v)", "", "x.v * y.v", "1")),
    "linear_step": _q(
        "SELECT lhs, r1, r2, round(p / sum(p) OVER (PARTITION BY lhs), 9) AS p FROM y WHERE p > 0",
        HALF + ", x AS (SELECT g.lhs, g.r1, g.r2, g.p, coalesce(h0.n, 0) AS n FROM g LEFT JOIN h0 ON h0.lhs = g.lhs AND h0.r1 = g.r1 AND h0.r2 IS NOT DISTINCT FROM g.r2), y AS (SELECT lhs, r1, r2, 0.7::DOUBLE * p + 0.3::DOUBLE * n / sum(n) OVER (PARTITION BY lhs) AS p FROM x)"),
    "exponentiated_step": _q(
        "SELECT lhs, r1, r2, round(p / sum(p) OVER (PARTITION BY lhs), 9) AS p FROM y",
        HALF + ", x AS (SELECT g.lhs, g.r1, g.r2, g.p, coalesce(h0.n, 0)::DOUBLE AS n FROM g LEFT JOIN h0 ON h0.lhs = g.lhs AND h0.r1 = g.r1 AND h0.r2 IS NOT DISTINCT FROM g.r2), y AS (SELECT lhs, r1, r2, p * exp(greatest(least(0.1::DOUBLE * n / ((SELECT sum(n) FROM h0 WHERE lhs = 'S') * p), 10), -10)) AS p FROM x)"),
    "span_overlap": _q("SELECT user_id, chunk, max(n)::INTEGER AS n, count(*) FILTER (pos BETWEEN 1 AND n - 2 AND pos = 1)::INTEGER AS common, count(*) FILTER (pos BETWEEN 1 AND n - 2)::INTEGER AS size FROM lv GROUP BY ALL"),
}
