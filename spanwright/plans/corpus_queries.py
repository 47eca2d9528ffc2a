"""Queries over the word corpus (documents) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.operators import clustering
from spanwright.operators import stats as S
from spanwright.operators import tokens as T
from spanwright.operators.lineage import cut

#: Clusters, least count of a clustered word, candidate words of the pair queries.
N_CLUSTERS, MIN_COUNT, TOP = 10, 10, 300


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sents(spark, sf):
    return T.sentences(_t(spark, sf, "documents"))


def _dealt(spark, sf):
    """The sentences of evenly dealt texts, for counts of long n-grams."""
    return T.sentences(T.dealt(_t(spark, sf, "documents")))


def _counts(spark, sf):
    return T.word_counts(_sents(spark, sf))


def _top(spark, sf, n=TOP, counts=None):
    """The n most frequent words, a list of fixed size, as a table of its own."""
    counts = _counts(spark, sf) if counts is None else counts
    return spark.createDataFrame([tuple(r) for r in counts.orderBy(F.desc("n"), "word").limit(n).collect()], "word string, n long")


def _clusters(counts):
    return T.hashed_clusters(counts, N_CLUSTERS, MIN_COUNT)


def exchanged(bigrams, counts):
    """(word, cid) after the exchange clustering of counted bigrams, until no single move gains; words of fewer than MIN_COUNT occurrences are
    the one word clustering.UNKNOWN, which moves as the others do."""
    rare = bigrams.sparkSession.createDataFrame([(clustering.UNKNOWN, MIN_COUNT)], "word string, n long")
    return clustering.exchange_together(bigrams, _clusters(counts.unionByName(rare)), N_CLUSTERS, counts=counts, unknown=True)


def word_expectations(spark, sf):
    s = _sents(spark, sf)
    return T.expectations(T.word_counts(s), T.sentence_count(s))


def length1_expectations(spark, sf):
    s = _sents(spark, sf)
    return T.expectations(T.of_length(s, 1), T.sentence_count(s))


def length2_expectations(spark, sf):
    s = _sents(spark, sf)
    return T.expectations(T.of_length(s, 2), T.sentence_count(s))


def bigram_pmi(spark, sf):
    s = _sents(spark, sf)
    b = T.bigram_counts(s)
    # a sentence has one boundary before it
    total = b.where(F.col("w1") == T.BOUNDARY).agg(F.sum("n").alias("total"))
    return S.pmi(b.where((F.col("w1") != T.BOUNDARY) & (F.col("w2") != T.BOUNDARY)), T.counts_of(b), total)


def _vocabulary(spark, sf):
    """Word counts as a checkpoint, and the clusters over it."""
    counts = cut(_counts(spark, sf))
    return counts, _clusters(counts)


def marginal(spark, sf):
    counts, clusters = _vocabulary(spark, sf)
    return T.marginal_features_of(_sents(spark, sf), clusters, counts, N_CLUSTERS)


def joint(spark, sf):
    counts, clusters = _vocabulary(spark, sf)
    return T.joint_features_of(_sents(spark, sf), clusters, counts, N_CLUSTERS)


def cluster_table(spark, sf):
    b = T.bigram_counts(_sents(spark, sf))
    return T.cluster_bigrams(b, _clusters(T.counts_of(b)))


def _top_pairs(spark, sf):
    counts, clusters = _vocabulary(spark, sf)
    top = _top(spark, sf, counts=counts)
    return S.pair_table(S.distributions(T.marginal_features_of(_sents(spark, sf), clusters, counts, N_CLUSTERS, top)))


def basis_distance(spark, sf):
    import numpy as np

    e = _t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    first = np.array(e.where("vec_id = 0").first()["v"])
    return S.distance_from(e, [(first / np.linalg.norm(first)).tolist()]).select("vec_id", F.round("distance", 6).alias("distance"))


def segment_association(spark, sf):
    """Contingency of nations and market segments, as words and contexts of the association test."""
    c = _t(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return S.chi2_pairs(c.select(F.col("c_mktsegment").alias("word"), F.lit("nation").alias("side"), F.col("c_nationkey").cast("string").alias("ctx"), "n"))


QUERIES = {
    "bigram_counts": lambda sp, sf: T.bigram_counts(_sents(sp, sf)),
    "trigram_counts": lambda sp, sf: T.trigram_counts(_dealt(sp, sf)),
    "word_expectations": word_expectations,
    "length1_expectations": length1_expectations,
    "length2_expectations": length2_expectations,
    "bigram_pmi": bigram_pmi,
    "context_counts_k2": lambda sp, sf: T.contexts(_sents(sp, sf), _top(sp, sf)),
    "gap_correction": lambda sp, sf: T.gap_correction(_sents(sp, sf)),
    "vocab_ids": lambda sp, sf: T.vocabulary(_counts(sp, sf), 2),
    "unk_replace": lambda sp, sf: T.replace_rare(_sents(sp, sf), _counts(sp, sf), MIN_COUNT),
    "freq_of_freq": lambda sp, sf: S.freq_of_freq(_counts(sp, sf)),
    "good_turing_loglinear": lambda sp, sf: S.good_turing(_counts(sp, sf)),
    "context_features_marginal": marginal,
    "context_features_joint": joint,
    "cluster_bigram_table": cluster_table,
    "exchange_objective": lambda sp, sf: T.exchange_objective(cluster_table(sp, sf)),
    "word_context_long": lambda sp, sf: T.word_contexts(T.bigram_counts(_sents(sp, sf))),
    "chi2_pairs": lambda sp, sf: S.chi2_pairs(T.word_contexts(T.bigram_counts(_sents(sp, sf)), F.broadcast(_top(sp, sf)))),
    "segment_association": segment_association,
    "renyi_pairs": lambda sp, sf: S.renyi(_top_pairs(sp, sf), 2.0),
    "kl_pairs": lambda sp, sf: S.renyi(_top_pairs(sp, sf), 1),
    "violation_fraction": lambda sp, sf: S.violation_fraction(_top_pairs(sp, sf), 0.5),
    "shrinkage_rows": lambda sp, sf: S.shrunk(cut(marginal(sp, sf))),
    "basis_distance": basis_distance,
    "variation_of_information": lambda sp, sf: S.variation_of_information(_t(sp, sf, "documents"), "lang", "source"),
}

SENT = r"""
doc_parts AS (SELECT doc_id, regexp_split_to_array(lower(text), '[.\n]+') AS p FROM documents),
sent_text AS (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) - 1 AS sno FROM doc_parts),
sent AS MATERIALIZED (SELECT doc_id, sno, w FROM (SELECT doc_id, sno, list_filter(string_split(trim(regexp_replace(t, '[^\p{L}]+', ' ', 'g')), ' '), lambda x : x <> '') AS w FROM sent_text) WHERE len(w) > 0),
padded AS (SELECT doc_id, sno, w, list_concat(['<s>'], w, ['<s>']) AS p FROM sent),
tok AS (SELECT doc_id, sno, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM sent),
cnt AS MATERIALIZED (SELECT word, count(*) AS n FROM tok GROUP BY word),
total AS (SELECT count(*) AS total FROM sent)"""
BI = ", pairs AS (SELECT unnest(list_zip(p[:-2], p[2:])) AS b FROM padded), bi AS MATERIALIZED (SELECT b[1] AS w1, b[2] AS w2, count(*) AS n FROM pairs GROUP BY ALL)"
TRI = ", trip AS (SELECT unnest(list_zip(p[1:-3], p[2:-2], p[3:])) AS b FROM padded), tri AS MATERIALIZED (SELECT b[1] AS w1, b[2] AS w2, b[3] AS w3, count(*) AS n FROM trip GROUP BY ALL)"
CL = f", cl AS (SELECT word, (1 + ('0x' || substr(md5('7:' || word), 1, 8))::BIGINT % {N_CLUSTERS - 1})::INTEGER AS cid FROM cnt WHERE n >= {MIN_COUNT})"
TOPQ = f", top AS (SELECT word, n FROM cnt ORDER BY n DESC, word LIMIT {TOP})"
MARG = f""", marg AS MATERIALIZED (SELECT word, feature, sum(n)::BIGINT AS value FROM (
  SELECT w2 AS word, coalesce(cid, 0) AS feature, bi.n FROM bi LEFT JOIN cl ON cl.word = w1 WHERE w2 <> '<s>'
  UNION ALL SELECT w1, coalesce(cid, 0) + {N_CLUSTERS + 1}, bi.n FROM bi LEFT JOIN cl ON cl.word = w2 WHERE w1 <> '<s>') GROUP BY ALL)"""
CTAB = ", ct AS (SELECT coalesce(a.cid, 0) AS c1, coalesce(b.cid, 0) AS c2, sum(bi.n)::BIGINT AS n FROM bi LEFT JOIN cl a ON a.word = w1 LEFT JOIN cl b ON b.word = w2 GROUP BY ALL)"
WCTX = """, wc AS (SELECT w2 AS word, 'left' AS side, w1 AS ctx, n FROM bi WHERE w1 <> '<s>' AND w2 <> '<s>' UNION ALL SELECT w1, 'right', w2, n FROM bi WHERE w1 <> '<s>' AND w2 <> '<s>')"""
DIST = """, dist AS (SELECT word, feature, value / sum(value) OVER (PARTITION BY word) AS p FROM marg WHERE word IN (SELECT word FROM top)),
pq AS (SELECT a.word AS a, b.word AS b, f.feature, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q FROM top a JOIN top b ON a.word <> b.word, (SELECT DISTINCT feature FROM dist) f
  LEFT JOIN dist x ON x.word = a.word AND x.feature = f.feature LEFT JOIN dist y ON y.word = b.word AND y.feature = f.feature)"""


def _chi2(source: str) -> str:
    """Cells of the pairs that share a context, one by one; what a word holds alone enters by its columns' sums."""
    return f"""
sh AS (SELECT x.word AS a, y.word AS b, side, ctx, x.n AS x, y.n AS y FROM {source} x JOIN {source} y USING (side, ctx) WHERE x.word < y.word),
sa AS (SELECT a, b, sum(CASE WHEN x + y > 5 THEN x END) AS sx, sum(CASE WHEN x + y > 5 THEN y END) AS sy, count(*) FILTER (x + y > 5) AS c, sum(x) FILTER (x > 5) AS ox, sum(y) FILTER (y > 5) AS oy, count(*) FILTER (x > 5) AS cx, count(*) FILTER (y > 5) AS cy FROM sh GROUP BY ALL),
lg AS (SELECT word, sum(n) FILTER (n > 5) AS s, count(*) FILTER (n > 5) AS c FROM {source} GROUP BY word),
ro AS (SELECT u.word AS a, v.word AS b, coalesce(u.s, 0) - coalesce(ox, 0) AS ax, coalesce(v.s, 0) - coalesce(oy, 0) AS bx, u.c - coalesce(cx, 0) AS ca, v.c - coalesce(cy, 0) AS cb, coalesce(sx, 0) AS sx, coalesce(sy, 0) AS sy, coalesce(sa.c, 0) AS c
  FROM lg u JOIN lg v ON u.word < v.word LEFT JOIN sa ON sa.a = u.word AND sa.b = v.word),
rr AS (SELECT a, b, ax, bx, ca, cb, (sx + ax)::DOUBLE AS nx, (sy + bx)::DOUBLE AS ny, c + ca + cb AS cols FROM ro WHERE c + ca + cb >= 2 AND sx + ax > 0 AND sy + bx > 0),
ce AS (SELECT a, b, x::DOUBLE AS x, y::DOUBLE AS y FROM sh WHERE x + y > 5 UNION ALL SELECT a, b, ax, 0 FROM rr WHERE cols = 2 AND ca = 1 UNION ALL SELECT a, b, 0, bx FROM rr WHERE cols = 2 AND cb = 1),
e AS (SELECT ce.a, ce.b, x, y, cols, nx * (x + y) / (nx + ny) AS ex, ny * (x + y) / (nx + ny) AS ey FROM ce JOIN rr USING (a, b)),
c2 AS (SELECT a, b, sum(CASE WHEN cols = 2 THEN greatest(abs(x - ex) - 0.5, 0) ** 2 / ex + greatest(abs(y - ey) - 0.5, 0) ** 2 / ey ELSE (x - ex) ** 2 / ex + (y - ey) ** 2 / ey END) AS chi2 FROM e GROUP BY ALL),
ch AS (SELECT rr.a, rr.b, coalesce(chi2, 0) + CASE WHEN cols = 2 THEN 0 ELSE ax * ny / nx + bx * nx / ny END AS chi2, (nx + ny)::BIGINT AS n, cols - 1 AS df FROM rr LEFT JOIN c2 USING (a, b))
SELECT a, b, round(chi2 + 1e-9, 6) AS chi2, n, df, round(sqrt(greatest(chi2, 0) / n) + 1e-12, 9) AS v FROM ch"""


ORACLES = {
    "bigram_counts": f"WITH {SENT}{BI} SELECT * FROM bi",
    "trigram_counts": f"WITH {SENT}{TRI} SELECT * FROM tri",
    "word_expectations": f"WITH {SENT} SELECT word, n, round(n / total::DOUBLE, 9) AS e FROM cnt, total",
    "length1_expectations": f"WITH {SENT}, x AS (SELECT w[1] AS word, count(*) AS n FROM sent WHERE len(w) = 1 GROUP BY ALL) SELECT word, n, round(n / total::DOUBLE, 9) AS e FROM x, total",
    "length2_expectations": f"WITH {SENT}, x AS (SELECT w[1] AS w1, w[2] AS w2, count(*) AS n FROM sent WHERE len(w) = 2 GROUP BY ALL) SELECT w1, w2, n, round(n / total::DOUBLE, 9) AS e FROM x, total",
    "bigram_pmi": f"""WITH {SENT}{BI} SELECT w1, w2, bi.n, round(ln(bi.n) + ln(total) - ln(a.n) - ln(b.n), 9) + 0 AS pmi
FROM bi JOIN cnt a ON a.word = w1 JOIN cnt b ON b.word = w2, total WHERE w1 <> '<s>' AND w2 <> '<s>'""",
    "context_counts_k2": f"""WITH {SENT}{TOPQ}, p2 AS (SELECT w, list_concat(['<s>', '<s>'], w, ['<s>', '<s>']) AS p FROM sent),
c AS (SELECT p, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM p2)
SELECT word, array_to_string(list_concat(p[i:i+1], p[i+3:i+4]), ' ') AS ctx, count(*) AS n FROM c WHERE word IN (SELECT word FROM top) GROUP BY ALL""",
    "gap_correction": f"""WITH {SENT}, g1 AS (SELECT unnest(list_zip(p[1:-3], p[3:])) AS c FROM padded), g2 AS (SELECT unnest(list_zip(p[1:-4], p[4:])) AS c FROM padded WHERE len(w) > 1),
c1 AS (SELECT c[1] AS l, c[2] AS r, count(*) AS c1 FROM g1 GROUP BY ALL), c2 AS (SELECT c[1] AS l, c[2] AS r, count(*) AS c2 FROM g2 GROUP BY ALL),
t AS (SELECT sum(len(w)) AS t1, sum(len(w) - 1) AS t2 FROM sent)
SELECT l, r, c1, coalesce(c2, 0) AS c2, round(ln(c1) - ln(coalesce(c2, 0.5)) + ln(t2) - ln(t1), 9) AS gap FROM c1 LEFT JOIN c2 USING (l, r), t""",
    "vocab_ids": f"WITH {SENT} SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS id FROM cnt WHERE n >= 2",
    "unk_replace": f"WITH {SENT} SELECT doc_id, sno::INTEGER AS sno, string_agg(CASE WHEN n >= {MIN_COUNT} THEN word ELSE 'unk' END, ' ' ORDER BY pos) AS s FROM tok JOIN cnt USING (word) GROUP BY ALL",
    "freq_of_freq": f"WITH {SENT} SELECT n AS r, count(*) AS nr FROM cnt GROUP BY ALL",
    "good_turing_loglinear": f"""WITH {SENT}, f AS (SELECT n AS r, count(*) AS nr FROM cnt GROUP BY ALL),
a AS (SELECT r, nr, coalesce(lag(r) OVER (ORDER BY r), 0) AS b, coalesce(lead(r) OVER (ORDER BY r), 2 * r - coalesce(lag(r) OVER (ORDER BY r), 0)) AS c FROM f),
z AS (SELECT r, nr, 2.0::DOUBLE * nr / (c - b) AS z FROM a), fit AS (SELECT regr_slope(ln(z), ln(r)) AS s, regr_intercept(ln(z), ln(r)) AS i FROM z),
t AS (SELECT sum(r * nr)::DOUBLE AS total, coalesce(max(CASE WHEN r = 1 THEN nr END), 0) AS n1 FROM f),
st AS (SELECT r, nr, z, (r + 1) * exp(s * ln(r + 1) + i) / exp(s * ln(r) + i) AS rs, n1 / total AS p0 FROM z, fit, t)
SELECT r, nr, round(z, 6) AS z, round(rs, 6) AS r_star, round((1 - p0) * rs / (SELECT sum(rs * nr) FROM st), 12) AS p, round(p0, 9) AS p0 FROM st""",
    "context_features_marginal": f"WITH {SENT}{BI}{CL}{MARG} SELECT * FROM marg",
    "context_features_joint": f"""WITH {SENT}{TRI}{CL} SELECT w2 AS word, coalesce(a.cid, 0) * {N_CLUSTERS + 1} + coalesce(b.cid, 0) AS feature, sum(tri.n)::BIGINT AS value
FROM tri LEFT JOIN cl a ON a.word = w1 LEFT JOIN cl b ON b.word = w3 GROUP BY ALL""",
    "cluster_bigram_table": f"WITH {SENT}{BI}{CL}{CTAB} SELECT * FROM ct",
    "exchange_objective": f"""WITH {SENT}{BI}{CL}{CTAB}, u AS (SELECT c1, sum(n)::DOUBLE AS u1 FROM ct GROUP BY c1), v AS (SELECT c2, sum(n)::DOUBLE AS u2 FROM ct GROUP BY c2)
SELECT round(sum(n * ln(n / (u1 * u2))), 3) AS objective FROM ct JOIN u USING (c1) JOIN v USING (c2)""",
    "word_context_long": f"WITH {SENT}{BI}{WCTX} SELECT * FROM wc",
    "chi2_pairs": f"WITH {SENT}{BI}{WCTX}{TOPQ}, src AS (SELECT * FROM wc WHERE word IN (SELECT word FROM top)), {_chi2('src')}",
    "segment_association": f"WITH src AS (SELECT c_mktsegment AS word, 'nation' AS side, c_nationkey::VARCHAR AS ctx, count(*) AS n FROM customer GROUP BY ALL), {_chi2('src')}",
    "renyi_pairs": f"WITH {SENT}{BI}{CL}{MARG}{TOPQ}{DIST} SELECT a, b, CASE WHEN bool_or(p > 0 AND q <= 0) THEN 'inf'::DOUBLE ELSE round(ln(sum(CASE WHEN p > 0 AND q > 0 THEN p * (p / q) ELSE 0 END)), 9) END AS d FROM pq GROUP BY ALL",
    "kl_pairs": f"WITH {SENT}{BI}{CL}{MARG}{TOPQ}{DIST} SELECT a, b, CASE WHEN bool_or(p > 0 AND q <= 0) THEN 'inf'::DOUBLE ELSE round(sum(CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) ELSE 0 END), 9) END AS d FROM pq GROUP BY ALL",
    "violation_fraction": f"WITH {SENT}{BI}{CL}{MARG}{TOPQ}{DIST} SELECT a, b, round(avg(CASE WHEN ln(p) - ln(q) < -0.5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS vf FROM pq WHERE p > 0 AND q > 0 GROUP BY ALL",
    "shrinkage_rows": f"""WITH {SENT}{BI}{CL}{MARG}, m AS MATERIALIZED (SELECT * FROM marg), nn AS (SELECT word, sum(value)::DOUBLE AS n FROM m GROUP BY word),
g AS (SELECT feature, sum(value)::DOUBLE AS g FROM m GROUP BY feature), t AS (SELECT sum(value)::DOUBLE AS t, count(DISTINCT feature)::DOUBLE AS f FROM m)
SELECT nn.word, g.feature, round((1 - f / (f + n)) * coalesce(m.value, 0) / n + f / (f + n) * g / t, 12) AS p FROM nn, g, t LEFT JOIN m ON m.word = nn.word AND m.feature = g.feature""",
    "basis_distance": """WITH b AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, round(sqrt(greatest(list_dot_product(x.v, x.v) - (list_dot_product(x.v, b.v) / sqrt(list_dot_product(b.v, b.v))) ** 2, 0)), 6) AS distance FROM x, b""",
    "variation_of_information": """WITH j AS (SELECT lang, source, count(*)::DOUBLE AS n FROM documents GROUP BY ALL), p AS (SELECT lang, sum(n) AS na FROM j GROUP BY lang), q AS (SELECT source, sum(n) AS nb FROM j GROUP BY source), t AS (SELECT sum(n) AS t FROM j)
SELECT round(-sum(n / t * (ln(n / na) + ln(n / nb))), 9) AS vi FROM j JOIN p USING (lang) JOIN q USING (source), t""",
}
