"""What grows with the corpus: which tables are shuffled, how often, and that the plainer sums stay."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.operators import contextmodels
from spanwright.operators import tokens as T


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def corpus(spark, n=120, words=40, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(k, 0, [f"w{x}" for x in rng.zipf(1.3, rng.integers(1, 9)) if x < words] or ["w1"]) for k in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, sno int, w array<string>")


def test_contexts_of_a_list_shuffle_no_sentences(spark):
    _, df = corpus(spark)
    wanted = spark.createDataFrame([("w1", 3), ("w2", 2)], "word string, n long")
    plan = plan_of(T.contexts(df, wanted))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("alpha", [1, 2.0, 5.0])
def test_divergences_of_contexts_that_many_words_hold(spark, alpha):
    rows, df = corpus(spark, 400)
    rows += [(10_000 + k, 0, [f"w{k}"]) for k in range(1, 31)]  # one context of thirty words
    df = df.unionByName(spark.createDataFrame(rows[400:], df.schema))
    words = T.word_counts(df).where(F.col("word").isin([f"w{k}" for k in range(1, 31)]))
    n = {r["word"]: r["n"] for r in words.collect()}
    c = {w: Counter() for w in n}
    for _, _, w in rows:
        p = ["<s>", *w, "<s>"]
        for i, x in enumerate(w):
            if x in n:
                c[x][p[i], p[i + 2]] += 1
    want = {}
    for a in n:
        for b in n:
            r = {k: (x + 0.1) / (c[b][k] + 0.1) for k, x in c[a].items()}
            t = sum(x / n[a] * (math.log(r[k]) if alpha == 1 else r[k] ** (alpha - 1)) for k, x in c[a].items())
            if a != b:
                want[a, b] = (t if alpha == 1 else math.log(t) / (alpha - 1)) + math.log(n[b]) - math.log(n[a])
    assert max(len({a for a in c if k in c[a]}) for k in {k for x in c.values() for k in x}) > contextmodels.FEW_HOLDERS
    got = {(r["a"], r["b"]): r["d"] for r in contextmodels.pair_divergences(df, words, alpha).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_rows_of_the_anchor_search_read_no_text(spark):
    from spanwright.plans import model_queries as M

    assert "Scan parquet" not in plan_of(M._rows(spark, "/root/testdata/sf0.001"))


def test_candidates_are_tested_on_a_checkpoint(spark, monkeypatch):
    from spanwright.operators import induction as I

    rows = [(w, "left", c, n) for w, c, n in [("a", "x", 40), ("a", "y", 2), ("b", "x", 3), ("b", "y", 50), ("c", "x", 9)]]
    seen = []
    real = I.stats.chi2_pairs
    monkeypatch.setattr(I.stats, "chi2_pairs", lambda c, **k: seen.append(c) or real(c, **k))
    contexts = spark.createDataFrame(rows, "word string, side string, ctx string, n long").groupBy("word", "side", "ctx").agg(F.sum("n").alias("n"))
    assert I.distinct_from(contexts, "a", ["b"]).distinct
    assert "HashAggregate" not in plan_of(seen[0])


def test_equal_sentences_are_parsed_once(spark, tmp_path):
    """Counts of a corpus many times over are so many times the counts, from as many charts."""
    from spanwright.operators import charts, general

    rules = spark.createDataFrame([("S", "A", "A", 1.0), ("A", "A", "A", 0.3), ("A", "x", None, 0.4), ("A", "y", None, 0.3)], "lhs string, r1 string, r2 string, p double")
    one = [["x", "y", "x"], ["y", "y"], ["x"], [], None, ["x", None]]
    frame = lambda times: spark.createDataFrame([(k, w) for k, w in enumerate(one * times)], "id int, w array<string>")
    assert general.distinct_sentences(frame(50)).count() == len(one)
    for count in (lambda s: general.expected_counts(general.from_binary(rules), s), lambda s: charts.expected_counts(s, charts.chart_of(rules))):
        a, b = ({tuple(map(str, r[:-1])): r[-1] for r in count(frame(t)).collect()} for t in (1, 50))
        assert {k: v * 50 for k, v in a.items()} == pytest.approx(b)
        assert a


def test_lists_of_words_shuffle_no_corpus(spark):
    from spanwright.operators import induction as I

    _, df = corpus(spark)
    b = T.bigram_counts(df)
    wanted = spark.createDataFrame([("w1", 3), ("w2", 2)], "word string, n long")
    assert "SortMergeJoin" not in plan_of(T.word_contexts(b, F.broadcast(wanted)))
    clusters = F.broadcast(spark.createDataFrame([("w1", 1), ("w2", 2)], "word string, cid int"))
    assert "SortMergeJoin" not in plan_of(I.pair_features(df, I.kernel_map(spark, [I.START, "w1", "w2"]), clusters, 3))


@pytest.mark.parametrize("head", [0, 2, 50])
def test_features_are_counted_by_cluster(spark, head):
    """Words are clusters before they are counted: rows as those of the n-gram tables, whether a word is looked up or met by a shuffle."""
    _, df = corpus(spark)
    counts = T.word_counts(df)
    clusters = T.hashed_clusters(counts, 4, 3)
    assert clusters.count() > 2
    rows = lambda x: sorted(map(tuple, x.select("word", "feature", "value").collect()))
    assert rows(T.marginal_features_of(df, clusters, counts, 4, head=head)) == rows(T.marginal_features(T.bigram_counts(df), clusters, 4))
    assert rows(T.joint_features_of(df, clusters, counts, 4, head=head)) == rows(T.joint_features(T.trigram_counts(df), clusters, 4))


def test_features_shuffle_no_ngrams(spark):
    from spanwright.plans import corpus_queries as W

    for query in (W.joint, W.marginal):
        assert "SortMergeJoin" not in plan_of(query(spark, "/root/testdata/sf0.001"))


def test_pair_tables_count_wanted_words_alone(spark):
    from spanwright.plans import corpus_queries as W

    _, df = corpus(spark)
    counts = T.word_counts(df)
    clusters, wanted = T.hashed_clusters(counts, 4, 3), counts.where("word in ('w1', 'w3')")
    rows = lambda x: sorted(map(tuple, x.select("word", "feature", "value").collect()))
    assert rows(T.marginal_features_of(df, clusters, counts, 4, wanted)) == [r for r in rows(T.marginal_features(T.bigram_counts(df), clusters, 4)) if r[0] in ("w1", "w3")]
    assert "SortMergeJoin" not in plan_of(W._top_pairs(spark, "/root/testdata/sf0.001"))


def test_shrunk_rows_join_no_grid(spark):
    from spanwright.operators import stats as S

    rows = [("a", 0, 3), ("a", 2, 1), ("b", 1, 5), ("c", 2, 2)]
    x = S.shrunk(spark.createDataFrame(rows, "word string, feature int, value long"))
    plan = plan_of(x)
    assert "SortMergeJoin" not in plan and "Window" not in plan
    n, g = {"a": 4, "b": 5, "c": 2}, {0: 3, 1: 5, 2: 3}
    value = {r[:2]: r[2] for r in rows}
    want = {(w, f): (1 - 3 / (3 + n[w])) * value.get((w, f), 0) / n[w] + 3 / (3 + n[w]) * g[f] / 11 for w in n for f in g}
    assert {(r["word"], r["feature"]): r["p"] for r in x.collect()} == pytest.approx(want, abs=1e-11)


def test_given_anchors_need_no_bigrams(spark, monkeypatch):
    """A grammar of given anchors counts clusters beside words, and no bigram table is made."""
    from spanwright.operators import induction as I

    _, df = corpus(spark)
    clusters = T.hashed_clusters(T.word_counts(df), 4, 3)
    monkeypatch.setattr(T, "bigram_counts", None)
    learned = I.learn(df, clusters, 4, kernels=[I.START, "w1", "w2"])
    assert {"S", "NT_w1", "NT_w2"} == {r["lhs"] for r in learned.wcfg.select("lhs").distinct().collect()}


def test_equal_order_trees_are_read_once(spark, monkeypatch):
    from spanwright.operators import nary
    from spanwright.plans import general_queries as Q

    seen = []
    real = nary.mapped
    monkeypatch.setattr(nary, "mapped", lambda t, *a: seen.append(t) or real(t, *a))
    rows = Q.binarised_round_trip(spark, "/root/testdata/sf0.001").count()
    assert rows == Q.order_trees(spark, "/root/testdata/sf0.001").count()
    assert all(x.count() == x.select("value" if "value" in x.columns else "two").distinct().count() < rows for x in seen)
    once = spark.createDataFrame([("(S (A a) (A b))", 3), ("(S (A a))", 1)], "value string, times long")
    many = spark.createDataFrame([("(S (A a) (A b))",)] * 3 + [("(S (A a))",)], "value string")
    table = lambda x: {(r["lhs"], tuple(r["rhs"])): (r["n"], r["p"]) for r in x.collect()}
    assert table(nary.rules_of(nary.productions(once), "times")) == table(nary.rules_of(nary.productions(many)))


def test_samples_are_scored_in_one_pass(spark):
    from spanwright.operators import charts, evaluation, sampling

    rows = [("S", "A", "A", 1.0), ("A", "A", "A", 0.3), ("A", "x", None, 0.4), ("A", "y", None, 0.3)]
    g = spark.createDataFrame(rows, "lhs string, r1 string, r2 string, p double")
    h = spark.createDataFrame([r for r in rows if r[1] != "y"], g.schema)  # has no y
    scored = sampling.scored_samples(g, 60, 1, 12, models={"h": h})
    assert "Join" not in plan_of(scored) and plan_of(evaluation.sampled_divergences(scored, ["h"])).count("Range") == 1
    for r in scored.collect():
        assert (r["h_tree"] is None) == (r["h_string"] is None) == (r["h_bracket"] is None) == (" y)" in r["tree"])
        assert r["target_tree"] <= r["target_bracket"] + 1e-9 <= r["target_string"] + 2e-9
    c = charts.Chart(rows)
    sents = [["x", "y", "x"], [], ["y"], ["x", "z"], ["x", "x"], ["y", "y", "y"], ["x", "y", "x", "x", "y"]]
    want = [c.log_probability(w) for w in sents]
    got = c.log_probabilities(sents)
    assert [x is None for x in got] == [x is None for x in want]
    assert [x for x in got if x is not None] == pytest.approx([x for x in want if x is not None])


@pytest.mark.parametrize("first", [0, 3, 1000])
def test_common_words_are_numbered_where_they_stand(spark, first):
    """Ids as those of a join of all tokens; only tokens of other words are shuffled, none where all are known."""
    rows, df = corpus(spark)
    v = T.vocabulary(T.word_counts(df), 3)
    of = {r["word"]: r["id"] for r in v.collect()}
    x = T.numbered(df, v, first)
    assert {(r["doc_id"], r["sno"]): r["ids"] for r in x.collect()} == {(d, s): [of.get(t, 0) for t in w] for d, s, w in rows}
    assert ("Join" in plan_of(x)) == (first < len(of))


@pytest.mark.parametrize("head", [3, 1000])
def test_exchange_numbers_its_bigrams_once(spark, head):
    from spanwright.operators import clustering as C

    _, df = corpus(spark, 300)
    b, counts = T.bigram_counts(df).cache(), T.word_counts(df)
    start = T.hashed_clusters(counts, 5, 2)
    pairs = C.Pairs(T.bigrams(df), start, counts, head)
    at = pairs.numbered(start).cache()
    assert (pairs.rare is None) == (head == 1000)
    cid, names = {r["word"]: r["cid"] for r in at.collect()}, {r["id"]: r["word"] for r in at.collect()}
    want = {w: Counter() for w in cid}
    for r in b.collect():
        for w, place in ((r["w1"], cid.get(r["w2"], 0)), (r["w2"], 5 + cid.get(r["w1"], 0))):
            if w in cid and r["w1"] != r["w2"]:
                want[w][place] += r["n"]
        if r["w1"] == r["w2"] and r["w1"] in cid:
            want[r["w1"]][10] += r["n"]
    profiles = C._profiles(pairs, at, 5)
    assert {names[r["id"]]: Counter({x["at"]: x["n"] for x in r["p"]}) for r in profiles.collect()} == want
    if head == 1000:  # a sweep shuffles what tasks have added up, no bigrams
        assert "Join" not in plan_of(profiles) and "Join" not in plan_of(C._tried(pairs, at.withColumns({"to": F.lit(1), "sets": F.lit(1)}), 5, 2))
    counted, raw = C.exchange_together(b, start, 5, head=head), C.exchange_together(T.bigrams(df), start, 5, counts=counts)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, raw.collect()))


def test_trigrams_are_counted_over_evenly_dealt_texts(spark):
    from spanwright.plans import corpus_queries as W

    plan = plan_of(W.QUERIES["trigram_counts"](spark, "/root/testdata/sf0.001"))
    assert "RoundRobinPartitioning" in plan
    docs = spark.createDataFrame([(1, "a b c. a b"), (2, None), (3, ""), (1, "a b c")], "doc_id long, text string")
    plain, dealt = (sorted(map(tuple, T.trigram_counts(T.sentences(d)).collect())) for d in (docs, T.dealt(docs)))
    assert plain == dealt and ("a", "b", "c", 2) in dealt


@pytest.mark.parametrize(("chunk", "shares"), [(7, 3), (1 << 20, None)])
def test_bigram_scores_shuffle_no_tokens(spark, chunk, shares):
    """Chunks send their different pairs; scores are those of counts over all sentences, with a key of any type."""
    from spanwright.operators import bigram_scores

    rows, df = corpus(spark, 200)
    rows += [(500, 0, ["été", "a", "a"]), (501, 1, ["x" * 300, "w1"])]
    df = spark.createDataFrame([(str(d), s, w) for d, s, w in rows], "doc_id string, sno int, w array<string>").repartition(3)
    n, m = Counter(), Counter()
    for _, _, w in rows:
        p = ["<s>", *w, "<s>"]
        n.update(zip(p, p[1:]))
        m.update(p[:-1])
    want = {(str(d), s): sum(math.log((n[x] + 1) / (m[x[0]] + len(m))) for x in zip(["<s>", *w], [*w, "<s>"])) for d, s, w in rows}
    got = bigram_scores.sentence_scores(df, T.word_counts(df).count() + 1, chunk, shares)
    assert {(r["doc_id"], r["sno"]): r["lp"] for r in got.collect()} == pytest.approx(want, abs=1e-9)


def test_bigram_model_joins_no_tokens(spark):
    from spanwright.plans import model_queries as M

    plan = plan_of(M.bigram_model(spark, "/root/testdata/sf0.001"))
    assert "Join" not in plan and "hashpartitioning(doc_id" not in plan


@pytest.mark.parametrize("head", [0, 2, 50])
def test_word_rows_are_counted_by_chunk(spark, head):
    """Rows as the features of the n-gram tables, whether a neighbour is looked up or met by a shuffle, over chunks of any size."""
    from spanwright.operators import word_rows

    _, df = corpus(spark)
    df = df.repartition(3)
    counts, n = T.counted(df)
    clusters = T.hashed_clusters(counts, 4, 3)
    assert n == df.count() and sorted(map(tuple, counts.collect())) == sorted(map(tuple, T.word_counts(df).collect()))
    for chunk, shares, unknown in ((9, 3, 0), (1 << 20, None, 2)):
        want = {(r["word"], r["feature"]): r["value"] for r in T.marginal_features(T.bigram_counts(df), clusters, 4, unknown).collect()}
        got = word_rows.marginal_rows(df, clusters, counts, 4, head, chunk, shares, unknown).collect()
        assert len(got) == len({r["word"] for r in got}) and {(r["word"], a): n for r in got for a, n in zip(r["at"], r["n"], strict=True)} == want


@pytest.mark.parametrize("head", [0, 2, 50])
def test_pairs_of_many_members_meet_where_they_stand(spark, head):
    """Features of pairs as those of two joins, whether a word is looked up or met by a shuffle; only pairs of rarer words are shuffled."""
    from spanwright.operators import induction as I

    _, df = corpus(spark, 300)
    counts = T.word_counts(df).cache()
    clusters = T.hashed_clusters(counts, 4, 3)
    members = spark.createDataFrame([("w1", "w1"), ("w2", "w2"), ("w5", "w1"), ("w9", "w2"), ("w30", "w2")], "word string, kernel string")
    rows = lambda x: sorted(map(tuple, x.select("b", "c", "feature", "value").collect()))
    got = I.pair_features(df, members, clusters, 4, counts, head)
    assert rows(got) == rows(I.pair_features(df, members, clusters, 4)) and got.count() > 10
    met = plan_of(I._standing(spark.createDataFrame([("a", "w1", "w2", "b")], "l string, u string, v string, r string"), members, counts, head))
    assert ("hashpartitioning(__key" in met) == (head < 50)


def test_learning_keeps_no_sentences_and_shuffles_no_pairs_of_words(spark, monkeypatch):
    """What ``learn`` keeps has a row for each word at most, and words that stand for anchors go to every task."""
    from spanwright.operators import induction as I

    _, df = corpus(spark, 400)
    counts = T.word_counts(df)
    clusters = T.hashed_clusters(counts, 4, 3)
    kept, real = [], I.cut
    monkeypatch.setattr(I, "cut", lambda x: kept.append((x.columns, plan_of(x), x.count())) or real(x))
    out = I.learn(df, clusters, 4, kernels=[I.START, "w1", "w2"])
    rules = I.to_pcfg(out.wcfg)
    assert max(n for _, _, n in kept) <= counts.count() and "w" not in {c for x, _, _ in kept for c in x}
    pairs = [plan for columns, plan, _ in kept if columns == ["b", "c", "feature", "value"]]
    assert len(pairs) == 1 and "SortMergeJoin" not in pairs[0]
    assert {r["lhs"] for r in rules.select("lhs").distinct().collect()} == {"S", "NT_w1", "NT_w2"}
