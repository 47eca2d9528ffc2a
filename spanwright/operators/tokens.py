"""Sentences, tokens, n-grams, vocabularies and contexts of a corpus, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanwright.operators.lineage import cut

BOUNDARY = "<s>"


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sno, w): a text's non-empty sentences, cut at full stops and line ends, lower-cased, letters only."""
    # one generator over finished sentences: a filter behind it would split the text a second time
    each = F.transform(F.split(F.lower(text_col), r"[.\n]+"), lambda t, k: F.struct(k.alias("sno"), F.regexp_extract_all(t, F.lit(r"(\p{L}+)"), F.lit(1)).alias("w")))
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(F.filter(each, lambda x: F.size(x["w"]) > 0)))


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 8) -> DataFrame:
    """The texts, dealt evenly over ``share`` tasks for each split of their files: most n-grams are rare, so a task's partial counts are as
    long as its text, and those of a whole split leave its memory and are sorted on disk."""
    rows = docs.select(id_col, text_col)
    return rows.repartition(share * max(1, rows.rdd.getNumPartitions()))


def sequences(events: DataFrame, key: str, order: list[str], symbol: str, length: int) -> DataFrame:
    """(key, chunk, w): each key's symbols in order, cut into chunks of at most ``length``."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    placed = events.select(key, F.col(symbol).alias("s"), k.alias("k"))
    chunk = F.floor(F.col("k") / length).cast("long").alias("chunk")
    return placed.groupBy(key, chunk).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("w"))


def tokens(sents: DataFrame) -> DataFrame:
    """One row per token: (doc_id, sno, pos, word)."""
    return sents.select("doc_id", "sno", F.posexplode("w").alias("pos", "word"))


def word_counts(sents: DataFrame) -> DataFrame:
    return sents.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def counted(sents: DataFrame) -> tuple[DataFrame, int]:
    """Word counts as a checkpoint, and the number of sentences: each counts as one null behind its words, so the text is read once."""
    both = cut(word_counts(sents.select(F.concat("w", F.array(F.lit(None).cast("string"))).alias("w"))))
    ends = both.where("word IS NULL").first()
    return both.where("word IS NOT NULL"), ends["n"] if ends else 0


def counts_of(ngrams: DataFrame, word: str = "w2") -> DataFrame:
    """Word counts from an n-gram table, whose exchange Spark then uses for both."""
    return ngrams.where(F.col(word) != BOUNDARY).groupBy(F.col(word).alias("word")).agg(F.sum("n").alias("n"))


def _padded(w: Column) -> Column:
    return F.concat(F.array(F.lit(BOUNDARY)), w, F.array(F.lit(BOUNDARY)))


def bigrams(sents: DataFrame) -> DataFrame:
    """(w1, w2) of all neighbours, the boundary on both sides included."""
    p = _padded(F.col("w"))
    return sents.select(F.inline(F.arrays_zip(F.slice(p, 1, F.size(p) - 1).alias("w1"), F.slice(p, 2, F.size(p) - 1).alias("w2"))))


def bigram_counts(sents: DataFrame) -> DataFrame:
    """Counts of neighbours, the boundary on both sides included."""
    return bigrams(sents).groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"))


def trigram_counts(sents: DataFrame) -> DataFrame:
    """Counts of (left, centre, right) around every token."""
    p = _padded(F.col("w"))
    n = F.size("w")
    rows = sents.select(F.explode(F.arrays_zip(F.slice(p, 1, n).alias("w1"), F.slice(p, 2, n).alias("w2"), F.slice(p, 3, n).alias("w3"))).alias("b"))
    return rows.groupBy("b.w1", "b.w2", "b.w3").agg(F.count(F.lit(1)).alias("n"))


def inner_bigrams(sents: DataFrame) -> DataFrame:
    """Counts of neighbours within sentences."""
    return bigram_counts(sents).where((F.col("w1") != BOUNDARY) & (F.col("w2") != BOUNDARY))


def expectations(counts: DataFrame, n_sentences: DataFrame) -> DataFrame:
    """Counts per sentence; ``n_sentences`` is a frame of one row and column."""
    total = n_sentences.select(F.col(n_sentences.columns[0]).alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("e", F.round(F.col("n") / F.col("total"), 9)).drop("total")


def sentence_count(sents: DataFrame) -> DataFrame:
    return sents.agg(F.count(F.lit(1)).alias("total"))


def of_length(sents: DataFrame, n: int) -> DataFrame:
    """Counts of the sentences of exactly n words, a column for each word."""
    names = ["word"] if n == 1 else [f"w{k + 1}" for k in range(n)]
    return sents.where(F.size("w") == n).select(*[F.col("w")[k].alias(c) for k, c in enumerate(names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, min_count: int = 1) -> DataFrame:
    """(word, n, id): ids from 1 by descending count, then word; the boundary has 0.

    Ids are ranks within ranges plus the sizes of the ranges before: a range is one count and two first letters for rare words, of
    which there are most, and a power of two of counts for others, so no task holds the whole vocabulary.
    """
    rare = F.col("n") < 64
    ranked = counts.where(F.col("n") >= min_count).withColumns({"level": F.when(rare, -F.col("n")).otherwise(-64 - F.floor(F.log2(F.col("n").cast("double")))).cast("long"), "head": F.when(rare, F.substring("word", 1, 2)).otherwise("")})
    sizes = ranked.groupBy("level", "head").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("level", "head", F.coalesce(F.sum("size").over(Window.orderBy("level", "head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = ranked.withColumn("k", F.row_number().over(Window.partitionBy("level", "head").orderBy(F.desc("n"), "word")))
    return local.join(before, ["level", "head"]).select("word", "n", (F.col("k") + F.col("before")).cast("long").alias("id"))


#: Ids of what is no word: padding, start and end of a sentence, unknown words (fixed values).
SPECIAL = {"<pad>": 0, "<sos>": 1, "<eos>": 2, "<unk>": 3}


def special_vocabulary(counts: DataFrame, min_count: int = 1) -> DataFrame:
    """(word, id): the special tokens, and behind them the words by descending count."""
    own = counts.sparkSession.createDataFrame(sorted(SPECIAL.items(), key=lambda x: x[1]), "word string, id long")
    return own.unionByName(vocabulary(counts, min_count).select("word", (F.col("id") + len(SPECIAL) - 1).alias("id")))


def encoded(sents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(keys, ids): sentences as ids between start and end, unknown words as <unk>."""
    keys = [c for c in sents.columns if c != "w"]
    t = sents.select(*keys, F.posexplode_outer("w").alias("pos", "word")).join(vocabulary.select("word", "id"), "word", "left")
    inner = F.transform(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(SPECIAL["<unk>"])).alias("id"))))), lambda x: x["id"])
    return t.groupBy(*keys).agg(F.concat(F.array(F.lit(SPECIAL["<sos>"]).cast("long")), inner, F.array(F.lit(SPECIAL["<eos>"]).cast("long"))).alias("ids"))


#: Words of the least ids that go to every task as a dictionary; others are met by a shuffle of the tokens that are not among them.
FIRST_IDS = 200_000


def numbered(sents: DataFrame, vocabulary: DataFrame, first: int = FIRST_IDS) -> DataFrame:
    """(keys, ids): sentences as ids of a vocabulary whose ids start at 1, 0 for words that it lacks.

    The ``first`` ids (a list of fixed size) are looked up where the sentence lies, so only tokens of other words are shuffled one by
    one. ``vocabulary`` is read several times.
    """
    keys = [c for c in sents.columns if c != "w"]
    spark, own = sents.sparkSession, vocabulary.select("word", "id")
    all_known = own.where(F.col("id") > first).limit(1).count() == 0
    shared = spark.sparkContext.broadcast({r["word"]: r["id"] for r in own.where(F.col("id") <= first).collect()})
    schema = ", ".join(f"`{c}` {sents.schema[c].dataType.simpleString()}" for c in keys)
    sents = sents.select(*keys, "w")

    def looked_up(words: pa.Array) -> np.ndarray:
        x = words.dictionary_encode()  # each different word of a batch is looked up once
        return np.array([shared.value.get(w, 0) for w in x.dictionary.to_pylist()], np.int64)[x.indices.to_numpy()]

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # tokens of other words are left out, unless there are none
        for b in batches:
            w = b.column("w")
            ids, sizes = looked_up(w.flatten()), w.value_lengths().to_numpy()
            at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            take = np.ones(len(ids), bool) if all_known else ids > 0
            edges = np.append(0, np.cumsum(take))[np.append(0, np.cumsum(sizes))]
            part = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(at[take], pa.int32()), pa.array(ids[take])], names=["pos", "id"]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), part], names=[*keys, "part"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, sizes = b.column("w").flatten(), b.column("w").value_lengths().to_numpy()
            k = np.flatnonzero(looked_up(words) == 0)
            row = np.repeat(np.arange(len(sizes)), sizes)[k]
            pos = k - (np.cumsum(sizes) - sizes)[row]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row)) for c in keys), pa.array(pos, pa.int32()), words.take(pa.array(k))], names=[*keys, "pos", "word"])

    parts = sents.mapInArrow(known, f"{schema}, part array<struct<pos:int,id:long>>")
    if not all_known:
        met = sents.mapInArrow(others, f"{schema}, pos int, word string").join(own.where(F.col("id") > first), "word", "left")
        parts = parts.unionByName(met.select(*keys, F.array(F.struct("pos", F.coalesce("id", F.lit(0)).cast("long").alias("id"))).alias("part")))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.flatten(F.collect_list("part"))), lambda x: x["id"]).alias("ids"))


def decoded(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(keys, w): ids as words again, special ones left out but <unk>."""
    keys = [c for c in rows.columns if c != "ids"]
    t = rows.select(*keys, F.posexplode("ids").alias("pos", "id")).join(vocabulary.select("word", "id"), "id", "left")
    kept = F.when(~F.col("word").isin("<pad>", "<sos>", "<eos>"), F.struct("pos", "word"))
    return t.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["word"]).alias("w"))


def replace_rare(sents: DataFrame, counts: DataFrame, min_count: int, unk: str = "unk") -> DataFrame:
    """(doc_id, sno, s): sentences with words of fewer than ``min_count`` occurrences replaced."""
    t = tokens(sents).join(counts, "word")
    t = t.withColumn("out", F.when(F.col("n") >= min_count, F.col("word")).otherwise(unk))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]), " ")
    return t.groupBy("doc_id", "sno").agg(joined.alias("s"))


def contexts(sents: DataFrame, wanted: DataFrame, k: int = 2) -> DataFrame:
    """(word, ctx, n): counts of the k words on either side of each wanted word, boundary padded. The wanted words are a bounded list,
    which goes to every task: the tokens, with their sentences beside them, are not shuffled to meet it."""
    pad = F.array_repeat(F.lit(BOUNDARY), k)
    padded = sents.select(F.concat(pad, "w", pad).alias("p"), F.posexplode("w").alias("pos", "word"))
    ctx = F.concat_ws(" ", F.slice("p", F.col("pos") + 1, F.lit(k)), F.slice("p", F.col("pos") + k + 2, F.lit(k)))
    rows = padded.join(F.broadcast(wanted.select("word")), "word", "left_semi").select("word", ctx.alias("ctx"))
    return rows.groupBy("word", "ctx").agg(F.count(F.lit(1)).alias("n"))


def gap_correction(sents: DataFrame, min_count: int = 1) -> DataFrame:
    """Per context (left, right): ln c1 - ln c2 + ln T2 - ln T1 of its one-word against its two-word gaps.

    A context never seen around two words counts half there; only contexts of ``min_count`` one-word gaps are given.
    """
    p = _padded(F.col("w"))
    n = F.size("w")
    one = sents.select(F.explode(F.arrays_zip(F.slice(p, 1, n).alias("l"), F.slice(p, 3, n).alias("r"))).alias("c"))
    two = sents.where(n > 1).select(F.explode(F.arrays_zip(F.slice(p, 1, n - 1).alias("l"), F.slice(p, 4, n - 1).alias("r"))).alias("c"))
    c1 = one.groupBy("c.l", "c.r").agg(F.count(F.lit(1)).alias("c1"))
    c2 = two.groupBy("c.l", "c.r").agg(F.count(F.lit(1)).alias("c2"))
    totals = sents.agg(F.sum(n).alias("t1"), F.sum(n - 1).alias("t2"))
    rows = c1.where(F.col("c1") >= min_count).join(c2, ["l", "r"], "left").crossJoin(F.broadcast(totals))
    value = F.ln(F.col("c1").cast("double")) - F.ln(F.coalesce(F.col("c2").cast("double"), F.lit(0.5))) + F.ln(F.col("t2").cast("double")) - F.ln(F.col("t1").cast("double"))
    return rows.select("l", "r", "c1", F.coalesce("c2", F.lit(0)).alias("c2"), F.round(value, 9).alias("gap"))


def hashed_clusters(counts: DataFrame, n_clusters: int, min_count: int, seed: str = "7") -> DataFrame:
    """(word, cid): a deterministic start for the exchange: words of ``min_count`` occurrences dealt over 1 .. n_clusters - 1 by md5."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), "word")), 1, 8), 16, 10).cast("long")
    return counts.where(F.col("n") >= min_count).select("word", (1 + h % (n_clusters - 1)).cast("int").alias("cid"))


def _cid(frame: DataFrame, clusters: DataFrame, word: str, out: str, unknown: int = 0) -> DataFrame:
    """``frame`` with the cluster of a word column; the boundary has 0, words outside ``clusters`` have ``unknown``."""
    c = clusters.select(F.col("word").alias(word), F.col("cid").alias(out))
    return frame.join(c, word, "left").withColumn(out, F.coalesce(out, F.when(F.col(word) == BOUNDARY, F.lit(0)).otherwise(F.lit(unknown))))


def marginal_features(bigrams: DataFrame, clusters: DataFrame, n_clusters: int, unknown: int = 0) -> DataFrame:
    """(word, feature, value): counts of the left neighbour's cluster, and behind them of the right neighbour's; words outside ``clusters`` have ``unknown``."""
    left = _cid(bigrams, clusters, "w1", "c", unknown).where(F.col("w2") != BOUNDARY).select(F.col("w2").alias("word"), F.col("c").alias("feature"), "n")
    right = _cid(bigrams, clusters, "w2", "c", unknown).where(F.col("w1") != BOUNDARY).select(F.col("w1").alias("word"), (F.col("c") + n_clusters + 1).alias("feature"), "n")
    return left.unionByName(right).groupBy("word", "feature").agg(F.sum("n").alias("value"))


def joint_features(trigrams: DataFrame, clusters: DataFrame, n_clusters: int) -> DataFrame:
    """(word, feature, value): counts of the pair of the neighbours' clusters."""
    t = _cid(_cid(trigrams, clusters, "w1", "c1"), clusters, "w3", "c3")
    return t.groupBy(F.col("w2").alias("word"), (F.col("c1") * (n_clusters + 1) + F.col("c3")).alias("feature")).agg(F.sum("n").alias("value"))


#: Clustered words of the most occurrences that go to every task; rarer ones are met by a shuffle of what has them.
HEAD = 50_000


def by_cluster(rows: DataFrame, words: list[str], clusters: DataFrame, counts: DataFrame, head: int = HEAD, n: str | None = None, unknown: int = 0) -> DataFrame:
    """(other columns, words, n): counts of ``rows``, or sums of their column ``n``, with each of the ``words`` columns turned into its cluster:
    0 for the boundary, ``unknown`` for words outside ``clusters``.

    The ``head`` clustered words of the most occurrences (a list of fixed size) are looked up before anything is counted, so what
    is shuffled has a row for each cluster and no longer one for each n-gram. ``clusters`` and ``counts`` are read several times.
    """
    keys = [c for c in rows.columns if c not in words and c != n]
    total = (F.count(F.lit(1)) if n is None else F.sum(n)).alias("n")
    weight = [] if n is None else [n]
    own = clusters.select("word", "cid")
    all_known = own.limit(head + 1).count() <= head
    known = F.broadcast(own if all_known else own.join(counts.select("word", "n"), "word").orderBy(F.desc("n"), "word").limit(head).select("word", "cid"))
    for c in words:
        rows = rows.join(known.select(F.col("word").alias(c), F.col("cid").alias(f"__{c}")), c, "left")
    if all_known:
        outside = lambda c: F.when(F.col(c) == BOUNDARY, F.lit(0)).otherwise(F.lit(unknown))
        return rows.select(*keys, *(F.coalesce(f"__{c}", outside(c)).alias(c) for c in words), *weight).groupBy(*keys, *words).agg(total)
    place = lambda c: F.when(F.col(c) == BOUNDARY, F.lit(0)).otherwise(F.col(f"__{c}"))
    rows = rows.select(*keys, *(place(c).alias(f"__{c}") for c in words), *(F.when(place(c).isNull(), F.col(c)).alias(c) for c in words), *weight)
    counted = cut(rows.groupBy(*(c for c in rows.columns if c not in weight)).agg(total))
    rest = F.lit(False)
    for c in words:
        rest = rest | F.col(c).isNotNull()
    done, open_ = counted.where(~rest), counted.where(rest)
    for k, c in enumerate(words):
        # rows without a word here are dealt by a number: null keys would all meet in one task
        dealt = F.coalesce(c, F.concat(F.lit("\0"), F.xxhash64(*keys, *words).cast("string")))
        open_ = open_.withColumn("__key", dealt).join(own.select(F.col("word").alias("__key"), F.col("cid").alias("__cid")), "__key", "left")
        open_ = open_.withColumn(f"__{c}", F.coalesce(f"__{c}", "__cid", F.lit(unknown))).drop("__key", "__cid")
    both = done.unionByName(open_).select(*keys, *(F.col(f"__{c}").alias(c) for c in words), "n")
    return both.groupBy(*keys, *words).agg(F.sum("n").alias("n"))


def _beside(sents: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """(word, l, r) of every token, or of those of a bounded list of words, which goes to every task."""
    p, n = _padded(F.col("w")), F.size("w")
    rows = sents.select(F.explode(F.arrays_zip(F.slice(p, 1, n).alias("l"), F.col("w").alias("word"), F.slice(p, 3, n).alias("r"))).alias("b")).select("b.*")
    return rows if wanted is None else rows.join(F.broadcast(wanted.select("word")), "word", "left_semi")


def marginal_features_of(sents: DataFrame, clusters: DataFrame, counts: DataFrame, n_clusters: int, wanted: DataFrame | None = None, head: int = HEAD) -> DataFrame:
    """``marginal_features`` from the sentences, of all words or of a bounded list."""
    side = lambda k, c: F.struct("word", F.lit(k).alias("side"), F.col(c).alias("other"))
    rows = _beside(sents, wanted).select(F.inline(F.array(side(0, "l"), side(1, "r"))))
    x = by_cluster(rows, ["other"], clusters, counts, head)
    return x.select("word", (F.col("other") + F.col("side") * (n_clusters + 1)).alias("feature"), F.col("n").alias("value"))


def joint_features_of(sents: DataFrame, clusters: DataFrame, counts: DataFrame, n_clusters: int, head: int = HEAD) -> DataFrame:
    """``joint_features`` from the sentences."""
    x = by_cluster(_beside(sents, None), ["l", "r"], clusters, counts, head)
    return x.select("word", (F.col("l") * (n_clusters + 1) + F.col("r")).alias("feature"), F.col("n").alias("value"))


def cluster_bigrams(bigrams: DataFrame, clusters: DataFrame) -> DataFrame:
    """(c1, c2, n): the bigram table over clusters."""
    return _cid(_cid(bigrams, clusters, "w1", "c1"), clusters, "w2", "c2").groupBy("c1", "c2").agg(F.sum("n").alias("n"))


def exchange_objective(table: DataFrame) -> DataFrame:
    """Sum of n ln(n / (u1 u2)) over the cluster bigram table: what the exchange clustering raises."""
    rows = table.groupBy("c1").agg(F.sum("n").alias("u1"))
    cols = table.groupBy("c2").agg(F.sum("n").alias("u2"))
    x = table.join(F.broadcast(rows), "c1").join(F.broadcast(cols), "c2")
    n, u1, u2 = (F.col(c).cast("double") for c in ("n", "u1", "u2"))
    return x.agg(F.round(F.sum(n * F.ln(n / (u1 * u2))), 3).alias("objective"))


def word_contexts(bigrams: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(word, side, ctx, n): neighbours of the wanted words, or of all; boundary left out. A bounded list of words may come as F.broadcast(...)."""
    inner = bigrams.where((F.col("w1") != BOUNDARY) & (F.col("w2") != BOUNDARY))
    sides = F.explode(F.array(F.struct(F.col("w2").alias("word"), F.lit("left").alias("side"), F.col("w1").alias("ctx"), "n"), F.struct(F.col("w1").alias("word"), F.lit("right").alias("side"), F.col("w2").alias("ctx"), "n")))
    both = inner.select(sides.alias("x")).select("x.*")
    return both if wanted is None else both.join(wanted.select("word"), "word", "left_semi")
