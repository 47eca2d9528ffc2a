"""Exchange clustering of words on bigram mutual information.

What an exchange needs is aggregated by Spark: each word's counts with every cluster, and the cluster table. ``exchange_together``
is the distributed form: the exact gain of every move comes from the word's counts with each cluster, sets of moves are made together,
and it ends where no single move gains. Its bigrams are numbered and dealt by word once (``Pairs``); a sweep sends the clusters to them. ``exchange`` moves words one after the other, each seeing the moves before it, on the driver, over a table that
``max_words`` and ``max_pairs`` bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators.lineage import cut
from spanwright.operators.tokens import BOUNDARY, FIRST_IDS, by_cluster, cluster_bigrams, counts_of, vocabulary


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def objective(table: np.ndarray) -> float:
    """sum n ln(n / (u v)) of a square cluster table."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(1)).sum() - _xlogx(table.sum(0)).sum())


def exchange(bigrams: DataFrame, clusters: DataFrame, n_clusters: int, max_sweeps: int = 20, max_words: int = 2_000, max_pairs: int = 1_000_000) -> DataFrame:
    """(word, cid) after ordered sweeps, until no word moves. Words outside ``clusters`` and the boundary stay in cluster 0."""
    spark = bigrams.sparkSession
    rows = clusters.orderBy("word").limit(max_words + 1).collect()
    if len(rows) > max_words:
        raise ValueError(f"more than {max_words} words to move one by one: use exchange_together")
    words = [r["word"] for r in rows]
    at, cid = {w: k for k, w in enumerate(words)}, np.array([r["cid"] for r in rows], int)
    pool = clusters.select(F.col("word"))
    name = lambda c: F.when(F.col(c) == BOUNDARY, None).otherwise(F.col(c))
    known = bigrams.join(F.broadcast(pool.withColumnRenamed("word", "w1").withColumn("k1", F.lit(1))), "w1", "left").join(F.broadcast(pool.withColumnRenamed("word", "w2").withColumn("k2", F.lit(1))), "w2", "left")
    pairs = known.groupBy(F.when(F.col("k1") == 1, name("w1")).alias("a"), F.when(F.col("k2") == 1, name("w2")).alias("b")).agg(F.sum("n").alias("n")).limit(max_pairs + 1).collect()  # over the kept words
    if len(pairs) > max_pairs:
        raise ValueError(f"more than {max_pairs} pairs of words: use exchange_together")
    outside = len(words)
    cids = np.append(cid, 0)
    table = np.zeros((n_clusters, n_clusters))
    right: list[dict[int, float]] = [{} for _ in range(outside + 1)]
    left: list[dict[int, float]] = [{} for _ in range(outside + 1)]
    for r in pairs:
        i, j = at.get(r["a"], outside), at.get(r["b"], outside)
        right[i][j] = right[i].get(j, 0) + r["n"]
        left[j][i] = left[j].get(i, 0) + r["n"]
        table[cids[i], cids[j]] += r["n"]
    size = np.bincount(cid, minlength=n_clusters)
    for _ in range(max_sweeps):
        moved = False
        for w in range(outside):
            old = cids[w]
            if size[old] == 1:
                continue
            out_, in_ = np.zeros(n_clusters), np.zeros(n_clusters)
            for j, n in right[w].items():
                if j != w:
                    out_[cids[j]] += n
            for i, n in left[w].items():
                if i != w:
                    in_[cids[i]] += n
            own = right[w].get(w, 0.0)
            base = table.copy()
            base[old] -= out_
            base[:, old] -= in_
            base[old, old] -= own
            gains = np.full(n_clusters, -np.inf)
            for c in range(1, n_clusters):
                t = base.copy()
                t[c] += out_
                t[:, c] += in_
                t[c, c] += own
                gains[c] = objective(t)
            best = int(np.argmax(gains))
            if best != old and gains[best] > gains[old] + 1e-9:
                table = base
                table[best] += out_
                table[:, best] += in_
                table[best, best] += own
                size[old] -= 1
                size[best] += 1
                cids[w] = best
                moved = True
        if not moved:
            break
    return spark.createDataFrame([(w, int(c)) for w, c in zip(words, cids[:outside], strict=True)], "word string, cid int")


def cluster_table(bigrams: DataFrame, clusters: DataFrame, n_clusters: int) -> np.ndarray:
    """Counts of neighbouring clusters."""
    table = np.zeros((n_clusters, n_clusters))
    for r in cluster_bigrams(bigrams, clusters).collect():  # clusters squared rows
        table[r["c1"], r["c2"]] = r["n"]
    return table


def move_gains(table: np.ndarray, cid: np.ndarray, out: np.ndarray, in_: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What the objective gains by moving each word to each cluster, exactly.

    A word lies in ``cid`` and stands ``out[g]`` times before and ``in_[g]`` times behind other words of cluster g, ``own`` times before
    itself. A move from a to b changes rows and columns a and b of the table alone. Cluster 0 is no aim.
    """
    f, k, n = _xlogx, np.arange(len(table)), np.arange(len(cid))
    rows, cols, old = table[cid], table.T[cid], f(table)
    leave = (f(rows - out) - old[cid]), (f(cols - in_) - old.T[cid])  # (word, g): a's row and column
    enter = f(table[None] + out[:, None]) - old[None], f(table.T[None] + in_[:, None]) - old.T[None]  # (word, b, g)
    gain = sum(x.sum(1)[:, None] - x[n, cid][:, None] - x for x in leave)  # over g besides a and b
    gain = gain + sum(x.sum(2) - x[n, :, cid] - x[:, k, k] for x in enter)
    oa, ia, now = out[n, cid][:, None], in_[n, cid][:, None], own[:, None]
    aa, bb = table[cid, cid][:, None], table[k, k][None]
    gain += f(aa - oa - ia - now) - f(aa) + f(bb + out + in_ + now) - f(bb) + f(rows - out + ia) - f(rows) + f(cols + oa - in_) - f(cols)
    for total, moved in ((table.sum(1), out.sum(1) + own), (table.sum(0), in_.sum(1) + own)):
        gain -= (f(total[cid] - moved) - f(total[cid]))[:, None] + f(total[None] + moved[:, None]) - f(total)[None]
    gain[n, cid] = 0.0
    gain[:, 0] = -np.inf
    return gain


#: Stands for all words outside the clusters, where these are clustered as one word.
UNKNOWN = "<unk>"
#: Words of the most occurrences whose clusters go to every task, a list of fixed size; pairs with rarer ones are met by a shuffle.
HEAD = 1 << 20
BLOCKS = "word array<int>, other array<int>, side array<tinyint>, n array<bigint>"


class Pairs:
    """Bigrams of the clustered words by number, 0 for all else, as the sweeps read them. With ``unknown``, all words outside ``clusters`` are
    its word UNKNOWN, number 1, and 0 is the boundary alone.

    ``words`` (id, word) are numbered by falling occurrences. ``blocks`` has each pair of words up to ``head`` beside both of them,
    dealt and sorted by word, many in a row: side 0 where the word stands before the other, 1 behind it, 2 beside itself; 0 beside 0 is a row too. ``rare`` has the
    pairs (w1, w2, n) of words beyond, or is None.
    """

    def __init__(self, bigrams: DataFrame, clusters: DataFrame, counts: DataFrame | None = None, head: int = HEAD, looked_up: int = FIRST_IDS, unknown: bool = False) -> None:
        n = "n" if "n" in bigrams.columns else None
        counts = counts_of(bigrams) if counts is None else counts
        own = clusters.select("word").join(counts.select("word", "n"), "word", "left").select("word", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        if unknown:  # first of the numbers
            own = own.withColumn("n", F.when(F.col("word") == UNKNOWN, F.lit(1 << 62)).otherwise(F.col("n")))
        ranked = cut(vocabulary(own, 0))
        self.words, self.head = ranked.select(F.col("id").cast("int").alias("id"), "word"), head
        pairs = by_cluster(bigrams.select("w1", "w2", *([n] if n else [])), ["w1", "w2"], ranked.select("word", F.col("id").cast("int").alias("cid")), ranked.where("n > 0"), min(head, looked_up), n, int(unknown))
        some = self.words.where(F.col("id") > head).limit(1).count() > 0
        pairs = cut(pairs) if some else pairs
        far = (F.col("w1") > head) | (F.col("w2") > head)
        near = _beside(pairs.where(~far)).repartition("word").sortWithinPartitions("word")
        self.blocks = cut(near.mapInArrow(_packed, BLOCKS))
        self.rare = cut(pairs.where(far)) if some else None

    def numbered(self, clusters: DataFrame) -> DataFrame:
        """(id, word, cid)"""
        return clusters.select("word", "cid").join(self.words, "word").select("id", "word", "cid")

    def first(self, placed: DataFrame, *columns: str) -> list[np.ndarray]:
        """Columns of the words up to ``head`` as arrays over their numbers, 0 at 0."""
        got = placed.where(F.col("id") <= self.head).select("id", *columns).toArrow()
        at = got.column("id").to_numpy()
        out = [np.zeros(1 + (int(at.max()) if len(at) else 0), np.int32) for _ in columns]
        for x, c in zip(out, columns, strict=True):
            x[at] = got.column(c).to_numpy()
        return out


def _beside(pairs: DataFrame) -> DataFrame:
    """(word, other, side, n) of (w1, w2, n): a row for each of the two words that is no 0, one for a word beside itself or 0 beside 0."""
    side = lambda word, other, k: F.struct(F.col(word).cast("int").alias("word"), F.col(other).cast("int").alias("other"), F.lit(k).cast("tinyint").alias("side"))
    both = F.when(F.col("w1") == F.col("w2"), F.array(side("w1", "w2", 2))).otherwise(F.array(side("w1", "w2", 0), side("w2", "w1", 1)))
    return pairs.select(F.inline(F.filter(both, lambda x: (x["word"] > 0) | (x["side"] == 2))), "n")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)) for c in ("word", "other", "side", "n")], names=["word", "other", "side", "n"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        for i in range(0, b.num_rows, 64):
            word, other, side, n = (b.column(c).slice(i, 64).flatten().to_numpy() for c in ("word", "other", "side", "n"))
            yield word.astype(np.int64), other, side.astype(np.int64), n.astype(float)


def _once(word: np.ndarray, other: np.ndarray, side: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both words of each pair in order, and n: a pair of two words lies beside both."""
    k = (side != 1) | (other == 0)
    return np.where(side == 1, other, word)[k], np.where(side == 1, word, other)[k], n[k]


def _table(pairs: Pairs, clusters: DataFrame, g: int) -> np.ndarray:
    """``cluster_table`` of numbered pairs and clusters."""
    shared = clusters.sparkSession.sparkContext.broadcast(pairs.first(clusters, "cid")[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, total = shared.value, np.zeros(g * g)
        for block in _blocks(batches):
            one, two, n = _once(*block)
            total += np.bincount(cid[one] * g + cid[two], n, g * g)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // g).astype(np.int32)), pa.array((at % g).astype(np.int32)), pa.array(total[at])], names=["c1", "c2", "n"])

    rows = pairs.blocks.mapInArrow(run, "c1 int, c2 int, n double")
    if pairs.rare is not None:
        rows = rows.unionByName(cluster_bigrams(pairs.rare, clusters.select(F.col("id").alias("word"), "cid")).select("c1", "c2", F.col("n").cast("double").alias("n")))
    table = np.zeros((g, g))
    for r in rows.groupBy("c1", "c2").agg(F.sum("n").alias("n")).collect():  # clusters squared rows
        table[r["c1"], r["c2"]] = r["n"]
    return table


def _among(pairs: Pairs, few: list[int]) -> DataFrame:
    """(w1, w2, n) of a bounded list of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = np.array(few)
        for block in _blocks(batches):
            one, two, n = _once(*block)
            k = np.isin(one, only)
            k[k] = np.isin(two[k], only)
            yield pa.RecordBatch.from_arrays([pa.array(one[k].astype(np.int32)), pa.array(two[k].astype(np.int32)), pa.array(n[k])], names=["w1", "w2", "n"])

    rows = pairs.blocks.mapInArrow(run, "w1 int, w2 int, n double")
    return rows if pairs.rare is None else rows.unionByName(pairs.rare.where(F.col("w1").isin(few) & F.col("w2").isin(few)).select("w1", "w2", F.col("n").cast("double").alias("n")))


def _summed(batches: Iterator[pa.RecordBatch], cid: np.ndarray, g: int, only: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and their counts with every cluster behind them, before them and beside themselves (2 g + 1 columns), each word once."""
    last: tuple[np.ndarray, np.ndarray] | None = None
    for word, other, side, n in _blocks(batches):
        take = word > 0 if only is None else np.isin(word, only)
        word, other, side, n = word[take], other[take], side[take], n[take]
        if not len(word):
            continue
        new = np.append(True, word[1:] != word[:-1])
        ids = word[new]
        at = (np.cumsum(new) - 1) * (2 * g + 1) + np.where(side == 2, 2 * g, side * g + cid[other])
        x = np.bincount(at, n, len(ids) * (2 * g + 1)).reshape(len(ids), 2 * g + 1)
        if last is not None and last[0][0] == ids[0]:
            x[0] += last[1][0]
        elif last is not None:
            yield last
        last = ids[-1:], x[-1:]
        if len(ids) > 1:
            yield ids[:-1], x[:-1]
    if last is not None:
        yield last


def _profiles(pairs: Pairs, clusters: DataFrame, g: int, few: list[int] | None = None) -> DataFrame:
    """(id, p): each word's counts with every cluster behind it, before it and beside itself (2 g + 1 places), of all words or of a bounded list."""
    spark, c = clusters.sparkSession, clusters.select("id", "cid")
    (cid,), only = pairs.first(c, "cid"), None if few is None else np.array(sorted(few), np.int64)
    shared = spark.sparkContext.broadcast((cid, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, only = shared.value
        for ids, x in _summed(batches, cid, g, only):
            row, at = np.nonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row].astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(x[row, at])], names=["id", "at", "n"])

    sums = pairs.blocks.mapInArrow(run, "id int, at int, n double")
    if pairs.rare is not None:
        near = _beside(pairs.rare).select(F.col("word").alias("id"), "other", "side", "n")
        near = near if few is None else near.where(F.col("id").isin(few))
        near = near.join(c.select(F.col("id").alias("other"), F.col("cid").alias("g")), "other", "left")
        at = F.when(F.col("side") == 2, 2 * g).otherwise(F.col("side") * g + F.coalesce("g", F.lit(0))).cast("int")
        sums = sums.unionByName(near.groupBy("id", at.alias("at")).agg(F.sum("n").cast("double").alias("n")))
    # tasks have added up what they could: dealt by word once for both sums
    return sums.repartition("id").groupBy("id", "at").agg(F.sum("n").alias("n")).groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("p"))


def _dense(p: pa.Array, g: int) -> np.ndarray:
    x = np.zeros((len(p), 2 * g + 1))
    x[np.repeat(np.arange(len(p)), p.value_lengths().to_numpy()), p.flatten().field("at").to_numpy()] = p.flatten().field("n").to_numpy()
    return x


def _moves(pairs: Pairs, clusters: DataFrame, table: np.ndarray) -> DataFrame:
    """(id, word, cid, to, gain) over the numbered ``clusters``: ``best_moves`` by number. Without ``rare`` pairs a word's profile is whole in its task and not shuffled."""
    g, schema, own = len(table), "id int, to int, gain double", clusters.select("id", "word", "cid")

    def moved(ids: np.ndarray, cid: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(ids), 256):
            at = slice(i, i + 256)
            gains = move_gains(table, cid[at].astype(int), x[at, :g], x[at, g : 2 * g], x[at, 2 * g])
            yield pa.RecordBatch.from_arrays([pa.array(ids[at].astype(np.int32)), pa.array(gains.argmax(1), pa.int32()), pa.array(gains.max(1))], names=["id", "to", "gain"])

    if pairs.rare is None:
        shared = clusters.sparkSession.sparkContext.broadcast(pairs.first(own, "cid")[0])

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cid = shared.value
            for ids, x in _summed(batches, cid, g):
                yield from moved(ids, cid[ids], x)

        return pairs.blocks.mapInArrow(whole, schema).join(own, "id").select("id", "word", "cid", "to", "gain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from moved(b.column("id").to_numpy(), b.column("cid").to_numpy(), _dense(b.column("p"), g))

    return _profiles(pairs, clusters, g).join(own.select("id", "cid"), "id").mapInArrow(run, schema).join(own, "id").select("id", "word", "cid", "to", "gain")


def best_moves(bigrams: DataFrame, clusters: DataFrame, table: np.ndarray) -> DataFrame:
    """(word, cid, to, gain): every word's move of the greatest exact gain; of equal ones that to the first cluster."""
    pairs = Pairs(bigrams, clusters)
    return _moves(pairs, cut(pairs.numbered(clusters)), table).select("word", "cid", "to", "gain")


#: Words that a sweep moves one after the other, and sets of moves that it tries beside: all, those of at least 2^-k of the best
#: gain, hashed shares of all and of those.
ORDERED, STEPS, SHARES = 512, (2, 4, 6), ((2, 4), (2, None), (4, 4), (4, None), (8, None))


def _one_by_one(rows: list, profiles: dict[int, np.ndarray], pairs: list, table: np.ndarray, least: float) -> tuple[dict[int, int], np.ndarray]:
    """Clusters of ``rows`` (words of ``_moves``) after moving them in order until none gains ``least``, and the table; ``pairs`` are their counts beside each other."""
    g, table = len(table), table.copy()
    at, cid, x = {r["id"]: k for k, r in enumerate(rows)}, np.array([r["cid"] for r in rows]), np.array([profiles[r["id"]] for r in rows])
    behind: list[list[tuple[int, float]]] = [[] for _ in rows]
    before: list[list[tuple[int, float]]] = [[] for _ in rows]
    for r in pairs:
        i, j = at[r["w1"]], at[r["w2"]]
        if i != j:
            behind[i].append((j, r["n"]))
            before[j].append((i, r["n"]))
    moved = True
    while moved:
        moved = False
        for w in range(len(rows)):
            out, in_, own, a = x[w, :g], x[w, g : 2 * g], x[w, 2 * g], cid[w]
            gains = move_gains(table, cid[w : w + 1], out[None], in_[None], x[w : w + 1, 2 * g])[0]
            b = int(gains.argmax())
            if gains[b] <= least:
                continue
            for k, sign in ((a, -1), (b, 1)):
                table[k] += sign * out
                table[:, k] += sign * in_
                table[k, k] += sign * own
            for others, side in ((behind[w], g), (before[w], 0)):  # the words behind see this one before them
                for j, n in others:
                    x[j, side + a] -= n
                    x[j, side + b] += n
            cid[w], moved = b, True
    return {w: int(cid[k]) for w, k in at.items()}, table


def _tried(pairs: Pairs, placed: DataFrame, g: int, n_sets: int) -> DataFrame:
    """(set, c1, c2, n): what the cluster table changes by where the words of a set of moves go ``to`` their clusters; ``sets`` has a bit for each set."""
    spark = placed.sparkSession
    shared = spark.sparkContext.broadcast(pairs.first(placed.withColumn("to", F.coalesce("to", "cid")), "cid", "to", "sets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, to, sets = shared.value
        total = np.zeros((n_sets, g * g))
        for block in _blocks(batches):
            one, two, n = _once(*block)
            moves = (sets[one] | sets[two]) != 0
            one, two, n = one[moves], two[moves], n[moves]
            old = np.bincount(cid[one] * g + cid[two], n, g * g)
            for k in range(n_sets):
                new = np.where(sets >> k & 1, to, cid)
                total[k] += np.bincount(new[one] * g + new[two], n, g * g) - old
        k, at = np.nonzero(total)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (k, at // g, at % g)] + [pa.array(total[k, at])], names=["set", "c1", "c2", "n"])

    out = pairs.blocks.mapInArrow(run, "set int, c1 int, c2 int, n double")
    if pairs.rare is not None:
        end = lambda k: placed.select(F.col("id").alias(f"w{k}"), F.col("cid").alias(f"c{k}"), F.col("to").alias(f"t{k}"), F.col("sets").alias(f"s{k}"))
        both = pairs.rare.join(end(1), "w1", "left").join(end(2), "w2", "left").where("t1 IS NOT NULL OR t2 IS NOT NULL")
        old = lambda k: F.coalesce(f"c{k}", F.lit(0))
        new = lambda k: F.coalesce(F.when(F.col(f"s{k}").bitwiseAND(F.expr("shiftleft(1, set)")) != 0, F.col(f"t{k}")).otherwise(F.col(f"c{k}")), F.lit(0))
        change = lambda c, n: F.struct(c(1).alias("c1"), c(2).alias("c2"), n.cast("double").alias("n"))
        tried = both.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(n_sets - 1)))).select("set", F.inline(F.array(change(old, -F.col("n")), change(new, F.col("n")))))
        out = out.unionByName(tried)
    return out.groupBy("set", "c1", "c2").agg(F.sum("n").alias("n"))


def sweep_together(pairs: Pairs, clusters: DataFrame, table: np.ndarray, least_gain: float = 1e-9, seed: int = 0) -> tuple[DataFrame, np.ndarray] | None:
    """One distributed sweep over numbered ``clusters`` (id, word, cid). Moves made together gain less than each alone, as words move
    that others stand beside. So the ORDERED best ones are made one after the other from their profiles, each gain exact; and one pass
    over the bigrams gives the tables of larger sets of moves made together. What raises the objective most is kept. Nothing where no
    single move gains ``least_gain`` of the objective: a local optimum."""
    g, before = len(table), objective(table)
    moves = cut(_moves(pairs, clusters, table).where(F.col("gain") > least_gain * abs(before)))
    best = moves.orderBy(F.desc("gain"), "word").limit(ORDERED).collect()
    if not best:
        return None
    spark, few = clusters.sparkSession, [r["id"] for r in best]
    got = _profiles(pairs, clusters, g, few).toArrow().combine_chunks()
    profiles = dict(zip(got.column("id").to_pylist(), _dense(got.column("p").combine_chunks(), g), strict=True))
    beside = _among(pairs, few).collect()  # at most ORDERED squared
    found, ordered = _one_by_one(best, profiles, beside, table, least_gain * abs(before))
    alone = F.broadcast(spark.createDataFrame(list(found.items()), "id int, ordered int"))
    step = lambda k: F.lit(True) if k is None else F.col("gain") >= best[0]["gain"] / 2**k
    share = lambda m: F.pmod(F.xxhash64("word", F.lit(seed)), F.lit(m)) == 0
    tests = [step(None), *map(step, STEPS), *(share(m) & step(k) for m, k in SHARES)]
    sets = sum((F.when(t, F.lit(1 << k)).otherwise(0) for k, t in enumerate(tests)), F.lit(0)).cast("int")
    moving = moves.select("id", "to", sets.alias("sets"))
    placed = cut(clusters.select("id", "word", "cid").join(moving, "id", "left").join(alone, "id", "left").select("id", "word", "cid", "to", F.coalesce("sets", F.lit(0)).alias("sets"), F.coalesce("ordered", "cid").alias("ordered")))
    tables = [table.copy() for _ in tests]
    for r in _tried(pairs, placed, g, len(tests)).collect():  # sets times clusters squared
        tables[r["set"]][r["c1"], r["c2"]] += r["n"]
    k = int(np.argmax([objective(t) for t in tables]))
    if objective(tables[k]) > objective(ordered):
        return placed.select("id", "word", F.when(F.col("sets").bitwiseAND(1 << k) != 0, F.col("to")).otherwise(F.col("cid")).cast("int").alias("cid")), tables[k]
    return placed.select("id", "word", F.col("ordered").cast("int").alias("cid")), ordered


def exchange_together(bigrams: DataFrame, clusters: DataFrame, n_clusters: int, least_gain: float = 1e-9, counts: DataFrame | None = None, head: int = HEAD, unknown: bool = False) -> DataFrame:
    """(word, cid) after distributed sweeps, until no single move gains ``least_gain`` of the objective. ``bigrams`` are counted (w1, w2, n), or
    (w1, w2) with a row for each, whose words' ``counts`` (word, n) are given. They are shuffled to be numbered and dealt by word, not in a
    sweep, but for those of words beyond the first ``head``. Each sweep's clusters lie over a checkpoint of their own. Words outside
    ``clusters`` stay in cluster 0, or with ``unknown`` move as one, the word UNKNOWN of ``clusters``."""
    pairs = Pairs(bigrams, clusters, counts, head, unknown=unknown)
    at = cut(pairs.numbered(clusters))
    table, k = _table(pairs, at, n_clusters), 0
    while (step := sweep_together(pairs, at, table, least_gain, k)) is not None:
        # a checkpoint keeps its plan's estimated size, which joins multiply from sweep to sweep; a table of rows starts anew
        at, table, k = bigrams.sparkSession.createDataFrame(step[0].rdd, "id int, word string, cid int"), step[1], k + 1
    return at.select("word", "cid")
