"""A grammar from recurrent gap models: candidates, models on all sentences and on halves, anchors, rule weights, grammar.

Training is a Spark job a round: every task takes the round's model over its own sentences, and the tasks' weights are averaged by
their sentences, in merges of a few models a task; one model comes back to the driver, whatever the corpus's size. Divergences come
from sums that each task adds up over its gaps, so a task gives a row for each pair or triple of words, not for each gap.

Sentences are rows of keys and w; ids those of ``tokens.special_vocabulary``. Words outside the vocabulary count as <unk>; empty and
null sentences have no gaps; a corpus without any leaves the model as it began.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators import anchors as A
from spanwright.operators import contextmodels as M
from spanwright.operators import induction as I
from spanwright.operators import tokens as T
from spanwright.operators.averaging import PART, averaged
from spanwright.operators.lineage import cut
from spanwright.operators.recurrent import ClozeModel, _Model

#: Sentences of a task's share of a round.
SHARE = 4096
#: Greatest exponent in a sum of powers: beyond it a word is as good as never seen there.
STEEP = 600.0


def _flat(model: _Model) -> np.ndarray:
    """Weights and both of Adam's moments of each, end to end."""
    p = model.parameters()
    moments = [model.moments.get(k, [np.zeros_like(v), np.zeros_like(v)]) for k, v in p.items()]
    return np.concatenate([x.ravel() for k, v in zip(moments, p.values(), strict=True) for x in (v, *k)])


def _fill(model: _Model, flat: np.ndarray, t: int) -> _Model:
    at = 0
    for k, v in model.parameters().items():
        parts = [flat[at + i * v.size : at + (i + 1) * v.size].reshape(v.shape) for i in range(3)]
        v[:] = parts[0]
        model.moments[k] = [parts[1].copy(), parts[2].copy()]
        at += 3 * v.size
    model.t = t
    return model


def train_together(kind: type[_Model], rows: DataFrame, vocabulary: int, rounds: int = 5, batch: int = 64, rate: float = 5e-3, seed: int = 1, share: int = SHARE, **options) -> tuple[_Model, list[float]]:
    """Fit on all sentences (ids): in each round tasks of about ``share`` sentences go on from the mean of the last; the mean loss of each round."""
    model, history = kind(vocabulary, seed=seed, **options), []
    rows = cut(rows.select("ids").where(F.size("ids") > (2 if kind is ClozeModel else 1)))  # without a word there is no gap
    tasks = -(-rows.count() // share)
    for k in range(rounds if tasks else 0):
        dealt = rows.repartition(tasks, F.xxhash64("ids", F.lit(seed + k), F.monotonically_increasing_id()))
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], k: int = k, shared=shared) -> Iterator[pa.RecordBatch]:
            own, rng, losses = shared.value, np.random.default_rng(seed + k), []
            began = own.t
            own = _fill(kind(vocabulary, seed=seed, **options), _flat(own), began)
            for b in batches:
                got = [np.array(x) for x in b.column("ids").to_pylist()]
                order = sorted(rng.permutation(len(got)), key=lambda i: len(got[i]))  # like lengths together
                parts = [order[i : i + batch] for i in range(0, len(order), batch)]
                losses += [(len(parts[j]), own.step([got[i] for i in parts[j]], rate)) for j in rng.permutation(len(parts))]
            n = sum(x for x, _ in losses)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sum(x * y for x, y in losses) / n]), pa.array([own.t - began]), pa.array([_flat(own)], pa.list_(pa.float64()))], names=["n", "loss", "steps", "flat"])

        _, loss, steps, flat = averaged(dealt.mapInArrow(run, PART))
        model = _fill(model, flat, model.t + steps)
        history.append(loss)
    return model, history


def gap_sums(rows: DataFrame, single: ClozeModel, anchors: list[int], others: list[int] | None = None, gapped: ClozeModel | None = None, alpha: float = 2.0) -> DataFrame:
    """(a, b, c, n, total) over the one-word gaps of each anchor a, n of them.

    With c null: sums over the gaps of exp((alpha - 1)(ln P(a) - ln P(b))) for b of ``others`` (all words unless given), as ``single``
    sees the gap. With ``gapped``, the same for pairs b, c of anchors, P(b c) being the gapped model's P(b) times single's P(c) behind
    b. For alpha 1 logs are summed, for infinity the greatest is taken.
    """
    ids = np.array(sorted(anchors))
    beside = np.arange(single.size) if others is None else np.array(sorted(others))
    shared = rows.sparkSession.sparkContext.broadcast((single, gapped))
    k = len(ids)

    def power(x: np.ndarray) -> np.ndarray:
        return x if alpha in (1, math.inf) else np.exp(np.minimum((alpha - 1) * x, STEEP))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        n, words, pairs = np.zeros(k, np.int64), np.full((k, len(beside)), -np.inf if alpha == math.inf else 0.0), np.full((k, k, k), -np.inf if alpha == math.inf else 0.0)
        add = np.maximum.at if alpha == math.inf else np.add.at
        for b in batches:
            left, right, gaps, _ = one.contexts([np.array(x) for x in b.column("ids").to_pylist()])
            at = [j for j, w in enumerate(gaps) if w[0] in ids]
            for i in range(0, len(at), 256):
                part = at[i : i + 256]
                ls, rs = [left[j] for j in part], [right[j] for j in part]
                a = np.searchsorted(ids, [gaps[j][0] for j in part])
                lp = one.log_probs(ls, rs)
                own = lp[np.arange(len(part)), ids[a]][:, None]
                np.add.at(n, a, 1)
                add(words, a, power(own - lp[:, beside]))
                if two is not None:
                    first = two.log_probs(ls, rs)[:, ids]
                    for j, x in enumerate(ids):
                        second = one.log_probs([np.append(y, x) for y in ls], rs)[:, ids]
                        add(pairs[:, j], a, power(own - first[:, j : j + 1] - second))
        seen = np.flatnonzero(n)
        if not len(seen):
            return
        grid = [(int(ids[a]), int(beside[b]), None, int(n[a]), float(words[a, b])) for a in seen for b in range(len(beside))]
        if two is not None:
            grid += [(int(ids[a]), int(ids[b]), int(ids[c]), int(n[a]), float(pairs[a, b, c])) for a in seen for b in range(k) for c in range(k)]
        kinds = [pa.int64()] * 4 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*grid, strict=True), kinds, strict=True)], names=["a", "b", "c", "n", "total"])

    total = F.max("total") if alpha == math.inf else F.sum("total")
    return rows.select("ids").mapInArrow(run, "a long, b long, c long, n long, total double").groupBy("a", "b", "c").agg(F.sum("n").alias("n"), total.alias("total"))


def divergences(sums: DataFrame, expectations: DataFrame, pairs: DataFrame, alpha: float = 2.0) -> DataFrame:
    """(a, b, c, d) of ``gap_sums`` with (id, e) and (b, c, e) of words and neighbouring words: Renyi divergences of the contexts of a from those of b, or of b c."""
    mean = F.col("total") / F.col("n")
    raw = mean if alpha == 1 else F.col("total") if alpha == math.inf else F.ln(mean) / (alpha - 1)
    e = expectations.select("id", F.ln("e").alias("le"))
    x = sums.join(F.broadcast(e.select(F.col("id").alias("a"), F.col("le").alias("la"))), "a")  # as many as anchors are met
    one = x.where("c IS NULL").join(e.select(F.col("id").alias("b"), F.col("le").alias("lb")), "b").select("a", "b", "c", (raw - F.col("la") + F.col("lb")).alias("d"))
    two = x.where("c IS NOT NULL").join(pairs.select("b", "c", F.ln("e").alias("lb")), ["b", "c"]).select("a", "b", "c", (raw - F.col("la") + F.col("lb")).alias("d"))
    return one.unionByName(two)


@dataclass
class GapLearned:
    """Anchors with the log of their choice, the weighted grammar, and the losses of the models by name."""

    ordered: A.Ordered
    wcfg: DataFrame
    losses: dict[str, list[float]]

    def pcfg(self) -> DataFrame:
        return I.to_pcfg(self.wcfg)


def learn(sents: DataFrame, n_candidates: int = 60, candidates: list[str] | None = None, anchors: list[str] | None = None, min_count: int = 1, alpha: float = 2.0, rounds: int = 5, share: int = SHARE, batch: int = 64, rate: float = 5e-3, seed: int = 1, **options) -> GapLearned:
    """The whole flow. Candidates are the most frequent words unless given; anchors are chosen among them by the divergence order, with noise from models of two halves, unless given."""
    sents = cut(sents)
    counts = cut(T.word_counts(sents))
    vocabulary = cut(T.special_vocabulary(counts, min_count))
    size, n = vocabulary.count(), sents.count()
    rows = cut(T.encoded(sents, vocabulary))
    losses: dict[str, list[float]] = {}

    def fitted(name: str, ids: DataFrame, gap: int = 1) -> ClozeModel:
        model, losses[name] = train_together(ClozeModel, ids, size, rounds, batch, rate, seed, share, gap=gap, **options)
        return model

    single = fitted("single", rows)
    e = cut(counts.join(vocabulary, "word").select("word", "id", F.col("n").alias("count"), (F.col("n") / n).alias("e")))
    none = sents.sparkSession.createDataFrame([], "b long, c long, e double")
    ordered = A.Ordered(list(anchors or []))
    if anchors is None:
        words = M.word_table(sents, n_candidates).select("word") if candidates is None else sents.sparkSession.createDataFrame([(w,) for w in candidates], "word string")
        known = {r["id"]: (r["word"], r["count"]) for r in e.join(words, "word").collect()}  # a row a candidate

        def table(ids: DataFrame, model: ClozeModel) -> A.Table:
            d = divergences(gap_sums(ids, model, list(known), list(known), alpha=alpha), e, none, alpha)
            return {(known[r["a"]][0], known[r["b"]][0]): r["d"] for r in d.where("a <> b").collect()}

        halves = [table(x, fitted(name, x)) for name, x in zip(("first half", "second half"), A.halves(rows), strict=True)]
        ordered = A.divergence_ordered(table(rows, single), *halves, {w: c for w, c in known.values()})
    ids = {r["word"]: r["id"] for r in e.where(F.col("word").isin(ordered.anchors)).select("word", "id").collect()}
    own = [w for w in ordered.anchors if w in ids]
    names = {v: k for k, v in ids.items()}
    gapped = fitted("gapped", rows, 2)
    inner = T.inner_bigrams(sents).where(F.col("w1").isin(own) & F.col("w2").isin(own))
    code = lambda c, out: e.select(F.col("word").alias(c), F.col("id").alias(out))
    pairs = inner.join(F.broadcast(code("w1", "b")), "w1").join(F.broadcast(code("w2", "c")), "w2").select("b", "c", (F.col("n") / n).alias("e"))
    d = cut(divergences(gap_sums(rows, single, list(ids.values()), None, gapped, alpha), e, pairs, alpha))
    two = {(names[r["a"]], f"{names[r['b']]} {names[r['c']]}"): r["d"] for r in d.where("c IS NOT NULL").collect()}  # anchors cubed
    spark = sents.sparkSession
    label = spark.createDataFrame([(ids[w], f"NT_{w}") for w in own], "a long, lhs string")
    lexical = d.where("c IS NULL").join(F.broadcast(label), "a").join(e.select(F.col("id").alias("b"), F.col("word").alias("r1"), "e"), "b").select("lhs", "r1", F.lit(None).cast("string").alias("r2"), (F.col("e") * F.exp(-F.col("d"))).alias("p"))
    alone = T.of_length(sents, 1).join(e.select("word"), "word").select(F.lit("S").alias("lhs"), F.col("word").alias("r1"), F.lit(None).cast("string").alias("r2"), (F.col("n") / n).alias("p"))
    weights = [("S" if a == "S" else f"NT_{a}", f"NT_{b}", f"NT_{c}", w) for a, b, c, w in A.binary_weights(sents, own, two)]
    binary = spark.createDataFrame(weights, "lhs string, r1 string, r2 string, p double")
    return GapLearned(ordered, cut(lexical.unionByName(alone).unionByName(binary).where("p > 0")), losses)
