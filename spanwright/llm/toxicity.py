"""Toxicity scores: a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A text's words are read in overlapping windows. A word's input is learned vectors of its hashed letters and of its hashed first
four letters beside the mean of learned vectors of its hashed character trigrams. Two gated recurrent layers read a window forwards and backwards; attention
weighs their states into one vector, and a logistic unit scores it. A text's score is that of its highest window, calibrated.
Training takes a bounded sample of the labelled rows (MAX_TRAIN documents, those of the smallest hashes, and of each at most
MAX_WINDOWS windows dealt at random) and learns from a document's label through its highest window. Scoring reads every
overlapping window of every text.

Defined cases: a null text counts as empty; an empty one gets the score of a window without words; repeated rows are scored
each for itself; repeated labels of a document count as toxic if one does, null labels as none; an empty table gives an empty
result, and without labelled rows every score is the prior 0.05; further columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import id_text, small_batches, table

WINDOW, STRIDE = 32, 24
WORD_BUCKETS, GRAM_BUCKETS = 1 << 18, 1 << 14
EMBED, HIDDEN, PREFIX = 8, 8, 4
MAX_TRAIN, MAX_WINDOWS = 4000, 24
STEPS, BATCH = 360, 192
SLICE = 500_000
#: Pull of the word and trigram vectors towards zero, so that chance words of few documents stay near it.
DECAY = 0.05
EMBED_RATE = 0.001
THRESHOLD = 0.3

_PUNCT = re.compile(r"[\W_]+")


def words_of(text: str) -> list[str]:
    return text.lower().split()


def window_starts(n: int) -> list[int]:
    """Starts of the windows that together hold n words; one for an empty text."""
    return [0, *range(STRIDE, max(0, n - WINDOW) + STRIDE, STRIDE)] if n > WINDOW else [0]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word and of its first letters (words x 2); buckets of all trigrams end to end; where each word's start."""
    plain = [_PUNCT.sub("", w).encode("utf-8", "surrogatepass").decode("utf-8", "ignore") for w in words]
    bucket = np.array([(zlib.crc32(w.encode()), zlib.crc32(b"^" + w[:PREFIX].encode())) for w in plain], np.int64).reshape(-1, 2) & (WORD_BUCKETS - 1)
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer(("".join(f"^{w}$" for w in words)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    at = np.cumsum(sizes + 2) - (sizes + 2)
    grams = (codes[:-2] * 1000003 + codes[1:-1] * 10007 + codes[2:] * 101) if len(codes) > 2 else np.zeros(0, np.int64)
    grams = ((grams ^ (grams >> 17)) * 2654435761 >> 9) & (GRAM_BUCKETS - 1)
    keep = np.ones(len(codes), bool)
    ends = at + sizes + 1
    keep[ends] = False
    keep[ends - 1] = False  # the last two places of a word start no trigram within it
    keep = keep[: len(grams)] if len(grams) else np.zeros(0, bool)
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])[:-1]
    return bucket, grams[keep], starts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct row numbers and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    own, at = np.unique(rows[order], return_index=True)
    return own, np.add.reduceat(values[order], at, axis=0)


class Model:
    """The network's weights, with its forward and backward passes."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        f = lambda *s, scale=0.3: rng.normal(0, scale, s).astype(np.float32)
        h = HIDDEN
        self.word, self.gram = f(WORD_BUCKETS, EMBED, scale=0.02), f(GRAM_BUCKETS, EMBED, scale=0.02)
        self.p = {"W": f(2, 3 * EMBED, 3 * h), "b": np.zeros((2, 3 * h), np.float32), "U": f(2, h, 3 * h), "A": f(2 * h, h), "c": np.zeros(h, np.float32), "v": f(h), "w": f(2 * h), "o": np.full(1, -1.0, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, bucket: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(bucket):
            return np.zeros((0, 3 * EMBED), np.float32)
        count = np.diff(np.append(starts, len(grams)))
        mean = np.add.reduceat(self.gram[grams], np.minimum(starts, len(grams) - 1), axis=0) / np.maximum(count, 1)[:, None]
        return np.concatenate([self.word[bucket].reshape(-1, 2 * EMBED), mean.astype(np.float32)], axis=1)

    def forward(self, proj: list[np.ndarray], ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows of row numbers ``ids`` (windows x words) into the projected inputs; masked places keep the state."""
        p, h, (n, t_max) = self.p, HIDDEN, ids.shape
        states = np.zeros((t_max, n, 2 * h), np.float32)
        tape = []
        for side in (0, 1):
            s, U = np.zeros((n, h), np.float32), p["U"][side]
            for t in range(t_max) if side == 0 else range(t_max - 1, -1, -1):
                x, g = proj[side][ids[:, t]], s @ U
                zr = _sigmoid(x[:, : 2 * h] + g[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * g[:, 2 * h :])
                m = mask[:, t : t + 1]
                new = s + m * (1 - z) * (c - s)
                if keep:
                    tape.append((side, t, s, z, r, c, g[:, 2 * h :], m))
                s = new
                states[t, :, side * h : side * h + h] = s
        u = np.tanh(states @ p["A"] + p["c"])
        e = np.where(mask.T > 0, u @ p["v"], -1e9)
        a = np.exp(e - e.max(0))
        a *= mask.T
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", a, states)
        logit = pooled @ p["w"] + p["o"][0]
        return (logit, (states, u, a, pooled, tape)) if keep else logit

    def backward(self, proj, ids, mask, kept, d_logit):
        """Gradients of the weights, and of each projected input row."""
        p, h = self.p, HIDDEN
        states, u, a, pooled, tape = kept
        g = {k: np.zeros_like(x) for k, x in p.items()}
        g["o"][0], g["w"] = d_logit.sum(), pooled.T @ d_logit
        d_pool = d_logit[:, None] * p["w"]
        d_states = a[:, :, None] * d_pool
        d_a = np.einsum("nh,tnh->tn", d_pool, states)
        d_e = a * (d_a - (a * d_a).sum(0))
        d_pre = d_e[:, :, None] * p["v"] * (1 - u * u)
        g["v"], g["c"] = np.einsum("tn,tnh->h", d_e, u), d_pre.sum((0, 1))
        g["A"] = np.einsum("tni,tnj->ij", states, d_pre)
        d_states += d_pre @ p["A"].T
        d_in = np.zeros((2, *ids.shape, 3 * h), np.float32)
        carry = {0: 0.0, 1: 0.0}
        for side, t, s, z, r, c, gn, m in reversed(tape):
            d = d_states[t, :, side * h : side * h + h] + carry[side]
            d_c = d * m * (1 - z) * (1 - c * c)
            d_z = d * m * (s - c) * z * (1 - z)
            d_r = d_c * gn * r * (1 - r)
            d_g = np.concatenate([d_z, d_r, d_c * r], axis=1)
            d_in[side, :, t, : 2 * h], d_in[side, :, t, 2 * h :] = d_g[:, : 2 * h], d_c
            g["U"][side] += s.T @ d_g
            carry[side] = d * (1 - m * (1 - z)) + d_g @ p["U"][side].T
        d_x = [np.zeros_like(x) for x in proj]
        for side in (0, 1):
            rows, sums = summed(ids.ravel(), d_in[side].reshape(-1, 3 * h))
            d_x[side][rows] = sums
        return g, d_x

    def project(self, x: np.ndarray) -> list[np.ndarray]:
        """Input rows through the two layers' input weights, with a row of zeros at the end for places without a word."""
        x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        return [x @ self.p["W"][s] + self.p["b"][s] for s in (0, 1)]

    def score(self, texts: list[str]) -> np.ndarray:
        """Calibrated score of the highest window of each text; about SLICE characters are read at once."""
        ends = np.cumsum([len(t) for t in texts]) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
        return np.concatenate([np.zeros(0), *(self._score(texts[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True) if z > a)])

    def _score(self, texts: list[str]) -> np.ndarray:
        known: dict[str, int] = {}
        ids: list[int] = []
        spans, owner = [], []
        for k, text in enumerate(texts):
            own = [known.setdefault(w, len(known)) for w in words_of(text)]
            starts = window_starts(len(own))
            spans += [(len(ids) + s, min(WINDOW, len(own) - s)) for s in starts]
            owner += [k] * len(starts)
            ids += own
        proj = self.project(self.inputs(*features(list(known))))
        flat = np.array([*ids, *[len(known)] * WINDOW], np.int64)
        at = np.array([s for s, _ in spans])[:, None] + np.arange(WINDOW)
        mask = (np.arange(WINDOW) < np.array([n for _, n in spans])[:, None]).astype(np.float32)
        top = np.full(len(texts), -np.inf)
        for i in range(0, len(at), 1024):
            m = mask[i : i + 1024]
            logit = self.forward(proj, np.where(m > 0, flat[np.minimum(at[i : i + 1024], len(flat) - 1)], len(known)), m)
            np.maximum.at(top, np.array(owner[i : i + 1024]), logit)
        return _sigmoid(self.scale * top + self.shift)


def train(rows: list[tuple[str, int]], seed: int = 7) -> Model:
    """Fit the network on (text, label); of a text, at most MAX_WINDOWS windows dealt at random."""
    rng, model = np.random.default_rng(seed), Model(seed)
    known: dict[str, int] = {}
    wins: list[np.ndarray] = []
    doc: list[int] = []
    for k, (text, _) in enumerate(rows):
        ws = words_of(text)
        starts = window_starts(len(ws))
        for s in starts if len(starts) <= MAX_WINDOWS else rng.choice(starts, MAX_WINDOWS, replace=False):
            wins.append(np.array([known.setdefault(w, len(known)) for w in ws[s : s + WINDOW]], np.int64))
            doc.append(k)
    blank = len(known)
    ids = np.full((len(wins), WINDOW), blank)
    for k, w in enumerate(wins):
        ids[k, : len(w)] = w
    mask = (ids != blank).astype(np.float32)
    owner, label = np.array(doc), np.array([y for _, y in rows])
    first = np.searchsorted(owner, np.arange(len(rows) + 1))
    bucket, grams, starts = features(list(known))
    ends = np.append(starts, len(grams))
    # every fifth document is kept for the calibration
    fold = np.arange(len(rows)) % 5 == 4
    pos, neg = np.flatnonzero((label == 1) & ~fold), np.flatnonzero((label == 0) & ~fold)
    # the vectors' first entries begin as how far a word's, start's or trigram's documents are more often toxic than chance has it
    own_words = [w[w != blank] for w in (np.unique(ids[first[k] : first[k + 1]]) for k in range(len(rows)))]
    part_grams = lambda w: np.concatenate([grams[starts[x] : ends[x + 1]] for x in w]) if len(w) else np.zeros(0, np.int64)
    for vectors, of in ((model.word, [np.unique(bucket[w]) for w in own_words]), (model.gram, [np.unique(part_grams(w)) for w in own_words])):
        seen = [np.bincount(np.concatenate([of[k] for k in part_]) if len(part_) else np.zeros(0, np.int64), minlength=len(vectors)) for part_ in (pos, neg)]
        expected = (seen[0] + seen[1]) * (len(pos) / max(1, len(pos) + len(neg)))
        # of fewer than four documents a word would only say which document it is from
        vectors[:, 0] = np.where(seen[0] + seen[1] >= 4, np.clip((seen[0] - expected) / np.sqrt(expected + 1), -3, 8) / 4, 0)
    adam = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in model.p.items()}
    squares = [np.full(WORD_BUCKETS, 1e-3, np.float32), np.full(GRAM_BUCKETS, 1e-3, np.float32)]

    def part(rows_: np.ndarray):
        """The distinct words of some windows, renumbered."""
        own, inv = np.unique(ids[rows_], return_inverse=True)
        own = own[own != blank] if own[-1] == blank else own
        local = inv.reshape(len(rows_), WINDOW)
        local = np.minimum(local, len(own))
        g = np.concatenate([np.arange(starts[w], ends[w + 1]) for w in own]) if len(own) else np.zeros(0, np.int64)
        counts = ends[own + 1] - starts[own]
        return own, local, g, counts, np.cumsum(counts) - counts

    def logits(rows_: np.ndarray) -> np.ndarray:
        own, local, g, _, st = part(rows_)
        return model.forward(model.project(model.inputs(bucket[own], grams[g], st)), local, mask[rows_])

    top = np.array([rng.integers(first[k], first[k + 1]) for k in range(len(rows))])
    for step in range(STEPS):
        late = step >= STEPS // 3
        if late and step % (STEPS // 6) == 0 or step == STEPS // 3:  # which window of each document is highest now
            every = np.concatenate([logits(np.arange(i, min(i + 2048, len(ids)))) for i in range(0, len(ids), 2048)])
            top = np.array([first[k] + int(np.argmax(every[first[k] : first[k + 1]])) for k in range(len(rows))])
        take = lambda from_, n: rng.choice(from_, n) if len(from_) else np.zeros(0, np.int64)
        docs = np.concatenate([take(pos, BATCH // 3), take(neg, BATCH - BATCH // 3)]).astype(np.int64)
        if not len(docs):
            break
        free = np.array([rng.integers(first[k], first[k + 1]) for k in docs])
        use_top = (label[docs] == 1) | (rng.random(len(docs)) < 0.5)
        rows_ = np.where(use_top, top[docs], free) if late else free
        own, local, g, counts, st = part(rows_)
        # a word's own vector is left out half of the time, so that its start and trigrams must do
        drop = np.repeat(rng.random((len(own), 3)) >= (0.5, 0.1, 0.3), EMBED, axis=1)
        x = model.inputs(bucket[own], grams[g], st) * drop
        proj = model.project(x)
        logit, kept = model.forward(proj, local, mask[rows_], keep=True)
        d = ((_sigmoid(logit) - label[docs]) / len(docs)).astype(np.float32)
        grad, d_proj = model.backward(proj, local, mask[rows_], kept, d)
        xx = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        d_x = np.zeros_like(x)
        for s in (0, 1):
            grad["W"][s], grad["b"][s] = xx.T @ d_proj[s], d_proj[s].sum(0)
            d_x += (d_proj[s] @ model.p["W"][s].T)[:-1] * drop
        norm = float(np.sqrt(sum((v.astype(np.float64) ** 2).sum() for v in grad.values())))
        rate = 0.015 * (1 - 0.9 * step / STEPS)
        for k, v in grad.items():
            v = v * min(1.0, 1.0 / (norm + 1e-9)) + (1e-4 * model.p[k] if k in "WUA" else 0)
            m1, m2 = adam[k]
            m1 += 0.1 * (v - m1)
            m2 += 0.01 * (v * v - m2)
            model.p[k] -= rate * (m1 / (1 - 0.9 ** (step + 1))) / (np.sqrt(m2 / (1 - 0.99 ** (step + 1))) + 1e-7)
        wide = np.zeros((0, EMBED), np.float32) if not len(g) else np.repeat(d_x[:, 2 * EMBED :] / np.maximum(counts, 1)[:, None], counts, axis=0)
        for emb, sq, rows2, val in ((model.word, squares[0], bucket[own].ravel(), d_x[:, : 2 * EMBED].reshape(-1, EMBED)), (model.gram, squares[1], grams[g], wide)):
            if len(rows2):
                hit, sums = summed(rows2, val)
                sums = sums * len(docs) + DECAY * emb[hit]
                sq[hit] += (sums**2).mean(1)
                emb[hit] -= EMBED_RATE * sums / np.sqrt(sq[hit])[:, None]
    # calibration: one scale and shift over the documents' highest windows
    every = np.concatenate([logits(np.arange(i, min(i + 2048, len(ids)))) for i in range(0, len(ids), 2048)])
    best = np.maximum.reduceat(every, first[:-1]).astype(np.float64)
    if fold.sum() >= 40:
        best, label = best[fold], label[fold]
    a, b = 1.0, 0.0
    for _ in range(400):
        e = _sigmoid(a * best + b) - label
        w = np.maximum(_sigmoid(a * best + b) * (1 - _sigmoid(a * best + b)), 1e-6)
        hess = np.array([[(w * best * best).sum() + 1.0, (w * best).sum()], [(w * best).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, [(e * best).sum() + (a - 1), e.sum()])
        a, b = a - 0.5 * da, b - 0.5 * db
        if abs(da) + abs(db) < 1e-7:
            break
    model.scale, model.shift = float(max(a, 1e-3)), float(b)
    return model


def held_out(id_col: str = "doc_id"):
    """The rows never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Train, in one task, on a bounded sample: the MAX_TRAIN labelled, not held-out documents of the smallest hashes."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(MAX_TRAIN).collect()
    if not chosen:
        return None
    ids = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "doc_id long, toxic int")
    small_batches(spark)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # of a text, MAX_WINDOWS windows dealt at random are enough to learn from: only they reach the training
        for pdf in batches:
            out = []
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                ws = t.split()
                if len(ws) > MAX_WINDOWS * STRIDE:
                    starts = np.random.default_rng(d & 0xFFFFFFFF).choice(window_starts(len(ws)), MAX_WINDOWS, replace=False)
                    ws = [w for s in sorted(starts) for w in ws[s : s + STRIDE]]
                out.append(" ".join(ws))
            yield pdf.assign(text=out)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sorted((d, x, t) for pdf in batches for d, x, t in zip(pdf["doc_id"], pdf["text"], pdf["toxic"], strict=True))
        if own:
            yield pd.DataFrame({"model": [pickle.dumps(train([(x, int(t)) for _, x, t in own]))]})

    rows = id_text(docs, id_col, text_col).join(F.broadcast(ids), "doc_id").mapInPandas(cut, "doc_id long, text string, toxic int")
    sample = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # of repeated rows one; MAX_TRAIN rows at most
    # a task of its own trains: its arrays are many times the model, and what Python once took stays with the driver to the end
    got = sample.repartition(1).mapInPandas(learn, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else None


def score_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_text(docs, id_col, text_col)
    if model is None:
        return rows.select("doc_id", F.lit(0.05).alias("score"))
    shared = spark.sparkContext.broadcast(model)  # fixed size: about two MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": shared.value.score(pdf["text"].tolist()).astype("float64") if len(pdf) else []})

    return rows.mapInPandas(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text scores under ``threshold``."""
    if model is None:
        return docs
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(shared.value.score([t or "" for t in batch.column(text_col).to_pylist()]) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
