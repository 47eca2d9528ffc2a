"""Feed-forward context models: the word, or the pair of words, in a gap from the words around it.

Spark counts the (context, target) rows. ``train_together`` takes all of them, each round's tasks going on from the mean network of
the last; ``train`` a bounded sample on the driver. Scoring runs in Arrow batches on all rows. ``kind`` is "bow" (mean of the context's vectors) or "positional" (vectors side by side, two hidden layers).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators.averaging import PART, averaged
from spanwright.operators.lineage import cut
from spanwright.operators.tokens import BOUNDARY


def gap_rows(sents: DataFrame, ids: DataFrame, k: int = 2, gap: int = 1) -> DataFrame:
    """(ctx array<int>, targets array<int>, n): counts of the 2k words around each gap of 1 or 2; 0 is the boundary and unknown."""
    pad = F.array_repeat(F.lit(BOUNDARY), k)
    keys = [c for c in sents.columns if c != "w"]  # they tell sentences apart
    placed = sents.select(*keys, F.concat(pad, "w", pad).alias("p"), F.explode(F.when(F.size("w") >= gap, F.sequence(F.lit(0), F.size("w") - gap))).alias("at"))
    words = placed.select(*keys, "at", F.posexplode(F.slice("p", F.col("at") + 1, F.lit(2 * k + gap))).alias("j", "word"))
    coded = words.join(ids.select("word", "id"), "word", "left").select(*keys, "at", "j", F.coalesce("id", F.lit(0)).cast("int").alias("id"))
    whole = coded.groupBy(*keys, "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "id"))), lambda x: x["id"]).alias("x"))
    ctx = F.concat(F.slice("x", 1, k), F.slice("x", k + gap + 1, k))
    return whole.select(ctx.alias("ctx"), F.slice("x", k + 1, gap).alias("targets")).groupBy("ctx", "targets").agg(F.count(F.lit(1)).alias("n"))


class ContextModel:
    """Embedding, hidden layers and softmax; a second softmax for the pair's second word given the first."""

    def __init__(self, vocabulary: int, k: int = 2, kind: str = "bow", embed: int = 24, hidden: int = 48, pair: bool = False, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        w = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        width = embed if kind == "bow" else embed * 2 * k
        self.kind, self.pair, self.size = kind, pair, vocabulary
        self.p = {"E": rng.normal(0, 0.1, (vocabulary, embed)), "W1": w(width, hidden), "b1": np.zeros(hidden), "O": w(hidden, vocabulary), "c": np.zeros(vocabulary)}
        if kind == "positional":
            self.p |= {"W2": w(hidden, hidden), "b2": np.zeros(hidden)}
        if pair:
            self.p |= {"V": w(hidden + embed, vocabulary), "d": np.zeros(vocabulary)}

    def hidden(self, ctx: np.ndarray):
        e = self.p["E"][ctx]
        x = e.mean(1) if self.kind == "bow" else e.reshape(len(ctx), -1)
        h1 = np.maximum(x @ self.p["W1"] + self.p["b1"], 0)
        h2 = np.maximum(h1 @ self.p["W2"] + self.p["b2"], 0) if "W2" in self.p else h1
        return x, h1, h2

    @staticmethod
    def log_softmax(z: np.ndarray) -> np.ndarray:
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def log_probs(self, ctx: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """Rows of log probabilities of the gap's first word, or of the second given ``first``."""
        h = self.hidden(ctx)[2]
        if first is None:
            return self.log_softmax(h @ self.p["O"] + self.p["c"])
        return self.log_softmax(np.concatenate([h, self.p["E"][first]], 1) @ self.p["V"] + self.p["d"])

    def step(self, ctx: np.ndarray, targets: np.ndarray, adam: dict, t: int, rate: float) -> float:
        """One Adam step on cross entropy; the loss before it."""
        p, n = self.p, len(ctx)
        x, h1, h2 = self.hidden(ctx)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        lp = self.log_softmax(h2 @ p["O"] + p["c"])
        loss = -lp[np.arange(n), targets[:, 0]].mean()
        d = np.exp(lp)
        d[np.arange(n), targets[:, 0]] -= 1
        d /= n
        g["O"], g["c"] = h2.T @ d, d.sum(0)
        dh = d @ p["O"].T
        if self.pair:
            first = targets[:, 0]
            both = np.concatenate([h2, p["E"][first]], 1)
            lp2 = self.log_softmax(both @ p["V"] + p["d"])
            loss -= lp2[np.arange(n), targets[:, 1]].mean()
            d2 = np.exp(lp2)
            d2[np.arange(n), targets[:, 1]] -= 1
            d2 /= n
            g["V"], g["d"] = both.T @ d2, d2.sum(0)
            back = d2 @ p["V"].T
            dh += back[:, : h2.shape[1]]
            np.add.at(g["E"], first, back[:, h2.shape[1] :])
        if "W2" in p:
            dh = dh * (h2 > 0)
            g["W2"], g["b2"] = h1.T @ dh, dh.sum(0)
            dh = dh @ p["W2"].T
        dh = dh * (h1 > 0)
        g["W1"], g["b1"] = x.T @ dh, dh.sum(0)
        dx = dh @ p["W1"].T
        k = ctx.shape[1]
        de = np.repeat(dx[:, None] / k, k, 1) if self.kind == "bow" else dx.reshape(n, k, -1)
        np.add.at(g["E"], ctx.ravel(), de.reshape(-1, de.shape[-1]))
        for key, v in g.items():
            m1, m2 = adam.setdefault(key, (np.zeros_like(v), np.zeros_like(v)))
            m1 += 0.1 * (v - m1)
            m2 += 0.001 * (v * v - m2)
            p[key] -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        return float(loss)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            np.savez(f, kind=self.kind, pair=self.pair, size=self.size, **{f"p_{k}": v for k, v in self.p.items()})

    @classmethod
    def load(cls, path: str) -> ContextModel:
        with np.load(path) as z:
            m = cls.__new__(cls)
            m.kind, m.pair, m.size = str(z["kind"]), bool(z["pair"]), int(z["size"])
            m.p = {k[2:]: z[k] for k in z.files if k.startswith("p_")}
        return m


def train(rows: DataFrame, vocabulary: int, k: int = 2, kind: str = "bow", pair: bool = False, epochs: int = 3, batch: int = 512, rate: float = 3e-3, most: int = 200_000, seed: int = 1) -> tuple[ContextModel, list[float]]:
    """Fit on at most ``most`` counted rows, those of the smallest hashes, drawn by their counts; the mean loss of each epoch."""
    got = rows.orderBy(F.xxhash64("ctx", "targets", F.lit(seed)), "ctx", "targets").limit(most).collect()
    model, adam, rng, history, t = ContextModel(vocabulary, k, kind, pair=pair, seed=seed), {}, np.random.default_rng(seed), [], 0
    if not got:
        return model, history
    ctx, targets = np.array([r["ctx"] for r in got]), np.array([r["targets"] for r in got])
    share = np.array([r["n"] for r in got], float)
    share /= share.sum()
    for _ in range(epochs):
        losses = []
        for _ in range(max(1, len(got) // batch)):
            own, t = rng.choice(len(got), batch, p=share), t + 1
            losses.append(model.step(ctx[own], targets[own], adam, t, rate))
        history.append(float(np.mean(losses)))
    return model, history


def train_together(rows: DataFrame, vocabulary: int, k: int = 2, kind: str = "bow", pair: bool = False, rounds: int = 5, batch: int = 512, rate: float = 3e-3, seed: int = 1, share: int = 65_536) -> tuple[ContextModel, list[float]]:
    """Fit on all counted rows: tasks of about ``share`` rows draw them by their counts and go on from the mean network of the last round; the mean loss of each round. Without rows the network stays as it began."""
    model, history, t = ContextModel(vocabulary, k, kind, pair=pair, seed=seed), [], 0
    names = sorted(model.p)
    sizes = np.cumsum([0, *(model.p[x].size for x in names)])
    moments = np.zeros(2 * sizes[-1])

    def flat(p: dict) -> np.ndarray:
        return np.concatenate([p[x].ravel() for x in names])

    def filled(own: ContextModel, values: np.ndarray) -> dict:
        return {x: values[sizes[i] : sizes[i + 1]].reshape(own.p[x].shape).copy() for i, x in enumerate(names)}

    rows = cut(rows.select("ctx", "targets", "n"))
    tasks = -(-rows.count() // share)
    for turn in range(rounds if tasks else 0):
        dealt = rows.repartition(tasks, F.xxhash64("ctx", "targets", F.lit(seed + turn)))
        shared = rows.sparkSession.sparkContext.broadcast((flat(model.p), moments, t))

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            weights, started, began = shared.value
            own, rng = ContextModel(vocabulary, k, kind, pair=pair, seed=seed), np.random.default_rng(seed + turn)
            own.p, half = filled(own, weights), len(weights)
            first, second = filled(own, started[:half]), filled(own, started[half:])
            adam, at, seen, losses = {x: (first[x], second[x]) for x in names}, began, 0, []
            for b in batches:
                if not b.num_rows:
                    continue
                ctx, targets, n = np.array(b.column("ctx").to_pylist()), np.array(b.column("targets").to_pylist()), b.column("n").to_numpy().astype(float)
                for _ in range(-(-len(n) // batch)):
                    drawn, at = rng.choice(len(n), min(batch, len(n)), p=n / n.sum()), at + 1
                    losses.append(own.step(ctx[drawn], targets[drawn], adam, at, rate))
                seen += int(n.sum())
            if seen:
                out = np.concatenate([flat(own.p), *(np.concatenate([adam[x][i].ravel() for x in names]) for i in (0, 1))])
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([float(np.mean(losses))]), pa.array([at - began]), pa.array([out], pa.list_(pa.float64()))], names=["n", "loss", "steps", "flat"])

        _, loss, steps, got = averaged(dealt.mapInArrow(run, PART))
        model.p, moments, t = filled(model, got[: sizes[-1]]), got[sizes[-1] :], t + steps
        history.append(loss)
    return model, history


def score(rows: DataFrame, model: ContextModel) -> DataFrame:
    """``rows`` (ctx, targets, n) with lp, the log probability of the targets, for all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ctx, targets = np.array(b.column("ctx").to_pylist()), np.array(b.column("targets").to_pylist())
            at = np.arange(len(ctx))
            lp = shared.value.log_probs(ctx)[at, targets[:, 0]]
            if shared.value.pair:
                lp = lp + shared.value.log_probs(ctx, targets[:, 0])[at, targets[:, 1]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lp)], names=[*b.schema.names, "lp"])

    return rows.mapInArrow(run, "ctx array<int>, targets array<int>, n long, lp double")


def perplexity(scored: DataFrame) -> float:
    """exp of the mean negative log probability, rows weighed by their counts."""
    return float(scored.agg(F.exp(-F.sum(F.col("n") * F.col("lp")) / F.sum("n"))).first()[0])
