"""Recurrent models of sentences in numpy: a language model, and the word in a gap from all words before and behind it.

Both are LSTM layers over word vectors. Training takes a bounded sample of the sentences (``most``, those of the smallest hashes) on
the driver; scoring runs in Arrow batches over all sentences. Ids are those of ``tokens.special_vocabulary``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators.tokens import SPECIAL


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(-1, keepdims=True)
    return z - np.log(np.exp(z).sum(-1, keepdims=True))


class Layer:
    """One LSTM layer; padded places keep the state."""

    def __init__(self, inputs: int, hidden: int, rng: np.random.Generator) -> None:
        self.h = hidden
        self.p = {"W": rng.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * hidden)), "U": rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)), "b": np.zeros(4 * hidden)}
        self.p["b"][hidden : 2 * hidden] = 1.0

    def forward(self, x: np.ndarray, mask: np.ndarray):
        """(states after each step, tape) of (rows, steps, inputs)."""
        n, t_max, _ = x.shape
        h, z = self.h, x @ self.p["W"] + self.p["b"]
        s, c = np.zeros((n, h)), np.zeros((n, h))
        out, tape = np.zeros((n, t_max, h)), []
        for t in range(t_max):
            g = z[:, t] + s @ self.p["U"]
            i, f, o, u = _sigmoid(g[:, :h]), _sigmoid(g[:, h : 2 * h]), _sigmoid(g[:, 2 * h : 3 * h]), np.tanh(g[:, 3 * h :])
            m = mask[:, t : t + 1]
            new = f * c + i * u
            tc = np.tanh(new)
            tape.append((s, c, i, f, o, u, tc, m))
            c, s = m * new + (1 - m) * c, m * o * tc + (1 - m) * s
            out[:, t] = s
        return out, tape

    def backward(self, x: np.ndarray, tape: list, d_out: np.ndarray):
        """Gradients of the weights and of the inputs."""
        g, d_x, h = {k: np.zeros_like(v) for k, v in self.p.items()}, np.zeros_like(x), self.h
        ds, dc = np.zeros((len(x), h)), np.zeros((len(x), h))
        for t in range(x.shape[1] - 1, -1, -1):
            s, c, i, f, o, u, tc, m = tape[t]
            e = d_out[:, t] + ds
            new = e * m
            cell = new * o * (1 - tc * tc) + dc * m
            gate = np.concatenate([cell * u * i * (1 - i), cell * c * f * (1 - f), new * tc * o * (1 - o), cell * i * (1 - u * u)], 1)
            g["U"] += s.T @ gate
            g["W"] += x[:, t].T @ gate
            g["b"] += gate.sum(0)
            d_x[:, t] = gate @ self.p["W"].T
            dc, ds = cell * f + dc * (1 - m), e * (1 - m) + gate @ self.p["U"].T
        return g, d_x


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    width = max((len(r) for r in rows), default=1) or 1
    ids, mask = np.full((len(rows), width), SPECIAL["<pad>"]), np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        ids[k, : len(r)], mask[k, : len(r)] = r, 1
    return ids, mask


class _Model:
    """Parameters by name, Adam steps, files."""

    kind = ""

    def __init__(self, vocabulary: int, embed: int = 32, hidden: int = 48, seed: int = 1, gap: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.size, self.gap = vocabulary, gap
        self.layers = [Layer(embed, hidden, rng) for _ in range(self.sides)]
        self.own = {"E": rng.normal(0, 0.1, (vocabulary, embed)), "O": rng.normal(0, 1 / np.sqrt(hidden * self.sides), (hidden * self.sides, vocabulary)), "c": np.zeros(vocabulary)}
        self.moments: dict[str, list[np.ndarray]] = {}
        self.t = 0

    def parameters(self) -> dict[str, np.ndarray]:
        return self.own | {f"{n}{k}": v for k, layer in enumerate(self.layers) for n, v in layer.p.items()}

    def update(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        norm = float(np.sqrt(sum((g**2).sum() for g in grads.values())))
        for k, p in self.parameters().items():
            g = grads[k] * min(1.0, 5.0 / (norm + 1e-12))
            m = self.moments.setdefault(k, [np.zeros_like(p), np.zeros_like(p)])
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.001 * (g * g - m[1])
            p -= rate * (m[0] / (1 - 0.9**self.t)) / (np.sqrt(m[1] / (1 - 0.999**self.t)) + 1e-8)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            np.savez(f, kind=self.kind, size=self.size, gap=self.gap, **{f"p_{k}": v for k, v in self.parameters().items()})

    @classmethod
    def load(cls, path: str):
        with np.load(path) as z:
            if str(z["kind"]) != cls.kind:
                raise ValueError(f"{path} holds a model of kind {z['kind']}")
            m = cls(int(z["size"]), z["p_E"].shape[1], z["p_U0"].shape[0], gap=int(z["gap"]))
            for k, v in m.parameters().items():
                v[:] = z[f"p_{k}"]
        return m


class LanguageModel(_Model):
    """Each word from those before it, the sentence's end included."""

    kind, sides = "language", 1

    def _run(self, rows: list[np.ndarray]):
        ids, mask = _padded(rows)
        x, ids, mask = self.own["E"][ids[:, :-1]], ids, mask[:, 1:]
        s, tape = self.layers[0].forward(x, mask)
        return ids, mask, x, s, tape, log_softmax(s @ self.own["O"] + self.own["c"])

    def log_probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of whole sentences (ids between start and end)."""
        if not rows:
            return np.zeros(0)
        ids, mask, *_, lp = self._run(rows)
        return (np.take_along_axis(lp, ids[:, 1:, None], 2)[..., 0] * mask).sum(1)

    def step(self, rows: list[np.ndarray], rate: float) -> float:
        ids, mask, x, s, tape, lp = self._run(rows)
        n = mask.sum()
        loss = -(np.take_along_axis(lp, ids[:, 1:, None], 2)[..., 0] * mask).sum() / n
        d = np.exp(lp)
        np.put_along_axis(d, ids[:, 1:, None], np.take_along_axis(d, ids[:, 1:, None], 2) - 1, 2)
        d *= mask[..., None] / n
        g, d_x = self.layers[0].backward(x, tape, d @ self.own["O"].T)
        e = np.zeros_like(self.own["E"])
        np.add.at(e, ids[:, :-1].ravel(), d_x.reshape(-1, d_x.shape[-1]))
        self.update({"E": e, "O": np.einsum("nth,ntv->hv", s, d), "c": d.sum((0, 1))} | {f"{k}0": v for k, v in g.items()}, rate)
        return float(loss)


class ClozeModel(_Model):
    """The first word in a gap of ``gap`` words, from the words before (read forwards) and behind (read backwards)."""

    kind, sides = "cloze", 2

    def contexts(self, rows: list[np.ndarray]):
        """Left and right contexts of every gap of every sentence, its words, and the sentence it is of."""
        out = [(r[:i], r[i + self.gap :][::-1], r[i : i + self.gap], k) for k, r in enumerate(rows) for i in range(1, len(r) - self.gap)]
        return [list(x) for x in zip(*out, strict=True)] if out else [[], [], [], []]

    def _run(self, left: list[np.ndarray], right: list[np.ndarray]):
        sides, states = [], []
        for layer, rows in zip(self.layers, (left, right), strict=True):
            ids, mask = _padded(rows)
            x = self.own["E"][ids]
            s, tape = layer.forward(x, mask)
            sides.append((ids, x, tape, s.shape))
            states.append(s[:, -1])
        h = np.concatenate(states, 1)
        return sides, h, log_softmax(h @ self.own["O"] + self.own["c"])

    def log_probs(self, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """Rows over the vocabulary; right contexts are given backwards."""
        return self._run(left, right)[2] if left else np.zeros((0, self.size))

    def step(self, rows: list[np.ndarray], rate: float) -> float:
        left, right, words, _ = self.contexts(rows)
        if not left:
            return 0.0
        sides, h, lp = self._run(left, right)
        n, y = len(left), np.array([w[0] for w in words])
        d = np.exp(lp)
        d[np.arange(n), y] -= 1
        d /= n
        d_h, grads, e = d @ self.own["O"].T, {"O": h.T @ d, "c": d.sum(0)}, np.zeros_like(self.own["E"])
        for k, (ids, x, tape, shape) in enumerate(sides):
            d_out = np.zeros(shape)
            d_out[:, -1] = d_h[:, k * self.layers[k].h : (k + 1) * self.layers[k].h]
            g, d_x = self.layers[k].backward(x, tape, d_out)
            np.add.at(e, ids.ravel(), d_x.reshape(-1, d_x.shape[-1]))
            grads |= {f"{n_}{k}": v for n_, v in g.items()}
        self.update(grads | {"E": e}, rate)
        return float(-lp[np.arange(n), y].mean())


def pair_log_probs(single: ClozeModel, gapped: ClozeModel, left: list[np.ndarray], right: list[np.ndarray], first: int, second: int) -> np.ndarray:
    """log P(first, second | context): the first word by the model of gaps of two, the second by that of one, the first before it."""
    a = gapped.log_probs(left, right)[:, first]
    return a + single.log_probs([np.append(x, first) for x in left], right)[:, second]


def train(kind: type[_Model], rows: DataFrame, vocabulary: int, epochs: int = 5, batch: int = 64, rate: float = 5e-3, most: int = 20_000, seed: int = 1, **options) -> tuple[_Model, list[float]]:
    """Fit on at most ``most`` sentences (ids), those of the smallest hashes; the mean loss of each epoch."""
    got = [np.array(r["ids"]) for r in rows.select("ids").orderBy(F.xxhash64("ids", F.lit(seed)), "ids").limit(most).collect()]
    model, rng, history = kind(vocabulary, seed=seed, **options), np.random.default_rng(seed), []
    for _ in range(epochs if got else 0):
        order = sorted(rng.permutation(len(got)), key=lambda k: len(got[k]))  # like lengths together
        parts = [order[i : i + batch] for i in range(0, len(order), batch)]
        history.append(float(np.mean([model.step([got[k] for k in parts[j]], rate) for j in rng.permutation(len(parts))])))
    return model, history


def score(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """``rows`` (keys, ids) with lp, the log probability of every sentence, and n, its words and its end."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keys = [c for c in rows.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.array(x) for x in b.column("ids").to_pylist()]
            for i in range(0, len(ids), 256):
                part = ids[i : i + 256]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, len(part)) for c in keys), pa.array(shared.value.log_probabilities(part)), pa.array([len(x) - 1 for x in part], pa.int64())], names=[*keys, "lp", "n"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys) + ", lp double, n long")


def perplexity(scored: DataFrame) -> float:
    return float(scored.agg(F.exp(-F.sum("lp") / F.sum("n"))).first()[0])


def string_divergence(scored: DataFrame, target: str = "target_string") -> float:
    """Mean log ratio of a grammar's string probabilities to the model's, over samples of the grammar with both columns."""
    return float(scored.agg(F.avg(F.col(target) - F.col("lp"))).first()[0])


def gap_log_probs(rows: DataFrame, model: ClozeModel, wanted: list[int]) -> DataFrame:
    """(word, cand, own, lp): of every gap whose word (id) is wanted, the log probability of that word and of each wanted word there."""
    shared = rows.sparkSession.sparkContext.broadcast((model, np.array(sorted(wanted))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, ids = shared.value
            left, right, words, _ = m.contexts([np.array(x) for x in b.column("ids").to_pylist()])
            at = [k for k, w in enumerate(words) if w[0] in ids]
            for i in range(0, len(at), 256):
                part = at[i : i + 256]
                word = np.array([words[k][0] for k in part])
                lp = m.log_probs([left[k] for k in part], [right[k] for k in part])[:, ids]
                own = lp[np.arange(len(part)), np.searchsorted(ids, word)]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(word, n)), pa.array(np.tile(ids, len(part))), pa.array(np.repeat(own, n)), pa.array(lp.ravel())], names=["word", "cand", "own", "lp"])

    return rows.select("ids").mapInArrow(run, "word long, cand long, own double, lp double")


def gap_divergences(probs: DataFrame, expectations: DataFrame, alpha: float = 2.0) -> DataFrame:
    """(a, b, d) from ``gap_log_probs`` and (id, e): Renyi divergences of words' contexts as the model sees them, each gap counting once."""
    e = expectations.select("id", F.ln("e").alias("le"))
    x = probs.where("word <> cand").join(F.broadcast(e.select(F.col("id").alias("word"), F.col("le").alias("ea"))), "word").join(F.broadcast(e.select(F.col("id").alias("cand"), F.col("le").alias("eb"))), "cand")
    ratio = (F.col("own") - F.col("ea")) - (F.col("lp") - F.col("eb"))
    d = F.avg(ratio) if alpha == 1 else F.max(ratio) if alpha == float("inf") else F.ln(F.avg(F.exp((alpha - 1) * ratio))) / (alpha - 1)
    return x.groupBy(F.col("word").alias("a"), F.col("cand").alias("b")).agg(d.alias("d"))
