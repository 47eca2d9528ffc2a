"""Anchor words from context divergences, and the rule weights that anchors give.

Divergence tables come from Spark (``contextmodels.pair_divergences``) for a bounded list of candidates, a few hundred words; the
greedy choice over such a table is a driver's loop.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from statistics import NormalDist, median

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators import contextmodels as M
from spanwright.operators import tokens as T

Table = dict[tuple[str, str], float]


def divergence_table(frame: DataFrame) -> Table:
    """The pairs of a bounded candidate list."""
    return {(r["a"], r["b"]): r["d"] for r in frame.collect()}


def halves(sents: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The sentences in two halves by hash, the same on every run."""
    h = F.pmod(F.xxhash64(*sents.columns, F.lit(seed)), F.lit(2))
    return sents.where(h == 0), sents.where(h == 1)


def max_min(d: Table, words: list[str], least: float = 0.3) -> list[str]:
    """From the most frequent word on, always the word whose smallest divergence from the chosen ones is greatest, down to ``least``."""
    chosen = words[:1]
    while rest := [w for w in words if w not in chosen]:
        gap = {w: min(d.get((w, c), math.inf) for c in chosen) for w in rest}
        best = max(rest, key=lambda w: (gap[w], -words.index(w)))
        if gap[best] < least:
            break
        chosen.append(best)
    return chosen


@dataclass
class Decision:
    """What became of a candidate, for the log."""

    word: str
    closest: str
    divergence: float
    noise: float
    kept: bool
    reason: str


@dataclass
class NoiseFit:
    """Sampling noise of divergences: a + b / sqrt(the rarer word's count), fitted to the differences of two halves."""

    a: float = 0.0
    b: float = 0.0

    @classmethod
    def of(cls, one: Table, two: Table, counts: dict[str, int]) -> NoiseFit:
        x, y = [], []
        for k in one.keys() & two.keys():
            if math.isfinite(one[k]) and math.isfinite(two[k]):
                x.append(1 / math.sqrt(min(counts[k[0]], counts[k[1]])))
                y.append(abs(one[k] - two[k]))
        if len(x) < 3:
            return cls()
        (b, a), *_ = np.linalg.lstsq(np.stack([x, np.ones(len(x))], axis=1), np.array(y), rcond=None)
        return cls(max(0.0, float(a)), max(0.0, float(b)))

    def __call__(self, n: int) -> float:
        return self.a + self.b / math.sqrt(n)


@dataclass
class Ordered:
    anchors: list[str] = field(default_factory=list)
    log: list[Decision] = field(default_factory=list)
    threshold: float = 0.0


def divergence_ordered(full: Table, one: Table, two: Table, counts: dict[str, int], spread: float = 8.0, max_rejects: int = 20, mixture: float = 3.0) -> Ordered:
    """Greedy furthest words on divergence less noise; the threshold comes from the median spread of pairs below their noise.

    A candidate that some pair of anchors together covers (its divergence to both within ``mixture`` of the noise) is left out.
    """
    noise = NoiseFit.of(one, two, counts)
    words = sorted(counts, key=lambda w: (-counts[w], w))
    excess = lambda a, b: full.get((a, b), math.inf) - noise(min(counts[a], counts[b]))
    low = [x for a in words for b in words if a != b and math.isfinite(x := excess(a, b)) and x <= 0]
    threshold = spread * median([abs(x - median(low)) for x in low]) if len(low) > 10 else 0.0
    out, rejects = Ordered(words[:1], [], threshold), 0
    left = words[1:]
    while left and rejects < max_rejects:
        gap = {w: min((excess(w, c), c) for c in out.anchors) for w in left}
        best = max(left, key=lambda w: (gap[w][0], counts[w], w))
        left.remove(best)
        g, near = gap[best]
        n = noise(min(counts[best], counts[near]))
        covered = [c for c in out.anchors if full.get((c, best), math.inf) < mixture * max(n, 1e-9)]
        if g <= threshold:
            out.log.append(Decision(best, near, g + n, n, False, "near an anchor"))
            break
        if len(covered) >= 2:
            out.log.append(Decision(best, near, g + n, n, False, "mixture of anchors"))
            rejects += 1
            continue
        rejects = 0
        out.anchors.append(best)
        out.log.append(Decision(best, near, g + n, n, True, "far"))
        for c in out.anchors[1:-1]:  # an anchor that the new one covers goes
            if excess(c, best) <= threshold:
                out.anchors.remove(c)
    return out


def noise_sigma(fractions: list[float], epsilon: float) -> float:
    """Third quartile of the noise scales that would give these shares of violations by chance."""
    normal = NormalDist()
    scales = sorted(-epsilon / normal.inv_cdf(v) for v in fractions if 0 < v < 0.5)
    return scales[int(0.75 * (len(scales) - 1))] if scales else 100.0


def violation_threshold(sigma: float, n: int, epsilon: float, confidence: float = 0.99) -> float:
    """Share of violations that noise alone stays under."""
    p = NormalDist().cdf(-epsilon / sigma) if sigma > 0 else 0.0
    return p + NormalDist().inv_cdf(confidence) * math.sqrt(p * (1 - p) / max(n, 1))


def minimal(violations: Table, counts: dict[str, int], epsilon: float = 1.5, floor: float = 0.1) -> list[str]:
    """Antichain of words none of whose contexts are a subset of another's, by shares of violated contexts."""
    words = sorted(counts, key=lambda w: (-counts[w], w))
    sigma = noise_sigma([v for (a, b), v in violations.items() if a in words[:80] and b in words[:80]], epsilon)
    within = lambda a, b: violations.get((a, b), 1.0) < max(floor, violation_threshold(sigma, min(counts[a], counts[b]), epsilon))
    kept: list[str] = []
    for w in words:
        if any(within(k, w) for k in kept):  # some kept word is as special
            continue
        kept = [k for k in kept if not within(w, k)] + [w]
    return kept


def binary_weights(sents: DataFrame, anchors: list[str], divergence: Table | None = None) -> list[tuple[str, str, str, float]]:
    """(A, B, C, xi): for the start, E2(bc) / (E(b) E(c)) of two-word sentences; for others exp(PMI(b, c) - D)."""
    total = sents.count()
    e = {r["word"]: r["n"] / total for r in T.word_counts(sents).where(F.col("word").isin(anchors)).collect()}
    pairs = T.inner_bigrams(sents).where(F.col("w1").isin(anchors) & F.col("w2").isin(anchors)).collect()
    two = T.of_length(sents, 2).where(F.col("w1").isin(anchors) & F.col("w2").isin(anchors)).collect()
    out = [("S", r["w1"], r["w2"], r["n"] / total / (e[r["w1"]] * e[r["w2"]])) for r in two]
    for r in pairs:
        b, c = r["w1"], r["w2"]
        ratio = r["n"] / total / (e[b] * e[c])
        out += [(a, b, c, ratio * math.exp(-(divergence or {}).get((a, f"{b} {c}"), 0.0))) for a in anchors]
    return out


def select(sents: DataFrame, n_candidates: int = 60, alpha: float = 2.0) -> Ordered:
    """Divergence-ordered anchors among the most frequent words, with a count model on all sentences and on each half."""
    words = M.word_table(sents, n_candidates)
    counts = {r["word"]: r["n"] for r in words.collect()}
    table = lambda s: divergence_table(M.pair_divergences(s, words, alpha))
    a, b = halves(sents)
    return divergence_ordered(table(sents), table(a), table(b), counts)
