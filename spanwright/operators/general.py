"""Weighted grammars whose rules have any length, unary ones among nonterminals too: rule tables (lhs, rhs array<string>, p).

Longer rules are factored into binary ones over symbols that rules share; unary rules enter every chart cell through their
closure, the sum of all chains of them. A symbol is a nonterminal if it is some rule's left side; words stand alone on a right
side. Only the rules among nonterminals, of a grammar's size, come to the driver: lexical rules are joined to the tokens, so a
lexicon may be as large as it likes.

A sentence that doesn't parse, an empty or null one, has a null score and no counts. Sentences are rows of keys, w (array<string>)
and, if they like, weight (how often each counts).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.operators.grammar import Divergent
from spanwright.operators.lineage import cut

RULE = ["lhs", "rhs"]
SEPARATOR = "|"


def from_binary(rules: DataFrame) -> DataFrame:
    """(lhs, rhs, p) of rules (lhs, r1, r2, p)."""
    return rules.select("lhs", F.when(F.col("r2").isNull(), F.array("r1")).otherwise(F.array("r1", "r2")).alias("rhs"), "p")


def binarised(rules: DataFrame, side: str = "left", separator: str = SEPARATOR) -> DataFrame:
    """The same grammar with rules of two symbols at most.

    ``left`` makes symbols of the beginnings of right sides, ``right`` of their ends; rules with a beginning (end) in common share
    them. The last rule of a chain has the weight, the others 1, so trees keep their weights.
    """
    held = F.exists(F.concat(F.array("lhs"), "rhs"), lambda s: F.contains(s, F.lit(separator))) & (F.size("rhs") > 1)
    rules = rules.withColumn("lhs", F.when(held, F.raise_error(F.concat(F.lit(f"a symbol of a longer rule holds the separator {separator}: "), "lhs"))).otherwise(F.col("lhs")))
    n = F.size("rhs")
    long_ = rules.where(n > 2)
    of = lambda a, k: F.array_join(F.slice("rhs", a, k), separator)
    if side == "left":
        top = F.array(of(F.lit(1), n - 1), F.element_at("rhs", -1))
        step: Column = F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.struct(of(F.lit(1), k).alias("lhs"), F.array(of(F.lit(1), k - 1), F.element_at("rhs", k)).alias("rhs")))
    else:
        top = F.array(F.element_at("rhs", 1), of(F.lit(2), n - 1))
        step = F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.struct(of(k, n - k + 1).alias("lhs"), F.array(F.element_at("rhs", k), of(k + 1, n - k)).alias("rhs")))
    made = long_.select(F.explode(step).alias("s")).select("s.lhs", "s.rhs").distinct().withColumn("p", F.lit(1.0))
    return rules.where(n <= 2).select(*RULE, "p").unionByName(long_.select("lhs", top.alias("rhs"), "p")).unionByName(made)


def unbinarised(rules: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """The rules that ``binarised`` came from; other columns (counts) stay."""
    inside = F.flatten(F.transform("rhs", lambda s: F.when(F.size("rhs") > 1, F.split(s, f"\\Q{separator}\\E")).otherwise(F.array(s))))
    return rules.where(~F.contains("lhs", F.lit(separator)) | (F.size("rhs") == 1)).withColumn("rhs", inside)


def nonterminals(rules: DataFrame) -> list[str]:
    return sorted(r["lhs"] for r in rules.select("lhs").distinct().collect())  # a row for each nonterminal


def lexical_rules(rules: DataFrame, nts: list[str]) -> DataFrame:
    """(lhs, word, p), repeated rules added up."""
    x = rules.where((F.size("rhs") == 1) & ~F.get("rhs", F.lit(0)).isin(nts)).select("lhs", F.get("rhs", F.lit(0)).alias("word"), "p")
    return x.groupBy("lhs", "word").agg(F.sum("p").alias("p"))


def closure(unary: np.ndarray, least: float = 0.0) -> np.ndarray:
    """(I - U)^-1: sums of the weights of all chains of unary rules; entries up to ``least`` are left out."""
    if len(unary) and np.abs(np.linalg.eigvals(unary)).max() >= 1:
        raise Divergent("chains of unary rules have no finite sum")
    out = np.linalg.inv(np.eye(len(unary)) - unary)
    return np.where(out > least, out, 0.0)


class GeneralChart:
    """Binary and unary rules among numbered symbols, and the closure of the unary ones."""

    def __init__(self, rules: list[tuple[str, list[str], float]], symbols: list[str], start: str = "S", least: float = 0.0) -> None:
        self.symbols = symbols
        at = {s: k for k, s in enumerate(symbols)}
        self.start = at.get(start, -1)
        rules = sorted((r for r in rules if r[2] > 0), key=lambda r: (r[0], r[1]))
        self.binary = [(at[a], at[r[0]], at[r[1]], p) for a, r, p in rules if len(r) == 2]
        self.unary = [(at[a], at[r[0]], p) for a, r, p in rules if len(r) == 1]
        self.a, self.b, self.c = (np.array([r[k] for r in self.binary], np.int64) for k in range(3))
        self.p = np.array([r[3] for r in self.binary], float)
        self.ua, self.ub = (np.array([r[k] for r in self.unary], np.int64) for k in range(2))
        self.up = np.array([r[2] for r in self.unary], float)
        u = np.zeros((len(symbols), len(symbols)))
        np.add.at(u, (self.ua, self.ub), self.up)
        self.closure = closure(u, least)

    def sum_to(self, symbols: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(symbols, values, len(self.symbols))

    def inside(self, leaves: np.ndarray) -> tuple[np.ndarray, float]:
        """(n, n + 1, symbols) span weights with chains above them, words scaled to a greatest weight of 1, and the log of the scale."""
        n, m = leaves.shape
        scale = leaves.max(1, initial=0)
        scale[scale <= 0] = 1.0
        t = np.zeros((n, n + 1, m))
        t[np.arange(n), np.arange(1, n + 1)] = leaves / scale[:, None] @ self.closure.T
        for width in range(2, n + 1):
            for i in range(n - width + 1):
                j = i + width
                own = self.p * np.einsum("kr,kr->r", t[i, i + 1 : j][:, self.b], t[i + 1 : j, j][:, self.c])
                t[i, j] = self.closure @ self.sum_to(self.a, own)
        return t, float(np.log(scale).sum())

    def log_probability(self, leaves: np.ndarray) -> float | None:
        if not len(leaves) or self.start < 0:
            return None
        t, scale = self.inside(leaves)
        top = t[0, len(leaves), self.start]
        return math.log(top) + scale if top > 0 else None

    def counts(self, leaves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray] | None:
        """Log probability, and expected uses of the binary rules, of the unary ones, and of each lexical rule at each word."""
        n = len(leaves)
        if not n or self.start < 0:
            return None
        t, scale = self.inside(leaves)
        top = t[0, n, self.start]
        if top <= 0:
            return None
        out = np.zeros_like(t)
        out[0, n, self.start] = 1 / top
        binary, unary, words = np.zeros(len(self.binary)), np.zeros(len(self.unary)), np.zeros_like(leaves)
        largest = leaves.max(1)
        for width in range(n, 0, -1):
            for i in range(n - width + 1):
                j = i + width
                if not out[i, j].any():
                    continue
                below = self.closure.T @ out[i, j]  # what stands around a symbol that no unary rule has expanded yet
                if len(self.unary):
                    unary += below[self.ua] * self.up * t[i, j, self.ub]
                if width == 1:
                    words[i] = below * leaves[i] / largest[i]
                    continue
                part = below[self.a] * self.p
                lb, rc = t[i, i + 1 : j][:, self.b], t[i + 1 : j, j][:, self.c]
                binary += part * np.einsum("kr,kr->r", lb, rc)
                for s, k in enumerate(range(i + 1, j)):
                    out[i, k] += self.sum_to(self.b, part * rc[s])
                    out[k, j] += self.sum_to(self.c, part * lb[s])
        return math.log(top) + scale, binary, unary, words


def chart_of(rules: DataFrame, start: str = "S", least: float = 0.0) -> tuple[GeneralChart, DataFrame]:
    """The rules among nonterminals as a chart, repeated ones added up, and the lexical rules, which stay in Spark. A word in a longer rule is refused."""
    nts = nonterminals(rules)
    inner = binarised(rules.where((F.size("rhs") > 1) | F.get("rhs", F.lit(0)).isin(nts)))
    rows: dict[tuple, float] = {}
    for r in inner.collect():  # of a grammar's size, without its lexicon
        key = r["lhs"], tuple(r["rhs"])
        rows[key] = rows.get(key, 0.0) + r["p"]
    symbols = sorted({*nts, *(a for a, _ in rows)})
    bad = {s for _, r in rows for s in r} - set(symbols)
    if bad:
        raise ValueError(f"words in longer rules: {sorted(bad)}")
    return GeneralChart([(a, list(r), p) for (a, r), p in rows.items()], symbols, start, least), lexical_rules(rules, nts)


def _with_leaves(sents: DataFrame, lexical: DataFrame, symbols: list[str]) -> DataFrame:
    """(keys, weight, leaves): each token with its word and the lexical rules that it may come from; keys tell sentences apart."""
    keys = [c for c in sents.columns if c not in ("w", "weight")]
    if not keys:
        raise ValueError("sentences need a key beside w")
    number = sents.sparkSession.createDataFrame(list(enumerate(symbols)), "k int, lhs string")
    own = lexical.where("p > 0").join(F.broadcast(number), "lhs").groupBy("word").agg(F.collect_list(F.struct("k", "p")).alias("own"))  # as many as nonterminals
    x = sents if "weight" in sents.columns else sents.withColumn("weight", F.lit(1.0))
    x = x.select(*keys, F.col("weight").cast("double").alias("weight"), F.posexplode_outer("w").alias("i", "word")).join(own, "word", "left")
    return x.groupBy(*keys).agg(F.first("weight").alias("weight"), F.array_sort(F.collect_list(F.struct("i", "word", "own"))).alias("leaves"))  # a sentence's tokens


def _matrix(leaves: list[dict], m: int) -> np.ndarray:
    if leaves and leaves[0]["i"] is None:
        return np.zeros((0, m))
    out = np.zeros((len(leaves), m))
    for i, x in enumerate(leaves):
        for y in x["own"] or ():
            out[i, y["k"]] += y["p"]
    return out


def inside_log_probability(rules: DataFrame, sents: DataFrame, start: str = "S", least: float = 0.0) -> DataFrame:
    """(keys, lp) under a grammar of any arity."""
    chart, lexical = chart_of(rules, start, least)
    keys = [c for c in sents.columns if c not in ("w", "weight")]
    shared = sents.sparkSession.sparkContext.broadcast(chart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = shared.value
            lp = pa.array([c.log_probability(_matrix(x, len(c.symbols))) for x in batch.column("leaves").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), lp], names=[*keys, "lp"])

    schema = ", ".join(f"`{c}` {sents.schema[c].dataType.simpleString()}" for c in keys) + ", lp double"
    return _with_leaves(sents, lexical, chart.symbols).mapInArrow(run, schema)


def distinct_sentences(sents: DataFrame) -> DataFrame:
    """(id, w, weight): each different sentence once, with the weights of all its copies; the id is the sentence itself as text.

    What sums over sentences needs no more: over a small lexicon and a bounded length the number of sentences no longer grows.
    """
    weight = F.col("weight").cast("double") if "weight" in sents.columns else F.lit(1.0)
    return sents.select("w", weight.alias("weight")).groupBy("w").agg(F.sum("weight").alias("weight")).select(F.to_json(F.struct("w")).alias("id"), "w", "weight")


def expected_counts(rules: DataFrame, sents: DataFrame, start: str = "S", least: float = 0.0) -> DataFrame:
    """(lhs, rhs, n): expected uses of the rules over all sentences that parse, each by its weight. Rows with a null lhs hold what
    the sentences add up to: their number ('sentences'), log probability ('log_probability') and words ('tokens')."""
    chart, lexical = chart_of(rules, start, least)
    shared = sents.sparkSession.sparkContext.broadcast(chart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        binary, unary, lex, sums = np.zeros(len(c.binary)), np.zeros(len(c.unary)), {}, np.zeros(3)
        for batch in batches:
            for leaves, weight in zip(batch.column("leaves").to_pylist(), batch.column("weight").to_pylist(), strict=True):
                got = c.counts(_matrix(leaves, len(c.symbols)))
                if got is None:
                    continue
                lp, b, u, words = got
                binary += weight * b
                unary += weight * u
                sums += weight * np.array([1.0, lp, len(words)])
                for i, k in zip(*np.nonzero(words), strict=True):
                    key = int(k), leaves[i]["word"]
                    lex[key] = lex.get(key, 0.0) + weight * float(words[i, k])
        s = c.symbols
        rows = [(s[x], [s[y], s[z]], n) for (x, y, z, _), n in zip(c.binary, binary.tolist(), strict=True)] + [(s[x], [s[y]], n) for (x, y, _), n in zip(c.unary, unary.tolist(), strict=True)]
        rows += [(s[k], [w], n) for (k, w), n in lex.items()] + [(None, [x], n) for x, n in zip(("sentences", "log_probability", "tokens"), sums.tolist(), strict=True)]
        rows = [r for r in rows if r[2]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.float64())], names=["lhs", "rhs", "n"])

    counts = _with_leaves(distinct_sentences(sents), lexical, chart.symbols).mapInArrow(run, "lhs string, rhs array<string>, n double").groupBy(*RULE).agg(F.sum("n").alias("n"))
    return unbinarised(counts.where("lhs IS NOT NULL")).unionByName(counts.where("lhs IS NULL"))


def normalised(rules: DataFrame) -> DataFrame:
    """p over the sum of its left side, which is summed before the shuffle."""
    return rules.join(rules.groupBy("lhs").agg(F.sum("p").alias("__t")), "lhs").select(*RULE, (F.col("p") / F.col("__t")).alias("p"))


class Fit:
    """What training has come to: the rules, and for each round its objective and bits a word; ``counts`` are the last expectations."""

    def __init__(self, rules: DataFrame) -> None:
        self.rules, self.objective, self.bits, self.counts = rules, [], [], None


def _expectations(fit: Fit, sents: DataFrame, start: str) -> tuple[DataFrame, float, float]:
    counts = cut(expected_counts(fit.rules, sents, start))
    sums = {r["rhs"][0]: r["n"] for r in counts.where("lhs IS NULL").collect()}  # three rows
    return counts.where("lhs IS NOT NULL"), sums.get("log_probability", 0.0), sums.get("tokens", 0.0)


def m_step(rules: DataFrame, counts: DataFrame, bias: float = 0.0, variational: bool = False) -> DataFrame:
    """Weights from counts with ``bias`` added to every rule's: relative frequencies, or exp(psi(n)) / exp(psi(sum)) where ``variational``."""
    x = rules.select(*RULE).join(counts, RULE, "left").select(*RULE, F.greatest(F.coalesce("n", F.lit(0.0)) + bias, F.lit(0.0)).alias("p"))
    total = x.groupBy("lhs").agg(F.sum("p").alias("t"))
    x = x.join(total, "lhs")
    return x.select(*RULE, (F.exp(psi(F.col("p")) - psi(F.col("t"))) if variational else F.try_divide("p", "t")).alias("p")).where("p > 0")


def psi(x: Column) -> Column:
    """Digamma as an expression: six steps of recurrence, then the asymptotic series; null where x is not positive."""
    x = F.when(x > 0, x)
    up = x + 6
    y = 1 / (up * up)
    series = F.ln(up) - 0.5 / up - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    for k in range(6):
        series = series - 1 / (x + k)
    return series


def em(rules: DataFrame, sents: DataFrame, rounds: int = 5, start: str = "S", least_rounds: int = 1, tolerance: float = 0.0, prune: float = 0.0, bias: float = 0.0, variational: bool = False, jitter: float = 0.0, anneal: tuple[float, float, int] = (1.0, 1.0, 0), max_length: int | None = None, seed: int = 0) -> Fit:
    """Batch EM over rules of any arity until ``rounds``, or from ``least_rounds`` on until the log probability rises by less than ``tolerance`` of itself and no rule goes.

    ``prune`` drops lighter rules, ``jitter`` scales weights by up to so much at random, ``anneal`` (from, to, rounds) raises the
    weights of the first rounds to one over a temperature that falls from one to the other.
    """
    sents = sents if max_length is None else sents.where(F.size("w") <= max_length)
    sents = cut(distinct_sentences(sents))
    fit = Fit(rules.select(*RULE, "p"))
    counts, last, tokens = _expectations(fit, sents, start)
    n_rules = fit.rules.count()
    for k in range(1, rounds + 1):
        if not tokens:
            break
        x = normalised(m_step(fit.rules, counts, bias, variational).where(F.col("p") > prune))
        if jitter:
            x = normalised(x.withColumn("p", F.col("p") * (1 + jitter * (F.pmod(F.xxhash64("lhs", "rhs", F.lit(seed), F.lit(k)), F.lit(1 << 20)) / float(1 << 20)))))
        if k < anneal[2]:
            x = x.withColumn("p", F.pow("p", F.lit(1 / (anneal[0] * (anneal[1] / anneal[0]) ** ((k - 1) / max(anneal[2] - 1, 1))))))
        fit.rules = cut(x)
        counts, lp, tokens = _expectations(fit, sents, start)
        fit.objective.append(lp)
        fit.bits.append(-lp / math.log(2) / tokens if tokens else float("nan"))
        left = fit.rules.count()
        if left == n_rules and k >= least_rounds and (lp - last) / max(abs(lp), 1e-300) < tolerance:
            break
        last, n_rules = lp, left
    fit.counts = counts
    return fit


def entropies(rules: DataFrame) -> float:
    """Sum of the entropies of the left sides' rules."""
    return -(rules.where("p > 0").agg(F.coalesce(F.sum(F.col("p") * F.ln("p")), F.lit(0.0))).first()[0])


def entropic_target(rules: DataFrame, counts: DataFrame, factor: float) -> DataFrame:
    """p times the slope of (log probability - ``factor`` x entropies), normalised: an uphill end point within the simplex of each left side.

    The slope of a rule is n / p + factor (ln p + 1); where that is negative for some rule, all of its left side rise by so much,
    which leaves the way along the simplex as it is. With the factor 0 this is the M-step of EM.
    """
    x = rules.join(counts, RULE, "left").select(*RULE, "p", (F.coalesce("n", F.lit(0.0)) / F.col("p") + factor * (F.ln("p") + 1)).alias("slope"))
    of = x.groupBy("lhs").agg(F.greatest(F.lit(0.0), -F.min("slope")).alias("lift"), F.sum(F.col("p") * F.col("slope")).alias("t"), F.sum("p").alias("one"))
    y = x.join(of, "lhs").withColumn("total", F.col("t") + F.col("lift") * F.col("one"))
    moved = F.when(F.col("total") > 0, F.col("p") * (F.col("slope") + F.col("lift")) / F.col("total")).otherwise(F.col("p"))
    return y.select(*RULE, moved.alias("p"))


def entropic(rules: DataFrame, sents: DataFrame, factor: float, rounds: int = 5, start: str = "S", prune: float = 0.0, tolerance: float = 0.0, halvings: int = 10, max_length: int | None = None) -> Fit:
    """Training that favours sharp grammars (``factor`` > 0) or flat ones (< 0): ascent of log probability - factor x entropies.

    A round goes from the weights towards ``entropic_target``, all the way or half as far until the objective doesn't fall, so it
    never does; expectations come from a Spark job for each try. ``prune`` drops lighter rules before the ascent begins to measure a round.
    """
    sents = sents if max_length is None else sents.where(F.size("w") <= max_length)
    sents = cut(distinct_sentences(sents))
    fit = Fit(cut(normalised(rules.select(*RULE, "p").where("p > 0"))))
    counts, lp, tokens = _expectations(fit, sents, start)
    fit.objective.append(lp - factor * entropies(fit.rules))
    for _ in range(rounds):
        target = cut(entropic_target(fit.rules, counts, factor))
        way, found = 1.0, False
        for _ in range(halvings):
            mixed = fit.rules.join(target.withColumnRenamed("p", "q"), RULE).select(*RULE, ((1 - way) * F.col("p") + way * F.col("q")).alias("p")).where(F.col("p") > prune)
            trial = Fit(cut(normalised(mixed)))
            more, lp, tokens = _expectations(trial, sents, start)
            value = lp - factor * entropies(trial.rules)
            if value >= fit.objective[-1]:
                found = True
                break
            way /= 2
        if not found:
            break
        rise = value - fit.objective[-1]
        fit.rules, counts = trial.rules, more
        fit.objective.append(value)
        fit.bits.append(-lp / math.log(2) / tokens if tokens else float("nan"))
        if rise < tolerance * abs(value):
            break
    fit.counts = counts
    return fit
