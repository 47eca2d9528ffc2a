"""Trees and strings sampled from a grammar: a generator of its own for every sample number, so any task can redo its share."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators import charts, trees
from spanwright.operators import grammar as G
from spanwright.operators.grammar import is_normalised


class Sampler:
    """Top-down draws from normalised rules."""

    def __init__(self, rules: list[tuple[str, str, str | None, float]], start: str = "S", max_depth: int = 100) -> None:
        self.start, self.max_depth = start, max_depth
        self.by: dict[str, tuple[list[tuple[str, str | None]], np.ndarray]] = {}
        for a in sorted({r[0] for r in rules}):
            own = sorted(((b, c, p) for x, b, c, p in rules if x == a), key=lambda r: (r[0], r[1] or ""))
            p = np.cumsum([x[2] for x in own])
            self.by[a] = [(b, c) for b, c, _ in own], p / p[-1]

    def tree(self, rng: np.random.Generator) -> str | None:
        """A bracketing, or None where it grows deeper than ``max_depth``."""
        out: list[str] = []
        todo: list[tuple[str, int] | str] = [(self.start, 0)]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            a, depth = x
            if depth >= self.max_depth:
                return None
            choices, cum = self.by[a]
            b, c = choices[min(int(np.searchsorted(cum, rng.random(), "right")), len(choices) - 1)]
            if c is None:
                out.append(f"({a} {b})")
            else:
                out.append(f"({a} ")
                todo += [")", (c, depth + 1), " ", (b, depth + 1)]
        return "".join(out)


def sample_trees(rules: DataFrame, n: int, seed: int, start: str = "S", max_depth: int = 100) -> DataFrame:
    """(sample, tree) for n samples; null trees were too deep."""
    if not is_normalised(rules):
        raise ValueError("the grammar is not normalised")
    spark = rules.sparkSession
    shared = spark.sparkContext.broadcast(Sampler([tuple(r) for r in rules.select("lhs", "r1", "r2", "p").collect()], start, max_depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([shared.value.tree(np.random.default_rng([seed, k])) for k in b.column("id").to_pylist()], pa.string())], names=["sample", "tree"])

    return spark.range(n).mapInArrow(run, "sample long, tree string")


def yields(trees: DataFrame) -> DataFrame:
    """(sample, w): the words of sampled trees."""
    return trees.where("tree is not null").select("sample", F.expr(r"regexp_extract_all(tree, '([^\\s()]+)\\)', 1)").alias("w"))


def random_grammar(spark, nonterminals: int, terminals: int, seed: int, binary_share: float = 0.4, concentration: float = 1.0, zipf: float = 1.0, per_nonterminal: int | None = None) -> DataFrame:
    """(lhs, r1, r2, p): a normalised grammar drawn at random. The start rewrites as pairs only and is in no right side.

    Every other nonterminal keeps ``1 - binary_share`` of its mass for words (under one half branches, so trees are finite) and deals
    it over words, all or ``per_nonterminal`` of them, by Zipf weights in an order of its own; pairs get Dirichlet weights.
    """
    rng = np.random.default_rng(seed)
    below, words = [f"NT{k}" for k in range(1, nonterminals)], trees.made_words(terminals, rng)
    rows = []
    for a in ["S", *below]:
        share = 1.0 if a == "S" else binary_share
        for (b, c), p in zip([(b, c) for b in below for c in below], rng.dirichlet(np.full(len(below) ** 2, concentration)), strict=True):
            rows.append((a, b, c, float(share * p)))
        if a != "S":
            own = rng.permutation(words)[:per_nonterminal]
            w = np.arange(1, len(own) + 1) ** -float(zipf)
            rows += [(a, str(x), None, float((1 - share) * p)) for x, p in zip(own, w / w.sum(), strict=True)]
    return spark.createDataFrame([r for r in rows if r[3] > 0], "lhs string, r1 string, r2 string, p double")


def with_terminals(rules: DataFrame, terminals: int, seed: int, zipf: float = 1.0) -> DataFrame:
    """The same nonterminals and pairs over a lexicon of another size: each nonterminal's lexical mass is dealt anew."""
    rng = np.random.default_rng(seed)
    words = trees.made_words(terminals, rng)
    rows = []
    for r in G.lexical(rules).groupBy("lhs").agg(F.sum("p").alias("m")).orderBy("lhs").collect():  # one row per nonterminal
        w = np.arange(1, terminals + 1) ** -float(zipf)
        rows += [(r["lhs"], str(x), None, float(r["m"] * p)) for x, p in zip(rng.permutation(words), w / w.sum(), strict=True)]
    return rules.sparkSession.createDataFrame(rows, "lhs string, r1 string, r2 string, p double").unionByName(G.binary(rules).select("lhs", "r1", "r2", "p"))


#: Different trees whose scores a task keeps at once.
KNOWN = 100_000


def _derivation(nodes: list[dict], logs: dict[tuple, float]) -> float | None:
    """Log weight of a tree; null where the grammar lacks a rule of it."""
    uses = Counter((x["label"], x["word"], None) if x["word"] is not None else (x["label"], nodes[x["left"]]["label"], nodes[x["right"]]["label"]) for x in nodes)
    return sum(n * logs[r] for r, n in uses.items()) if all(r in logs for r in uses) else None


def scored_samples(rules: DataFrame, n: int, seed: int, max_length: int = 50, start: str = "S", models: dict[str, DataFrame] | None = None) -> DataFrame:
    """(sample, tree, len, and for the grammar itself and each further one: lp_tree, lp_bracket, lp_string): log weights of sampled
    trees, of all labellings of their shapes, and of their strings; null where a grammar has none. Trees over ``max_length`` words go.

    One pass over the samples: a tree that a task has met before keeps its scores, the strings of the others are scored together."""
    grammars = {}
    for name, g in ({"target": rules} | (models or {})).items():
        rows = [tuple(r) for r in g.select("lhs", "r1", "r2", "p").collect()]  # a grammar
        grammars[name] = charts.Chart(rows, start), {(a, b, c): math.log(p) for a, b, c, p in rows if p > 0}
    shared = rules.sparkSession.sparkContext.broadcast(grammars)
    columns = [f"{name}_{kind}" for name in grammars for kind in ("string", "bracket", "tree")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple | None] = {}
        for b in batches:
            if len(known) > KNOWN:
                known = {}
            texts = b.column("tree").to_pylist()
            new = {x: trees.parse_tree(x) for x in dict.fromkeys(texts) if x not in known}
            words = {x: [y["word"] for y in nodes if y["word"] is not None] for x, nodes in new.items() if nodes}
            known |= dict.fromkeys(x for x in new if len(words.get(x, ())) not in range(1, max_length + 1))
            kept = [x for x in new if x not in known]
            at = {w: k for k, w in enumerate(dict.fromkeys(tuple(words[x]) for x in kept))}
            scores = [(c, logs, c.log_probabilities([list(w) for w in at])) for c, logs in shared.value.values()]
            for x in kept:
                own = [len(words[x])]
                for c, logs, of in scores:
                    bracket = c.bracketed(new[x])
                    own += [of[at[tuple(words[x])]], None if bracket is None else bracket[0], _derivation(new[x], logs)]
                known[x] = tuple(own)
            take = [k for k, x in enumerate(texts) if known[x] is not None]
            found = [known[texts[k]] for k in take]
            values = [pa.array([f[0] for f in found], pa.int32()), *(pa.array([f[k + 1] for f in found], pa.float64()) for k in range(len(columns)))]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(take, pa.int64())) for c in ("sample", "tree")), *values], names=["sample", "tree", "len", *columns])

    sampled = sample_trees(rules, n, seed, start).where("tree is not null")
    return sampled.mapInArrow(run, ", ".join(["sample long", "tree string", "len int", *(f"`{c}` double" for c in columns)]))


def string_entropy(scored: DataFrame) -> DataFrame:
    """One row: entropy of strings, of trees given strings (ambiguity), and word perplexity, from a grammar's own samples."""
    return scored.agg((-F.avg("target_string")).alias("entropy"), F.avg(F.col("target_string") - F.col("target_tree")).alias("ambiguity"), F.exp(-F.sum("target_string") / F.sum(F.col("len") + 1)).alias("perplexity"))


def string_density(rules: DataFrame, length: int, n: int, seed: int) -> float:
    """Share of n strings of ``length`` words, drawn evenly, that the grammar has."""
    words = [r["r1"] for r in G.lexical(rules).select("r1").distinct().orderBy("r1").collect()]  # the lexicon
    at = [F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(len(words))).cast("int") for k in range(length)]
    s = rules.sparkSession.range(n).select("id", F.array(*[F.get(F.array(*[F.lit(w) for w in words]), a) for a in at]).alias("w"))
    return float(charts.inside_log_probability(s, charts.chart_of(rules)).agg(F.avg(F.col("lp").isNotNull().cast("double"))).first()[0])
