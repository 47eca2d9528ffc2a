"""Chart parsing of sentences in Arrow batches: inside sums, best trees, tree counts, and expected rule counts.

A sentence is parsed within one task; the grammar, small beside the corpus, goes to the tasks as a broadcast value. Write length
filters before the parser, so that Spark drops long sentences before Python sees them. A sentence that doesn't parse has null
scores and no counts, as has an empty or null one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Numbers that the charts of sentences of one length hold at once.
MAX_CELLS = 1 << 22


class Chart:
    """A grammar's rules as arrays."""

    def __init__(self, rules: list[tuple[str, str, str | None, float]], start: str = "S") -> None:
        self.nts = sorted({r[0] for r in rules})
        at = {a: k for k, a in enumerate(self.nts)}
        self.lex: dict[str, list[tuple[int, float]]] = {}
        self.start = at.get(start, -1)
        rows = []
        for a, b, c, p in sorted(rules, key=lambda r: (r[0], r[1], r[2] or "")):
            if p <= 0:
                continue
            if c is None:
                self.lex.setdefault(b, []).append((at[a], p))
            elif b in at and c in at:
                rows.append((at[a], at[b], at[c], p))
        self.a, self.b, self.c = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        self.p = np.array([r[3] for r in rows], float)
        self.rows = rows

    def leaves(self, w: list[str], wildcard: str | None = None) -> np.ndarray | None:
        """(n, nonterminals) lexical weights; the wildcard stands for any word."""
        out = np.zeros((len(w), len(self.nts)))
        for i, x in enumerate(w):
            if wildcard is not None and x == wildcard:
                for own in self.lex.values():
                    for k, p in own:
                        out[i, k] += p
            for k, p in self.lex.get(x, ()):
                out[i, k] += p
        return out

    def inside(self, w: list[str], wildcard: str | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(n, n + 1, nonterminals) span weights scaled word by word, and the log of each word's scale."""
        n, leaves = len(w), self.leaves(w, wildcard)
        scale = leaves.max(1)
        scale[scale <= 0] = 1.0
        t = np.zeros((n, n + 1, len(self.nts)))
        for i in range(n):
            t[i, i + 1] = leaves[i] / scale[i]
        for width in range(2, n + 1):
            for i in range(n - width + 1):
                j = i + width
                left, right = t[i, i + 1 : j], t[i + 1 : j, j]
                np.add.at(t[i, j], self.a, self.p * (left[:, self.b] * right[:, self.c]).sum(0))
        return t, np.log(scale)

    def log_probability(self, w: list[str], wildcard: str | None = None) -> float | None:
        if not w or self.start < 0:
            return None
        t, scale = self.inside(w, wildcard)
        top = t[0, len(w), self.start]
        return math.log(top) + float(scale.sum()) if top > 0 else None

    def log_probabilities(self, sents: list[list[str]]) -> list[float | None]:
        """``log_probability`` of many sentences: those of a length share each step of the chart, some MAX_CELLS entries at once."""
        out: list[float | None] = [None] * len(sents)
        of: dict[int, list[int]] = {}
        for k, w in enumerate(sents):
            if w and self.start >= 0:
                of.setdefault(len(w), []).append(k)
        upper = np.zeros((len(self.a), len(self.nts)))
        upper[np.arange(len(self.a)), self.a] = self.p
        for n, own in of.items():
            size = max(1, MAX_CELLS // (n * (n + 1) * max(len(self.nts), len(self.a), 1)))
            for part in (own[x : x + size] for x in range(0, len(own), size)):
                leaves = np.stack([self.leaves(sents[k]) for k in part])
                scale = leaves.max(2)
                scale[scale <= 0] = 1.0
                t = np.zeros((len(part), n, n + 1, len(self.nts)))
                t[:, np.arange(n), np.arange(1, n + 1)] = leaves / scale[:, :, None]
                for width in range(2, n + 1):
                    for i in range(n - width + 1):
                        j = i + width
                        t[:, i, j] = (t[:, i, i + 1 : j][..., self.b] * t[:, i + 1 : j, j][..., self.c]).sum(1) @ upper
                for k, top, logs in zip(part, t[:, 0, n, self.start].tolist(), np.log(scale).sum(1).tolist(), strict=True):
                    out[k] = math.log(top) + logs if top > 0 else None
        return out

    def best(self, w: list[str]) -> tuple[float, str] | None:
        """Log weight and bracketing of the heaviest tree; on ties the first split, then the first rule by name."""
        n = len(w)
        if not n or self.start < 0:
            return None
        score = np.full((n, n + 1, len(self.nts)), -np.inf)
        back: dict[tuple[int, int, int], tuple[int, int]] = {}
        with np.errstate(divide="ignore"):
            for i, row in enumerate(self.leaves(w)):
                score[i, i + 1] = np.log(row)
            logp = np.log(self.p)
        for width in range(2, n + 1):
            for i in range(n - width + 1):
                j = i + width
                for m in range(i + 1, j):
                    v = logp + score[i, m, self.b] + score[m, j, self.c]
                    for k in np.flatnonzero(v > score[i, j, self.a]):
                        if v[k] > score[i, j, self.a[k]]:
                            score[i, j, self.a[k]] = v[k]
                            back[i, j, int(self.a[k])] = (m, int(k))
        if score[0, n, self.start] == -np.inf:
            return None

        def show(i: int, j: int, a: int) -> str:
            if j == i + 1:
                return f"({self.nts[a]} {w[i]})"
            m, k = back[i, j, a]
            return f"({self.nts[a]} {show(i, m, int(self.b[k]))} {show(m, j, int(self.c[k]))})"

        return float(score[0, n, self.start]), show(0, n, self.start)

    def bracketed(self, nodes: list[dict], best: bool = False) -> tuple[float, str | None] | None:
        """Log weight of all labellings of a tree's shape, or the heaviest labelling (the first rule by name on ties) and its text."""
        if not nodes or self.start < 0:
            return None
        own: dict[int, np.ndarray] = {}
        back: dict[tuple[int, int], int] = {}
        with np.errstate(divide="ignore"):
            logp = np.log(self.p)
            for x in reversed(nodes):  # children stand behind their parents
                if x["word"] is not None:
                    own[x["id"]] = np.log(self.leaves([x["word"]])[0])
                    continue
                v = logp + own[x["left"]][self.b] + own[x["right"]][self.c]
                out = np.full(len(self.nts), -np.inf)
                if best:
                    for k in np.argsort(-v, kind="stable"):
                        if v[k] > out[self.a[k]]:
                            out[self.a[k]] = v[k]
                            back[x["id"], int(self.a[k])] = int(k)
                else:
                    np.logaddexp.at(out, self.a, v)
                own[x["id"]] = out
        top = own[nodes[0]["id"]][self.start]
        if top == -np.inf:
            return None
        if not best:
            return float(top), None
        out_, todo = [], [(0, self.start)]
        while todo:
            t = todo.pop()
            if isinstance(t, str):
                out_.append(t)
                continue
            k, a = t
            x = nodes[k]
            if x["word"] is not None:
                out_.append(f"({self.nts[a]} {x['word']})")
            else:
                r = back[x["id"], a]
                out_.append(f"({self.nts[a]} ")
                todo += [")", (x["right"], int(self.c[r])), " ", (x["left"], int(self.b[r]))]
        return float(top), "".join(out_)

    def trees(self, w: list[str]) -> int:
        """Number of trees, exactly."""
        n = len(w)
        t: dict[tuple[int, int], dict[int, int]] = {(i, i + 1): {k: 1 for k, _ in self.lex.get(x, ())} for i, x in enumerate(w)}
        for width in range(2, n + 1):
            for i in range(n - width + 1):
                own: dict[int, int] = {}
                for m in range(i + 1, i + width):
                    left, right = t[i, m], t[m, i + width]
                    for a, b, c, _ in self.rows if left and right else ():
                        if b in left and c in right:
                            own[a] = own.get(a, 0) + left[b] * right[c]
                t[i, i + width] = own
        return t.get((0, n), {}).get(self.start, 0)

    def counts(self, w: list[str], weight: float = 1.0) -> tuple[float, dict[tuple[str, str, str | None], float]] | None:
        """Log probability and expected rule counts of a sentence."""
        n = len(w)
        if not n or self.start < 0:
            return None
        t, scale = self.inside(w)
        top = t[0, n, self.start]
        if top <= 0:
            return None
        out_ = np.zeros_like(t)
        out_[0, n, self.start] = 1.0
        uses = np.zeros(len(self.rows))
        for width in range(n, 1, -1):
            for i in range(n - width + 1):
                j = i + width
                o = out_[i, j]
                if not o.any():
                    continue
                left, right = t[i, i + 1 : j], t[i + 1 : j, j]
                part = o[self.a] * self.p
                lb, rc = left[:, self.b], right[:, self.c]
                uses += part * (lb * rc).sum(0)
                for s, m in enumerate(range(i + 1, j)):
                    np.add.at(out_[i, m], self.b, part * rc[s])
                    np.add.at(out_[m, j], self.c, part * lb[s])
        found = {(self.nts[a], self.nts[b], self.nts[c]): weight * u / top for (a, b, c, _), u in zip(self.rows, uses, strict=True) if u > 0}
        for i, x in enumerate(w):
            for k, p in self.lex.get(x, ()):
                v = out_[i, i + 1, k] * p / math.exp(scale[i]) / top * weight
                if v > 0:
                    key = (self.nts[k], x, None)
                    found[key] = found.get(key, 0.0) + v
        return math.log(top) + float(scale.sum()), found


def chart_of(rules: DataFrame, start: str = "S") -> Chart:
    """The grammar, brought to the driver: its size is that of a grammar, not of a corpus."""
    return Chart([tuple(r) for r in rules.select("lhs", "r1", "r2", "p").collect()], start)


def _per_sentence(sents: DataFrame, chart: Chart, f, kind: pa.DataType, name: str, sql: str) -> DataFrame:
    keys = [c for c in sents.columns if c != "w"]
    schema = ", ".join(f"`{c}` {sents.schema[c].dataType.simpleString()}" for c in keys) + f", {name} {sql}"
    shared = sents.sparkSession.sparkContext.broadcast(chart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([f(shared.value, w or []) for w in batch.column("w").to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), values], names=[*keys, name])

    return sents.mapInArrow(run, schema)


def inside_log_probability(sents: DataFrame, chart: Chart, wildcard: str | None = None) -> DataFrame:
    """``sents`` (keys, w) with lp, null where there is no tree."""
    return _per_sentence(sents, chart, lambda c, w: c.log_probability(w, wildcard), pa.float64(), "lp", "double")


def viterbi(sents: DataFrame, chart: Chart) -> DataFrame:
    """``sents`` with best (lp, tree)."""
    kind = pa.struct([("lp", pa.float64()), ("tree", pa.string())])
    return _per_sentence(sents, chart, lambda c, w: dict(zip(("lp", "tree"), b, strict=True)) if (b := c.best(w)) else None, kind, "best", "struct<lp:double,tree:string>")


def known_words(sents: DataFrame, chart: Chart, unk: str) -> DataFrame:
    """``sents`` with words that the grammar lacks replaced, for the parsers."""
    keys = [c for c in sents.columns if c != "w"]
    shared = sents.sparkSession.sparkContext.broadcast(frozenset(chart.lex))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([None if w is None else [x if x in shared.value else unk for x in w] for w in batch.column("w").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), words], names=[*keys, "w"])

    return sents.select(*keys, "w").mapInArrow(run, ", ".join(f"`{c}` {sents.schema[c].dataType.simpleString()}" for c in keys) + ", w array<string>")


def bracketed_scores(trees: DataFrame, chart: Chart) -> DataFrame:
    """``trees`` (keys, nodes) with lp (log weight of all labellings of the shape) and best (lp, tree), null where there is none."""
    keys = [c for c in trees.columns if c != "nodes"]
    schema = ", ".join(f"`{c}` {trees.schema[c].dataType.simpleString()}" for c in keys) + ", lp double, best struct<lp:double,tree:string>"
    shared = trees.sparkSession.sparkContext.broadcast(chart)
    kind = pa.struct([("lp", pa.float64()), ("tree", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [n or [] for n in batch.column("nodes").to_pylist()]
            lp = [x[0] if (x := shared.value.bracketed(n)) else None for n in nodes]
            best = [dict(zip(("lp", "tree"), x, strict=True)) if (x := shared.value.bracketed(n, True)) else None for n in nodes]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(lp, pa.float64()), pa.array(best, kind)], names=[*keys, "lp", "best"])

    return trees.mapInArrow(run, schema)


def tree_counts(sents: DataFrame, chart: Chart) -> DataFrame:
    """``sents`` with n_trees, exact as a decimal of 38 digits."""
    from decimal import Decimal

    return _per_sentence(sents, chart, lambda c, w: Decimal(c.trees(w)), pa.decimal128(38, 0), "n_trees", "decimal(38,0)")


COUNTS = "lhs string, r1 string, r2 string, n double"


def expected_counts(sents: DataFrame, chart: Chart) -> DataFrame:
    """(lhs, r1, r2, n): expected rule counts over all sentences that parse; the rule (null, 'sentences', null) counts those, and
    (null, 'log_probability', null) sums their log probabilities. Equal sentences are parsed once; counts are added up in each task
    before the shuffle."""
    shared = sents.sparkSession.sparkContext.broadcast(chart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, float] = {}
        for batch in batches:
            for w, times in zip(batch.column("w").to_pylist(), batch.column("times").to_pylist(), strict=True):
                got = shared.value.counts(w or [], float(times))
                if got:
                    lp, found = got
                    for k, v in [*found.items(), ((None, "sentences", None), float(times)), ((None, "log_probability", None), lp * times)]:
                        total[k] = total.get(k, 0.0) + v
        if total:
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in total], pa.string()) for i in range(3)), pa.array(list(total.values()))], names=["lhs", "r1", "r2", "n"])

    return sents.groupBy("w").agg(F.count(F.lit(1)).alias("times")).mapInArrow(run, COUNTS).groupBy("lhs", "r1", "r2").agg(F.sum("n").alias("n"))
