"""Trees as pre-order arrays of nodes: reading brackets, yields, spans, productions, relabelling.

``nodes`` is array<struct<id, label, i, j, left, right, word>>; children are numbers of nodes, -1 for none. Reading bracket text
is the one step in Python, in Arrow batches; all else is expressions over the array.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "struct<id:int,label:string,i:int,j:int,left:int,right:int,word:string>"
_ARROW = pa.list_(pa.struct([("id", pa.int32()), ("label", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("word", pa.string())]))
_TOKEN = re.compile(r"\(|\)|[^\s()]+")


def parse_tree(text: str | None) -> list[dict] | None:
    """Nodes of a binary bracketing ``(A (B b) (C c))``; null for anything else. Without recursion, so depth is no limit."""
    nodes: list[dict] = []
    open_: list[int] = []
    at, done, expect = 0, False, None
    for t in _TOKEN.findall(text or ""):
        if done:
            return None
        if t == "(":
            expect = "label"
        elif t == ")":
            if expect == "label" or not open_:
                return None
            k = open_.pop()
            n = nodes[k]
            if n["word"] is None and n["right"] < 0:
                return None
            n["j"] = at
            if open_:
                up = nodes[open_[-1]]
                if up["word"] is not None or up["right"] >= 0:
                    return None
                up["left" if up["left"] < 0 else "right"] = k
            else:
                done = True
        elif expect == "label":
            nodes.append({"id": len(nodes), "label": t, "i": at, "j": -1, "left": -1, "right": -1, "word": None})
            open_.append(len(nodes) - 1)
            expect = None
        else:
            if not open_ or nodes[open_[-1]]["word"] is not None or nodes[open_[-1]]["left"] >= 0:
                return None
            nodes[open_[-1]]["word"] = t
            at += 1
    return nodes if done else None


def read_trees(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """``lines`` with ``nodes`` of each bracketing, null where it can't be read."""
    keep = lines.schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.fields) + f", nodes array<{NODE}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = pa.array([parse_tree(t) for t in b.column(text_col).to_pylist()], _ARROW)
            yield pa.RecordBatch.from_arrays([*b.columns, nodes], names=[*b.schema.names, "nodes"])

    return lines.mapInArrow(run, schema)


def leaf_words(nodes: Column) -> Column:
    return F.transform(F.filter(nodes, lambda n: n["word"].isNotNull()), lambda n: n["word"])


def preterminals(nodes: Column) -> Column:
    return F.transform(F.filter(nodes, lambda n: n["word"].isNotNull()), lambda n: n["label"])


def labelled_spans(nodes: Column) -> Column:
    """(label, i, j) of the inner nodes, root included."""
    return F.transform(F.filter(nodes, lambda n: n["word"].isNull()), lambda n: F.struct(n["label"].alias("label"), n["i"].alias("i"), n["j"].alias("j")))


def unlabelled_spans(nodes: Column) -> Column:
    """(i, j) of the inner nodes below the root."""
    return F.transform(F.filter(nodes, lambda n: n["word"].isNull() & (n["id"] > 0)), lambda n: F.struct(n["i"].alias("i"), n["j"].alias("j")))


def relabelled(nodes: Column, mapping: Column) -> Column:
    """Labels renamed by a map column; others stay."""
    return F.transform(nodes, lambda n: n.withField("label", F.coalesce(mapping[n["label"]], n["label"])))


def productions(trees: DataFrame, nodes: str = "nodes") -> DataFrame:
    """(lhs, r1, r2) of every node of every tree."""
    x = trees.select(F.col(nodes).alias("t"), F.explode(nodes).alias("n"))
    child = lambda k: F.get("t", F.col(f"n.{k}"))["label"]
    lex = F.col("n.word").isNotNull()
    return x.select(F.col("n.label").alias("lhs"), F.when(lex, F.col("n.word")).otherwise(child("left")).alias("r1"), F.when(~lex, child("right")).alias("r2"))


def treebank_wcfg(prods: DataFrame) -> DataFrame:
    """Bottom-up weights of a treebank: lexical c over the number of trees, binary c n / (c(B) c(C))."""
    total = prods.where("lhs = 'S'").agg(F.count(F.lit(1)).alias("t"))
    c = prods.groupBy("lhs", "r1", "r2").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))
    of = prods.groupBy("lhs").agg(F.count(F.lit(1)).alias("m"))
    x = c.join(F.broadcast(of.select(F.col("lhs").alias("r1"), F.col("m").alias("m1"))), "r1", "left").join(F.broadcast(of.select(F.col("lhs").alias("r2"), F.col("m").alias("m2"))), "r2", "left")
    return x.select("lhs", "r1", "r2", F.when(F.col("r2").isNull(), F.col("n") / F.col("t")).otherwise(F.col("n") * F.col("t") / (F.col("m1") * F.col("m2"))).alias("p"))


def brackets(nodes: list[dict] | None) -> str | None:
    """Bracket text of nodes, without recursion."""
    if not nodes:
        return None
    out, stack = [], [0]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
            continue
        n = nodes[k]
        if n["word"] is not None:
            out.append(f"({n['label']} {n['word']})")
        else:
            out.append(f"({n['label']} ")
            stack += [")", n["right"], " ", n["left"]]
    return "".join(out)


def catalan(n: int) -> int:
    """Number of binary trees over n + 1 leaves."""
    out = 1
    for k in range(n):
        out = out * 2 * (2 * k + 1) // (k + 2)
    return out


def random_tree(words: list[str], labels: list[str], rng: np.random.Generator) -> str:
    """A bracketing drawn uniformly from the shapes over ``words``; the root takes the first label, other nodes any."""

    def build(lo: int, hi: int, label: str) -> str:
        n = hi - lo
        if n == 1:
            return f"({label} {words[lo]})"
        shares = np.array([catalan(k - 1) * catalan(n - k - 1) for k in range(1, n)], dtype=object)
        pick, at = int(rng.integers(0, 1 << 62)) * int(shares.sum()) >> 62, 0
        k = 0
        while at + shares[k] <= pick:
            at += shares[k]
            k += 1
        return f"({label} {build(lo, lo + k + 1, str(rng.choice(labels)))} {build(lo + k + 1, hi, str(rng.choice(labels)))})"

    return build(0, len(words), labels[0])


def depth(nodes: list[dict] | None) -> int:
    """Levels of a tree; a single leaf has one."""
    if not nodes:
        return 0
    level = {0: 1}
    for n in nodes:  # parents stand before their children
        for c in (n["left"], n["right"]):
            if c >= 0:
                level[c] = level[n["id"]] + 1
    return max(level.values())


def unlabelled(nodes: Column) -> Column:
    """A tree's shape with its words, as text: equal for trees that differ in labels only."""
    return F.array_join(F.transform(nodes, lambda n: F.concat_ws(":", n["i"].cast("string"), n["j"].cast("string"), F.coalesce(n["word"], F.lit("")))), " ")


def simplified(nested: str) -> str:
    """Bracket text whose lexical nodes have a preterminal of their own, ``(A (PREA w))``, as ``(A w)``; a root above the start,
    ``(S1 (S ...))``, goes. Both are unary nodes, so any unary node gives way to its child, lexical ones keeping the upper label."""
    stack: list[list] = [[]]
    for t in _TOKEN.findall(nested):
        if t == "(":
            stack.append([])
        elif t == ")":
            x = stack.pop()
            if len(x) == 2 and isinstance(x[1], list):  # unary
                x = [x[0], x[1][1]] if len(x[1]) == 2 and isinstance(x[1][1], str) else x[1]
            stack[-1].append(x)
        else:
            stack[-1].append(t)
    text = lambda x: x if isinstance(x, str) else "(" + " ".join(text(y) for y in x) + ")"
    return text(stack[0][0])


def max_entropy(n: int) -> float:
    """Entropy of a uniform choice among the binary trees over n words."""
    return float(np.log(catalan(n - 1))) if n > 0 else 0.0


def made_words(n: int, rng: np.random.Generator, length: int = 3) -> list[str]:
    """n different strings of lower-case letters; longer ones where the short ones don't suffice."""
    out: dict[str, None] = {}
    while len(out) < n:
        if len(out) * 2 >= 26**length:
            length += 1
        out["".join(chr(97 + k) for k in rng.integers(0, 26, length))] = None
    return list(out)
