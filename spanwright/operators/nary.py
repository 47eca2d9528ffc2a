"""Trees whose nodes have any number of children, as bracket text: their productions, and binary forms that can be undone.

Trees are read, changed and written within Arrow batches, a tree at a time and without recursion, so depth is no limit. Text that
is no tree gives null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators.general import SEPARATOR

_TOKEN = re.compile(r"\(|\)|[^\s()]+")


class Node:
    """A label, and children; a word is a node without any."""

    __slots__ = ("children", "label")

    def __init__(self, label: str, children: list[Node] | None = None) -> None:
        self.label, self.children = label, children or []


def read(text: str | None) -> Node | None:
    """The tree of ``(A (B b) c ...)``; null for anything else, as for a bracket without label or children."""
    open_: list[Node] = []
    root, label = None, False
    for t in _TOKEN.findall(text or ""):
        if root is not None or (label and t in "()"):
            return None
        if t == "(":
            label = True
        elif label:
            open_.append(Node(t))
            label = False
        elif not open_:
            return None
        elif t != ")":
            open_[-1].children.append(Node(t))
        else:
            n = open_.pop()
            if not n.children:
                return None
            if open_:
                open_[-1].children.append(n)
            else:
                root = n
    return root


def write(root: Node) -> str:
    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif not n.children:
            out.append(n.label)
        else:
            out.append(f"({n.label}")
            stack.append(")")
            for c in reversed(n.children):
                stack += [c, " "]
    return "".join(out)


def in_order(root: Node) -> list[Node]:
    """All nodes, parents before their children."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += n.children[::-1]
    return out


def collapsed(root: Node) -> Node:
    """Without nodes over a single child of the same label: one of a chain stays."""
    for n in in_order(root):
        while len(n.children) == 1 and n.children[0].children and n.children[0].label == n.label:
            n.children = n.children[0].children
    return root


def binarised(root: Node, side: str = "right", separator: str = SEPARATOR) -> Node:
    """Nodes with three children or more get inner ones.

    ``right``: an inner node holds a child and all after it, under their labels joined. ``left``: a child and all before it.
    ``down``: as right, but its label joins the parent's and those of the children before it.
    """
    for n in in_order(root):
        own = n.children
        if len(own) < 3:
            continue
        names = [c.label for c in own]
        if side == "left":
            inner = own[0]
            for k in range(1, len(own) - 1):
                inner = Node(separator.join(names[: k + 1]), [inner, own[k]])
            n.children = [inner, own[-1]]
        else:
            inner = own[-1]
            for k in range(len(own) - 2, 0, -1):
                inner = Node(separator.join(names[k:] if side == "right" else [n.label, *names[:k]]), [own[k], inner])
            n.children = [own[0], inner]
    return root


def unbinarised(root: Node, separator: str = SEPARATOR) -> Node:
    """Inner nodes, whose labels hold the separator, give way to their children."""
    for n in in_order(root):
        while any(c.children and separator in c.label for c in n.children):
            n.children = [g for c in n.children for g in (c.children if c.children and separator in c.label else [c])]
    return root


def mapped(trees: DataFrame, change: Callable[[Node], Node], text_col: str = "value", out: str = "value") -> DataFrame:
    """``trees`` with the changed tree's text as ``out``, null where there is no tree."""
    keep = [f for f in trees.schema.fields if f.name != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([write(change(t)) if (t := read(x)) is not None else None for x in b.column(text_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), texts], names=[*(f.name for f in keep), out])

    return trees.mapInArrow(run, schema)


def productions(trees: DataFrame, text_col: str = "value") -> DataFrame:
    """(other columns, lhs, rhs array<string>) of every node with children of every tree."""
    keep = [f for f in trees.schema.fields if f.name != text_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "lhs string", "rhs array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, lhs, rhs = [], [], []
            for k, x in enumerate(b.column(text_col).to_pylist()):
                for n in in_order(t) if (t := read(x)) is not None else ():
                    if n.children:
                        at.append(k)
                        lhs.append(n.label)
                        rhs.append([c.label for c in n.children])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name).take(take) for f in keep), pa.array(lhs, pa.string()), pa.array(rhs, pa.list_(pa.string()))], names=[*(f.name for f in keep), "lhs", "rhs"])

    return trees.mapInArrow(run, schema)


def rules_of(prods: DataFrame, times: str | None = None) -> DataFrame:
    """(lhs, rhs, n, p): relative frequencies of productions, each as often as the column ``times`` has it."""
    c = prods.groupBy("lhs", "rhs").agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("n"))
    total = c.groupBy("lhs").agg(F.sum("n").alias("t"))
    return c.join(total, "lhs").select("lhs", "rhs", "n", (F.col("n") / F.col("t")).alias("p"))


def log_weights(prods: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lp): the log weight of each tree from its productions; null where the grammar lacks one."""
    used = prods.groupBy(*keys, "lhs", "rhs").agg(F.count(F.lit(1)).alias("c"))
    x = used.join(rules.select("lhs", "rhs", "p"), ["lhs", "rhs"], "left")
    lacks = F.max((F.coalesce("p", F.lit(0.0)) <= 0).cast("int"))
    return x.groupBy(*keys).agg(F.when(lacks == 0, F.sum(F.when(F.col("p") > 0, F.col("c") * F.ln("p")))).alias("lp"))
