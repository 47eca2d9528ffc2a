"""Text sinks of grammars, n-gram tables, clusters and anchors. Parquet is the lossless sink; these keep seven digits."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _text(lines: DataFrame, path: str, header: list[str], compression: str | None = None) -> None:
    """``lines`` (key columns to order by, value) behind a header, in files that read in that order."""
    head = lines.sparkSession.createDataFrame([(k, f"# {h}") for k, h in enumerate(header)] or [(0, None)], "k int, value string").where("value is not null").select(F.lit(0).alias("part"), F.col("k").cast("string").alias("key"), "value")
    body = lines.select(F.lit(1).alias("part"), F.col("key").cast("string").alias("key"), "value")
    head.unionByName(body).orderBy("part", "key").select("value").write.text(path, compression=compression)


def write_grammar(rules: DataFrame, path: str, header: list[str] = ()) -> None:
    """Lines ``%e LHS -> RHS``."""
    rhs = F.concat_ws(" ", "r1", "r2")
    _text(rules.select(F.concat_ws(" ", "lhs", rhs).alias("key"), F.format_string("%e %s -> %s", "p", "lhs", rhs).alias("value")), path, list(header))


def write_preterminal_grammar(rules: DataFrame, path: str, start: str = "S") -> None:
    """The start rule, ``A --> PREA`` with A's lexical mass, ``PREA --> w`` with its share, and the binary rules."""
    lex = rules.where("r2 is null")
    mass = lex.groupBy("lhs").agg(F.sum("p").alias("m"))
    line = lambda p, lhs, rhs: F.format_string("%e %s --> %s", p, lhs, rhs)
    pre = F.concat(F.lit("PRE"), "lhs")
    parts = [
        rules.sparkSession.createDataFrame([("0", f"1.0 S1 --> {start}")], "key string, value string"),
        mass.select(F.concat(F.lit("1"), "lhs").alias("key"), line(F.col("m"), F.col("lhs"), pre).alias("value")),
        lex.join(F.broadcast(mass), "lhs").select(F.concat_ws(" ", F.lit("2"), "lhs", "r1").alias("key"), line(F.col("p") / F.col("m"), pre, F.col("r1")).alias("value")),
        rules.where("r2 is not null").select(F.concat_ws(" ", F.lit("3"), "lhs", "r1", "r2").alias("key"), line(F.col("p"), F.col("lhs"), F.concat_ws(" ", "r1", "r2")).alias("value")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    _text(out, path, [])


def write_ngrams(counts: DataFrame, path: str, gz: bool = True) -> None:
    """Sorted tab-separated counts behind a line with the numbers of types and tokens."""
    keys = [c for c in counts.columns if c != "n"]
    types, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    name = {2: "bigrams", 3: "trigrams"}.get(len(keys), "ngrams")
    _text(counts.select(F.concat_ws("\t", *keys).alias("key"), F.concat_ws("\t", *keys, F.col("n").cast("string")).alias("value")), path, [f"{name} n_types={types} n_tokens={total}"], "gzip" if gz else None)


def write_clusters(clusters: DataFrame, path: str, **settings: object) -> None:
    _text(clusters.select(F.col("word").alias("key"), F.concat_ws(" ", "word", F.col("cid").cast("string")).alias("value")), path, [" ".join(f"{k}={v}" for k, v in settings.items())] if settings else [])


def write_corpus(sents: DataFrame, path: str) -> None:
    """One sentence a line."""
    sents.select(F.array_join("w", " ").alias("value")).write.text(path)


def write_anchors(spark, words: list[str], path: str, as_json: bool = False, **settings: object) -> None:
    rows = [json.dumps(words)] if as_json else [*([" ".join(["#", *(f"{k}={v}" for k, v in settings.items())])] if settings else []), *words]
    spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1).write.text(path)


def write_general_grammar(rules: DataFrame, path: str, least: float = 0.0) -> None:
    """Lines ``weight LHS --> RHS...`` of rules (lhs, rhs, p) heavier than ``least``; all digits are kept."""
    line = F.concat_ws(" ", F.col("p").cast("string"), "lhs", F.lit("-->"), F.array_join("rhs", " "))
    rules.where(F.col("p") > least).orderBy("lhs", F.desc("p"), F.array_join("rhs", " ")).select(line.alias("value")).write.mode("overwrite").text(path)
