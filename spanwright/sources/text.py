"""Text formats of corpora, grammars, n-gram tables, clusters, anchor lists and experiment settings, read as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """(value, parts) of the non-blank lines; ``#`` starts a comment line."""
    x = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    if comments:
        x = x.where(~F.col("value").startswith("#"))
    return x.withColumn("parts", F.split("value", r"\s+"))


def _metadata(spark: SparkSession, path: str) -> dict[str, int | str]:
    """``k=v`` pairs of the comment lines, whole numbers as such."""
    pairs = spark.read.text(path).where(F.col("value").startswith("#")).select(F.explode(F.expr(r"regexp_extract_all(value, '(\\w+)=(\\S+)', 0)")).alias("kv")).collect()
    out: dict[str, int | str] = {}
    for r in pairs:
        k, v = r["kv"].split("=", 1)
        out[k] = int(v) if v.lstrip("-").isdigit() else v
    return out


def _checked(value: Column, bad: Column, message: str) -> Column:
    return F.when(bad, F.raise_error(F.concat(F.lit(message + ": "), F.col("value")))).otherwise(value)


def read_corpus(spark: SparkSession, path: str, comments: bool = False, lower_only: bool = False) -> DataFrame:
    """(sid, w): a sentence per non-empty line. ``lower_only`` refuses tokens that don't start with a small letter."""
    x = _lines(spark, path, comments)
    w = F.col("parts")
    if lower_only:
        w = _checked(w, F.exists("parts", lambda t: ~t.rlike(r"^\p{Ll}")), "token does not start with a small letter")
    return x.select(F.monotonically_increasing_id().alias("sid"), w.alias("w"))


def read_weighted_yields(spark: SparkSession, path: str) -> DataFrame:
    """(weight, w): lines that may start with a number."""
    x = _lines(spark, path)
    first = F.expr("try_cast(get(parts, 0) AS double)")
    return x.select(F.coalesce(first, F.lit(1.0)).alias("weight"), F.when(first.isNotNull(), F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))).otherwise(F.col("parts")).alias("w"))


def read_grammar(spark: SparkSession, path: str, start: str = "S") -> DataFrame:
    """(lhs, r1, r2, p) of lines ``p LHS -> RHS...``; a repeated production counts once, with its last weight by value order.

    A weight that is negative or zero is refused, and so is a grammar without a rule of the start symbol.
    """
    x = _lines(spark, path).where((F.size("parts") >= 4) & (F.get("parts", F.lit(2)) == "->"))
    p = F.expr("cast(get(parts, 0) AS double)")
    rows = x.select(F.get("parts", F.lit(1)).alias("lhs"), F.get("parts", F.lit(3)).alias("r1"), F.get("parts", F.lit(4)).alias("r2"), _checked(p, p <= 0, "weight must be positive").alias("p"))
    rows = rows.groupBy("lhs", "r1", "r2").agg(F.max("p").alias("p"))
    if rows.where(F.col("lhs") == start).limit(1).count() == 0:
        raise ValueError(f"no rule of the start symbol {start}")
    return rows


def read_unweighted_grammar(spark: SparkSession, path: str) -> DataFrame:
    """(lhs, r1, r2) of lines ``LHS -> RHS...``."""
    x = _lines(spark, path).where(F.get("parts", F.lit(1)) == "->")
    return x.select(F.get("parts", F.lit(0)).alias("lhs"), F.get("parts", F.lit(2)).alias("r1"), F.get("parts", F.lit(3)).alias("r2")).distinct()


def read_general_grammar(spark: SparkSession, path: str, default_bias: float = 0.0) -> DataFrame:
    """(weight, bias, lhs, rhs) of lines ``[weight [bias]] Parent --> Children...`` of any arity."""
    m = r"^(?:([-+0-9.eE]+)\s+(?:([-+0-9.eE]+)\s+)?)?(\S+)\s+-->\s*(.*)$"
    x = spark.read.text(path).where(F.trim("value") != "")
    num = lambda k, d: F.coalesce(F.expr(f"try_cast(regexp_extract(value, r'{m}', {k}) AS double)"), F.lit(d))
    return x.select(num(1, 1.0).alias("weight"), num(2, default_bias).alias("bias"), F.regexp_extract("value", m, 3).alias("lhs"), F.filter(F.split(F.regexp_extract("value", m, 4), r"\s+"), lambda t: t != "").alias("rhs"))


def read_preterminal_grammar(spark: SparkSession, path: str) -> DataFrame:
    """(lhs, r1, r2, p): ``A --> PREA`` times ``PREA --> w`` folded into ``A -> w``; the top rule ``S1 --> S`` left out."""
    g = read_general_grammar(spark, path).where("lhs <> 'S1'")
    pre = lambda c: F.col(c).startswith("PRE")
    up = g.where((F.size("rhs") == 1) & ~pre("lhs")).select("lhs", F.col("rhs")[0].alias("pre"), F.col("weight").alias("a"))
    down = g.where((F.size("rhs") == 1) & pre("lhs")).select(F.col("lhs").alias("pre"), F.col("rhs")[0].alias("r1"), F.col("weight").alias("b"))
    lex = up.join(down, "pre").select("lhs", "r1", F.lit(None).cast("string").alias("r2"), (F.col("a") * F.col("b")).alias("p"))
    return lex.unionByName(g.where(F.size("rhs") == 2).select("lhs", F.col("rhs")[0].alias("r1"), F.col("rhs")[1].alias("r2"), F.col("weight").alias("p")))


def read_rule_counts(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """Counts (lhs, r1, r2, n) and the number of parsed sentences, which the line of ``S1 --> S`` holds."""
    g = read_general_grammar(spark, path)
    top = g.where("lhs = 'S1'").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    return g.where("lhs <> 'S1'").select("lhs", F.get("rhs", F.lit(0)).alias("r1"), F.get("rhs", F.lit(1)).alias("r2"), F.col("weight").alias("n")), float(top)


def read_bigrams(spark: SparkSession, path: str) -> DataFrame:
    """(w1, w2, n) of a tab-separated table, plain or gzip."""
    return spark.read.csv(path, sep="\t", comment="#", quote="", schema="w1 string, w2 string, n bigint").groupBy("w1", "w2").agg(F.max("n").alias("n"))


def read_trigrams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", quote="", schema="w1 string, w2 string, w3 string, n bigint").groupBy("w1", "w2", "w3").agg(F.max("n").alias("n"))


def read_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(word, cid) and the header's settings."""
    x = _lines(spark, path).select(F.get("parts", F.lit(0)).alias("word"), F.expr("cast(get(parts, 1) AS int)").alias("cid"))
    return x, _metadata(spark, path)


def read_anchors(spark: SparkSession, path: str) -> tuple[list[str], dict]:
    """Anchor words in order, of a JSON list or of a list of lines; a handful of words."""
    raw = "\n".join(r["value"] for r in spark.read.text(path).collect())
    if raw.lstrip().startswith("["):
        return json.loads(raw), {}
    return [x.strip() for x in raw.splitlines() if x.strip() and not x.startswith("#")], _metadata(spark, path)


def read_config(path: str, defaults: dict[str, dict]) -> dict[str, dict]:
    """A JSON file of settings by section, over the defaults."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    return {k: {**defaults.get(k, {}), **given.get(k, {})} for k in {**defaults, **given}}
