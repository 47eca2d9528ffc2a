"""Frequencies of frequencies, association and divergence tables, shrinkage, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def mutual(bg: Column, u1: Column, u2: Column) -> Column:
    """bg ln(bg / (u1 u2)), 0 without joint counts."""
    return F.when(bg > 0, bg * F.ln(bg / (u1 * u2))).otherwise(F.lit(0.0))


def pmi(bigrams: DataFrame, words: DataFrame, total: DataFrame, min_count: int = 1) -> DataFrame:
    """(w1, w2, n, pmi) of neighbours seen ``min_count`` times: ln E(w1 w2) - ln E(w1) - ln E(w2), expectations per sentence."""
    a = words.select(F.col("word").alias("w1"), F.col("n").alias("n1"))
    b = words.select(F.col("word").alias("w2"), F.col("n").alias("n2"))
    x = bigrams.where(F.col("n") >= min_count).join(a, "w1").join(b, "w2").crossJoin(F.broadcast(total))
    d = lambda c: F.col(c).cast("double")
    return x.select("w1", "w2", "n", (F.round(F.ln(d("n")) + F.ln(d("total")) - F.ln(d("n1")) - F.ln(d("n2")), 9) + F.lit(0.0)).alias("pmi"))


def freq_of_freq(counts: DataFrame, n: str = "n") -> DataFrame:
    """(r, nr): how many species have each count. One row a distinct count."""
    return counts.groupBy(F.col(n).alias("r")).agg(F.count(F.lit(1)).alias("nr"))


def good_turing(counts: DataFrame, mode: str = "loglinear", confidence: float = 1.96) -> DataFrame:
    """Simple Good-Turing: (r, nr, z, r_star, p, p0). Works on the frequencies of frequencies, whose number is small.

    ``loglinear`` always takes the regression's estimate; ``switch`` takes Turing's estimate for small r until it first differs
    from the regression's by no more than ``confidence`` standard deviations.
    """
    w = Window.orderBy("r")
    f = freq_of_freq(counts)
    around = f.withColumn("before", F.coalesce(F.lag("r").over(w), F.lit(0))).withColumn("after", F.coalesce(F.lead("r").over(w), 2 * F.col("r") - F.coalesce(F.lag("r").over(w), F.lit(0))))
    z = around.withColumn("z", 2.0 * F.col("nr") / (F.col("after") - F.col("before"))).withColumn("next_nr", F.when(F.lead("r").over(w) == F.col("r") + 1, F.lead("nr").over(w)))
    fit = z.agg(F.regr_slope(F.ln("z"), F.ln(F.col("r").cast("double"))).alias("a"), F.regr_intercept(F.ln("z"), F.ln(F.col("r").cast("double"))).alias("b"))
    sums = f.agg(F.sum(F.col("r") * F.col("nr")).alias("total"), F.coalesce(F.max(F.when(F.col("r") == 1, F.col("nr"))), F.lit(0)).alias("n1"))
    x = z.crossJoin(F.broadcast(fit)).crossJoin(F.broadcast(sums))
    r = F.col("r").cast("double")
    line = lambda v: F.exp(F.col("a") * F.ln(v) + F.col("b"))
    x = x.withColumn("smooth", (r + 1) * line(r + 1) / line(r)).withColumn("turing", (r + 1) * F.col("next_nr") / F.col("nr"))
    if mode == "switch":
        sd = F.sqrt((r + 1) ** 2 * F.col("next_nr") / F.col("nr") ** 2 * (1 + F.col("next_nr") / F.col("nr")))
        x = x.withColumn("close", F.coalesce((F.abs(F.col("smooth") - F.col("turing")) <= confidence * sd), F.lit(True)).cast("int"))
        x = x.withColumn("r_star", F.when(F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1, F.col("smooth")).otherwise(F.col("turing")))
    else:
        x = x.withColumn("r_star", F.col("smooth"))
    mass = x.agg(F.sum(F.col("r_star") * F.col("nr")).alias("mass"))
    p0 = F.col("n1") / F.col("total")
    out = x.crossJoin(F.broadcast(mass))
    return out.select("r", "nr", F.round("z", 6).alias("z"), F.round("r_star", 6).alias("r_star"), F.round((1 - p0) * F.col("r_star") / F.col("mass"), 12).alias("p"), F.round(p0, 9).alias("p0"))


def distributions(features: DataFrame) -> DataFrame:
    """(word, feature, p) from (word, feature, value)."""
    total = F.sum("value").over(Window.partitionBy("word"))
    return features.select("word", "feature", (F.col("value") / total).alias("p"))


def pair_table(dist: DataFrame, key: str = "word") -> DataFrame:
    """(a, b, p, q, lone) of every ordered pair of words and each feature that a has: q is 0 where b lacks it. For a bounded set of words.

    One row a word, its features in a map: pairs of words are made once, not once a feature.
    """
    rows = dist.where("p > 0").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("feature", "p"))).alias("m"))
    a, b = rows.select(F.col(key).alias("a"), F.col("m").alias("ma")), rows.select(F.col(key).alias("b"), F.col("m").alias("mb"))
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", F.transform(F.map_entries("ma"), lambda e: F.struct(e["value"].alias("p"), F.coalesce(F.try_element_at("mb", e["key"]), F.lit(0.0)).alias("q"))).alias("pq"))


def renyi(pairs: DataFrame, alpha: float) -> DataFrame:
    """(a, b, d): Renyi divergence of order alpha of the rows of ``pair_table``; infinite where b lacks what a has; order 1 is Kullback-Leibler."""
    lacks = F.exists("pq", lambda x: x["q"] <= 0)
    add = (lambda x: x["p"] * F.ln(x["p"] / x["q"])) if alpha == 1 else (lambda x: x["p"] * F.pow(x["p"] / x["q"], alpha - 1))
    total = F.aggregate(F.filter("pq", lambda x: x["q"] > 0), F.lit(0.0), lambda s, x: s + add(x))
    return pairs.select("a", "b", F.when(lacks, F.lit(float("inf"))).otherwise(F.round(total if alpha == 1 else F.ln(total) / (alpha - 1), 9)).alias("d"))


def chi2_pairs(contexts: DataFrame, min_column: int = 5, focus: str | None = None) -> DataFrame:
    """(a, b, chi2, n, df, v): homogeneity of two words' contexts, over columns that they hold more than ``min_column`` times together.

    With one degree of freedom each difference is drawn half a count towards nothing (Yates). ``focus`` pairs one word with the
    others. Only the words that share a context meet there (a bounded list of words); what a word holds alone counts through its
    sums: chi2 = (sum x^2 / (x + y) - nx^2 / n) n^2 / (nx ny), where a column of one word alone adds x or nothing to the sum.
    """
    held = contexts.groupBy("side", "ctx").agg(F.collect_list(F.struct("word", "n")).alias("held")).where(F.size("held") > 1)
    pair = lambda u, v: F.struct(u["word"].alias("a"), v["word"].alias("b"), u["n"].alias("x"), v["n"].alias("y"))
    if focus is None:
        met = F.flatten(F.transform("held", lambda u: F.transform(F.filter("held", lambda v: v["word"] > u["word"]), lambda v: pair(u, v))))
    else:
        ordered = lambda u, v: F.when(u["word"] < v["word"], pair(u, v)).otherwise(pair(v, u))
        met = F.flatten(F.transform(F.filter("held", lambda u: u["word"] == focus), lambda u: F.transform(F.filter("held", lambda v: v["word"] != focus), lambda v: ordered(u, v))))
    both = held.select(F.explode(met).alias("p")).select("p.*", (F.col("p.x") + F.col("p.y") > min_column).alias("large"))
    when = lambda c: F.when(F.col("large"), c)
    over = lambda c: F.when(F.col(c) > min_column, F.col(c))
    shared = both.groupBy("a", "b").agg(
        F.sum(when(F.col("x"))).alias("sx"), F.sum(when(F.col("y"))).alias("sy"), F.sum(when(F.col("x") * F.col("x") / (F.col("x") + F.col("y")))).alias("q"), F.count_if("large").alias("cols"),
        F.max(when(F.struct("x", "y"))).alias("one"), F.sum(over("x")).alias("ox"), F.sum(over("y")).alias("oy"), F.count(over("x")).alias("cx"), F.count(over("y")).alias("cy"),
    )
    large = contexts.where(F.col("n") > min_column).groupBy("word").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c"))
    words = contexts.groupBy("word").agg(F.count(F.lit(1)).alias("__")).drop("__")
    order = F.col("a") < F.col("b") if focus is None else (F.col("a") < F.col("b")) & ((F.col("a") == focus) | (F.col("b") == focus))
    x = words.select(F.col("word").alias("a")).join(words.select(F.col("word").alias("b")), order).join(shared, ["a", "b"], "left")
    for c in ("a", "b"):
        x = x.join(large.select(F.col("word").alias(c), F.col("s").alias(f"l{c}"), F.col("c").alias(f"c{c}")), c, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    x = x.select("a", "b", "one", zero("q").alias("q"), (zero("la") - zero("ox")).alias("ax"), (zero("lb") - zero("oy")).alias("bx"), zero("sx").alias("sx"), zero("sy").alias("sy"), (zero("cols") + zero("ca") - zero("cx") + zero("cb") - zero("cy")).alias("cols"))
    x = x.withColumns({"nx": F.col("sx") + F.col("ax"), "ny": F.col("sy") + F.col("bx")}).withColumn("n", F.col("nx") + F.col("ny")).where("cols >= 2 and nx > 0 and ny > 0")
    n, nx, ny = (F.col(c).cast("double") for c in ("n", "nx", "ny"))
    # two columns: the second is what the first leaves
    x1, y1 = F.coalesce("one.x", "ax").cast("double"), F.coalesce(F.col("one.y"), F.lit(0)).cast("double")
    gap = F.greatest(F.abs(x1 * (ny - y1) - (nx - x1) * y1) / n - 0.5, F.lit(0.0))
    chi2 = F.when(F.col("cols") == 2, gap * gap * (1 / (x1 + y1) + 1 / (n - x1 - y1)) * n * n / (nx * ny)).otherwise((F.col("q") + F.col("ax") - nx * nx / n) * n * n / (nx * ny))
    return x.withColumn("chi2", chi2).select("a", "b", F.round(F.col("chi2") + 1e-9, 6).alias("chi2"), "n", (F.col("cols") - 1).alias("df"), F.round(F.sqrt(F.greatest("chi2", F.lit(0.0)) / F.col("n")) + 1e-12, 9).alias("v"))  # halves round up


def variation_of_information(table: DataFrame, a: str, b: str) -> DataFrame:
    """-sum r (ln(r / p) + ln(r / q)) of two labellings of the same rows."""
    joint = table.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    p = joint.groupBy(a).agg(F.sum("n").alias("na"))
    q = joint.groupBy(b).agg(F.sum("n").alias("nb"))
    total = joint.agg(F.sum("n").alias("t"))
    x = joint.join(F.broadcast(p), a).join(F.broadcast(q), b).crossJoin(F.broadcast(total))
    d = lambda c: F.col(c).cast("double")
    return x.agg(F.round(-F.sum(d("n") / d("t") * (F.ln(d("n") / d("na")) + F.ln(d("n") / d("nb")))), 9).alias("vi"))


def shrunk(features: DataFrame, ssf: float = 1.0) -> DataFrame:
    """(word, feature, p): rows pulled towards the mean of all, by f / (f + n) with f features and n counts of the row."""
    # one row a word, its features in a map, which every feature of the list is looked up in: the grid is not joined to the counts
    rows = features.groupBy("word").agg(F.sum("value").alias("n"), F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    glob = features.groupBy("feature").agg(F.sum("value").alias("g"))
    total = glob.agg(F.sum("g").alias("t"), F.count(F.lit(1)).alias("f"), F.collect_list(F.struct("feature", "g")).alias("all"))
    x = rows.crossJoin(F.broadcast(total))
    lam = F.col("f") / (F.col("f") + F.col("n"))
    own = lambda a: F.round((1 - lam) * F.coalesce(F.try_element_at("m", a["feature"]), F.lit(0)) / F.col("n") + lam * a["g"] / F.col("t"), 12)
    return x.select("word", F.inline(F.transform("all", lambda a: F.struct(a["feature"].alias("feature"), own(a).alias("p")))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance_from(vectors: DataFrame, basis: list[list[float]], vec: str = "v") -> DataFrame:
    """``vectors`` with the distance of each to the span of an orthonormal basis (a few vectors, held by the driver)."""
    rest = dot(F.col(vec), F.col(vec))
    for b in basis:
        rest = rest - F.pow(dot(F.col(vec), F.array(*[F.lit(float(x)) for x in b])), 2)
    return vectors.withColumn("distance", F.sqrt(F.greatest(rest, F.lit(0.0))))


def violation_fraction(pairs: DataFrame, epsilon: float) -> DataFrame:
    """(a, b, vf): share of features where ln p - ln q < -epsilon, over features that both have (rows of ``pair_table``)."""
    both = F.filter("pq", lambda x: x["q"] > 0)
    low = F.size(F.filter(both, lambda x: F.ln(x["p"]) - F.ln(x["q"]) < -epsilon))
    return pairs.withColumn("k", F.size(both)).where("k > 0").select("a", "b", F.round(low / F.col("k"), 9).alias("vf"))
