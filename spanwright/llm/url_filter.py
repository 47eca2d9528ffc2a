"""URL filtering by a blocked Bloom filter and an exact hash join, in DataFrame operations only.

A list entry is a host and a path prefix. It fits a url whose host equals the entry's host or lies below it and whose path
starts with the entry's path. A url therefore has a small set of possible keys: its host suffixes times its path prefixes of
the lengths that occur in the list. The Bloom filter of the listed keys, one 64-bit block a key, passes the possible hits;
an equality join with the list removes its false positives; the longest entry that is left decides.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no entry; an empty table gives an
empty result; repeated rows are judged each for itself; an empty list allows everything; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A filter of up to this many blocks (8 bytes each) is a constant of the plan; a longer one is joined by block number.
INLINE_BLOCKS = 1 << 15
BITS_PER_KEY = 4


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def _key(host: Column, path: Column) -> Column:
    """Canonical url key; a space can't be part of a listed host."""
    return F.concat(host, F.lit(" "), path)


def _block(h: Column, n_blocks: int) -> Column:
    return F.pmod(h, F.lit(n_blocks))


def _mask(key: Column) -> Column:
    """BITS_PER_KEY bits of a 64-bit block."""
    out = F.lit(0).cast("long")
    for k in range(BITS_PER_KEY):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(k + 1)), F.lit(64)).cast("int")))
    return out


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """(block, bits) of a blocked Bloom filter over the column ``key``."""
    return keys.groupBy(_block(F.xxhash64("key"), n_blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("bits"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row of ``pages`` by ``rules`` (verdict, host, path); returns page_id, url, host, path, rule, verdict.

    ``rules`` may hold any number of rows. Repeated entries count once; of an entry listed both ways, block wins.
    """
    spark = pages.sparkSession
    listed = rules.groupBy(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict")).withColumn("key", _key(F.col("r_host"), F.col("r_path")))
    size, lengths = listed.agg(F.count(F.lit(1)), F.array_sort(F.collect_set(F.length("r_path")))).first()
    n_blocks = max(1, -(-size // 4))

    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"))
    host, path = split_url(F.col("__url"))
    base = base.select("page_id", "__url", host.alias("host"), path.alias("path"))
    # as many host suffixes as labels; as many path prefixes as lengths in the list (a bounded number: urls are short)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(int(n)) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _key(s, p))))
    blocks = bloom_blocks(listed, n_blocks)
    if n_blocks <= INLINE_BLOCKS:
        known = {r["block"]: r["bits"] for r in blocks.collect()}  # at most INLINE_BLOCKS rows
        words = F.split(F.lit(",".join(str(known.get(i, 0)) for i in range(n_blocks))), ",").cast("array<bigint>")
        passes = F.filter(keys, lambda k: F.get(words, _block(F.xxhash64(k), n_blocks).cast("int")).bitwiseAND(_mask(k)) == _mask(k))
        possible = base.select("page_id", "__url", F.explode(passes).alias("key"))
    else:
        possible = base.select("page_id", "__url", F.explode(keys).alias("key")).withColumn("block", _block(F.xxhash64("key"), n_blocks))
        possible = possible.join(blocks, "block").where(F.col("bits").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key"))).select("page_id", "__url", "key")
    hits = possible.join(listed, "key").groupBy("page_id", "__url").agg(F.max(F.struct(F.length("key").alias("n"), F.col("r_host"), F.col("r_path"), F.col("r_verdict"))).alias("best"))
    joined = base.alias("a").join(hits.alias("b"), F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & F.col("a.__url").eqNullSafe(F.col("b.__url")), "left")
    return joined.select(
        F.col("a.page_id").alias("page_id"), F.col("a.__url").alias("url"), "host", "path",
        F.concat(F.col("best.r_host"), F.col("best.r_path")).alias("rule"), F.coalesce(F.col("best.r_verdict"), F.lit(default)).alias("verdict"),
    )


#: The rules of the registered query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def rules_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def op10_url_filter(spark, sf_dir):
    from spanwright.llm.common import table

    return filter_urls(table(spark, sf_dir, "pages"), rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(v, h, q) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
hit AS (
  SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, hit.rule AS rule, coalesce(hit.v, 'allow') AS verdict FROM p LEFT JOIN hit USING (page_id)
"""
