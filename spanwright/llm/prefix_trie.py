"""Prefix tree of conversations: what they share from their beginnings, by collapse of whole sequences.

Turns are sorted over the cluster into blocks, and a prefix of d turns is known by its depth and the exclusive or of 128 bits of
its turns' contents under their places. Equal whole conversations become one weighted sequence with its list of ends; a sequence
that is a proper prefix of another one goes by an anti-join, which leaves the leaves; what nodes hold is summed from the weighted
sequences' prefixes. The smallest conversation of a node owns it. A sequence owns its path from some depth on, so sums over
subtrees are differences of running sums, and no node meets its ancestors one by one.

No task holds a whole conversation or group: places and prefixes run within blocks, and of each block one conversation at most
goes on in the next, so what is carried over (a row a block) is broadcast. Lists of ends are joined from pieces of a batch's ids
and hashed piece by piece.

Defined cases: null roles and texts are empty; a null turn stands before the others; turns of one number stand by the MD5 of
their contents; repeated rows are turns each; rows without conv_id belong to no conversation; an empty table has no nodes, not
even a root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.llm.common import dropped, small_batches, table, written

WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "k1", "k2"]


def ordered_turns(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, block, at, content, words), written in order over blocks: ``at`` rises with a conversation's turns, content is a turn's MD5."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    content = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = convs.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), content.alias("content"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "content", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "content", "words", F.monotonically_increasing_id().alias("at"))
    return written(rows.withColumn("block", F.shiftright("at", 33)), "turns")


def _in_block():
    return Window.partitionBy("conv_id", "block").orderBy("at")


def _earlier():
    return Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _placed(turns: DataFrame, name: str) -> DataFrame:
    """``turns`` with their place in the conversation, from 1. Of a block one conversation at most has begun before it: a row each is broadcast."""
    counts = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    carried = counts.select("conv_id", "block", F.sum("n").over(_earlier()).alias("before")).where("before is not null")
    rows = turns.withColumn(name, F.row_number().over(_in_block()).cast("long"))
    return rows.join(F.broadcast(carried), ["conv_id", "block"], "left").withColumn(name, F.col(name) + F.coalesce("before", F.lit(0))).drop("before")


def with_beginnings(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Turns of rebuilt conversations: the first h of conversation c - c % group, then c's own after its first h; h is crc32(c) % ``most``."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    placed = _placed(turns, "pos")
    first = placed.where((F.col("pos") < most) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), (F.col("pos") - most).alias("at"), "content", "words")
    convs = turns.groupBy("conv_id").agg(F.min("block").alias("block")).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    head = convs.join(first, "base").where(F.col("at") + most <= h)  # at most ``group`` conversations and ``most`` turns meet under a base
    columns = ["conv_id", "block", "at", "content", "words"]
    return head.select(*columns).unionByName(placed.where(F.col("pos") > h).select(*columns))


def prefixes(turns: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, words, total): every prefix of every member, that of no turns too, with the words of its last turn and of all its turns."""
    rows = _placed(turns, "depth")
    rows = rows.withColumns({x: F.xxhash64(F.lit(k), "depth", "content") for k, x in enumerate(("x1", "x2"))})
    sums: dict[str, Column] = {"k1": F.bit_xor("x1"), "k2": F.bit_xor("x2"), "total": F.sum("words")}
    blocks = turns.groupBy("conv_id").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").select("conv_id")  # fewer than there are blocks
    of_block = rows.join(F.broadcast(blocks), "conv_id").groupBy("conv_id", "block").agg(*(f.alias(c) for c, f in sums.items()))
    carried = of_block.select("conv_id", "block", F.bit_xor("k1").over(_earlier()).alias("c1"), F.bit_xor("k2").over(_earlier()).alias("c2"), F.sum("total").over(_earlier()).alias("c3"))
    running = _in_block().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: f.over(running) for c, f in sums.items()}).join(F.broadcast(carried), ["conv_id", "block"], "left")
    with_earlier = lambda c, b: F.col(c).bitwiseXOR(F.coalesce(b, F.lit(0)))
    rows = rows.select("conv_id", "depth", with_earlier("k1", "c1").alias("k1"), with_earlier("k2", "c2").alias("k2"), "words", (F.col("total") + F.coalesce("c3", F.lit(0))).alias("total"))
    zero = F.lit(0).cast("long")
    return rows.unionByName(members.select("conv_id", *(zero.alias(c) for c in [*KEY, "words", "total"])))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of key and id as pieces: the ids of one key in one batch, joined."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in KEY])
        start = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
        ids = pa.ListArray.from_arrays(pa.array(np.append(start, b.num_rows), pa.int32()), b.column("conv_id").cast(pa.string()))
        yield pa.RecordBatch.from_arrays([*(pa.array(keys[i][start]) for i in range(3)), b.column("conv_id").take(pa.array(start)), pc.binary_join(ids, ",")], names=[*KEY, "first", "ids"])


def _hashed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of pieces in order: SHA-256 of the pieces joined; a list is never whole in memory."""
    own, digest = None, None

    def row(key, digest):
        return tuple(key) + (digest.hexdigest(),)

    def batch(rows):
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.string())], names=[*KEY, "ends_sha256"])

    for b in batches:
        out = []
        for *key, ids in zip(*(b.column(c).to_pylist() for c in [*KEY, "ids"]), strict=True):
            if key == own:
                digest.update(b",")
            else:
                if own is not None:
                    out.append(row(own, digest))
                own, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield batch(out)
    if own is not None:
        yield batch([row(own, digest)])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of rows (depth, k1, k2, conv_id): the ids of each key in rising order, comma-joined, hashed."""
    order = [*KEY, "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined_ids, "depth long, k1 long, k2 long, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashed_lists, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_nodes(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each node of the prefix tree of ``turns`` (conv_id, block, at, content, words); ``members`` (conv_id) are all conversations, also those without turns."""
    small_batches(turns.sparkSession)
    all_ = written(prefixes(turns, members), "prefixes")
    end = all_.groupBy("conv_id").agg(F.max(F.struct(*KEY, "total")).alias("e")).select("conv_id", "e.*")
    end = written(end, "ends")
    # equal whole conversations are one weighted sequence, named by its smallest
    whole = end.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.min("total").alias("all")).join(end_hashes(end), KEY)
    whole = written(whole, "sequences")
    path = all_.join(whole.select("conv_id", "weight", "all", F.col("depth").alias("length"), F.col("ends_sha256").alias("sha")), "conv_id")
    path = written(path.withColumn("sha", F.when(F.col("depth") == F.col("length"), F.col("sha"))), "paths")
    dropped(all_)
    dropped(end)
    # written, so that the join with a hot node's paths has an exchange of its own on either side and can be split
    own = written(path.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("depth") < F.col("length")).alias("inner")), "nodes")
    leaves = whole.join(own.where("inner").select(*KEY), KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    # the last node of a path that another sequence owns: below it the path is its own
    shared = path.join(own.where("n > 1").select(*KEY, "owner"), KEY).where("owner < conv_id").groupBy("conv_id").agg(F.max(F.struct("depth", F.col("total").alias("until"), F.col("owner").alias("above"))).alias("s"))
    parts = whole.select("conv_id").join(shared, "conv_id", "left").join(leaves, "conv_id", "left")
    parts = parts.select("conv_id", F.coalesce(F.col("s.depth") + 1, F.lit(0)).alias("from"), F.coalesce("s.until", F.lit(0)).alias("until"), "s.above", F.coalesce("leaf", F.lit(0)).alias("leaf"))
    x = path.join(parts, "conv_id")
    before, mine = F.col("total") - F.col("words"), F.col("depth") >= F.col("from")
    saved = F.col("weight") * (F.col("all") - before) - (F.col("all") - F.when(mine, before).otherwise(F.col("until")))
    above = F.when(F.col("depth") == 0, None).when(F.col("depth") > F.col("from"), F.col("conv_id")).otherwise(F.col("above"))
    out = x.groupBy(*KEY).agg(
        F.min(F.struct("conv_id", above.alias("parent"))).alias("o"), F.sum("weight").alias("n_convs"), F.sum("leaf").cast("long").alias("n_leaves"), F.sum(saved).alias("saved_tokens"), F.max("sha").alias("sha"),
        F.sum(((F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("from"))).cast("long")).alias("n_children"),
    )
    return out.select(F.col("o.conv_id").alias("conv_id"), "depth", F.col("o.parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of conversations as they are."""
    turns = ordered_turns(convs, conv_col, turn_col, role_col, text_col)
    return prefix_nodes(turns, turns.select("conv_id").distinct())


def op13_prefix_trie(spark, sf_dir):
    turns = ordered_turns(table(spark, sf_dir, "conversations"))
    rebuilt = written(with_beginnings(turns), "rebuilt")
    return prefix_nodes(rebuilt, turns.select("conv_id").distinct())


OP13_SQL = rf"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT i::BIGINT AS b, i::BIGINT AS v, 0 AS k FROM range(256) x(i) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT c, s, 0 AS i, 4294967295::BIGINT AS v FROM ids UNION ALL SELECT c, s, i + 1, xor(crc.v // 256, b.v) FROM crc JOIN (SELECT b, v FROM bits WHERE k = 8) b ON b.b = xor(crc.v % 256, ascii(substr(s, i + 1, 1))::BIGINT) WHERE i < length(s)),
h AS (SELECT c, xor(v, 4294967295::BIGINT) % 4 AS h FROM crc WHERE i = length(s)),
t0 AS (SELECT conv_id AS c, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS m, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS w FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, m, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, m) AS p FROM t0),
r AS (SELECT h.c, 0 AS own, p, m, w FROM h JOIN t ON t.c = h.c - h.c % 20 AND p <= h UNION ALL SELECT h.c, 1, p, m, w FROM h JOIN t ON t.c = h.c AND p > h),
d AS (SELECT c, m, w, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d FROM r),
px AS (SELECT c, d, w, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) AS k FROM d UNION ALL SELECT c, 0, 0, '' FROM ids),
node AS (SELECT k, d, min(c) AS c, count(*) AS n, max(w) AS w FROM px GROUP BY k, d),
up AS (SELECT DISTINCT a.k AS top, b.k AS k FROM px a JOIN px b ON a.c = b.c AND b.d >= a.d),
inner_ AS (SELECT DISTINCT left(k, length(k) - 32) AS k FROM node WHERE d > 0),
sub AS (SELECT top AS k, count(*) FILTER (up.k NOT IN (SELECT k FROM inner_)) AS n_leaves, sum((n - 1) * w) AS saved FROM up JOIN node ON node.k = up.k GROUP BY top),
kids AS (SELECT left(k, length(k) - 32) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
ends AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM (SELECT c, max_by(k, d) AS k FROM px GROUP BY c) GROUP BY k)
SELECT node.c AS conv_id, node.d AS depth, p.c AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM node JOIN sub ON sub.k = node.k LEFT JOIN node p ON node.d > 0 AND p.k = left(node.k, length(node.k) - 32) LEFT JOIN kids ON kids.k = node.k LEFT JOIN ends ON ends.k = node.k"""
