"""N-gram Jaccard self-join with R-trees over count vectors, and the components of its links.

A document's set holds the hashes of its distinct word n-grams. Documents of equal sets are one class from the start. Two
classes link when 100 * common >= percent * union; a class's smallest doc_id stands for it.

* Tokens (n-gram hashes) are hashed into GROUPS groups; how many of a class's tokens fall into each is its point.
* Which classes can meet: both would hold one of the first ``n - ceil(n * percent / 100) + 1`` tokens of each other's set in any
  fixed order of all tokens, so classes meet under those tokens. The order puts tokens that a bounded sample of the documents
  shows to be frequent last (any sample gives the same links; a good one gives few meetings). Tokens that the same classes
  hold are one meeting.
* The classes under a token form an R-tree over their points. A point's search leaves out boxes and points whose summed
  coordinate minima, the most that the two sets can share, are too small. A token with more than BLOCK classes is dealt out as
  pairs of blocks of classes, each pair a task's work.
* What passes connects classes into components; the classes of a component meet with their whole sets, in blocks of bounded
  sets and tokens again, search an R-tree of the component and count what they share with each survivor exactly.

Defined cases: a null text counts as empty; a document without words has no set, links with nothing and is its own component;
one of fewer than n words has the whole sequence as its one n-gram; repeated rows of a doc_id fall together (a doc_id with two
texts is in both texts' classes, its rows told apart by their sets); an empty table gives an empty result; further columns are
ignored. A null doc_id is kept with a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import dropped, id_text, mixed, slices, small_batches, table, utf8, word_hashes, written
from spanwright.llm.components import components

GROUPS = 256
#: Classes of a block, and their tokens.
BLOCK, BLOCK_TOKENS = 2048, 1 << 20
#: Documents of the sample that orders tokens, and the most frequent tokens it may name.
SAMPLE, NAMED = 20_000, 200_000
LEAF = 32
#: Up to this many classes in pairs, their ids are broadcast.
BROADCAST_IDS = 200_000
#: Bytes of text, rows of a meeting, and pairs that numpy works on at once.
PIECE, ROWS, PAIRS = 1 << 19, 1 << 13, 1 << 12

_MULT = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def token_sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (from, to, tokens, edges) of a text column: the sorted hashes of each text's distinct word n-grams, end to end."""
    data, edges = utf8(column)
    for a, z in slices(edges, PIECE):
        own = edges[a : z + 1] - edges[a]
        starts, _, words = word_hashes(data[edges[a] : edges[z]], own, PIECE)
        first = np.searchsorted(starts, own)
        rows = len(words) - n + 1
        grams = np.repeat(_MULT[:1] * np.uint64(n), max(rows, 0))
        for k in range(n if rows > 0 else 0):
            grams += words[k : rows + k] * _MULT[1 + k % 63]
        grams = mixed(grams)
        sets = []
        for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if e - s >= n:
                x = np.sort(grams[s : e - n + 1])
                sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            elif e > s:
                x = words[s:e] * _MULT[1 + np.arange(e - s) % 63]
                sets.append(mixed(x.sum(keepdims=True, dtype=np.uint64) + _MULT[:1] * np.uint64(e - s)))
            else:
                sets.append(words[:0])
        yield a, z, np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])


def needed(total: int | np.ndarray, percent: int):
    """Least common tokens of two sets of ``total`` tokens together: common >= percent / (100 + percent) * total."""
    return -(-(percent * total) // (100 + percent))


class RTree:
    """A packed R-tree over count vectors: leaves of LEAF points in order of one coordinate after another, boxes by maxima."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        order = np.lexsort((points @ np.arange(1, points.shape[1] + 1), sizes))  # alike sizes and counts side by side
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        starts = np.arange(0, len(order), LEAF)
        self.starts = starts
        self.high = np.maximum.reduceat(self.points, starts, axis=0)
        self.small, self.large = np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts)
        self.upper = np.arange(0, len(starts), LEAF)
        self.upper_high = np.maximum.reduceat(self.high, self.upper, axis=0)
        self.upper_small, self.upper_large = np.minimum.reduceat(self.small, self.upper), np.maximum.reduceat(self.large, self.upper)

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Numbers of the points that may share enough with a set of this point and size."""

        def may(high: np.ndarray, small: np.ndarray, large: np.ndarray) -> np.ndarray:
            # the bound is the sum of coordinate minima; sizes must be within the ratio
            ok = (small * 100 >= 0) & (np.minimum(large, size) * 100 >= percent * np.maximum(small, size))
            ok &= np.minimum(high, point).sum(1, dtype=np.int64) >= needed(size + small, percent)
            return ok

        tops = np.flatnonzero(may(self.upper_high, self.upper_small, self.upper_large))
        leaves = np.concatenate([np.arange(t * LEAF, min((t + 1) * LEAF, len(self.starts))) for t in tops]) if len(tops) else tops
        if len(leaves):
            leaves = leaves[may(self.high[leaves], self.small[leaves], self.large[leaves])]
        at = np.concatenate([np.arange(self.starts[x], min(self.starts[x] + LEAF, len(self.order))) for x in leaves]) if len(leaves) else leaves
        if len(at):
            at = at[may(self.points[at], self.sizes[at], self.sizes[at])]
        return self.order[at]


def _row_sums(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the stretches between edges, that of an empty one 0."""
    out = np.zeros(len(edges) - 1, x.dtype)
    some = np.flatnonzero(np.diff(edges))
    if len(some):
        out[some] = np.add.reduceat(x, edges[some])
    return out


def _identities(tokens: np.ndarray, edges: np.ndarray) -> list[pa.Array]:
    """128 bits that tell sets apart, in two columns."""
    return [pa.array(_row_sums(x, edges).view(np.int64)) for x in (tokens, mixed(tokens ^ _MULT[3]))]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


SETS = "doc_id long, n int, h1 long, h2 long, prefix array<long>, point binary"


def _set_rows(docs: DataFrame, frequent: np.ndarray, n: int, percent: int) -> DataFrame:
    """Size, 128-bit identity, first tokens and point of each document's set."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most NAMED numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        may = np.zeros(1 << 21, bool)
        may[(last >> np.uint64(43)).astype(np.int64)] = True
        for batch in batches:
            for a, z, tokens, edges in token_sets(batch.column("text"), n):
                sizes, rows = np.diff(edges), z - a
                known = np.zeros(len(tokens), bool)
                at = np.flatnonzero(may[(tokens >> np.uint64(43)).astype(np.int64)])
                if len(at):
                    known[at] = last[np.minimum(np.searchsorted(last, tokens[at]), len(last) - 1)] == tokens[at]
                owner = np.repeat(np.arange(rows), sizes)
                # place of each token in its set when the frequent ones come last
                before = np.concatenate([[0], np.cumsum(known)])
                fresh = sizes - np.diff(before[edges])
                place = np.where(known, fresh[owner] + before[:-1] - before[edges[owner]], np.arange(len(tokens)) - edges[owner] - before[:-1] + before[edges[owner]])
                first = place < (sizes + (-sizes * percent // 100) + 1)[owner]
                count = np.bincount(owner * GROUPS + (tokens >> np.uint64(7)).astype(np.int64) % GROUPS, minlength=rows * GROUPS).reshape(rows, GROUPS)
                most = count.max(1)
                points = [x.astype("<u1" if m < 256 else "<u2" if m < 65536 else "<u4").tobytes() if k else None for x, m, k in zip(count, most.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, rows), pa.array(sizes.astype(np.int32)), *_identities(tokens, edges), _lists(tokens[first], _row_sums(first.astype(np.int64), edges)), pa.array(points, pa.binary())], names=[c.split()[0] for c in SETS.split(", ")])

    return docs.mapInArrow(run, SETS)


def _frequent(docs: DataFrame, n: int) -> np.ndarray:
    """Tokens that several documents of a bounded sample hold."""
    total = docs.count()
    if not total:
        return np.zeros(0, np.uint64)
    share = min(1.0, SAMPLE / total)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, tokens, _ in token_sets(batch.column("text"), n):
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64))], names=["token"])

    counted = sample.select("text").distinct().mapInArrow(run, "token long").groupBy("token").count().where("count >= 3").orderBy(F.desc("count"), "token").limit(NAMED)
    return np.sort(np.array([r["token"] for r in counted.collect()], np.int64).view(np.uint64))


BLOCKED = ["key", "i", "j"]


def _blocked(rows: DataFrame, size: str, tokens: str | None = None) -> DataFrame:
    """``rows`` (key, id, ...) dealt out as pairs (i, j) of blocks of a key's ids, about BLOCK ids and BLOCK_TOKENS tokens each; ``side`` says which."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    if tokens:
        blocks = F.greatest(blocks, F.ceil(F.col(tokens) / BLOCK_TOKENS).cast("int"))
    own = F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int")
    spread = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j"), F.when(own <= o, 0).otherwise(1).alias("side")))
    at = rows.withColumn("at", F.explode(spread)).withColumns({c: F.col(f"at.{c}") for c in ("i", "j", "side")}).drop("at", size, *([tokens] if tokens else []))
    return at.repartition(*BLOCKED).sortWithinPartitions(*BLOCKED, "side", "id")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of whole pairs of blocks, and the edges between these: small pairs many at once, a large one alone."""
    held: list[pa.RecordBatch] = []

    def merged(final: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key, i, j = (t.column(c).to_numpy(zero_copy_only=False) for c in BLOCKED)
        new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        edges = np.concatenate([[0], new, [len(key)]])
        if not final:
            edges = edges[:-1]  # the last pair may go on
        held[:] = [] if final else [t.slice(edges[-1])]
        if edges[-1]:
            yield t.slice(0, edges[-1]), edges

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(x.num_rows for x in held) >= ROWS or sum(x.nbytes for x in held) >= 16 << 20:
                yield from merged(False)
    if held:
        yield from merged(True)


class _Forest:
    """Components of numbered rows, and the few edges that join them."""

    def __init__(self, n: int) -> None:
        self.of, self.edges = np.arange(n), []

    def join(self, k: int, hits: np.ndarray) -> None:
        other, first = np.unique(self.of[hits], return_index=True)
        first = first[other != self.of[k]]
        if len(first):
            self.edges += [(k, int(h)) for h in hits[first]]
            self.of[np.isin(self.of, other)] = self.of[k]


def _points(column: pa.Array) -> np.ndarray:
    """Count vectors; their bytes say how wide a count is."""
    data, edges = utf8(column)
    wide = np.diff(edges) // GROUPS
    if (wide == 1).all():
        return data.reshape(-1, GROUPS)
    return np.array([np.frombuffer(data[s:e].tobytes(), {1: "<u1", 2: "<u2", 4: "<u4"}[(e - s) // GROUPS]).astype(np.int32) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)])


def _sides(side: np.ndarray, one: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that search, and of those that are searched."""
    every = np.arange(len(side))
    return (every, every) if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))


def _small_pairs(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of rows within the stretches of 2 to LEAF rows: these are single leaves of a tree."""
    size, x, y = np.diff(edges), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(size[(size > 1) & (size <= LEAF)]):
        a, b = np.triu_indices(m, 1)
        at = edges[:-1][size == m][:, None]
        x.append((at + a).ravel())
        y.append((at + b).ravel())
    return np.concatenate(x), np.concatenate(y)


def _may_link(points: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows share enough by the sums of coordinate minima."""
    out = np.zeros(len(x), bool)
    likely = np.flatnonzero(100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
    for s in range(0, len(likely), PAIRS):
        at = likely[s : s + PAIRS]
        out[at] = np.minimum(points[x[at]], points[y[at]]).sum(1, dtype=np.int64) >= needed(n[x[at]] + n[y[at]], percent)
    return out


def _candidates(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect the classes whose points allow a link under a common token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in _meetings(batches):
            i, j, side, ids, n = (t.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "side", "id", "n"))
            n, points = n.astype(np.int64), _points(t.column("point"))
            x, y = _small_pairs(edges)
            meet = (i[x] == j[x]) | (side[x] != side[y])
            x, y = x[meet], y[meet]
            ok = _may_link(points, n, x, y, percent)
            found = {(int(p), int(q)) for p, q in zip(ids[x[ok]], ids[y[ok]], strict=True)}
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if e - s <= LEAF:
                    continue
                left, right = _sides(side[s:e], i[s] == j[s])
                if not len(left) or not len(right):
                    continue
                own, sizes, forest = points[s:e].astype(np.int32), n[s:e], _Forest(e - s)
                tree = RTree(own[right], sizes[right])
                for k in left:
                    forest.join(k, right[tree.search(own[k], int(sizes[k]), percent)])
                found |= {(int(ids[s + p]), int(ids[s + q])) for p, q in forest.edges}
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def _verified(members: DataFrame, percent: int) -> DataFrame:
    """(a, b, n): of a component's classes, edges (a, b) that connect what is linked, and rows (a, null, n): n links of a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in _meetings(batches):
            i, j, side, ids = (t.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "side", "id"))
            points, listed = _points(t.column("point")), t.column("tokens")
            every, at = listed.flatten().to_numpy(zero_copy_only=False), listed.offsets.to_numpy() - listed.offsets[0].as_py()
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                one = bool(i[s] == j[s])
                left, right = _sides(side[s:e], one)
                if not len(left) or not len(right) or one and e - s < 2:
                    continue
                sets, own = [every[at[k] : at[k + 1]] for k in range(s, e)], points[s:e].astype(np.int32)
                size, forest = np.diff(at[s : e + 1]).astype(np.int64), _Forest(e - s)
                tree, degree = RTree(own[right], size[right]), np.zeros(e - s, np.int64)
                # the searched sets' tokens, each with its holders side by side
                held = np.concatenate([sets[k] for k in right])
                holder = np.repeat(np.arange(len(right), dtype=np.int32), size[right])
                order = np.argsort(held, kind="stable")
                held, holder = held[order], holder[order]
                for k in left:
                    near = tree.search(own[k], int(size[k]), percent)
                    near = near[right[near] != k]
                    if not len(near):
                        continue
                    lo, hi = np.searchsorted(held, sets[k], "left"), np.searchsorted(held, sets[k], "right")
                    common = _held_by(holder, lo, hi, len(right))[near]
                    hits = right[near[100 * common >= percent * (size[k] + size[right[near]] - common)]]
                    degree[k] += len(hits)
                    if not one:
                        degree[hits] += 1
                    forest.join(k, hits)
                linked = np.flatnonzero(degree)
                a = [int(ids[s + x]) for x, _ in forest.edges] + [int(ids[s + k]) for k in linked]
                if a:
                    b = [int(ids[s + y]) for _, y in forest.edges] + [None] * len(linked)
                    n = [None] * len(forest.edges) + degree[linked].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return members.mapInArrow(run, "a long, b long, n long")


def _held_by(holder: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """How many of the stretches [lo, hi) of ``holder`` each holder is in; some million entries at once."""
    spans, out = hi - lo, np.zeros(n, np.int64)
    ends = np.cumsum(spans)
    for part in np.split(np.arange(len(spans)), np.searchsorted(ends, np.arange(1 << 21, ends[-1] if len(ends) else 0, 1 << 21), "left")):
        w = spans[part]
        at = np.repeat(lo[part] - np.cumsum(w) + w, w) + np.arange(w.sum())
        out += np.bincount(holder[at], minlength=n)
    return out


IDENTITY = ["h1", "h2"]


def ngram_links(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, heads, links): each document's set size and identity; a row (id, h1, h2, rep, copies) for each class; edges (a, b, null) that connect linked classes, and link numbers (a, null, n)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_text(docs, id_col, text_col)
    sets = written(_set_rows(rows, _frequent(rows, n), n, percent), "sets")
    named = sets.where("n > 0 and doc_id is not null")
    # the class's own row: its smallest document's; equal sets have equal prefixes and points
    classes = named.groupBy(*IDENTITY).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    heads = named.join(classes, [*IDENTITY, "doc_id"]).dropDuplicates([*IDENTITY, "doc_id"])
    heads = written(heads.select(F.monotonically_increasing_id().alias("id"), *IDENTITY, F.col("doc_id").alias("rep"), "copies", "n", "prefix", "point"), "heads")
    # most tokens are one class's alone: numbers only are shuffled until those are gone
    tokens = heads.select("id", F.explode("prefix").alias("key"))
    several = written(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "several")
    held = written(tokens.join(several, "key", "left_semi"), "held")
    dropped(several)
    # of tokens with the same holders one is enough
    signs = held.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id")).alias("s1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("s2"))
    chosen = written(signs.groupBy("m", "s1", "s2").agg(F.min("key").alias("key")).select("key", "m"), "chosen")
    met = held.join(chosen, "key").join(heads.select("id", "n", "point"), "id")
    joined = components(_candidates(_blocked(met, "m"), percent))
    dropped(held)
    dropped(chosen)
    # a component's classes meet with their whole sets, and links are counted exactly
    asked = written(joined.join(heads.select("id", *IDENTITY, "n", "point", "rep"), "id"), "asked")
    sizes = written(asked.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")), "sizes")
    few = asked.count() <= BROADCAST_IDS  # then a few hundred bytes each go to the tasks; more of them are joined by a shuffle
    ids = asked.select("id", F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("rep").alias("doc_id"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, tokens, edges in token_sets(batch.column("text"), n):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, z - a) for c in ("id", "a1", "a2")), *_identities(tokens, edges), _lists(tokens, np.diff(edges))], names=["id", "a1", "a2", *IDENTITY, "tokens"])

    texts = rows.join(F.broadcast(ids) if few else ids, "doc_id").select("id", "a1", "a2", "text")
    # a doc_id may have further texts, of other classes; equal texts are read once
    full = texts.mapInArrow(whole, "id long, a1 long, a2 long, h1 long, h2 long, tokens array<long>").where("h1 = a1 and h2 = a2").dropDuplicates(["id"]).select("id", "tokens")
    keyed = asked.select("id", "component", "point").join(sizes, "component").withColumnRenamed("component", "key")
    links = written(_verified(_blocked(full.join(keyed, "id"), "m", "total"), percent), "links")
    dropped(asked)
    dropped(sizes)
    return sets.select("doc_id", "n", *IDENTITY), heads.select("id", *IDENTITY, "rep", "copies"), links


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class (its smallest doc_id), n_links (links of its class with other classes) and component_id of every document."""
    sets, heads, links = ngram_links(docs, n, percent, id_col, text_col)
    joined = components(links.where("b is not null"))
    degree = links.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    grouped = joined.join(heads, "id")
    of = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = grouped.join(of, "component").join(degree, "id", "left").select(*IDENTITY, "rep", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # only classes of several documents or with links tell a document more than its own id; written, so that Spark can split a hot class
    alone = heads.where("copies > 1").join(linked.select(*IDENTITY), IDENTITY, "left_anti").select(*IDENTITY, "rep", F.col("rep").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    by_class = written(linked.unionByName(alone), "classes")
    dropped(links)
    own = F.when(F.col("n") > 0, F.col("doc_id"))
    return sets.join(by_class, IDENTITY, "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", own)).alias("class"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def op9_ngram_join(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id. Rows without an id stay."""
    extra = ngram_components(docs, n, percent, id_col, text_col).where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(extra, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
