"""Marginal features as one row a word, counted a chunk of the corpus at a time.

A task sends the words of a chunk with the clusters beside them, packed and dealt by a hash over their letters, to be added up: a word of
a chunk takes a few bytes, where a row for each of its features takes some thirty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators.packed import CHUNK, SHARES, hashes, ints, names, pack, packed_names, runs
from spanwright.operators.tokens import BOUNDARY

#: Clustered words of the most occurrences that go to every task, packed; neighbours that are not among them are met by a shuffle.
HEAD = 1 << 20
PARTS = "p int, words binary, at binary, n binary"


def _dealt(words: pa.Array, word: np.ndarray, feature: np.ndarray, n: np.ndarray, width: int, shares: int) -> Iterator[pa.RecordBatch]:
    """Rows of PARTS of the counts of (number of a word, feature), added up."""
    order = pc.sort_indices(words).to_numpy()
    p = (hashes(words) % np.uint64(shares)).astype(np.int32)
    order = order[np.argsort(p[order], kind="stable")]
    words, p, place = words.take(pa.array(order)), p[order], np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    key, inverse = np.unique(place[word] * width + feature, return_inverse=True)
    n, at = np.bincount(inverse, n, len(key)).astype(np.int64), (key % width).astype(np.int32)
    of = np.bincount(key // width, minlength=len(words))
    ends = np.append(0, np.cumsum(of))
    rows = [(int(p[i]), packed_names(words.slice(i, j - i), of[i:j]), pack(at[ends[i] : ends[j]]), pack(n[ends[i] : ends[j]])) for i, j in runs(p)]
    for i in range(0, len(rows), 256):
        x = list(zip(*rows[i : i + 256], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.int32()), *(pa.array(c, pa.binary()) for c in x[1:])], names=["p", "words", "at", "n"])


def _chunks(batches: Iterator[pa.RecordBatch], column: str, chunk: int) -> Iterator[pa.Table]:
    """Batches of about ``chunk`` items of a column."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            x = b.column(column)
            held, n = [*held, b], n + (len(x.flatten()) if pa.types.is_list(x.type) else len(x))
        if n >= chunk:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def marginal_rows(sents: DataFrame, clusters: DataFrame, counts: DataFrame, n_clusters: int, head: int = HEAD, chunk: int = CHUNK, shares: int | None = None, unknown: int = 0) -> DataFrame:
    """(word, at, n): the features that a word has, in order, and their counts: those of ``tokens.marginal_features_of``, words outside
    ``clusters`` having ``unknown``. ``sents`` is read once where
    all clustered words go to every task, else twice; ``clusters`` and ``counts`` are read several times."""
    stride, width = n_clusters + 1, 2 * (n_clusters + 1)
    sents, own = sents.select("w"), clusters.select("word", "cid")
    many = shares or SHARES * max(1, sents.rdd.getNumPartitions())
    all_known = own.limit(head + 1).count() <= head
    known = (own if all_known else own.join(counts.select("word", "n"), "word").orderBy(F.desc("n"), "word").limit(head).select("word", "cid")).toArrow().combine_chunks()
    column = lambda c: pa.concat_arrays(known.column(c).chunks) if known.num_rows else pa.array([], known.schema.field(c).type)
    shared = sents.sparkSession.sparkContext.broadcast((column("word"), column("cid").to_numpy().astype(np.int64)))

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """Of each chunk: its different words, its tokens as their numbers, each word's cluster or -1, and the neighbours' numbers (-1: the boundary) on either side."""
        listed, cids = shared.value
        for t in _chunks(batches, "w", chunk):
            w = t.column("w").combine_chunks()
            sizes, coded = w.value_lengths().to_numpy(), w.flatten().dictionary_encode()
            if not len(coded):
                continue
            words, token = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            at = pc.fill_null(pc.index_in(words, value_set=listed), -1).to_numpy()
            outside = np.where(pc.equal(words, BOUNDARY).to_numpy(zero_copy_only=False), 0, unknown if all_known else -1)
            cid = np.where(at >= 0, np.append(cids, 0)[at], outside)
            ends = np.cumsum(sizes)[sizes > 0]
            left, right = np.append(-1, token[:-1]), np.append(token[1:], -1)
            left[ends - sizes[sizes > 0]] = right[ends - 1] = -1
            yield words, token, cid, [left, right]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, token, cid, sides in beside(batches):
            places = [np.append(cid, 0)[x] for x in sides]  # the boundary's is the last
            key, n = np.unique(np.concatenate([(token * width + k * stride + c)[c >= 0] for k, c in enumerate(places)]), return_counts=True)
            yield from _dealt(words, key // width, key % width, n, width, many)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, token, cid, sides in beside(batches):
            key, n = np.unique(np.concatenate([((token * 2 + k) * len(words) + x)[np.append(cid, 0)[x] < 0] for k, x in enumerate(sides)]), return_counts=True)
            one, side = key // len(words) // 2, (key // len(words) % 2).astype(np.int32)
            for i in range(0, len(key), 100_000):
                at = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(one[at])), pa.array(side[at]), words.take(pa.array(key[at] % len(words))), pa.array(n[at])], names=["word", "side", "other", "n"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, "word", chunk):
            x = t.column("word").combine_chunks().dictionary_encode()
            yield from _dealt(x.dictionary, x.indices.to_numpy().astype(np.int64), t.column("feature").to_numpy(), t.column("n").to_numpy(), width, many)

    def sums(t: pa.Table) -> pa.Table:
        got = [names(x) for x in t.column("words").to_pylist()]
        x = pa.concat_arrays([x for x, _ in got]).dictionary_encode()
        word = np.repeat(x.indices.to_numpy().astype(np.int64), np.concatenate([of for _, of in got]))
        at, n = (np.concatenate([ints(b, kind) for b in t.column(c).to_pylist()]) for c, kind in (("at", np.int32), ("n", np.int64)))
        key, inverse = np.unique(word * width + at, return_inverse=True)
        total = np.bincount(inverse, n).astype(np.int64)
        # words without a feature here have empty lists
        ends = pa.array(np.append(0, np.cumsum(np.bincount(key // width, minlength=len(x.dictionary)))), pa.int32())
        return pa.table([x.dictionary, pa.ListArray.from_arrays(ends, pa.array((key % width).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(total))], names=["word", "at", "n"])

    parts = sents.mapInArrow(met, PARTS)
    if not all_known:
        rest = sents.mapInArrow(others, "word string, side int, other string, n long").join(own.select(F.col("word").alias("other"), "cid"), "other", "left")
        parts = parts.unionByName(rest.select("word", (F.coalesce("cid", F.lit(unknown)) + F.col("side") * stride).cast("long").alias("feature"), "n").mapInArrow(dealt, PARTS))
    return parts.groupBy("p").applyInArrow(sums, "word string, at array<int>, n array<long>")
