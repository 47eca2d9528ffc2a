"""Add-one bigram log probabilities of sentences, counted a chunk of the corpus at a time.

A task takes sentences until it has CHUNK tokens. It sends the chunk's different pairs and words, each once with its count and dealt by
a hash over their letters, to be added up; the totals come back in the order in which they were sent, so without their words. What is
shuffled beside them is a chunk's sentences as places in that order. All of it is packed, so a token takes a few bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from spanwright.operators.packed import CHUNK, SHARES, hashes, ints, names, pack, packed_names, runs, unpack
from spanwright.operators.tokens import BOUNDARY

#: What a chunk keeps beside its counts: keys and lengths of its sentences, their pairs' places, each place's first word, each word's place.
KEYS, PLACES, FIRST, WORDS = -4, -3, -2, -1
PARTS = pa.schema([("dest", pa.int64()), ("chunk", pa.int64()), ("p", pa.int32()), ("blob", pa.binary())])


def _sent(held: list[pa.RecordBatch], chunk: int, shares: int) -> Iterator[pa.RecordBatch]:
    """A chunk's rows of PARTS."""
    t = pa.Table.from_batches(held)
    w = t.column("w").combine_chunks()
    sizes, coded = w.value_lengths().to_numpy(), w.flatten().dictionary_encode()
    words = pa.concat_arrays([pa.array([BOUNDARY]), coded.dictionary])
    order = pc.sort_indices(words).to_numpy()
    rank, words = np.empty(len(order), np.int64), words.take(pa.array(order))
    rank[order] = np.arange(len(order))
    word = rank[coded.indices.to_numpy() + 1]
    ends = np.cumsum(sizes + 1)
    left, right = np.full((2, ends[-1]), rank[0])
    inner = np.ones((2, ends[-1]), bool)
    inner[0, ends - sizes - 1] = inner[1, ends - 1] = False
    left[inner[0]] = right[inner[1]] = word
    pairs, at, n = np.unique(left * len(words) + right, return_inverse=True, return_counts=True)
    one, two = pairs // len(words), pairs % len(words)
    alone = np.arange(len(words))
    # pairs and words as strings of one list; a word has no separator
    listed = pa.concat_arrays([pc.binary_join_element_wise(words.take(pa.array(one)), words.take(pa.array(two)), "\0"), words])
    n = np.append(n, np.bincount(left, minlength=len(words)))
    first = np.append(one, alone)
    h = hashes(words)
    mixed = np.append(h[one] * np.uint64(0x9E3779B97F4A7C15) + (h[two] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F), h * np.uint64(0x9E3779B97F4A7C15))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    p = ((mixed >> np.uint64(32)) % np.uint64(shares)).astype(np.int32)
    by = np.argsort(p, kind="stable")  # a share's strings stay in order, which packs them well
    place = np.empty(len(by), np.int32)
    place[by] = np.arange(len(by), dtype=np.int32)
    listed, n, p = listed.take(pa.array(by)), n[by], p[by]
    sink = pa.BufferOutputStream()
    keys = t.drop_columns(["w"]).append_column("__size", pa.array(sizes + 1)).combine_chunks()
    with pa.ipc.new_stream(sink, keys.schema) as out:
        out.write_table(keys)
    own = {KEYS: sink.getvalue(), PLACES: place[at], FIRST: np.diff(first[by], prepend=0).astype(np.int32), WORDS: place[len(pairs) :]}
    rows = [(-1 - chunk, chunk, k, pack(x)) for k, x in own.items()]
    rows += [(int(p[i]), chunk, int(p[i]), packed_names(listed.slice(i, j - i), n[i:j])) for i, j in runs(p)]
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[i : i + 64], strict=True), PARTS, strict=True)], schema=PARTS)


def _totals(t: pa.Table) -> pa.Table:
    """Counts of a share's strings over all chunks, for each chunk in its own order; what a chunk keeps passes."""
    if t.column("dest")[0].as_py() < 0:
        return t.select(["chunk", "p", "blob"])
    got = [names(x) for x in t.column("blob").to_pylist()]
    codes = pa.concat_arrays([x for x, _ in got]).dictionary_encode().indices.to_numpy()
    total = np.bincount(codes, np.concatenate([n for _, n in got])).astype(np.int64)[codes]
    ends = np.cumsum([len(n) for _, n in got]).tolist()
    blobs = [pack(total[e - len(n) : e]) for (_, n), e in zip(got, ends, strict=True)]
    return pa.table([t.column("chunk"), t.column("p"), pa.array(blobs, pa.binary())], names=["chunk", "p", "blob"])


def sentence_scores(sents: DataFrame, size: int, chunk: int = CHUNK, shares: int | None = None) -> DataFrame:
    """(keys, lp): sums of ln((n(w1 w2) + 1) / (n(w1) + size)) over a sentence's neighbours, the boundary on both sides."""
    keys = [c for c in sents.columns if c != "w"]
    sents = sents.select(*keys, "w")
    many = shares or SHARES * max(1, sents.rdd.getNumPartitions())

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, held, n = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            if b.num_rows:
                held, n = [*held, b], n + len(b.column("w").flatten())
            if n >= chunk:
                yield from _sent(held, k, many)
                k, held, n = k + 1, [], 0
        if held:
            yield from _sent(held, k, many)

    def scores(t: pa.Table) -> pa.Table:
        p, blobs = t.column("p").to_numpy(), t.column("blob")
        own = {k: blobs[int(np.flatnonzero(p == k)[0])].as_py() for k in (KEYS, PLACES, FIRST, WORDS)}
        total = np.concatenate([ints(blobs[int(i)].as_py(), np.int64) for i in np.argsort(p, kind="stable") if p[i] >= 0])
        lp = np.log((total + 1) / (total[ints(own[WORDS])][np.cumsum(ints(own[FIRST]))] + size))
        rows = pa.ipc.open_stream(unpack(own[KEYS])).read_all()
        sizes = rows.column("__size").to_numpy()
        return rows.drop_columns(["__size"]).append_column("lp", pa.array(np.add.reduceat(lp[ints(own[PLACES])], np.cumsum(sizes) - sizes)))

    schema = ", ".join(f"`{c}` {sents.schema[c].dataType.simpleString()}" for c in keys)
    sent = sents.mapInArrow(chunks, "dest long, chunk long, p int, blob binary")
    back = sent.groupBy("dest").applyInArrow(_totals, "chunk long, p int, blob binary")
    return back.groupBy("chunk").applyInArrow(scores, f"{schema}, lp double")
