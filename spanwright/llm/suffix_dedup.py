"""Removal of long repeated byte strings, by hashes of strings around minimum-hash anchors (in place of prefix doubling).

A byte goes if a string of ``length`` bytes that covers it also starts somewhere else. Ranking every position would shuffle
many times the corpus, so positions are ranked through samples that equal strings share: the anchor of a start p is the
leftmost place of the smallest hash of SEED bytes within [p, p + length). Starts in a row with one anchor make a run, about
one for each 190 bytes; equal strings have equal anchors at equal distances, so only runs of one anchor can hold them.

Each round hashes longer strings around the anchor, for what is left. Spark groups by the hashes and what
is unique leaves: its starts are kept for good. What repeats in the whole reach of a set of starts leaves too: they all go.
The compared strings grow from the anchor's SEED bytes towards ``length``, where every start stands for itself:

* round 0: the anchors, and the runs' whole texts;
* later rounds: the starts of a run at distances [i * w, (i + 1) * w) from the anchor, for w = WIDTHS in turn. Their common
  part, ``length - w + 1`` bytes, ranks whether any can repeat; their reach, ``length + w - 1`` bytes, whether all do.

A rank is two 64-bit hashes: the anchor's, and that of the added string with its place.

Defined cases: a null text counts as empty; a text shorter than ``length`` keeps all; repeated rows repeat all their strings;
an empty table gives an empty result; a text of any length is read in segments; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import dropped, id_text, small_batches, table, written

SEED = 32
WIDTHS = (64, 8, 1)
#: Starts that are looked at together.
SEGMENT = 1 << 18

_rng = np.random.default_rng(77)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POW["up"], _POW["down"] = _powers(_BASE, size), _powers(np.uint64(_inverse(int(_BASE))), size)
    return _POW["up"], _POW["down"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any substrings of ``b``, from one running sum."""

    def __init__(self, b: np.ndarray) -> None:
        up, self.down = _tables(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_VALUE[b] * up[: len(b)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def runs(b: np.ndarray, edges: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts in texts laid end to end: text, first start, last start, anchor place, hash of the anchor, of the reach."""
    n = len(b)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z
    h = Hashes(b)
    at = np.arange(n - SEED + 1)
    seed = h.of(at, at + SEED)
    key = (seed & np.uint64(0xFFFFFFFFFFF00000)) | at.astype(np.uint64)  # places fit 20 bits; the leftmost of equal hashes is least
    width, reach, low = length - SEED + 1, 1, key
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: n - length + 1], low[width - reach :][: n - length + 1])
    anchor = (low & np.uint64(0xFFFFF)).astype(np.int64)
    p = np.arange(n - length + 1)
    owner = np.searchsorted(edges, p, side="right") - 1
    ok = p + length <= edges[owner + 1]
    p, owner, anchor = p[ok], owner[ok], anchor[ok]
    if not len(p):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    lo, hi, a, own = p[first], p[last], anchor[first], owner[first]
    return own, lo, hi, a, seed[a].view(np.int64), h.of(lo, hi + length).view(np.int64)


def _segments(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Bytes, edges and (text number, offset) of texts laid end to end, long ones cut so that every start is in one piece."""
    parts: list[bytes] = []
    who: list[tuple[int, int]] = []
    size = 0
    for k, t in enumerate(texts):
        for s in range(0, max(0, len(t) - length + 1), SEGMENT):
            parts.append(t[s : s + SEGMENT + length - 1])
            who.append((k, s))
            size += len(parts[-1])
            if size >= SEGMENT:
                yield np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), who
                parts, who, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), who


RUNS = "doc_id long, text_hash long, lo int, far int, near int, anchor long, reach long"


def _run_rows(rows: DataFrame, length: int) -> DataFrame:
    """A row for each run: its text, first start, the distances of its first and last start from the anchor, and two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            ids, marks = batch.column("doc_id"), batch.column("text_hash")
            for b, edges, who in _segments(texts, length):
                own, lo, hi, a, anchor, reach = runs(b, edges, length)
                if not len(own):
                    continue
                take = pa.array(np.array([k for k, _ in who])[own])
                start = lo + np.array([s for _, s in who])[own] - edges[own]
                small = [pa.array(x.astype(np.int32)) for x in (start, a - lo, a - hi)]
                yield pa.RecordBatch.from_arrays([ids.take(take), marks.take(take), *small, pa.array(anchor), pa.array(reach)], names=[c.split()[0] for c in RUNS.split(", ")])

    return rows.mapInArrow(run, RUNS)


CONTENTS = "cid long, anchor long, doc_id long, text_hash long, lo int, far int, near int, copies long, bytes binary"
RANKS = "cid long, anchor long, node int, kind int, rank long, weight long"


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes that each run of a text reaches."""
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.int64(), pa.binary()]
    for batch in batches:
        out = []
        for d, mark, text, own in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text_hash", "text", "runs")), strict=True):
            raw = text.encode()
            out += [(r["cid"], r["anchor"], d, mark, r["lo"], r["far"], r["near"], r["copies"], raw[r["lo"] : r["lo"] + r["far"] - r["near"] + length]) for r in own]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in CONTENTS.split(", ")])


def _rank_rows(batches: Iterator[pa.RecordBatch], width: int, length: int) -> Iterator[pa.RecordBatch]:
    """Ranks of the asked sets of starts: kind 0 of the common part, kind 1 of the reach of sets that lie whole in their run."""
    for batch in batches:
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        for cid, anchor, far, near, copies, raw, nodes in zip(*(batch.column(n).to_pylist() for n in ("cid", "anchor", "far", "near", "copies", "bytes", "nodes")), strict=True):
            h = Hashes(np.frombuffer(raw, np.uint8))
            k = np.array(nodes, np.int64)
            x0, x1 = k * width, k * width + width - 1  # distances of the nearest and the farthest start
            whole = (x0 >= near) & (x1 <= far)
            for kind, start, end, use in ((0, far - x0, far - x1 + length, np.ones(len(k), bool)), (1, far - x1, far - x0 + length, whole)):
                n = int(use.sum())
                if n and (kind == 0 or width > 1):
                    rank = h.of(start[use], end[use]).view(np.int64)
                    for o, x in zip(out, (np.full(n, cid), np.full(n, anchor), k[use].astype(np.int32), np.full(n, kind, np.int32), rank, np.full(n, copies)), strict=True):
                        o.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=[x.split()[0] for x in RANKS.split(", ")])


def repeated_starts(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, lo, hi, single): ranges of starts, those of runs whose anchor is found elsewhere too, and (``single``) the
    parts of these whose strings of ``length`` bytes are found nowhere else after all. The rest of them repeats; all others are unique."""
    small_batches(docs.sparkSession)
    rows = _marked(docs, id_col, text_col)
    sampled = written(_run_rows(rows, length), "runs")
    # round 0: a lone anchor's starts are unique; where all runs of an anchor are equal all of them repeat; what is mixed stays.
    # Each anchor's rows meet as partial results, so a hot anchor is a row a task.
    place, kind = ["doc_id", "text_hash", "lo"], ["reach", "far", "near"]
    anchors = sampled.withColumn("kind", F.xxhash64(*kind)).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("most"), F.min("kind").alias("least"))
    anchors = written(anchors.where("n > 1").select("anchor", (F.col("most") != F.col("least")).alias("mixed")), "anchors")
    several = written(sampled.join(anchors, "anchor"), "several")
    dropped(sampled)
    dropped(anchors)
    found = [several.select("doc_id", "text_hash", "lo", (F.col("lo") + F.col("far") - F.col("near")).alias("hi"), F.lit(False).alias("single"))]
    # grouped by cid, not anchor: a hot anchor's rows are added up where they are, and its kinds go to many tasks
    open_ = several.where("mixed").withColumn("cid", F.xxhash64("anchor", *kind))
    open_ = open_.groupBy("cid").agg(F.count(F.lit(1)).alias("copies"), F.max(F.struct("anchor", *kind, *place)).alias("row")).select("cid", "copies", "row.*")
    # the bytes around the anchors that are left are fetched once; of equal runs one stands for all
    wanted = open_.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("cid", "anchor", "lo", "far", "near", "copies")).alias("runs"))
    contents = written(_with_text(rows, wanted, "inner").mapInArrow(lambda b: _cut(b, length), CONTENTS), "contents")
    one, spent = ["cid", "anchor", "node"], [contents]
    asked = contents.withColumn("nodes", _nodes(WIDTHS[0]))
    for k, width in enumerate(WIDTHS):
        ranked = asked.mapInArrow(lambda b, w=width: _rank_rows(b, w, length), RANKS)
        single = ranked.groupBy("anchor", "node", "kind", "rank").agg(F.sum("weight").alias("weight"), F.max("cid").alias("cid")).where("weight = 1").select(*one, "kind")
        single = written(single, f"round{k}")
        gone = single.where("kind = 0").select(*one)
        first, last = F.col("far") - (F.col("node") + 1) * width + 1, F.col("far") - F.col("node") * width
        at = contents.select("cid", "anchor", "doc_id", "text_hash", "lo", "far", "near")
        at = gone.join(at, ["cid", "anchor"]).select("doc_id", "text_hash", (F.col("lo") + F.greatest(first, F.lit(0))).cast("int").alias("lo"), (F.col("lo") + F.least(last, F.col("far") - F.col("near"))).cast("int").alias("hi"), F.lit(True).alias("single"))
        found.append(written(at, f"unique{k}"))
        spent.append(single)
        if width == 1:
            break
        # split what is neither unique nor repeats in its whole reach; sets that their run's ends cut have no reach to test
        sets = asked.select("cid", "anchor", "far", "near", "copies", F.explode("nodes").alias("node"))
        cut_off = sets.where("copies = 1").where((F.col("node") * width < F.col("near")) | ((F.col("node") + 1) * width - 1 > F.col("far"))).select(*one)
        split = single.where("kind = 1").select(*one).unionByName(cut_off).join(gone, one, "left_anti")
        # every run with such a set stays in it, decided or not: its strings still count against the others'
        per, w = width // WIDTHS[k + 1], WIDTHS[k + 1]
        inside = sets.join(split.select("anchor", "node").distinct(), ["anchor", "node"], "left_semi")
        finer = inside.groupBy("cid", "anchor").agg(F.collect_set("node").alias("parents")).select("cid", "anchor", F.flatten(F.transform("parents", lambda n: F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: (n * per + i).cast("int")))).alias("nodes"))
        asked = contents.join(finer, ["cid", "anchor"]).withColumn("nodes", F.filter("nodes", lambda i: ((i + 1) * w > F.col("near")) & (i * w <= F.col("far"))))  # noqa: B023
        asked = written(asked, f"asked{k}")
        spent.append(asked)
    for x in spent:
        dropped(x)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def repeated_by_doubling(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, lo): the starts whose string of ``length`` bytes starts elsewhere too, by prefix doubling over all positions.

    Each round ranks the pairs (rank here, rank ``step`` bytes on), so ranked strings double; a position whose rank is alone leaves,
    and with it whatever has it as its second half. Ranks are 64-bit hashes in place of dense numbers. It moves every position of the
    corpus in its first round, so ``remove_repeats`` ranks positions through anchors instead; this is the form to hold it against.
    """
    small_batches(docs.sparkSession)
    rows = written(_marked(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "rows")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode()
                for s in range(0, len(raw) - length + 1, SEGMENT):
                    b = np.frombuffer(raw[s : s + SEGMENT + SEED - 1], np.uint8)
                    at = np.arange(len(b) - SEED + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row)), pa.array((at + s).astype(np.int32)), pa.array(Hashes(b).of(at, at + SEED).view(np.int64))], names=["row", "at", "rank"])

    def shared(ranked: DataFrame, name: str) -> DataFrame:
        several = ranked.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rank")
        return written(ranked.join(several, "rank", "left_semi"), name)

    first = written(rows.select("row", "text").mapInArrow(seeds, "row long, at int, rank long"), "seeds")
    open_, reach = shared(first, "rank"), SEED
    dropped(first)
    while reach < length:
        step = min(reach, length - reach)
        second = open_.select("row", (F.col("at") - step).alias("at"), F.col("rank").alias("second"))
        longer = written(open_.join(second, ["row", "at"]).select("row", "at", F.xxhash64("rank", "second").alias("rank")), "pairs")
        dropped(open_)
        open_, reach = shared(longer, "rank"), reach + step
        dropped(longer)
    return open_.join(rows.select("row", "doc_id", "text_hash"), "row").select("doc_id", "text_hash", F.col("at").alias("lo"))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))


def _nodes(width: int):
    return F.sequence(F.floor(F.col("near") / width).cast("int"), F.floor(F.col("far") / width).cast("int"))


def _with_text(rows: DataFrame, by_text: DataFrame, how: str) -> DataFrame:
    b = by_text.withColumnsRenamed({"doc_id": "__d", "text_hash": "__h"})
    return rows.join(b, rows["doc_id"].eqNullSafe(b["__d"]) & (rows["text_hash"] == b["__h"]), how).drop("__d", "__h")


def spans_of(length: int, runs: set[tuple[int, int]], single: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes, given ranges of starts and the parts of them that don't repeat."""
    spans: list[list[int]] = []
    left = sorted(single, reverse=True)
    for lo, hi in sorted(runs):
        p = lo
        while p <= hi:
            while left and left[-1][1] < p:
                left.pop()
            a, b = left[-1] if left and left[-1][0] <= hi else (hi + 1, hi)
            if a > p:  # starts p .. a - 1 repeat
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = a - 1 + length
                else:
                    spans.append([p, a - 1 + length])
            p = max(a, b + 1)
    return [(s, e) for s, e in spans]


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (what is kept, a character cut in two dropped), n_bytes, n_removed, n_spans, kept_sha256, spans, and the string columns ``carry``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(c).cast("string").alias(c) for c in carry])
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    ranges = repeated_starts(docs, length, id_col, text_col).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("lo", "hi", "single")).alias("ranges"))
    schema = "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + "".join(f", `{c}` string" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, text, ranges_, *rest in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "ranges", *carry)), strict=True):
                raw = text.encode()
                spans = spans_of(length, *({(r["lo"], r["hi"]) for r in ranges_ or () if r["single"] == k} for k in (False, True)))
                kept = b"".join(raw[s:e] for s, e in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)], strict=True))
                out.append({"doc_id": d, "text": kept.decode("utf-8", "ignore"), "n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": [{"start": s, "end": e} for s, e in spans]} | dict(zip(carry, rest, strict=True)))
            arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), *[(c, pa.string()) for c in carry]])
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _with_text(rows, ranges, "left").mapInArrow(run, schema)


def op1_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
