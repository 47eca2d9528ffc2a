"""Packing of whole documents into as few sequences as can be: bin completion over the histogram of lengths.

One pass tokenises the documents and writes their pieces; a piece's length is all that packing needs. Lengths form at most
``length`` classes, whatever the corpus's size, so the search runs on their counts: a filling of a sequence is a list of
(length, how many), and one step places it as often as the counts allow. Best-fit decreasing gives the first incumbent.
Bin completion then takes the longest piece that is left, enumerates the undominated fillings around it, fullest first, and
goes back where the waste so far, or the lower bound of what is left, shows that no sequence can be saved. ``effort`` bounds the
fillings tried; what the search has not improved by then stays as it is. Pieces get their sequences by their rank in their
class, which comes from counts of blocks: no group of documents is ever packed by itself.

Steps that place a filling use up a class or leave fewer of it than fit in a sequence, so there are fewer than ``length`` times
(2 + ln ``length``) of them and the plan that goes to the tasks has a bounded size.

Defined cases: a null or empty text is a document of the end id alone; repeated rows are packed each for itself; an empty table
gives no pieces; a text of any length is cut into pieces of ``length`` and a rest; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwright.llm.common import id_text, small_batches, table, written
from spanwright.llm.packing import default_tokenizer_path, encode_column

#: Fillings that bin completion tries, and those it enumerates around one piece.
EFFORT, WIDTH, STEPS = 10_000, 8, 400

Filling = list[tuple[int, int]]
Plan = list[tuple[int, Filling]]


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that pieces need at least; ``counts`` by length, from 0 to the sequence's own. Pieces over half share no sequence, those of length K or more fit only beside pieces that leave K, and no more of them share one than K goes into it."""
    cap = len(counts) - 1
    n, size = np.cumsum(counts), np.cumsum(counts * np.arange(cap + 1))
    half = cap // 2
    k = np.arange(half + 1)
    over = n[cap] - n[half]
    beside = (n[cap - k] - n[half]) * cap - (size[cap - k] - size[half])  # room beside pieces over half that leave k
    small = size[half] - np.where(k > 0, size[np.maximum(k, 1) - 1], 0)
    each = cap // np.arange(1, cap + 1)
    return int(max(over + max(0, -(-(small - beside).max() // cap)), (-(-(n[cap] - n[:-1]) // each)).max()))


def best_fit_decreasing(counts: np.ndarray) -> Plan:
    """The longest pieces first, each into the fullest sequence that has room; equal sequences are filled together."""
    cap = len(counts) - 1
    open_: list[list[tuple[int, Filling]]] = [[] for _ in range(cap + 1)]
    there = np.zeros(cap + 1, bool)

    def put(n: int, room: int, filling: Filling) -> None:
        if n:
            open_[room].append((n, filling))
            there[room] = True

    for s in range(cap, 0, -1):
        left = int(counts[s])
        while left:
            room = s + int(there[s:].argmax())
            if there[room]:
                n, filling = open_[room].pop()
                there[room] = bool(open_[room])
            else:
                n, room, filling = left, cap, []
            each = room // s
            full = min(n, left // each)
            put(full, room - each * s, [*filling, (s, each)])
            left -= full * each
            n -= full
            if n and left and left < each:
                put(1, room - left * s, [*filling, (s, left)])
                left, n = 0, n - 1
            if filling:
                put(n, room, filling)
    return [(n, f) for groups in open_ for n, f in groups]


def fillings(counts: np.ndarray, size: int, slack: int, width: int = WIDTH, steps: int = STEPS) -> list[Filling]:
    """Undominated fillings of a sequence that holds a piece of ``size``, the longest left, with at most ``slack`` unused; fullest first, ``width`` at most.

    A piece that fills the rest exactly dominates all else. A filling is dominated where a piece left out can take the place of
    some of those inside (a longer one of one, or one for two) within the unused room, or can be added.
    """
    cap = len(counts) - 1
    room = cap - size
    free = counts.copy()
    free[size] -= 1
    if room == 0:
        return [[(size, 1)]]
    if free[room] > 0:
        return [_grouped([size, room])]
    sizes = np.flatnonzero(free[: room + 1])[::-1].tolist()
    found: list[tuple[int, list[int]]] = []
    tried = 0

    def grow(inside: list[int], left: int, at: int) -> None:
        nonlocal tried
        tried += 1
        if tried > steps or (len(found) >= width and found[-1][0] == 0):
            return
        if left and free[left] > 0 and (not inside or left <= inside[-1]):
            found.append((0, [*inside, left]))
            return
        fits = False
        for i in range(at, len(sizes)):
            s = sizes[i]
            if s > left or free[s] <= 0:
                continue
            fits = True
            free[s] -= 1
            grow([*inside, s], left - s, i)
            free[s] += 1
            if tried > steps or len(found) >= width:
                break
        if not fits and left <= slack and undominated(inside, left):
            found.append((left, inside))

    def undominated(inside: list[int], left: int) -> bool:
        if left == 0:
            return True
        if free[1 : left + 1].any() or any(free[s + 1 : s + left + 1].any() for s in set(inside)):
            return False
        return not any(free[a + b : a + b + left + 1].any() for k, a in enumerate(inside) for b in inside[k + 1 :])

    grow([], room, 0)
    found.sort(key=lambda x: x[0])
    return [_grouped([size, *inside]) for _, inside in found[:width]]


def _grouped(pieces: list[int]) -> Filling:
    return [(s, pieces.count(s)) for s in dict.fromkeys(pieces)]


def bin_completion(counts: np.ndarray, effort: int = EFFORT) -> Plan:
    """A plan of few sequences for pieces of these counts: best-fit decreasing, improved by branch and bound while ``effort`` lasts."""
    cap = len(counts) - 1
    counts = counts.astype(np.int64)
    best = best_fit_decreasing(counts)
    n_best = sum(n for n, _ in best)
    bound, total = lower_bound(counts), int((counts * np.arange(cap + 1)).sum())
    left, used, path = counts.copy(), 0, []
    stack: list[list[Filling]] = []
    remaining = total
    while effort and n_best > bound:
        slack = (n_best - 1 - used) * cap - remaining  # room that a better plan may still leave unused
        if not remaining:  # a better plan
            best, n_best = list(path), used
        if remaining and slack >= 0 and used + lower_bound(left) < n_best:
            size = int(np.flatnonzero(left)[-1])
            stack.append(fillings(left, size, slack)[::-1])
        else:
            stack.append([])
        while stack and not stack[-1]:
            stack.pop()
            if path:
                n, filling = path.pop()
                used -= n
                for s, k in filling:
                    left[s] += n * k
                    remaining += n * k * s
        if not stack:
            break
        filling = stack[-1].pop()
        effort -= 1
        n = min(int(left[s]) // k for s, k in filling)
        unused = cap - sum(s * k for s, k in filling)
        if unused:
            slack = (n_best - 1 - used) * cap - remaining
            n = max(1, min(n, slack // unused))
        for s, k in filling:
            left[s] -= n * k
            remaining -= n * k * s
        used += n
        path.append((n, filling))
    return best


def places(plan: Plan) -> tuple[np.ndarray, ...]:
    """Of each stretch of ranks in a class: class and first rank (in order), how many stand in a sequence, its first sequence, and the offset there."""
    rows, at, sequence = [], {}, 0
    for n, filling in plan:
        offset = 0
        for s, k in filling:
            rows.append((s, at.get(s, 0), k, sequence, offset))
            at[s] = at.get(s, 0) + n * k
            offset += k * s
        sequence += n
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


_RANK_BITS = 48
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, rank long"
OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def document_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, end_id: int = 1, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents' ids with their rank among those of their length in their block, which is the task that made them; ``with_ids`` adds the ids."""
    path = tokenizer_path or default_tokenizer_path()
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            ids, edges = encode_column(batch.column("text"), path)
            rows, kept = [], []
            for d, s, e in zip(batch.column("doc_id").to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = np.append(ids[s:e], np.uint32(end_id))
                for piece, at in enumerate(range(0, len(own), length)):
                    part = own[at : at + length]
                    n = len(part)
                    rows.append((d, piece, at, n, zlib.crc32(part.tobytes()), block, seen[n]))
                    seen[n] += 1
                    if with_ids:
                        kept.append(part.astype("int32"))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PIECES.split(", ")] + (["ids"] if with_ids else []))

    return id_text(docs, id_col, text_col).mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def pack_whole(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, end_id: int = 1, tokenizer_path: str | None = None, effort: int = EFFORT, with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and its place there; only documents of more than ``length`` ids are cut. ``with_ids`` adds the ids as array<int>."""
    pieces = written(document_pieces(docs, id_col, text_col, length, end_id, tokenizer_path, with_ids), "pieces")
    blocks = pieces.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(length + 1, np.int64)
    for n, c in blocks.groupBy("length").agg(F.sum("n")).collect():  # at most ``length`` rows
        counts[n] = c
    cls, first, each, sequence, offset = places(bin_completion(counts, effort))
    shared = docs.sparkSession.sparkContext.broadcast(((cls << _RANK_BITS) + first, first, each, sequence, offset))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    before = blocks.select("block", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["block", "length"]).withColumn("rank", F.col("rank") + F.col("before"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, each, sequence, offset = shared.value
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, (size << _RANK_BITS) + rank, "right") - 1
            own = rank - first[at]
            arrays = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence[at] + own // each[at]), pa.array(offset[at] + own % each[at] * size)]
            yield pa.RecordBatch.from_arrays(arrays + ([batch.column("ids")] if with_ids else []), names=[x.split()[0] for x in OUT.split(", ")] + (["ids"] if with_ids else []))

    return ranked.mapInArrow(placed, OUT + (", ids array<int>" if with_ids else ""))


def op11_best_fit(spark, sf_dir):
    return pack_whole(table(spark, sf_dir, "documents"))
