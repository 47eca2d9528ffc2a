"""Packing of documents into token sequences: first-fit decreasing over a tournament tree, in randomised groups.

Documents are dealt at random into groups of a bounded size; each group is tokenised and packed by itself in one task, so
the work grows with the corpus and no group does. In a group every whole window of ``length`` ids is a sequence of its own;
what remains of the documents is packed by first-fit decreasing, where a tournament tree of the bins' free room finds the
leftmost bin that fits in logarithmic time. Room that is left is filled by cutting pieces of the emptiest bins, and the last
bin of a group is cut into sequences of powers of two, which need no padding.

Defined cases: a null or empty text is a document of the end id alone; repeated rows are packed each for itself; an empty
table gives no pieces; a text of any length is cut; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import id_text, small_batches, table, utf8, word_hashes

#: Code points of text in a group, about.
GROUP_CHARS = 2_000_000
#: Chunks whose ids a Python worker keeps, at about 30 bytes each.
CACHE_ENTRIES = 600_000
#: Runs of letters that are encoded as one text.
JOINED = 5000
#: Bytes that end a chunk.
_BLANK = np.isin(np.arange(256), [9, 10, 13, 32])


class Known:
    """Ids of chunks by the chunks' hashes, in flat arrays; the longest unused half goes when there are too many."""

    def __init__(self, path: str | None = None) -> None:
        self.path, self.turn = path, 0
        self.keys, self.start, self.size, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, "<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``keys``, and which of them are there."""
        at = np.searchsorted(self.keys, keys)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        return at, there

    def add(self, keys: np.ndarray, ids: list[bytes], wanted: np.ndarray) -> None:
        """Take in new sorted keys; ``wanted`` ones are in use now."""
        self.turn += 1
        at, there = self.find(wanted)
        self.used[at[there]] = self.turn
        if len(self.keys) + len(keys) > CACHE_ENTRIES:
            keep = self.used >= min(self.turn, int(np.median(self.used)) + 1) if len(self.used) else np.zeros(0, bool)
            size = self.size[keep]
            self.ids = self.ids[_stretches(self.start[keep], size)]
            self.keys, self.size, self.used, self.start = self.keys[keep], size, self.used[keep], np.cumsum(size) - size
        size = np.array([len(x) // 4 for x in ids], np.int64)
        start = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.size = np.insert(self.keys, at, keys), np.insert(self.start, at, start), np.insert(self.size, at, size)
        self.used = np.insert(self.used, at, np.full(len(keys), self.turn, np.int32))


def _stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of stretches of ``size`` from ``start``, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


_tokenizers: dict = {}
_known = Known()


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_column(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, as the tokenizer gives them without special tokens, and the edges between texts.

    A space ends a chunk in this tokenizer's normaliser and pre-tokeniser, which drop white space, so a text's ids are those of
    its chunks one after the other. Each different chunk is encoded once and kept under its 64-bit hash. A chunk of Latin-1
    letters with stops behind them is two pre-tokens already, so its letters go to the merges alone, lower-cased; any other
    chunk takes the whole way.
    """
    global _known
    if _known.path != path:
        _known = Known(path)
    data, edges = utf8(column)
    lo, hi, hashes = word_hashes(data, edges, ends=_BLANK, fold=False)
    chunks, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    new = np.flatnonzero(~_known.find(chunks)[1])
    _known.add(chunks[new], _encoded([data[lo[k] : hi[k]].tobytes().decode() for k in first[new]], path), chunks)
    at, _ = _known.find(chunks)
    size = _known.size[at][which]
    ids = _known.ids[_stretches(_known.start[at][which], size)]
    return ids, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(lo, edges)]


def _encoded(chunks: list[str], path: str) -> list[bytes]:
    """Ids of each of some different chunks."""
    full, merges, blank = _tokenizer(path)
    simple = [(m[1].lower(), m[2]) if (m := SIMPLE(c)) else (None, c) for c in chunks]
    runs, whole = list({r for r, _ in simple if r is not None}), list({c for _, c in simple})
    of: dict[str | None, bytes] = {None: b""}
    for k in range(0, len(runs), JOINED):
        part = runs[k : k + JOINED]
        ids = np.array(merges.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends, raw = 4 * np.append(np.flatnonzero(ids == blank), len(ids)), ids.tobytes()
        of.update(zip(part, map(raw.__getitem__, map(slice, [0, *(ends[:-1] + 4).tolist()], ends.tolist())), strict=True))
    rest = {c: np.array(e.ids, dtype="<u4").tobytes() for c, e in zip(whole, full.encode_batch_fast(whole, add_special_tokens=False), strict=True)}
    return [of[r] + rest[c] for r, c in simple]


#: Letters that lower-casing and composing change in the same way everywhere, then stops.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)").fullmatch


def _tokenizer(path: str):
    """The tokenizer, its merges alone for runs with blanks between, and the blank's id, which no run has."""
    from tokenizers import Tokenizer, pre_tokenizers

    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        full = Tokenizer.from_file(path)
        merges = Tokenizer(full.model)
        merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        (blank,) = merges.encode_batch_fast([" "], add_special_tokens=False)[0].ids
        _tokenizers[path] = full, merges, blank
    return _tokenizers[path]


class Tournament:
    """Free room of bins in a complete binary tree; every node holds the greatest room below it."""

    def __init__(self, bins: int, room: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [room] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """The leftmost bin with room for ``size``; the room is taken. There must be one."""
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        bin_ = i - self.leaves
        tree[i] -= size
        while i > 1:
            i //= 2
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a > b else b
        return bin_


def pack(sizes: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every document once and whole."""
    out: list[list[tuple[int, int, int]]] = []
    rest = []
    for d, n in enumerate(sizes):
        whole = n // length * length
        out += [[(d, s, length)] for s in range(0, whole, length)]
        if n > whole:
            rest.append((n - whole, d, whole))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, bins = Tournament(max(1, len(rest)), length), {}
    for n, d, s in rest:
        bins.setdefault(tree.first_fit(n), []).append((d, s, n))
    open_ = []
    for b in bins.values():
        used = sum(p[2] for p in b)
        if used == length:
            out.append(b)
        else:
            open_.append((used, b))
    open_.sort(key=lambda x: -x[0])
    i, j = 0, len(open_) - 1
    room = [length - used for used, _ in open_]
    while i < j:
        donor = open_[j][1]
        if not donor:
            j -= 1
        elif not room[i]:
            i += 1
        else:
            d, s, n = donor.pop()
            take = min(n, room[i])
            open_[i][1].append((d, s, take))
            room[i] -= take
            if take < n:
                donor.append((d, s + take, n - take))
    for k, (_, b) in enumerate(open_):
        if b and sum(p[2] for p in b) < length:
            assert k == j or k == i
            out += by_powers(b)
        elif b:
            out.append(b)
    return out


def by_powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The same ids in sequences whose lengths are different powers of two."""
    out, queue = [], pieces[::-1]
    total = sum(p[2] for p in pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        want, seq = total & (1 << bit), []
        while want:
            d, s, n = queue.pop()
            take = min(n, want)
            seq.append((d, s, take))
            want -= take
            if take < n:
                queue.append((d, s + take, n - take))
        if seq:
            out.append(seq)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, end_id: int = 2, tokenizer_path: str | None = None, group_chars: int = GROUP_CHARS, seed: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds its ids as array<int>. Sequence ids are unique over the groups and as stable as the scan."""
    path = tokenizer_path or default_tokenizer_path()
    small_batches(docs.sparkSession)
    rows = id_text(docs, id_col, text_col)
    chars = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    groups = int(-(-chars // group_chars)) or 1
    # the row number deals repeated rows apart
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))

    names = [x.split()[0] for x in PIECES.split(", ")]

    def packed(key: tuple, group: pa.Table) -> pa.Table:
        texts = group.column("text").combine_chunks()
        ids, edges = encode_column(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts, path)
        own = [np.append(ids[s:e], np.uint32(end_id)) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        cols: list[tuple] = []
        kept = []
        for k, seq in enumerate(pack([len(a) for a in own], length)):
            at = 0
            for d, s, n in seq:
                part = own[d][s : s + n]
                cols.append((d, s, n, zlib.crc32(part.tobytes()), len(own[d]), (key[0].as_py() << 32) + k, at))
                if with_ids:
                    kept.append(part.astype("int32"))
                at += n
        doc, *rest = zip(*cols, strict=True)
        arrays = [group.column("doc_id").take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in rest)]
        return pa.table(arrays + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []), names=names + (["ids"] if with_ids else []))

    # so many partitions that each has a few groups, whatever the corpus's size
    return rows.repartition(-(-groups // 8), "g").groupBy("g").applyInArrow(packed, PIECES + (", ids array<int>" if with_ids else ""))


def op2_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
