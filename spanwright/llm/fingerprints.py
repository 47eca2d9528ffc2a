"""Document fingerprints: digests of improbable byte windows in chained Bloom filters.

Every 64-byte window of a text gets its Shannon entropy, and from it a rank: the farther the entropy lies from where windows
usually lie, the rarer the window and the lower its rank. The lowest rank of each 64 windows in a row, the leftmost on a tie,
scores a point; windows of at least 16 points are the text's features. Their hashes go, 160 to a filter, into a chain of
2048-bit Bloom filters. Two digests are compared filter by filter: common bits, less what chance gives, over what is possible,
the best for each filter of the shorter digest, averaged. The rank is a fixed rule, so digests of different corpora compare.

Defined cases: a null text counts as empty; a text of under 64 bytes has one feature, itself; an empty one has none, is like
another empty one by 1 and like any other text by 0; repeated rows are digested each for itself; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import id_text, small_batches, table

WINDOW = 64
POINTS = 16
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
#: Bytes that are worked on at once, so that the arrays stay in the processor's cache.
CHUNK = 1 << 16
#: Entropy, in thousandths of six bits, about which windows of ordinary prose lie.
USUAL = 640

_n = np.arange(WINDOW + 1, dtype=np.float64)
#: n log2 n in units of 2^-20; increments of its sum over a window's byte counts stay exact in integers.
_NLOGN = np.round(_n * np.log2(np.maximum(_n, 1)) * (1 << 20)).astype(np.int64)
_STEP = np.diff(_NLOGN).astype(np.int32)


def window_sums(b: np.ndarray) -> np.ndarray:
    """Sum of n log2 n over the byte counts n of each 64-byte window of ``b``, in units of 2^-20."""
    n = len(b)
    back, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (b[d:] == b[:-d]).view(np.uint8)
        back[d:] += same
        ahead[:-d] += same
    first = int(_NLOGN[np.bincount(b[:WINDOW], minlength=256)].sum())
    # window s -> s + 1: byte s leaves, having ahead[s] others in the window; byte s + 64 comes, finding back[s + 64] others
    out = np.empty(n - WINDOW + 1, np.int32)  # each sum is at most 64 * 6 * 2^20
    out[0] = first
    np.subtract(_STEP[back[WINDOW:]], _STEP[ahead[: n - WINDOW]], out=out[1:])
    return np.cumsum(out, out=out)


#: No feature: windows that are nearly of one byte value.
DULL = 1001
_LEVEL = np.clip(np.round((6.0 - np.arange((int(_NLOGN[WINDOW]) >> 16) + 1) / WINDOW / 16) * (1000 / 6)), 0, 1000).astype(np.int64)
_RANK = np.where(_LEVEL < 100, DULL, 1000 - np.abs(_LEVEL - USUAL))


def ranks(b: np.ndarray) -> np.ndarray:
    """Rank of each window by the rarity of its entropy, in thousandths of six bits: 0 is the rarest."""
    kind = np.int32 if len(b) < 1 << 21 else np.int64
    return _RANK.astype(kind)[window_sums(b) >> 16]


_MIX = np.random.default_rng(20240229).integers(1, 1 << 63, 9, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hashes(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(b[starts[:, None] + np.arange(WINDOW)]).view(np.uint64)
    h = np.full(len(starts), _MIX[8])
    for k in range(8):
        h = _mixed(h ^ (words[:, k] * _MIX[k]))
    return h


def _features(b: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the features of texts laid end to end; text k is b[edges[k]:edges[k + 1]]."""
    r = ranks(b)
    kind = r.dtype.type
    shift, most = kind(21 if kind is np.int32 else 40), np.iinfo(kind).max
    owner_end = np.repeat(edges[1:].astype(kind), np.diff(edges))[: len(r)]
    at = np.arange(len(r), dtype=kind)
    key = (r << shift) | at
    key[at + kind(WINDOW) > owner_end] = most  # windows over the end of a text
    low, reach = key, 1
    while reach < WINDOW:
        low = np.minimum(low[:-reach], low[reach:]) if len(low) > reach else low[:0]
        reach *= 2
    # a run of 64 windows that lies in one text; texts of fewer windows have one run, handled below
    whole = at[: len(low)] + kind(2 * WINDOW - 1) <= owner_end[: len(low)]
    points = np.bincount(low[whole] & ((kind(1) << shift) - kind(1)), minlength=len(r))
    chosen = np.flatnonzero((points >= POINTS) & (r < DULL))
    which = np.searchsorted(edges, chosen, side="right") - 1
    have = np.zeros(len(edges) - 1, bool)
    have[which] = True
    extra = []
    for k in np.flatnonzero(~have & (np.diff(edges) >= WINDOW)):  # short or monotonous: its rarest window
        part = key[edges[k] : edges[k + 1] - WINDOW + 1]
        extra.append(edges[k] + int(np.argmin(part)))
    if extra:
        chosen = np.sort(np.concatenate([chosen, np.array(extra)]))
        which = np.searchsorted(edges, chosen, side="right") - 1
    return which, _hashes(b, chosen)


def digests(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's chain of Bloom filters, as an array of shape (filters, 256) of bytes."""
    hashes: list[list[np.ndarray]] = [[] for _ in texts]
    batch: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if batch:
            b = np.frombuffer(b"".join(texts[k] for k in batch), np.uint8)
            edges = np.concatenate([[0], np.cumsum([len(texts[k]) for k in batch])])
            which, h = _features(b, edges)
            cuts = np.searchsorted(which, np.arange(len(batch) + 1))
            for i, k in enumerate(batch):
                hashes[k].append(h[cuts[i] : cuts[i + 1]])
        batch.clear()
        size = 0

    for k, t in enumerate(texts):
        if len(t) < WINDOW:
            if t:
                hashes[k].append(np.frombuffer(hashlib.blake2b(t, digest_size=8).digest(), np.uint64))
            continue
        batch.append(k)
        size += len(t)
        if size >= CHUNK:
            flush()
    flush()
    return [_filters(np.concatenate(h)) if h else np.zeros((0, FILTER_BITS // 8), np.uint8) for h in hashes]


def _filters(h: np.ndarray) -> np.ndarray:
    if len(h) > 1:
        h = h[np.sort(np.unique(h, return_index=True)[1])]  # once each, in the text's order
    bits = np.zeros((-(-len(h) // FILTER_FEATURES), FILTER_BITS), np.uint8)
    row = np.arange(len(h)) // FILTER_FEATURES
    for k in range(HASHES):
        bits[row, (h >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = 1
    return np.packbits(bits, axis=1)


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: common bits over chance, best for each filter of the shorter digest, averaged."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if len(a) > len(b) or len(a) == len(b) and a.tobytes() > b.tobytes():
        a, b = b, a
    na, nb = _ONES[a].sum(1).astype(float), _ONES[b].sum(1).astype(float)
    total = 0.0
    for x, n in zip(a, na, strict=True):
        common = _ONES[x & b].sum(1).astype(float)
        most = np.minimum(n, nb)
        chance = n * nb / FILTER_BITS
        floor = chance + 0.1 * (most - chance)
        total += float(np.clip(np.where(common > floor, (common - floor) / np.maximum(most - floor, 1e-9), 0.0), 0, 1).max())
    return total / len(a)


def encoded(d: np.ndarray) -> str:
    """A digest as text: the number of its filters, then their bits."""
    return f"{len(d)}:{base64.b64encode(d.tobytes()).decode()}"


def decoded(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s.split(":", 1)[1]), np.uint8).reshape(-1, FILTER_BITS // 8)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every text, without a shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fingerprint": [encoded(d) for d in digests([t.encode() for t in pdf["text"]])]})

    return id_text(docs, id_col, text_col).mapInPandas(run, "doc_id long, fingerprint string")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the start of the next document's.

    Next is by ascending (doc_id, text). The rows are cut into ranges of doc_id by approximate quantiles; the first row of a
    range is also sent to the range before it, so one shuffle of the texts gives every row its successor, and no range holds
    more than its share. Nulls of doc_id come first. Of repeated rows one follows the other.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_text(docs, id_col, text_col)
    ids = rows.select("doc_id")
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in ids.approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 1 / (8 * wanted))})  # a number bounded by the partitions
    width = max(1, int(len(cuts) ** 0.5))
    coarse = F.array(*[F.lit(c) for c in cuts[::width]]) if cuts else F.array().cast("array<long>")
    fine = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>") if cuts else F.array().cast("array<long>")
    group = F.size(F.filter(coarse, lambda c: c <= F.col("doc_id")))  # which coarse cuts lie below, then which fine ones
    part = F.when(F.col("doc_id").isNull() | (group == 0), 0).otherwise((group - 1) * width + F.size(F.filter(F.slice(fine, (group - 1) * width + 1, F.lit(width)), lambda c: c <= F.col("doc_id"))))
    firsts = ids.groupBy(part.alias("p")).agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("null")).orderBy("p").collect()  # a row for each range
    if not firsts:
        return spark.createDataFrame([], EDITED)
    before = [(f["first"], firsts[k - 1]["p"], k == 0) for k, f in enumerate(firsts)]
    send = F.array().cast("array<struct<p:int,guard:int>>")
    start = {f: (p, wrap) for f, p, wrap in before if f is not None}
    has_null = bool(firsts[0]["null"])
    if has_null and firsts[0]["first"] is not None:
        del start[firsts[0]["first"]]
    keys = sorted(start)
    if keys:
        where = F.array_position(F.split(F.lit(",".join(map(str, keys))), ",").cast("array<long>"), F.col("doc_id"))
        to = F.split(F.lit(",".join(str(start[k][0]) for k in keys)), ",").cast("array<int>")
        wrap = F.split(F.lit(",".join("2" if start[k][1] else "1" for k in keys)), ",").cast("array<int>")
        send = F.when(where > 0, F.array(F.struct(F.get(to, (where - 1).cast("int")).alias("p"), F.get(wrap, (where - 1).cast("int")).alias("guard")))).otherwise(send)
    if has_null:
        send = F.when(F.col("doc_id").isNull(), F.array(F.struct(F.lit(firsts[-1]["p"]).cast("int").alias("p"), F.lit(2).alias("guard")))).otherwise(send)
    # guard 0: a row of the range; 1: the first of the next range; 2: the first of all, after the last
    dealt = rows.withColumn("to", F.explode(F.concat(F.array(F.struct(part.cast("int").alias("p"), F.lit(0).alias("guard"))), send))).select("to.p", "to.guard", "doc_id", "text")
    dealt = dealt.repartition(len(firsts), "p").sortWithinPartitions("p", "guard", F.asc_nulls_first("doc_id"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last row of a batch waits for its successor
        for pdf in batches:
            rows_ = list(zip(pdf["p"], pdf["guard"], pdf["doc_id"], pdf["text"], strict=True))
            if held is not None:
                rows_ = [held, *rows_]
            held = rows_[-1]
            yield _digest_rows(rows_)

    return dealt.mapInPandas(run, EDITED)


def _digest_rows(rows: list[tuple]) -> pd.DataFrame:
    own = [k for k in range(len(rows) - 1) if rows[k][1] == 0 and rows[k + 1][0] == rows[k][0]]
    texts = [t.encode() for *_, t in rows]
    edited = []
    for k in own:
        text, after = rows[k][3], rows[k + 1][3]
        half = len(text) // 2
        edited.append((text[: len(text) - half] + after[:half]).encode())
    whole, changed = digests(texts), digests(edited)
    shown = [encoded(d) for d in whole]
    out = [
        (rows[k][2], len(rows[k][3]), hashlib.sha256(e).hexdigest(), shown[k], encoded(c), likeness(whole[k], c), likeness(whole[k], whole[k + 1]))
        for k, e, c in zip(own, edited, changed, strict=True)
    ]
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in EDITED.split(", ")])
    frame["doc_id"] = pd.array([None if x != x else int(x) for x in frame["doc_id"]], dtype="Int64")
    return frame


def op3_fingerprints(spark, sf_dir):
    return fingerprint_edits(table(spark, sf_dir, "documents"))
