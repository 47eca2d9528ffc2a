"""Helpers shared by the corpus operators: table access, shared scratch tables, Arrow batches and views of them."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch: long texts must not pile up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers are handed; every operator asks for the same bounds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes laid end to end, and the edges of its rows in them, without copies; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or edges[-1] == edges[0]:
        return np.zeros(0, np.uint8), edges - edges[0]
    return np.frombuffer(data, np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def slices(edges: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Rows (from, to) that hold about ``size`` bytes together; a longer row stands alone."""
    at, rows = 0, len(edges) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(edges, edges[at] + size, "right")) - 1)
        yield at, min(end, rows)
        at = min(end, rows)


_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: A number for each byte, and the same with A-Z read as a-z.
_PLAIN = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _PLAIN[_LOWER]
#: Bytes that end a word: white space.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 512


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, their bits mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _scales(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        steps = np.full((2, max(n, 1 << 16)), [[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
        steps[:, 0] = 1
        _powers[:] = np.multiply.accumulate(steps, axis=1)
    return _powers


def _piece_words(b: np.ndarray, edges: np.ndarray, ends: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = ends[b]
    turn = np.flatnonzero(np.diff(space, prepend=True, append=True))
    lo, hi = turn[::2], turn[1::2]
    inner = edges[(edges > 0) & (edges < len(b))]
    inner = np.unique(inner[~space[inner] & ~space[inner - 1]])
    if len(inner):
        lo, hi = np.sort(np.concatenate([lo, inner])), np.sort(np.concatenate([hi, inner]))
    up, down = _scales(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _PLAIN)[b] * up[: len(b)], out=sums[1:])
    hashes = mixed((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))
    for k in np.flatnonzero(hi - lo > LONG_WORD):
        import xxhash

        own = b[lo[k] : hi[k]]
        hashes[k] = xxhash.xxh64_intdigest((_LOWER[own].astype(np.uint8) if fold else own).tobytes(), 9)
    return lo, hi, hashes


def word_hashes(b: np.ndarray, edges: np.ndarray, piece: int = 1 << 19, ends: np.ndarray = SPACE, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words (``fold``: A-Z lower-cased) of texts laid end to end; ``edges`` of texts end words too. Many bytes are read in pieces that end between words."""
    if len(b) <= 2 * piece:
        return _piece_words(b, edges, ends, fold)
    at, out = 0, []
    while at < len(b):
        end = min(len(b), at + piece)
        while end < len(b) and not ends[b[end - 1]]:
            gap = np.flatnonzero(ends[b[end : end + piece]])
            end = end + int(gap[0]) + 1 if len(gap) else min(len(b), end + piece)
        lo, hi, hashes = _piece_words(b[at:end], edges[np.searchsorted(edges, at) : np.searchsorted(edges, end, "right")] - at, ends, fold)
        out.append((lo + at, hi + at, hashes))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of this machine if all runs on it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = os.path.join(tempfile.gettempdir(), "spanwright-checkpoints")
        os.makedirs(shared, exist_ok=True)
    return shared.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost executor costs no recomputation."""
    path = f"{scratch(df.sparkSession)}/spanwright-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession._jvm.System.gc()  # lets Spark delete the shuffle files that only the finished job needed
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` once nothing reads it any more."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null texts as empty ones; other columns stay behind in the scan."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
