"""Packed arrays and strings, for what chunks of a corpus send to be added up."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

#: Tokens of a chunk, and shares of what chunks send for each split of the text: a share is added up in one task.
CHUNK, SHARES = 1 << 21, 16


def pack(x: np.ndarray | bytes | pa.Buffer) -> bytes:
    raw = x.tobytes() if isinstance(x, np.ndarray) else bytes(x)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)


def ints(x: bytes, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(unpack(x), kind)


def packed_names(words: pa.Array, counts: np.ndarray) -> bytes:
    """Strings and a number of 32 bits for each."""
    n, ends = len(words), np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return pack(np.concatenate([[n], np.diff(ends), counts]).astype(np.int32).tobytes() + (data[int(ends[0]) : int(ends[-1])].to_pybytes() if data else b""))


def names(blob: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = unpack(blob)
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    sizes, counts = np.frombuffer(raw, np.int32, 2 * n, 4).reshape(2, n)
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[4 + 8 * n :])), counts


def hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((zlib.crc32(x.encode()) for x in words.to_pylist()), np.uint64, len(words))


def runs(p: np.ndarray) -> list[tuple[int, int]]:
    """Where each value of a sorted array begins and ends."""
    edges = np.append(np.flatnonzero(np.append(True, p[1:] != p[:-1])), len(p)).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True)) if len(p) else []
