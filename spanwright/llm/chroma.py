"""Chroma audio fingerprints of media columns, and the alignment of recordings by them.

A recording is a binary WAV column. Its frames' spectra are folded into twelve pitch classes; an integral image
over (frame, pitch class) lets box filters of six shapes be read off anywhere in four look-ups each. Sixteen filters, each
quantised to two bits, make one packed 32-bit integer for every stretch of WIDTH frames: the fingerprint. Two fingerprints are
aligned by a histogram of the offsets at which their integers agree in the leading bits; at the best offset the share of
differing bits says how alike the recordings are.

Recordings are matched across a whole table: equal fingerprints are one class; the classes that are asked for meet all classes
under the signs of the filters' levels (the upper bit of each) in three of their integers; what many classes hold is dealt out in
blocks; votes for offsets are added up by Spark, and every offset with a vote is held against the bits. Recordings that agree so
nowhere, by noise, are not found, nor are those of fewer than SPREAD[-1] + 1 integers but for equal ones.

Defined cases: null, empty or malformed audio, and audio shorter than WIDTH frames, has an empty fingerprint; an empty
fingerprint aligns with nothing (offset null, bit error 1.0) and is alike to no other; silence is all the same integer, which
stands once in a class's postings; of offsets with equal votes the one nearest to 0, then the lesser, is taken; repeated rows are
read each for itself; an empty table gives an empty result; further columns are ignored. WAV of 8, 16, 24 and 32 bits is read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import dropped, small_batches, table, written

RATE, FRAME, HOP = 4096, 512, 128
WIDTH = 16
#: Bits of two integers that must agree to vote for an offset.
VOTE_BITS = 20
#: Filters: shape, first pitch class, height, width in frames. Shapes 0 to 5: all; upper less lower half; right less left half;
#: diagonal quarters less the others; middle third in pitch less the rest; middle third in time less the rest.
FILTERS = [(k % 6, (k * 5) % 12 % (13 - h), h, w) for k, (h, w) in enumerate([(3, 16), (4, 16), (6, 16), (4, 12), (6, 16), (6, 15), (3, 8), (8, 16), (12, 16), (6, 12), (9, 16), (4, 15), (2, 12), (10, 8), (6, 8), (8, 14)])]
STEPS = (-0.2, 0.0, 0.2)


def read_wav(raw: bytes | None) -> np.ndarray:
    """Samples between -1 and 1; none of audio that can't be read."""
    if not raw:
        return np.zeros(0, np.float32)
    try:
        with wave.open(io.BytesIO(raw)) as w:
            raw_, width = w.readframes(w.getnframes()), w.getsampwidth()
            if width == 1:
                x = np.frombuffer(raw_, np.uint8).astype(np.float32) / 128 - 1
            elif width == 3:
                b = np.frombuffer(raw_[: len(raw_) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
                x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) / 2**31).astype(np.float32)
            else:
                x = (np.frombuffer(raw_[: len(raw_) // width * width], {2: "<i2", 4: "<i4"}[width]) / 2.0 ** (8 * width - 1)).astype(np.float32)
            x = x[: len(x) // w.getnchannels() * w.getnchannels()].reshape(-1, w.getnchannels()).mean(1)
            rate = w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0, np.float32)
    return x if rate == RATE or not len(x) else np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x).astype(np.float32)


def write_wav(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def _fold() -> np.ndarray:
    """Spectrum bins to pitch classes, between 60 Hz and 1900 Hz."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    m = np.zeros((len(f), 12), np.float32)
    for k, hz in enumerate(f):
        if 60 <= hz <= 1900:
            m[k, int(round(12 * np.log2(hz / 440.0))) % 12] = 1
    return m


_FOLD, _HANN = _fold(), np.hanning(FRAME).astype(np.float32)


def chroma(x: np.ndarray) -> np.ndarray:
    """(frames, 12) energies, each frame scaled to length one."""
    n = (len(x) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    out = (np.abs(np.fft.rfft(frames * _HANN)) ** 2).astype(np.float32) @ _FOLD
    return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-6)


def fingerprint(c: np.ndarray) -> np.ndarray:
    """Packed integers, one for each stretch of WIDTH frames."""
    n = len(c) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0).cumsum(1)
    at = np.arange(n)
    box = lambda t0, t1, p0, p1: image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]
    out = np.zeros(n, np.uint32)
    for shape, p, h, w in FILTERS:
        whole = box(0, w, p, p + h)
        if shape == 0:
            a, b = whole / h, box(0, w, 0, 12) / 12
        elif shape == 1:
            a = box(0, w, p, p + h // 2)
            b = whole - a
        elif shape == 2:
            a = box(w // 2, w, p, p + h)
            b = whole - a
        elif shape == 3:
            a = box(0, w // 2, p, p + h // 2) + box(w // 2, w, p + h // 2, p + h)
            b = whole - a
        elif shape == 4:
            a = box(0, w, p + h // 3, p + h - h // 3) * 2
            b = (whole - a / 2) * 2
        else:
            a = box(w // 3, w - w // 3, p, p + h) * 2
            b = whole - a / 2
        level = np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0)))
        code = np.searchsorted(STEPS, level)
        out = (out << np.uint32(2)) | (code ^ (code >> 1)).astype(np.uint32)  # neighbouring levels differ in one bit
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int | None, float]:
    """The offset of ``b`` in ``a`` that most leading bits vote for (the smallest on a tie), and the share of differing bits there."""
    if not len(a) or not len(b):
        return None, 1.0
    x, y = a >> np.uint32(32 - VOTE_BITS), b >> np.uint32(32 - VOTE_BITS)
    order = np.argsort(x, kind="stable")
    lo, hi = np.searchsorted(x[order], y, "left"), np.searchsorted(x[order], y, "right")
    votes = np.zeros(len(a) + len(b), np.int64)
    for k in np.flatnonzero(hi > lo):
        np.add.at(votes, order[lo[k] : hi[k]] - k + len(b), 1)
    if not votes.any():
        return None, 1.0
    best = votes.max()
    offset = min((int(o) - len(b) for o in np.flatnonzero(votes == best)), key=lambda o: (abs(o), o))
    s, e = max(0, offset), min(len(a), len(b) + offset)
    if e <= s:
        return None, 1.0
    return offset, float(np.bitwise_count(a[s:e] ^ b[s - offset : e - offset]).sum() / (32 * (e - s)))


def fingerprint_audio(media: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """(id, fingerprint array<long>) of every recording."""
    small_batches(media.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "fingerprint": [fingerprint(chroma(read_wav(x))).astype(np.int64) for x in pdf["audio"]]})

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(audio_col).cast("binary").alias("audio")).mapInPandas(run, "id long, fingerprint array<long>")


def align_audio(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` (id, two fingerprint columns) with offset and bit_error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [align(*(np.array([] if z is None else z, np.uint32) for z in xy)) for xy in zip(pdf["a"], pdf["b"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "offset": pd.array([o for o, _ in found], dtype="Int64"), "bit_error": [e for _, e in found]})

    return pairs.select("id", F.col(a).alias("a"), F.col(b).alias("b")).mapInPandas(run, "id long, offset long, bit_error double")


NOTE = 256


def melody(values: np.ndarray) -> np.ndarray:
    """Notes that a vector spells: each entry's rank among quantiles is a pitch within two octaves above 220 Hz."""
    v = np.nan_to_num(np.asarray(values, np.float64))
    pitch = np.floor(24 / (1 + np.exp(-4 * v / (np.abs(v).mean() + 1e-9)))).clip(0, 23)
    t = np.arange(NOTE) / RATE
    return (0.6 * np.sin(2 * np.pi * (220 * 2 ** (pitch / 12))[:, None] * t) * np.hanning(NOTE)).ravel()


def record_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, take, other): a WAV of each vector's melody, and of a second take: eight notes later in, softer, with hiss."""
    small_batches(vectors.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (whole.iloc[i : i + 32] for whole in batches for i in range(0, len(whole), 32)):  # audio is large beside its vector
            takes, others = [], []
            for v in pdf["v"]:
                x = melody([] if v is None else v)
                hiss = np.random.default_rng(_seed(x)).normal(0, 0.01, len(x))
                takes.append(write_wav(x))
                others.append(write_wav((0.5 * x + hiss)[8 * NOTE :]))
            yield pd.DataFrame({"id": pdf["id"], "take": takes, "other": others})

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInPandas(run, "id long, take binary, other binary")


def _seed(x: np.ndarray) -> int:
    return zlib.crc32(x.astype("<f4").tobytes())


def fingerprint_takes(media: DataFrame, id_col: str = "id", take: str = "take", other: str = "other") -> DataFrame:
    """id, n_items, fingerprint_sha256, and the alignment of the two recordings of a row: offset (in items) and bit_error."""
    small_batches(media.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, x, y in zip(pdf["id"], pdf["a"], pdf["b"], strict=True):
                a, b = (fingerprint(chroma(read_wav(z))) for z in (x, y))
                rows.append((d, len(a), hashlib.sha256(a.astype("<u4").tobytes()).hexdigest(), *align(a, b)))
            out = pd.DataFrame(rows, columns=["id", "n_items", "fingerprint_sha256", "offset", "bit_error"])
            yield out.assign(offset=pd.array([None if o != o or o is None else int(o) for o in out["offset"]], dtype="Int64"))

    return media.select(F.col(id_col).alias("id"), F.col(take).alias("a"), F.col(other).alias("b")).mapInPandas(run, "id long, n_items long, fingerprint_sha256 string, offset long, bit_error double")


#: Places of the integers under whose signs classes of different rows meet, and the bits that are signs; classes of a block of one
#: key's holders; the share of differing bits up to which two recordings are the same.
SPREAD, SIGNS, HOLDERS, SAME = (0, 6, 12), 0xAAAAAAAA, 256, 0.15


def alike(found: DataFrame, asked: DataFrame, same: float = SAME) -> DataFrame:
    """(a, b, offset, bit_error): for each asked class (fp, a number) the other classes of ``found`` (fp, fingerprint) that hold the same recording.

    ``found`` has a row for each different fingerprint, ``asked`` names some of them. Offsets say where b starts in a.
    """
    spark = found.sparkSession
    # a key stands once for each class and place; where a class repeats it on end, as silence does, its first place stands for the run
    n = F.size("fingerprint") - SPREAD[-1]
    signs = lambda i: F.xxhash64(*(F.element_at("fingerprint", i + s).bitwiseAND(F.lit(SIGNS)) for s in SPREAD))
    keyed = found.where(n > 0).select("fp", F.transform(F.sequence(F.lit(1), n), signs).alias("keys"))
    places = F.filter(F.transform("keys", lambda x, i: F.struct(x.alias("key"), i.alias("at"), F.when(i > 0, F.get("keys", i - 1)).alias("before"))), lambda p: p["before"].isNull() | (p["before"] != p["key"]))
    posts = written(keyed.select("fp", F.explode(places).alias("p")).select("fp", "p.key", "p.at"), "postings")
    holders = posts.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = written(holders.select("key", F.ceil(F.col("m") / HOLDERS).cast("int").alias("blocks")), "holders")
    # an asked place goes to every block of its integer's holders, each holder to one block
    q = posts.join(asked.select("fp"), "fp", "left_semi").join(blocks, "key").select(F.col("fp").alias("a"), "key", F.col("at").alias("at_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    held = posts.join(blocks, "key").select(F.col("fp").alias("b"), "key", F.col("at").alias("at_b"), F.pmod(F.xxhash64("fp", "at"), F.col("blocks")).cast("int").alias("block"))
    votes = q.join(held, ["key", "block"]).where("a <> b").groupBy("a", "b", (F.col("at_a") - F.col("at_b")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))
    best = written(votes, "offsets")
    dropped(posts)
    dropped(blocks)
    # as int, whose differing bits are the same
    prints = lambda c: found.select(F.col("fp").alias(c), F.transform("fingerprint", lambda x: (x - (1 << 31)).cast("int")).alias(f"print_{c}"))

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y, o in zip(*(batch.column(c).to_pylist() for c in ("print_a", "print_b", "offset")), strict=True):
                x, y = np.array(x, np.int32).view(np.uint32), np.array(y, np.int32).view(np.uint32)
                s, e = max(0, o), min(len(x), len(y) + o)
                out.append(float(np.bitwise_count(x[s:e] ^ y[s - o : e - o]).sum() / (32 * (e - s))) if e - s >= min(WIDTH, len(x), len(y)) else 1.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "offset", "votes")), pa.array(out, pa.float64())], names=["a", "b", "offset", "votes", "bit_error"])

    compared = best.join(prints("a"), "a").join(prints("b"), "b").mapInArrow(errors, "a long, b long, offset int, votes long, bit_error double").where(F.col("bit_error") <= same)
    one = compared.groupBy("a", "b").agg(F.min(F.struct("bit_error", -F.col("votes"), F.abs("offset"), "offset")).alias("x"))
    out = written(one.select("a", "b", F.col("x.offset").cast("long").alias("offset"), F.col("x.bit_error").alias("bit_error")), "alike")
    dropped(best)
    return out


def match_recordings(media: DataFrame, id_col: str = "id", audio_col: str = "audio", asked: Column | None = None) -> DataFrame:
    """(id, n_items, fingerprint_sha256, class_id, n_alike, alike_id, alike_offset, alike_error): every recording; class_id is the
    smallest id of equal fingerprints, and for asked recordings (those of ids divisible by 20 unless said) n_alike counts the other
    classes of the same recording, the likest of which follows (the smallest id on a tie); null for those that are not asked."""
    spark = media.sparkSession
    small_batches(spark)
    asked = F.col("id") % 20 == 0 if asked is None else asked
    prints = fingerprint_audio(media, id_col, audio_col).withColumn("fp", F.sha2(F.array_join(F.transform("fingerprint", lambda x: x.cast("string")), ","), 256))
    prints = written(prints, "prints")
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("class_id"), F.max(F.coalesce(asked, F.lit(False))).alias("asked"), F.count(F.lit(1)).alias("n")), "classes")
    heads = prints.join(classes.select("fp", F.col("class_id").alias("id")), ["fp", "id"], "left_semi").dropDuplicates(["fp"]).where(F.size("fingerprint") > 0)
    # a class's number is its place among the written heads: an id may have several recordings
    heads = written(heads.select(F.monotonically_increasing_id().alias("no"), "fp", "id", "fingerprint"), "heads")
    found = alike(heads.select(F.col("no").alias("fp"), "fingerprint"), heads.join(classes.where("asked").select("fp"), "fp").select(F.col("no").alias("fp")))
    other = found.join(heads.select(F.col("no").alias("b"), F.col("id").alias("alike_id")), "b")
    best = other.groupBy("a").agg(F.count(F.lit(1)).alias("n_alike"), F.min(F.struct("bit_error", "alike_id", "offset")).alias("x")).join(heads.select(F.col("no").alias("a"), "fp"), "a")
    by_class = classes.join(best, "fp", "left").select("fp", "class_id", F.coalesce("n_alike", F.lit(0)).alias("n_alike"), "x")
    by_class = written(by_class, "matches")  # written, so that Spark can split a hot class
    is_asked = F.coalesce(asked, F.lit(False))
    out = prints.select("id", F.size("fingerprint").cast("long").alias("n_items"), "fp").join(by_class, "fp", "left")
    when = lambda c: F.when(is_asked, c)
    return out.select("id", "n_items", F.col("fp").alias("fingerprint_sha256"), "class_id", when(F.col("n_alike")).alias("n_alike"), when(F.col("x.alike_id")).alias("alike_id"), when(F.col("x.offset")).alias("alike_offset"), when(F.col("x.bit_error")).alias("alike_error"))


#: Second takes have the ids of their vectors and this.
TAKE = 1 << 40


def op6_chroma(spark, sf_dir):
    """Recordings of all embeddings and their second takes, matched: takes of the vectors whose ids are divisible by 20 are asked."""
    both = record_vectors(table(spark, sf_dir, "embeddings"))
    # audio is never written: a batch of it goes from the one task's function to the other
    takes = both.select(F.explode(F.array(F.struct(F.col("id").alias("vec_id"), F.lit(0).alias("take"), F.col("take").alias("audio")), F.struct(F.col("id").alias("vec_id"), F.lit(1).alias("take"), F.col("other").alias("audio")))).alias("x"))
    takes = takes.select((F.col("x.vec_id") + F.col("x.take") * TAKE).alias("id"), "x.audio")
    found = match_recordings(takes, asked=(F.col("id") % TAKE) % 20 == 0)
    return found.select((F.col("id") % TAKE).alias("vec_id"), F.floor(F.col("id") / TAKE).cast("long").alias("take"), "n_items", "fingerprint_sha256", "class_id", "n_alike", "alike_id", "alike_offset", "alike_error")
