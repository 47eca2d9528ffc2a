"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read here, field by field: pieces with scores and kinds, the trainer's model type and byte fallback,
the normaliser's flags. From it comes a tokenizer of the tokenizers library: the word-start marker for spaces, unigram scores
for a unigram model or merges derived from scores for a BPE model, byte fallback, and the decoder that undoes them.

Where no piece has a marker behind another character, and none a line feed, merges never cross the place before a space or
around a line feed, so a text's ids are those of its chunks one after the other; each different chunk is encoded once and kept,
and its ids are held against the sentencepiece library's. Otherwise texts are encoded whole.

Defined cases: a null text counts as empty; an empty one has no ids and decodes to itself; repeated rows are encoded each for
itself; an empty table gives an empty result; further columns are ignored. A text in which a model's normaliser changes
characters does not decode to itself, and its ``round_trip`` says so.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import id_text, small_batches, table

MARK = "▁"
CACHE_ENTRIES = 500_000
#: Chunks: a word with the spaces before it; spaces before a line feed or the end; a line feed.
CHUNKS = re.compile(r" *[^ \n]+| +|\n")


@dataclass
class PieceModel:
    """What the protobuf says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # piece, score, kind: 1 normal, 2 unknown, 3 control, 4 user, 6 byte
    unigram: bool = True
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unk_id(self) -> int | None:
        return next((k for k, p in enumerate(self.pieces) if p[2] == 2), None)

    @property
    def chunked(self) -> bool:
        """Whether texts may be encoded chunk by chunk."""
        plain = all(MARK not in p.lstrip(MARK) and "\n" not in p for p, _, kind in self.pieces if kind in (1, 4))
        return plain and self.dummy_prefix and self.escape and not self.squeeze and not self.charsmap and not self.unigram


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields; 32-bit ones as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


def read_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        raw = f.read()
    m = PieceModel()
    for number, value in fields(raw):
        if number == 1:
            own = dict(fields(value))
            m.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, 1)))
        elif number == 2:
            own = dict(fields(value))
            m.unigram, m.byte_fallback = own.get(3, 1) == 1, bool(own.get(35, 0))
        elif number == 3:
            own = dict(fields(value))
            m.charsmap, m.dummy_prefix, m.squeeze, m.escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
    return m


def build(m: PieceModel):
    """The tokenizer of the tokenizers library."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if m.unigram:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback)
    else:
        ids = {p: k for k, (p, _, _) in enumerate(m.pieces)}
        usable = {p for p, _, kind in m.pieces if kind in (1, 4)}
        merges = []
        for p, score, kind in m.pieces:
            if kind == 1:
                merges += [(-score, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        merges.sort()
        core = models.BPE(ids, [(a, b) for *_, a, b in merges], unk_token=m.pieces[m.unk_id][0] if m.unk_id is not None else None, fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix and not m.chunked:
        steps.append(normalizers.Prepend(MARK))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    tail = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return t


class Codec:
    """A worker's tokenizer, the library it is held against, and the chunks it has met."""

    def __init__(self, path: str, threads: int = 1) -> None:
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true" if threads > 1 else "false", str(threads)
        self.model, self.threads = read_model(path), threads
        self.backend, self.judge = build(self.model), sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, bytes] = {}
        self.differ: set[str] = set()
        lead = self.judge.encode("\n") if self.model.chunked else []
        self.lead = len(lead)

    def _learn(self, new: list[str]) -> None:
        got = [e.ids for e in self.backend.encode_batch_fast(new, add_special_tokens=False)]
        # the library marks the start of what it is given: that stands for a chunk's first space, or is cut off with a line feed
        want = self.judge.encode([c[1:] + "\n" if c[0] == " " else "\n" + c for c in new], num_threads=self.threads)
        for c, a, b in zip(new, got, want, strict=True):
            self.known[c] = np.array(a, "<u4").tobytes()
            if a != (b[: 1 - self.lead] if c[0] == " " else b[self.lead :]):
                self.differ.add(c)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether the sentencepiece library gives the same."""
        if not self.model.chunked:
            ids = [e.ids for e in self.backend.encode_batch_fast(texts, add_special_tokens=False)]
            want = self.judge.encode(texts, num_threads=self.threads)
            return [np.array(a, "<u4") for a in ids], [a == b for a, b in zip(ids, want, strict=True)]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
            self.differ.clear()
        split = [CHUNKS.findall(" " + t) if t else [] for t in texts]
        new = list(set().union(*map(set, split)).difference(self.known)) if split else []
        for k in range(0, len(new), 20_000):
            self._learn(new[k : k + 20_000])
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, own)), "<u4") for own in split], [not self.differ or self.differ.isdisjoint(own) for own in split]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.backend.decode_batch([a.tolist() for a in ids], skip_special_tokens=False)


_codecs: dict[tuple[str, int], Codec] = {}


def codec(path: str, threads: int = 1) -> Codec:
    if (path, threads) not in _codecs:
        _codecs[path, threads] = Codec(path, threads)
    return _codecs[path, threads]


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, ids (array<int>, optional), n_tokens, ids_crc32, decoded_sha256, round_trip, parity of every whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    path, threads = model_path or default_model_path(), int(spark.conf.get("spark.task.cpus", "1"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            own = codec(path, threads)
            ids, parity = own.encode(texts)
            back = own.decode(ids)
            out = pdf[["doc_id"]].assign(
                n_tokens=[len(a) for a in ids], ids_crc32=[zlib.crc32(a.tobytes()) for a in ids], decoded_sha256=[hashlib.sha256(t.encode()).hexdigest() for t in back],
                round_trip=[a == b for a, b in zip(back, texts, strict=True)], parity=parity,
            )
            yield out.assign(ids=[a.astype("int32") for a in ids]) if with_ids else out

    return id_text(docs, id_col, text_col).mapInPandas(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean, parity boolean" + (", ids array<int>" if with_ids else ""))


def decode_pieces(encoded: DataFrame, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of its ids; null ids give an empty text."""
    path, threads = model_path or default_model_path(), int(encoded.sparkSession.conf.get("spark.task.cpus", "1"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": codec(path, threads).decode([np.array([] if a is None else a, "<u4") for a in pdf["ids"]])})

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInPandas(run, "doc_id long, text string")


def op4_pieces(spark, sf_dir):
    return encode_pieces(table(spark, sf_dir, "documents"), with_ids=False)
