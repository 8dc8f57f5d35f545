"""Encoding and decoding with a SentencePiece model on the tokenizers library.

The model file is parsed as a protobuf message: pieces with scores and types, the trainer's model
type and byte fallback, the normaliser's table and white-space rules. From these the tokenizers
library gets a normaliser, the metaspace marker, a unigram model with its scores or a pair-merging
model with merges in the order of the scores, byte fallback and the matching decoder. Every word, and
every text that is encoded whole, is also encoded by the SentencePiece library, and decoded: the
column ``verified`` says whether the ids agree and decoding gives the text back.

Defined cases: a null or empty text has no ids, agrees and comes back as the empty text. With a
normaliser that changes the text, the round trip compares with the normalised text.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.llm.common import handing_back, row_hash, small_batches
from courtspark.llm.wordwise import WordTable, encode_texts, split_groups

MARK = "▁"
# Piece types and model types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
THREADS = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        if kind not in (1, 2, 5):
            raise ValueError(f"unknown wire type {kind}")
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass(frozen=True)
class PieceModel:
    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    trim_spaces: bool

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def words_part(self) -> bool:
        """No piece goes on over a single space, and words are normalised on their own."""
        return self.dummy_prefix and not self.charsmap and all(MARK not in p[1:] or not p.strip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))


def read_model(data: bytes) -> PieceModel:
    pieces, trainer, normaliser = [], {}, {}
    for field, value in _fields(data):
        if field == 1:
            part = dict(_fields(value))
            pieces.append((part.get(1, b"").decode(), struct.unpack("<f", part[2])[0] if 2 in part else 0.0, part.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normaliser = dict(_fields(value))
    return PieceModel(
        tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
    )


def _merges(pieces: tuple) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece: best score first, as in the model."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, score, kind in pieces:
        if kind in (NORMAL, USER):
            halves = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
            found += [(-score, ids[a], ids[b], a, b) for a, b in halves]
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: PieceModel):
    """The same model in the tokenizers library."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    elif model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, _merges(model.pieces), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and pair-merging models are known")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    ends = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    user = [AddedToken(p, normalized=False, special=False) for p, _, kind in model.pieces if kind == USER]
    if user:
        tokenizer.add_tokens(user)
    return tokenizer


class Codec:
    """Encodes and decodes batches; ids agree with the SentencePiece library or are flagged."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = read_model(data)
        self.tokenizer = build(self.model)
        self.peer = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = np.array([kind == BYTE for *_, kind in self.model.pieces])
        self.starts = np.array([p.startswith(MARK) for p, *_ in self.model.pieces])
        self.table = WordTable(lambda words: split_groups(words, self.encode, self.starts))
        self.plain = not self.model.charsmap and not self.model.trim_spaces

    def _normal(self, text: str) -> str:
        return text if self.plain else self.peer.normalize(text).replace(MARK, " ")[1 if self.model.dummy_prefix else 0 :]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of every text, and whether they agree and come back."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        peer = self.peer.encode(texts, num_threads=THREADS)
        back = self.decode(ids)
        return ids, [a == b and c == self._normal(t).replace(MARK, " ") for a, b, c, t in zip(ids, peer, back, texts, strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


@lru_cache(2)
def _codec(path: str) -> Codec:
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    with open(path, "rb") as f:
        return Codec(f.read())


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _encode(path: str | None):
    def run(batches):
        codec = _codec(path or default_model())

        def whole(text: str):
            ids, fine = codec.encode([text])
            return ids[0], fine[0]

        table, apart = codec.table, codec.model.words_part

        def by_words(text: str) -> bool:
            return apart and "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text

        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = list(encode_texts(texts, by_words, table, whole))
            sizes = np.array([len(x) for x, _ in found], np.int64)
            ids = np.concatenate([np.zeros(0, np.int32), *(x for x, _ in found)])
            column = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids))
            flags = [codec.bytes[x] for x, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_hash"),
                    column,
                    pa.array(sizes),
                    pa.array([int(f.sum()) for f in flags], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x, _ in found], pa.int64()),
                    pa.array([ok for _, ok in found], pa.bool_()),
                ],
                names=["doc_id", "row_hash", "ids", "n_tokens", "n_bytes", "ids_crc32", "verified"],
            )

    return handing_back(run, lambda: _codec(path or default_model()).table.clear())


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row per document: doc_id, row_hash, ids, n_tokens, n_bytes (ids of single bytes),
    ids_crc32 (of the ids as little-endian 32-bit numbers) and verified (parity and round trip).
    ``model`` is the path of a model file that every executor can open; the default is the public one."""
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row_hash", row_hash(F.col("text")))
    kind = "doc_id long, row_hash long, ids array<int>, n_tokens long, n_bytes long, ids_crc32 long, verified boolean"
    return texts.mapInArrow(_encode(model), kind)


def _decode(path: str | None):
    def run(batches):
        codec = _codec(path or default_model())
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codec.decode([x or [] for x in ids]), pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id and text; null ids give the empty text."""
    rows = small_batches(encoded).select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(model), "doc_id long, text string")
