"""Token ids in directly addressable files.

An id is split into chunks of eight bits. Level k of a file holds the k-th chunks of all ids that
have one, a bitmap that says which ids go on to the next level, and a rank directory with the number
of ones before every 512 bits. The position of an id on the next level is the rank of its bit, so any
id, or any run of ids, is read from a few places of each level and nothing else is decoded.

A token set is a folder that Spark writes: rows of one file each, with the ids of its documents and
where they start. Files follow each other in ascending ``doc_id``; a file ends at a document and holds
about a million ids. Every document ends with the end id. Spark's own writer is used, so the folder
can be in any store, and a lost task leaves no half file.

File: magic, number of levels and of ids; per level the number of chunks, the chunks, the bitmap in
whole 64-bit words, the directory of 32-bit counts. All numbers are little-endian.

Defined cases: a null or empty text is the end id alone; rows without a ``doc_id`` come first; rows
that repeat an id follow each other by the hash of their text.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtspark.llm.common import row_hash, small_batches, stage
from courtspark.llm.wordwise import Spelled, WordTable, encode_column, split_groups
from courtspark.sources.staging import staging_folder

MAGIC = b"DAC1"
BLOCK = 512
END = 0
#: Ids of a file, about; a longer document has a file of its own.
IDS_PER_FILE = 1_000_000
#: Every core has a task of its own, so the library needs no more threads.
THREADS = 1
#: New words that are encoded as one text.
GROUP = 256
_HEAD = struct.Struct("<4sIQ")
_COUNT = struct.Struct("<Q")


def write_file(ids: np.ndarray) -> bytes:
    """The file of a sequence of ids from 0 to 2^32 - 1."""
    rest = np.asarray(ids, np.uint32)
    levels = []
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.r_[bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)]
        ones = np.bitwise_count(bits.view("<u8")).reshape(-1, BLOCK // 64).sum(1) if len(bits) else np.zeros(0, np.int64)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        levels.append(_COUNT.pack(len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    return _HEAD.pack(MAGIC, len(levels), len(ids)) + b"".join(levels)


class TokenFile:
    """Random access to the ids of a file."""

    def __init__(self, data: bytes | memoryview):
        magic, levels, self.n = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at, self.levels = _HEAD.size, []
        for _ in range(levels):
            (n,) = _COUNT.unpack_from(data, at)
            blocks = -(-n // BLOCK)
            at += _COUNT.size
            parts = []
            for kind, count in ((np.uint8, n), (np.uint8, blocks * BLOCK // 8), ("<u4", blocks)):
                parts.append(np.frombuffer(data, kind, count, at))
                at += parts[-1].nbytes
            self.levels.append(parts)

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, at: int) -> int:
        """Ones before a position."""
        _, bits, ranks = self.levels[level]
        block = at // BLOCK
        if block == len(ranks):  # the end
            block -= 1
        if block < 0:
            return 0
        begin = block * BLOCK // 8
        whole, odd = bits[begin : at // 8], at % 8
        part = int(bits[at // 8]) & ((1 << odd) - 1) if odd else 0
        return int(ranks[block]) + int(np.bitwise_count(whole).sum()) + part.bit_count()

    def __getitem__(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[at]) << (8 * level)
            if not bits[at // 8] >> (at % 8) & 1:
                break
            at = self._rank(level, at)
        return value

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, without those before or after."""
        here = None  # every place
        for level, (chunks, bits, _) in enumerate(self.levels):
            part = chunks[start:stop].astype(np.uint32)
            if here is None:
                out = part
            else:
                out[here] |= part << np.uint32(8 * level)
            first = start // 8
            more = np.unpackbits(bits[first : -(-stop // 8)], bitorder="little")[start - 8 * first :][: stop - start].view(bool)
            here = np.flatnonzero(more) if here is None else here[more]
            if not len(here):
                break
            start = self._rank(level, start)
            stop = start + len(here)
        return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def _tokenizer(path: str):
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Stands before the first word of a text; words are cut at spaces, so none holds one.
_FIRST = " "


_ODD = re.compile(r"\s\s|<\|")


def _parts(word: str) -> bool:
    """The spaces beside this word stand alone between two characters that are no white space, so that
    the pre-tokeniser cuts before them; and no special token can begin in it."""
    return word != "" and not _ODD.search(f" {word} ")


class Encoder:
    """Ids of texts with a byte-level tokenizer of the tokenizers library."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        pieces = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.starts = np.array([p.startswith("Ġ") for p in pieces])
        self.table = WordTable(self._words)

    def _encode(self, texts: list[str]):
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)], [True] * len(texts)

    def _words(self, words: list[str]) -> Spelled:
        first = [w for w in words if w[:1] == _FIRST]
        later = [w for w in words if w[:1] != _FIRST] if first else words
        safe, odd = later, []
        if _ODD.search(f" {' '.join(later)} "):
            safe, odd = [w for w in later if _parts(w)], [w for w in later if not _parts(w)]
        starts = Spelled.of(first, self._encode([w[1:] for w in first])[0], [_parts(w[1:]) for w in first])
        return Spelled.join([split_groups(safe, self._encode, self.starts, " ", GROUP), starts, Spelled.of(odd, [[]] * len(odd), [False] * len(odd))])

    def _whole(self, text: str):
        return self._encode([text])[0][0], True

    def texts(self, texts: list[str | None] | pa.Array):
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        return encode_column(column, self.table, self._whole, _FIRST)


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    """Kept by the worker, with its words, from task to task."""
    return Encoder(path)


_FILE = "part long, seq long, start long, n_ids long, doc_ids array<bigint>, sizes array<bigint>, file binary"


def _files(path: str | None, end: int, per_file: int):
    """One row per file; start counts the ids of the task's files before it."""

    def run(batches):
        encoder, part = _encoder(path or default_tokenizer()), TaskContext.get().partitionId()
        held, names, sizes, waiting, seq, start, last = [], [], [], 0, 0, 0, np.array([end], np.int64)

        def out():
            nonlocal held, names, sizes, waiting, seq, start
            ids = np.concatenate(held)
            row = {"part": part, "seq": seq, "start": start, "n_ids": len(ids), "doc_ids": names, "sizes": sizes, "file": write_file(ids)}
            held, names, sizes, waiting, seq, start = [], [], [], 0, seq + 1, start + len(ids)
            return pa.RecordBatch.from_pylist([row], schema=schema)

        i64 = pa.int64()
        schema = pa.schema([("part", i64), ("seq", i64), ("start", i64), ("n_ids", i64), ("doc_ids", pa.list_(i64)), ("sizes", pa.list_(i64)), ("file", pa.binary())])
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc, got in zip(ids, encoder.texts(batch.column("text")), strict=True):
                held += (got, last)
                sizes.append(len(got) + 1)
                names.append(doc)
                waiting += len(got) + 1
                if waiting >= per_file:
                    yield out()
        if held:
            yield out()

    return run


def write_tokens(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END, per_file: int = IDS_PER_FILE) -> None:
    """Writes the token set of ``docs`` in ascending order of the id."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", row_hash(F.col("text")))
    rows.mapInArrow(_files(tokenizer, end, per_file), _FILE).write.parquet(folder)


def _digest(batches):
    for batch in batches:
        docs, starts, sizes, sums = [], [], [], []
        for row in range(batch.num_rows):
            file = TokenFile(batch.column("file")[row].as_buffer())
            base, n = batch.column("start")[row].as_py(), np.array(batch.column("sizes")[row].as_py(), np.int64)
            ends = np.cumsum(n)
            ids = memoryview(file.read(0, len(file)).astype("<u4")).cast("B")
            docs += batch.column("doc_ids")[row].as_py()
            starts += (base + ends - n).tolist()
            sizes += n.tolist()
            sums += [zlib.crc32(ids[4 * (b - k) : 4 * b]) for k, b in zip(n.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, sizes, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """The files, with ``start`` counting all ids before the file. One row per task is summed up."""
    files = spark.read.parquet(folder)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.join(stage(parts.select("part", before.alias("before")), "parts"), "part").withColumn("start", F.col("start") + F.col("before"))


def read_digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files."""
    return _placed(spark, folder).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _ids(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            file = TokenFile(batch.column("file")[row].as_buffer())
            sizes = batch.column("sizes")[row].as_py()
            ends = np.r_[0, np.cumsum(sizes)]
            ids = [file.read(a, b).tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("doc_ids")[row].as_py(), pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids, with the end id."""
    return spark.read.parquet(folder).mapInArrow(_ids, "doc_id long, ids array<bigint>")


def token_digest(docs: DataFrame, **options) -> DataFrame:
    """Writes a token set into the shared folder and reads its digest back."""
    spark = docs.sparkSession
    folder = f"{staging_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, **options)
    return read_digest(spark, folder)
