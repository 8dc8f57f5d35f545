import zlib

import numpy as np
import pyarrow as pa
import sentencepiece

from courtspark.llm import pieces as P

TEXTS = ["", " ", "  a  b ", "a\nb", "\ta <s> </s> <unk> <0x0A> ▁x", "日本語 ñandú \U0001f600", "x x x ", " lead", "it is. And it was! 12,5 %", "\x00\x01"]


def test_agrees_with_the_model():
    codec = P._codec(P.default_model())
    ids, fine = codec.encode(TEXTS)
    assert all(fine)
    peer = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    assert ids == [peer.encode(t) for t in TEXTS]


def field(number, value):
    if isinstance(value, int):
        return bytes([number << 3 & 127 | (0x80 if number > 15 else 0)] + ([number >> 4] if number > 15 else []) + [value])
    return bytes([number << 3 | 2, len(value)]) + value


def test_reads_a_unigram_model():
    def piece(text, score, kind=1):
        return field(1, field(1, text.encode()) + bytes([2 << 3 | 5]) + np.float32(score).tobytes() + field(3, kind))

    parts = [piece("<unk>", 0, 2), *[piece(f"<0x{b:02X}>", 0, 6) for b in range(256)], piece("▁", -3), piece("▁ab", -1), piece("a", -4), piece("b", -4.5), piece("c", -5), piece("bc", -2)]
    data = b"".join(parts) + field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0))
    model = P.read_model(data)
    assert model.kind == P.UNIGRAM and model.byte_fallback and model.words_part and len(model.pieces) == 263
    codec = P.Codec(data)
    texts = ["abc", "ab ab", "cab", "é", "a  b"]
    ids, fine = codec.encode(texts)
    assert all(fine) and ids[1] == [258, 258]


def test_documents(spark, odd_documents):
    peer = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    got = P.encode(odd_documents).collect()
    want = sorted((r.doc_id or -1, peer.encode(r.text or "")) for r in odd_documents.collect())
    assert sorted((r.doc_id or -1, r.ids) for r in got) == want
    for r in got:
        assert r.verified and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    back = {r.doc_id: r.text for r in P.decode(P.encode(odd_documents)).collect()}
    assert back[7] == "ünïcode 漢字 \U0001f600 text" and back[1] == "" and back[5].endswith("long end")
    assert P.encode(odd_documents.limit(0)).count() == 0


def test_a_task_leaves_no_words_behind():
    batch = pa.record_batch({"doc_id": [1], "text": ["some words of a text"], "row_hash": [2]})
    assert [x.column("verified").to_pylist() for x in P._encode(None)(iter([batch]))] == [[True]]
    table = P._codec(P.default_model()).table
    assert not table.code and not len(table.ids)
