import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from courtspark.llm import token_files as T
from courtspark.llm import wordwise


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_any_id_and_any_run(ids):
    file = T.TokenFile(T.write_file(np.array(ids, np.uint32)))
    assert len(file) == len(ids) and file.read(0, len(ids)).tolist() == ids
    for at in range(0, len(ids), 7):
        assert file[at] == ids[at] and file.read(at, min(len(ids), at + 9)).tolist() == ids[at : at + 9]
    with pytest.raises(IndexError):
        file[len(ids)]
    with pytest.raises(ValueError):
        T.TokenFile(b"\0" * 16)


TEXTS = ["", " lead", "trail ", "a  b", "tab\t x", "new\n line", "it's 's <|endoftext|> x", "nbsp  x", "wide　 x", "\x00 a", "日本 語 text", "\U0001f600 a b", "plain words and more, words."]


def test_words_and_whole_texts_agree():
    encoder = T._encoder(T.default_tokenizer())
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert [x.tolist() for x in encoder.texts(TEXTS * 2)] == want * 2
    assert [x.tolist() for x in encoder.texts([None])] == [[]]


def test_a_word_is_looked_up_once_per_batch():
    class Counted(wordwise._Codes):
        asked = 0

        def __getitem__(self, word):
            Counted.asked += 1
            return super().__getitem__(word)

    table = wordwise.WordTable(lambda words: wordwise.Spelled.of(words, [[len(w)] for w in words], [True] * len(words)))
    table.code = Counted()
    codes = table.codes(["a", "bb", " bb"] * 500)
    assert table.spell(codes)[0].tolist() == [1, 2, 3] * 500 and Counted.asked <= 6
    assert table.spell(table.codes(["bb", "\ud800x", "a"]))[0].tolist() == [2, 2, 1]


def test_round_trip(spark, odd_documents, tmp_path):
    docs = odd_documents.select("doc_id", "text", "n", "part")
    encoder = T._encoder(T.default_tokenizer())
    folder = str(tmp_path / "tokens")
    T.write_tokens(docs, folder, per_file=40)
    got = T.read_digest(spark, folder).collect()
    want = {}
    for r in docs.collect():
        ids = [*next(iter(encoder.texts([r.text]))).tolist(), 0]
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x))
    back = {r.doc_id: r.ids for r in T.read_tokens(spark, folder).collect()}
    assert encoder.tokenizer.decode(back[7][:-1]) == "ünïcode 漢字 \U0001f600 text" and back[1] == [0]
    assert T.token_digest(docs.limit(0)).count() == 0
