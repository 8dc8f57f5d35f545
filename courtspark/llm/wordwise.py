"""Token ids of texts, put together from the ids of their words.

Where a tokenizer never joins anything across a single space, the ids of a text are the ids of its
words in order. Natural texts repeat their words, so each distinct word is encoded once and kept in
a table that is emptied when it gets large. Texts for which a space may not part tokens are encoded
as they are. The caller says which texts these are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words and ids that a table holds at most, and words that are put together at once.
MAX_WORDS, MAX_IDS, TOGETHER = 600_000, 6_000_000, 1_000_000
#: New words that are encoded as one text.
GROUP = 64


class Spelled(NamedTuple):
    """Words, all their ids in a row, the number of ids of each word, and whether all is well with it."""

    words: list[str]
    ids: np.ndarray
    sizes: np.ndarray
    fine: np.ndarray

    @classmethod
    def of(cls, words: list[str], ids: list, fine: list[bool]) -> Spelled:
        return cls(words, np.fromiter(chain.from_iterable(ids), np.int32), np.array([len(x) for x in ids], np.int64), np.array(fine, bool))

    @classmethod
    def join(cls, parts: list[Spelled]) -> Spelled:
        none = cls([], np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool))
        words, *rest = zip(none, *parts, strict=True)
        return cls(list(chain.from_iterable(words)), *map(np.concatenate, rest))


def split_groups(words: list[str], encode: Callable, starts: np.ndarray, before: str = "", size: int = GROUP) -> Spelled:
    """Words encoded in groups joined by a space, and cut where an id begins a word (``starts``, by
    id). A group that is not well, or does not fall into its words, goes word by word."""
    groups = [words[i : i + size] for i in range(0, len(words), size)]
    parts = []
    for group, got, ok in zip(groups, *encode([before + " ".join(g) for g in groups]), strict=True):
        got = np.array(got, np.int32)
        cut = starts[got]
        cut[:1] = True
        cuts = np.flatnonzero(cut)
        if ok and len(cuts) == len(group):
            parts.append(Spelled(group, got, np.diff(cuts, append=len(got)), np.ones(len(group), bool)))
        else:
            parts.append(Spelled.of(group, *encode([before + w for w in group])))
    return Spelled.join(parts)


class _Codes(dict):
    """A number for every word; new words are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code


class WordTable:
    """``encode`` spells a list of words, in any order."""

    def __init__(self, encode: Callable[[list[str]], Spelled]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.code = _Codes()
        self.ids = np.zeros(0, np.int32)
        self.start, self.length, self.fine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def codes(self, words: list[str] | pa.Array) -> np.ndarray:
        if len(self.code) > MAX_WORDS or len(self.ids) > MAX_IDS:
            self.clear()
        number = self.code.__getitem__
        try:  # repeats are found by Arrow, so that each distinct word is looked up once
            once = (words if isinstance(words, pa.Array) else pa.array(words, pa.large_string())).dictionary_encode()
            distinct = once.dictionary.to_numpy(zero_copy_only=False).tolist()
            codes = np.fromiter(map(number, distinct), np.int64, len(distinct))[once.indices.to_numpy()]
        except UnicodeEncodeError:  # lone surrogates
            codes = np.fromiter(map(number, words), np.int64, len(words))
        new, self.code.new = self.code.new, []
        if new:
            got = self.encode(new)
            at = slice(len(self.start), None) if got.words == new else np.fromiter(map(number, got.words), np.int64, len(new))
            self.start, self.length, self.fine = (np.r_[x, np.zeros(len(new), x.dtype)] for x in (self.start, self.length, self.fine))
            self.start[at] = len(self.ids) + np.cumsum(got.sizes) - got.sizes
            self.length[at], self.fine[at] = got.sizes, got.fine
            self.ids = np.r_[self.ids, got.ids]
        return codes

    def spell(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of ids of each word."""
        length = self.length[codes]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.start[codes] - ends + length, length)
        return self.ids[at], length


def encode_texts(texts: list[str | None], by_words: Callable[[str], bool] | None, table: WordTable, whole: Callable, first: str = "") -> Iterator[tuple[np.ndarray, bool]]:
    """Ids and flag of every text, in order; a null text has none. Without ``by_words`` a text goes by
    words if all is well with each of them, and else as a whole. ``first`` marks a text's first word
    for the table, where the words after a space have other ids; a space is in no word."""
    held: list[str | list[str]] = []
    waiting = 0

    def out():
        words = [w for x in held if isinstance(x, list) for w in x]
        codes = table.codes(words)
        ids, length = table.spell(codes)
        fine = table.fine[codes]
        ends = np.r_[0, np.cumsum(length)]
        at = 0
        for x in held:
            if not isinstance(x, list):
                got, ok = whole(x)
                yield np.asarray(got, np.int32), ok
                continue
            ok = bool(fine[at : at + len(x)].all())
            if ok or by_words:
                yield ids[ends[at] : ends[at + len(x)]], ok
            else:
                got, ok = whole(" ".join(x)[len(first) :])
                yield np.asarray(got, np.int32), ok
            at += len(x)

    for text in texts:
        parts = text or ""
        if text and (by_words is None or by_words(text)):
            parts = text.split(" ")
            parts[0] = first + parts[0]
        held.append(parts)
        waiting += len(held[-1]) if isinstance(held[-1], list) else 0
        if waiting > TOGETHER:
            yield from out()
            held, waiting = [], 0
    yield from out()


def encode_column(texts: pa.Array, table: WordTable, whole: Callable, first: str) -> Iterator[np.ndarray]:
    """Ids of every text of a column, in order, as ``encode_texts`` without ``by_words`` gives them. The words are
    cut by Arrow."""
    texts = texts.cast(pa.large_string())
    sizes = pc.fill_null(pc.add(pc.count_substring(texts, " "), 1), 0).to_numpy(zero_copy_only=False)
    together = np.cumsum(sizes) // TOGETHER
    cuts = np.r_[np.flatnonzero(np.r_[True, together[1:] != together[:-1]]), len(texts)] if len(texts) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield from _encode_part(texts.slice(a, b - a), sizes[a:b], table, whole, first)


def _encode_part(texts: pa.Array, sizes: np.ndarray, table: WordTable, whole: Callable, first: str) -> Iterator[np.ndarray]:
    ends = np.r_[0, np.cumsum(sizes)]
    words = pc.split_pattern(texts, " ").flatten()
    begins = np.zeros(len(words), bool)
    begins[ends[:-1][sizes > 0]] = True
    # one call for all words: the table may be emptied between two calls
    marked = pc.binary_join_element_wise(pa.scalar(first, pa.large_string()), words.filter(pa.array(begins)), pa.scalar("", pa.large_string()))
    codes = table.codes(pa.chunked_array([marked, words.filter(pa.array(~begins))]).combine_chunks())
    here = np.empty(len(words), np.int64)
    here[begins], here[~begins] = codes[: len(marked)], codes[len(marked) :]
    ids, length = table.spell(here)
    at = np.r_[0, np.cumsum(length)][ends]
    fails = np.r_[0, np.cumsum(~table.fine[here])][ends]
    for row in range(len(texts)):
        if fails[row + 1] > fails[row]:
            got, _ = whole(texts[row].as_py())
            yield np.asarray(got, np.int32)
        else:
            yield ids[at[row] : at[row + 1]]
