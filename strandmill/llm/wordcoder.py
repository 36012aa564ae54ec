"""Exact encoding of words with a public BPE tokenizer, on an executor.

The tokenizer drops white space and never lets a match cross it, so a text's ids are the ids of its white-space
words in order. Two things break that rule and go to the library as a whole text: the separators U+001C to U+001F
(white space for Python, ordinary characters for the tokenizer) and words with special strings next to nothing else
are safe, since those hold no white space.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

ODD = re.compile("[\x1c-\x1f]")
#: Printable Latin without what \d, \w and \p{N}, \p{L} class apart (ª º ² ³ ¹ ¼ ½ ¾), the soft hyphen, and İ.
_LATIN = re.compile("[!-~¡-©«¬®-±´-¸»¿-įı-ſ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w]|_)+")


def split_words(text: str) -> list[str]:
    """White-space words; a text that holds odd separators is one word, which the library encodes whole."""
    return [text] if ODD.search(text) else text.split()


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Slots(dict):
    """word -> slot, encoding what is missing."""

    def __init__(self, coder: WordCoder):
        super().__init__()
        self.coder = coder

    def __missing__(self, word: str) -> int:
        coder = self.coder
        ids = coder.word(word)
        slot = self[word] = len(coder.starts)
        coder.starts.append(len(coder.flat))
        coder.lengths.append(len(ids))
        coder.flat.extend(ids)
        return slot


class WordCoder:
    """Encodes each distinct word once and whole columns of texts by position, on an executor.

    Words live in slots; `starts` and `lengths` say where a slot's ids are in `flat`. A worker keeps at most `entries`
    words and starts anew beyond that."""

    def __init__(self, tokenizer_json: str, entries: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65_536 else np.dtype("<u4")
        self.model, self.bytes, self.entries = self.tokenizer.model, _byte_chars(), entries
        self.pieces: dict[str, list[int]] = {}
        if resize := getattr(self.model, "_resize_cache", None):
            resize(0)  # the library's own memo only costs here: each word comes once
        self.forget()

    def forget(self) -> None:
        self.slot_of = _Slots(self)
        self.starts, self.lengths, self.flat = array("q"), array("i"), array("H" if self.dtype.itemsize == 2 else "I")

    def letters(self, piece: str) -> list[int]:
        shown = piece if piece.isascii() else "".join(map(self.bytes.__getitem__, piece.encode()))
        return [t.id for t in self.model.tokenize(shown)]

    def piece(self, piece: str) -> list[int]:
        got = self.pieces.get(piece)
        if got is None:
            if len(self.pieces) > 100_000:
                self.pieces.clear()
            got = self.pieces[piece] = self.letters(piece)
        return got

    def word(self, word: str) -> list[int]:
        """Plain Latin words go through the model piece by piece, all else through the whole library."""
        if len(word) < 200:
            if word.isascii() and word.isalpha():
                return [t.id for t in self.model.tokenize(word.lower())]
            if _LATIN.fullmatch(word) and "<|" not in word:
                word = word.lower()
                return self.letters(word) if word.isalpha() else [i for p in _PIECES.findall(word) for i in (self.letters(p) if len(p) > 4 else self.piece(p))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def slots(self, words: list[str]) -> np.ndarray:
        """The slot of each word; new words are encoded. Slots hold until the next call."""
        if len(self.slot_of) + len(words) > self.entries:
            self.forget()
        return np.fromiter(map(self.slot_of.__getitem__, words), dtype=np.int64, count=len(words))

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the words one after another, and how many each has."""
        slots = self.slots(words)
        n = np.frombuffer(self.lengths, np.int32)[slots] if len(slots) else np.zeros(0, np.int32)
        return ragged(np.frombuffer(self.flat, self.dtype), np.frombuffer(self.starts, np.int64)[slots] if len(slots) else slots, n), n

    def column(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an Arrow column one after another, and how many each has; null texts have none."""
        words, docs = words_of(texts)
        distinct = words.dictionary_encode()
        flat, n = self.table(distinct.dictionary.to_pylist())
        at = distinct.indices.to_numpy(zero_copy_only=False)
        many = n[at]
        ends = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
        return ragged(flat, (np.cumsum(n, dtype=np.int64) - n)[at], many), np.diff(ends[docs])


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length] one after another."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    at = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return flat[at]


def words_of(texts) -> tuple:
    """The white-space words of an Arrow column of texts, and where each text's words begin (and the last one's end)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.fill_null("")
    if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
        lists = [split_words(t) for t in texts.to_pylist()]
        return pa.array([w for x in lists for w in x], pa.string()), np.cumsum([0, *map(len, lists)])
    lists = pc.utf8_split_whitespace(texts)
    return lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])


def parts_of(texts, most: int):
    """(from, to) of runs of rows with about `most` bytes of text each."""
    import pyarrow.compute as pc

    part = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) // most
    cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), len(part)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


_coders: dict[int, WordCoder] = {}


def coder_of(tokenizer_json: str) -> WordCoder:
    """One coder for each tokenizer and Python worker."""
    key = hash(tokenizer_json)
    if key not in _coders:
        _coders.clear()
        _coders[key] = WordCoder(tokenizer_json)
    return _coders[key]


def pieces_of(tokenizer_json: str) -> list[str]:
    """The piece of each id; the size is fixed by the tokenizer's file."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_json)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]


def tokenizer_json(name_or_path: str) -> str:
    """The text of a tokenizer's file: a path, or the name of one of the public files."""
    import os

    if not os.path.exists(name_or_path):
        import public_tokenizers

        name_or_path = public_tokenizers.path(name_or_path)
    with open(name_or_path, encoding="utf-8") as f:
        return f.read()
