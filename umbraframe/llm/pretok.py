"""Splitting texts into pre-tokens and encoding each distinct one once.

A tokenizer that merges inside pre-tokens gives the same ids for a pre-token wherever it stands. So a text is
split by the tokenizer's own pattern, each new pre-token goes to an ``encode_new`` function in batches, and a
bounded table keeps what has been encoded. Texts whose characters are all of ``SAFE`` split by an equivalent
pattern of the faster ``re`` module; others take ``split_any`` or are handed over whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np

#: ASCII without control characters but white space, and Latin letters on whose classes all engines agree.
SAFE = re.compile("[\\t-\\r\\x20-\\x7e¡«»¿À-ÖØ-öø-ž]*")
#: The byte-level pattern for the ``regex`` module, and its equal in ``re`` for safe texts.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_LEVEL_SAFE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: The word pattern (in lower case; white space dropped), for safe texts.
WORDS_SAFE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 as it is, the others from U+0100 on in order.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = {b: b for b in _PLAIN} | {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}
#: Marks a piece at the start of a text, which has no white space before it; no safe text holds it.
HEAD = "\x02"
#: A space or line feed with more white space beside it, or other white space: then pieces depend on each other.
UNEVEN = re.compile(r"[\x20\n]\s|[\t\v\f\r]|\s\Z")


def safe(text: str) -> bool:
    return SAFE.fullmatch(text) is not None


def byte_level_pieces(text: str) -> list[str] | None:
    """The text cut before each space and line feed, where no pre-token crosses such a cut; else None.

    Single white space always starts a new pre-token: a space joins what follows, a line feed stands alone.
    Pieces come without their space; :func:`whole_piece` puts it back.
    """
    if UNEVEN.search(text):
        return None
    pieces = text.replace("\n", " \n").split(" ")
    if pieces[0]:
        pieces[0] = HEAD + pieces[0]
        return pieces
    return pieces[1:]


def whole_piece(piece: str) -> str:
    """The part of the text that a piece stands for: its ids do not depend on its place."""
    return piece[1:] if piece[0] == HEAD else piece if piece[0] == "\n" else " " + piece


def word_pieces(text: str) -> list[str]:
    return text.lower().split()


class _Slots(dict):
    """word -> slot; a new word gets the next slot and waits in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        slot = self[word] = len(self)
        self.new.append(word)
        return slot


class Memo:
    """Ids of pre-tokens, by slot. encode_new(words) gives how many ids each has, and all ids. Where it holds over ``most`` words or ``most_ids`` ids, only those used again stay, half of either at most."""

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 300_000, most_ids: int = 3_000_000):
        self.encode_new, self.most, self.most_ids = encode_new, most, most_ids
        self.slots, self.ids, self.starts, self.counts, self.uses = _Slots(), array("I"), array("q"), array("q"), np.zeros(0, np.int64)

    def shrink(self) -> None:
        starts, counts = np.array(self.starts, np.int64), np.array(self.counts, np.int64)
        order = np.argsort(-self.uses, kind="stable")[: self.most // 2]
        order = order[(self.uses[order] > 1) & (np.cumsum(counts[order]) <= self.most_ids // 2)]
        kept = np.sort(order)
        n = counts[kept]
        upto = np.cumsum(n) - n
        ids = np.frombuffer(self.ids, np.uint32)[np.repeat(starts[kept] - upto, n) + np.arange(n.sum())]
        words, slots = list(self.slots), _Slots()
        for at in kept.tolist():
            dict.__setitem__(slots, words[at], len(slots))
        self.slots, self.ids, self.starts, self.counts = slots, array("I", ids.tobytes()), array("q", upto.tobytes()), array("q", n.tobytes())
        self.uses = self.uses[kept] // 2  # so that what was frequent long ago goes in the end

    def look_up(self, words: list[str]) -> np.ndarray:
        """Slots of the words, all encoded."""
        if len(self.slots) > self.most or len(self.ids) > self.most_ids:
            self.shrink()
        slots = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        uses = np.bincount(slots, minlength=len(self.slots))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        if new := self.slots.new:
            for at in range(0, len(new), 20_000):
                counts, ids = self.encode_new(new[at : at + 20_000])
                self.starts.frombytes((len(self.ids) + np.cumsum(counts) - counts).astype(np.int64).tobytes())
                self.counts.frombytes(counts.astype(np.int64).tobytes())
                self.ids.frombytes(ids.astype(np.uint32).tobytes())
            self.slots.new = []
        return slots

    def count(self, lists: list[list[str]]) -> list[int]:
        """How many ids each list of words has."""
        slots = self.look_up([w for x in lists for w in x])
        sums = np.concatenate([[0], np.cumsum(np.frombuffer(self.counts, np.int64)[slots] if len(slots) else np.zeros(0, np.int64))])
        ends = np.cumsum([len(x) for x in lists])
        return np.diff(sums[np.concatenate([[0], ends])]).tolist()

    def encode(self, lists: list[list[str]]) -> list[np.ndarray]:
        """The ids of each list of words, as unsigned 32-bit integers."""
        slots = self.look_up([w for x in lists for w in x])
        ends = np.cumsum([len(x) for x in lists])
        if not len(slots):
            return [np.zeros(0, np.uint32) for _ in lists]
        n = np.frombuffer(self.counts, np.int64)[slots]
        upto = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(np.frombuffer(self.starts, np.int64)[slots] - upto[:-1], n) + np.arange(upto[-1])
        ids = np.frombuffer(self.ids, np.uint32)[at]
        return np.split(ids, upto[ends][:-1])


def chunks(texts: list[str], most_chars: int = 2_000_000) -> Iterator[slice]:
    """Slices of the list with about so many characters each, at least one text."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most_chars:
            yield slice(start, i)
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def text_parts(column, most_bytes: int = 1_000_000) -> Iterator[tuple[slice, list[str]]]:
    """An Arrow column of texts by slices of about so many bytes, at least one text each: no more are Python objects at once."""
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most_bytes, "right")))
        yield slice(start, end), column.slice(start, end - start).to_pylist()
        start = end


class LibraryTokenizer:
    """A tokenizer file of the tokenizers library: safe texts by pieces through a memo, others whole through the library."""

    def __init__(self, path: str, kind: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.kind = kind
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.memo = Memo(self._new, 700_000, 8_000_000)  # a call of the model costs more than a merge of our own

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the library's model, from the pre-tokens in its byte alphabet."""
        find, model = (WORDS_SAFE if self.kind == "word" else BYTE_LEVEL_SAFE).findall, self.tokenizer.model.tokenize
        ids, ends, space = array("I"), [0], "" if self.kind == "word" else chr(ALPHABET[0x20])
        for piece in pieces:
            if piece.isascii() and piece.isalpha():  # one word, whose letters stand for themselves
                ids.extend([t.id for t in model(space + piece)])
            else:
                for w in find(piece if self.kind == "word" else whole_piece(piece)):
                    ids.extend([t.id for t in model(w.encode().decode("latin-1").translate(ALPHABET))])
            ends.append(len(ids))
        return np.diff(ends), np.frombuffer(ids, np.uint32)

    def pieces(self, text: str) -> list[str] | None:
        if not safe(text) or self.special and "<|" in text and self.special.search(text):
            return None
        return word_pieces(text) if self.kind == "word" else byte_level_pieces(text)

    def _sorted_out(self, texts: list[str]) -> tuple[list[list[str]], list[int], list[int]]:
        lists, plain, odd = [], [], []
        for i, t in enumerate(texts):
            if (x := self.pieces(t)) is None:
                odd.append(i)
            else:
                lists.append(x)
                plain.append(i)
        return lists, plain, odd

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        for part in chunks(texts):
            some = texts[part]
            lists, plain, odd = self._sorted_out(some)
            for i, n in zip(plain, self.memo.count(lists), strict=True):
                out[part.start + i] = n
            for i, e in zip(odd, self.tokenizer.encode_batch([some[i] for i in odd], add_special_tokens=False), strict=True):
                out[part.start + i] = len(e)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        for part in chunks(texts):
            some = texts[part]
            lists, plain, odd = self._sorted_out(some)
            for i, ids in zip(plain, self.memo.encode(lists) if lists else [], strict=True):
                out[part.start + i] = ids
            for i, e in zip(odd, self.tokenizer.encode_batch([some[i] for i in odd], add_special_tokens=False), strict=True):
                out[part.start + i] = np.array(e.ids, np.uint32)
        return out


_LOADED: dict[tuple, LibraryTokenizer] = {}


def library_tokenizer(path: str, kind: str) -> LibraryTokenizer:
    """One tokenizer a Python worker. kind: byte (byte-level) or word (lower-case words)."""
    key = (path, kind)
    if key not in _LOADED:
        _LOADED[key] = LibraryTokenizer(path, kind)
    return _LOADED[key]
