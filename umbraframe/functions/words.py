"""Words with offsets, subword counts and the windows of a long text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from umbraframe.functions.shipping import ship

#: Emoji by ranges of the Unicode blocks that hold them, and what joins or modifies them, for Java and Python.
EMOJI_RANGES = ((0x1F000, 0x1FAFF), (0x2600, 0x27BF), (0x2190, 0x21FF), (0x2300, 0x23FF), (0x2B00, 0x2BFF), (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299), (0xA9, 0xA9), (0xAE, 0xAE))
JOINER_RANGES = ((0xFE0F, 0xFE0F), (0x200D, 0x200D), (0x20E3, 0x20E3), (0x1F3FB, 0x1F3FF))


def _java(ranges) -> str:
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def _python(ranges) -> str:
    return "[" + "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in ranges) + "]"


EMOJI = f"^(?:{_java(EMOJI_RANGES)}{_java(JOINER_RANGES)}*)+$"
EMOJI_PYTHON = re.compile(f"(?:{_python(EMOJI_RANGES)}{_python(JOINER_RANGES)}*)+")
NEUTRAL = "-"
MAX_WIDTH = 12
#: Bytes of text, or logits, that a worker takes at once from a batch, as its arrays take many times that.
AT_ONCE = 1 << 20

WORD_TYPE = "array<struct<text:string,start:int,end:int>>"
# The code points with Unicode's White_Space property.
_WHITE = np.array([*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def found_words(texts: list[str | None]) -> pa.Array:
    """Of each text its words with their places, all texts at once: words are the runs of what is no white space.

    Texts are joined by a line feed, so no word crosses two of them, and a word's bytes are what stays of the joined text.
    """
    joined = "".join(t + "\n" for t in texts if t is not None)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    white = np.zeros(0x3001, bool)
    white[_WHITE] = True
    word = ~(white[np.minimum(points, 0x3000)] & (points <= 0x3000))
    edges = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    upto = np.concatenate([[0], np.cumsum(np.where(word, width, 0))])
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)[np.repeat(word, width)]
    offsets = np.concatenate([upto[starts], upto[-1:]]).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    lengths = np.array([0 if t is None else len(t) + 1 for t in texts], np.int64)
    begins = np.cumsum(lengths) - lengths
    per_text = np.searchsorted(starts, np.concatenate([begins, [len(points)]]))
    base = np.repeat(begins, np.diff(per_text))
    each = pa.StructArray.from_arrays([text.cast(pa.string()), pa.array((starts - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))], ["text", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), each)


def runs(sizes: pa.Array, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Half-open runs of neighbouring rows of about `most` in all; a larger row ends its run. Null counts as none."""
    upto = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = [0, *(np.flatnonzero(np.diff(upto // most)) + 1).tolist(), len(sizes)]
    return ((a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b)


def words_with_offsets(text: Column) -> Column:
    """Words with their places, in time linear in the text; none for null."""

    ship()

    @F.arrow_udf(WORD_TYPE)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for a, b in runs(pc.binary_length(texts)):
                yield found_words(texts.slice(a, b - a).to_pylist())

    return found(text)


def words(text: Column) -> Column:
    """Only the words."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def is_emoji(word: Column) -> Column:
    return word.rlike(EMOJI)


def neutral(word: Column) -> Column:
    """What is encoded for a word: a hyphen for one of emoji only."""
    return F.when(is_emoji(word), F.lit(NEUTRAL)).otherwise(word)


def preamble_length(label_tokens: list[int]) -> int:
    """Tokens before the text: one first, each label with its mark, a separator and one last."""
    return 1 + sum(1 + n for n in label_tokens) + 1 + 1


def plan(counts: list[int], capacity: int, max_width: int = MAX_WIDTH) -> list[tuple[int, int]] | None:
    """Half-open windows of words whose tokens fit; neighbours share up to max_width - 1 words. None if a word does not fit."""
    if capacity <= 0 or any(n > capacity for n in counts):
        return None
    out: list[tuple[int, int]] = []
    first = 0
    while first < len(counts):
        total, end = 0, first
        while end < len(counts) and total + counts[end] <= capacity:
            total += counts[end]
            end += 1
        out.append((first, end))
        if end == len(counts):
            break
        first = max(first + 1, end - min(max_width - 1, end - first - 1))
    return out


def window_plan(counts: Column, capacity: int, max_width: int = MAX_WIDTH) -> Column:
    ship()

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def planned(x: pd.Series) -> pd.Series:
        def one(c):
            p = None if c is None else plan(list(c), capacity, max_width)
            return None if p is None else [{"first": a, "last": b} for a, b in p]

        return x.map(one)

    return planned(counts)


def subword_counts(path: str):
    """A column function: subword tokens of each word, by a tokenizer file."""

    @F.pandas_udf("array<int>")
    def counted(x: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return x.map(lambda ws: None if ws is None else [len(e) for e in tokenizer.encode_batch(list(ws), add_special_tokens=False)])

    return lambda ws: counted(F.transform(ws, neutral))
