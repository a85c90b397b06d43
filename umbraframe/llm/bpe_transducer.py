"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words of the corpus are compiled, with the ids they encode to, into a minimal acyclic automaton:
words that end alike share their last states, and each edge carries how many words sort before it, so the sum
along a word's path is its number, which points at its ids. The automaton is a flat file of sorted arrays that
every Python worker maps into memory. Words that it lacks are merged exactly, all of a batch at once: in each
round every word merges its pair of lowest rank, from left to right, until no word has a known pair.

A word is frequent if some partition holds it with a share of at least ``SHARE`` of that partition's words: every
word with that share of the corpus has it in some partition, so none of them is missed, and a partition reports
at most 2 / SHARE words. The most frequent ``LEXICON`` of them are compiled.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import struct
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraframe.llm.common import ready, release_memory, table, whole_text
from umbraframe.llm.pretok import ALPHABET, BYTE_LEVEL, BYTE_LEVEL_SAFE, Memo, byte_level_pieces, chunks, safe, text_parts, whole_piece

SHARE = 1e-5
LEXICON = 40_000
#: Bytes of texts that are encoded at once.
CHARS = 1_000_000
MAGIC = b"UFT1"
NONE = np.iinfo(np.int64).max


# ---- the automaton


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The file of the minimal acyclic transducer that maps each word to its ids.

    States are made from the words in sorted order; as soon as no further word can pass a state, it is replaced
    by an equal one (same finality, same edges) if there is one, so suffixes are shared and the automaton is minimal.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settled(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # of the last word: [final, [(byte, state)]]
    last = b""
    ordered = sorted(words)
    for word in ordered:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        for i in range(len(last), shared, -1):
            path[i - 1][1].append((last[i - 1], settled(path.pop())))
        path.extend([False, []] for _ in word[shared:])
        path[len(word)][0] = True
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1][1].append((last[i - 1], settled(path.pop())))
    root = settled(path[0])

    below = np.zeros(len(states), np.int64)
    keys, targets, skips = [], [], []
    for i, (final, edges) in enumerate(states):  # targets have smaller numbers than their sources
        before = int(final)
        for byte, target in edges:
            keys.append(i << 8 | byte)
            targets.append(target)
            skips.append(before)
            before += int(below[target])
        below[i] = before
    ends = np.cumsum([0, *(len(words[w]) for w in ordered)]).astype("<u4")
    parts = [
        np.array(keys, "<u4"),
        np.array(targets, "<u4"),
        np.array(skips, "<u4"),
        ends,
        np.array([i for w in ordered for i in words[w]], "<u4"),
        np.array([f for f, _ in states], "u1"),
    ]
    head = struct.pack("<4s7I", MAGIC, root, *map(len, parts))
    return head + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon over any buffer, such as a mapped file."""

    def __init__(self, buffer):
        magic, root, *sizes = struct.unpack_from("<4s7I", buffer)
        if magic != MAGIC:
            raise ValueError("not a lexicon file")
        at, parts = 32, []
        for n, kind in zip(sizes, ("<u4", "<u4", "<u4", "<u4", "<u4", "u1"), strict=True):
            parts.append(np.frombuffer(buffer, kind, n, at))
            at += parts[-1].nbytes
        self.root = root
        self.keys, self.targets, self.skips, self.ends, self.ids, self.final = parts

    @classmethod
    def mapped(cls, content: bytes) -> Lexicon:
        """From a file of this worker's own that is mapped and at once unlinked, so nothing is left behind."""
        with tempfile.TemporaryFile() as f:
            f.write(content)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in sorted order, -1 where the lexicon lacks it. All words step together."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return out
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        alive = np.nonzero(lengths > 0)[0]
        state, number = np.full(len(alive), self.root, np.int64), np.zeros(len(alive), np.int64)
        depth = 0
        while len(alive):
            key = state << 8 | text[starts[alive] + depth]
            edge = np.minimum(np.searchsorted(self.keys, key.astype(np.uint32)), len(self.keys) - 1)
            found = self.keys[edge] == key
            alive, edge, number = alive[found], edge[found], number[found] + self.skips[edge[found]]
            state = self.targets[edge].astype(np.int64)
            depth += 1
            ended = lengths[alive] == depth
            whole = ended & (self.final[state] == 1)
            out[alive[whole]] = number[whole]
            alive, state, number = alive[~ended], state[~ended], number[~ended]
        return out


# ---- exact merges


class Merges:
    """The vocabulary and merge ranks of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        back = {chr(c): b for b, c in ALPHABET.items()}
        self.of_byte = np.array([vocab[chr(ALPHABET[b])] for b in range(256)], np.int64)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_ends = np.cumsum([0, *map(len, pieces)])

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of the pairs that begin at some places, none the last; NONE where they do not merge."""
        key = (symbols[at].astype(np.uint64) << np.uint64(16)) | symbols[at + 1].astype(np.uint64)
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[found] == key) & (owner[at] == owner[at + 1]), self.ranks[found], NONE), self.made[found]

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        counts, ids = self.encode_flat(words)
        return np.split(ids, np.cumsum(counts)[:-1]) if len(words) else []

    def encode_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids: every round merges each word's pair of lowest rank. All pairs of that rank go at
        once, as a pair that a merge makes has a higher rank; of overlapping ones (aaa) every second. Only pairs beside a
        merge are looked up anew."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        owners, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        rank, made = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
        rank[:-1], made[:-1] = self._pairs(symbols, owner, np.arange(max(len(symbols) - 1, 0)))
        while len(symbols):
            first = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0]
            count = np.diff(np.concatenate([first, [len(symbols)]]))
            least = np.minimum.reduceat(rank, first)
            finished = least == NONE
            over = np.repeat(finished, count)
            owners.append(owner[over])
            ids.append(symbols[over])
            best = np.nonzero((rank == np.repeat(least, count)) & (rank < NONE))[0]
            if not len(best):
                break
            start = np.concatenate([[True], np.diff(best) > 1])
            run = np.maximum.accumulate(np.where(start, np.arange(len(best)), 0))
            best = best[(np.arange(len(best)) - run) % 2 == 0]
            symbols[best] = made[best]
            stays = ~over
            stays[best + 1] = False
            merged = np.cumsum(stays)[best] - 1
            symbols, owner, rank, made = symbols[stays], owner[stays], rank[stays], made[stays]
            rank[merged] = NONE
            beside = np.concatenate([merged, merged - 1])
            beside = beside[(beside >= 0) & (beside < len(symbols) - 1)]
            rank[beside], made[beside] = self._pairs(symbols, owner, beside)
        of = np.concatenate(owners)
        return np.bincount(of, minlength=len(words)), np.concatenate(ids)[np.argsort(of, kind="stable")]

    def decode(self, ids: np.ndarray) -> str:
        start, end = self.piece_ends[ids], self.piece_ends[ids.astype(np.int64) + 1]
        n = end - start
        upto = np.cumsum(n)
        if not len(ids) or not upto[-1]:
            return ""
        return self.piece_bytes[np.repeat(start - (upto - n), n) + np.arange(upto[-1])].tobytes().decode("utf-8", "replace")


class Codec:
    """Encoder and decoder of one Python worker."""

    def __init__(self, merges: Merges, lexicon: bytes):
        import regex

        self.merges, self.lexicon = merges, Lexicon.mapped(lexicon)
        self.pattern = regex.compile(BYTE_LEVEL)
        self.special = re.compile("(" + "|".join(map(re.escape, self.merges.special)) + ")") if self.merges.special else None
        self.memo = Memo(self._new)

    def words_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids: the lexicon's where it has the word, else by the exact merges."""
        numbers = self.lexicon.numbers(words)
        unseen, seen = np.nonzero(numbers < 0)[0], np.nonzero(numbers >= 0)[0]
        merged_counts, merged = self.merges.encode_flat([words[i] for i in unseen.tolist()])
        ends, counts = self.lexicon.ends.astype(np.int64), np.zeros(len(words), np.int64)
        counts[unseen], counts[seen] = merged_counts, ends[numbers[seen] + 1] - ends[numbers[seen]]
        starts, out = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.int64)

        def places(first: np.ndarray, n: np.ndarray) -> np.ndarray:
            return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())

        out[places(starts[unseen], merged_counts)] = merged
        out[places(starts[seen], counts[seen])] = self.lexicon.ids[places(ends[numbers[seen]], counts[seen])]
        return counts, out

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # A piece of letters is one word; one that is marked is, too.
        split = [[" " + p] if p.isalpha() else BYTE_LEVEL_SAFE.findall(whole_piece(p)) if p[0] != "\x03" else [p[1:]] for p in pieces]
        counts, ids = self.words_ids([w.encode() for words in split for w in words])
        upto = np.concatenate([[0], np.cumsum(counts)])
        return np.diff(upto[np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])]), ids

    def _pieces(self, text: str) -> list[str]:
        """Pieces of any text. A word of one that is not safe is marked, as it must not be split again."""
        if safe(text) and (x := byte_level_pieces(text)) is not None:
            return x
        return ["\x03" + w for w in self.pattern.findall(text)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; special tokens' strings in a text become their ids."""
        out = []
        for part in chunks(texts, CHARS):
            cut = [self.special.split(t) if self.special and self.special.search(t) else [t] for t in texts[part]]
            coded = iter(self.memo.encode([self._pieces(s) if s else [] for x in cut for s in x[::2]]))
            for x in cut:
                ids = [np.array([self.merges.special[s]], np.uint32) if i % 2 else next(coded) for i, s in enumerate(x)]
                out.append(np.concatenate(ids) if len(ids) > 1 else ids[0])
        return out


_CODECS: dict[str, Codec] = {}


def codec(merges: Merges, lexicon: bytes, digest: str) -> Codec:
    """One codec a Python worker, for the last lexicon it was given."""
    if digest not in _CODECS:
        _CODECS.clear()
        _CODECS[digest] = Codec(merges, lexicon)
    return _CODECS[digest]


# ---- the operator


def frequent_words(docs: DataFrame, text_col: str = "text", share: float = SHARE, most: int = LEXICON) -> list[str]:
    """The most frequent white-space separated words of all texts, at most ``most``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter[str] = Counter()
        total = pruned = 0
        lost = 0.0  # no word that was dropped has had so many
        for batch in batches:
            for text in batch.column(0):
                words = (text.as_py() or "").split()
                total += len(words)
                counter.update(words)
            if len(counter) > 1_000_000 and total > 2 * pruned:
                counter = Counter({w: n for w, n in counter.items() if n + lost >= share * total / 2})
                pruned, lost = total, share * total / 2
        kept = [(w, n) for w, n in counter.items() if n >= 2 and n + lost >= share * total]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    counted = docs.select(text_col).transform(ready).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]


def build_lexicon(merges: Merges, words: list[str]) -> bytes:
    """Compile the pre-tokens of the words, as they stand after a space."""
    import regex

    pattern = regex.compile(BYTE_LEVEL)
    tokens = sorted({t.encode() for w in words for t in pattern.findall(" " + w)})
    merged = merges.encode(tokens)
    return compile_lexicon(dict(zip(tokens, (ids.tolist() for ids in merged), strict=True)))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids unless not asked for.

    Defined cases: a null text is empty; an empty text has no ids; null ids pass through; repeated rows each get
    a row; an empty table gives no rows; other columns are ignored; texts of any length are encoded whole.
    """
    # The tokenizer's file is read once, on the driver: workers get its tables, about as large as the vocabulary.
    merges = Merges(path)
    content = build_lexicon(merges, frequent_words(docs, text_col))
    digest, shared = hashlib.sha256(path.encode() + content).hexdigest(), docs.sparkSession.sparkContext.broadcast((merges, content))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        c = codec(*shared.value, digest)
        for batch in batches:
            for part, texts in text_parts(batch.column(1), CHARS):
                rows = [{"n": len(i), "sha": hashlib.sha256(i.astype("<u4", copy=False).tobytes()).hexdigest(), "text": hashlib.sha256(c.merges.decode(i).encode()).hexdigest()} | ({"ids": i.astype(np.int32)} if with_ids else {}) for i in c.encode(texts)]
                cols = [batch.column(0)[part], pa.array([r["n"] for r in rows], pa.int64()), pa.array([r["sha"] for r in rows], pa.string()), pa.array([r["text"] for r in rows], pa.string())]
                if with_ids:
                    ends = np.cumsum([0, *(r["n"] for r in rows)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(ends, np.concatenate([r["ids"] for r in rows])))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).transform(ready).mapInArrow(run, schema)


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids decode to an empty text."""

    shared = coded.sparkSession.sparkContext.broadcast(Merges(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = shared.value
        for batch in batches:
            texts = [merges.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = coded.select("doc_id").schema[0].dataType.simpleString()
    return coded.select("doc_id", "ids").transform(ready).mapInArrow(run, f"doc_id {kind}, text string")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
