"""Token ids as binary files: one zstandard dictionary for all, each document compressed by itself.

A dictionary is trained on the serialized ids of a bounded sample of documents. Every document's ids are
compressed alone against it, so a short document is read without its neighbours. Compressed documents are dealt by
ranges of doc_id, sorted and packed into blocks in this format (little-endian):

    "UZT2" | sha256 of the dictionary (32 bytes) | u32 documents | u32 bytes per id | u32 documents without an id
    i64 doc_id x n | u32 tokens x n | u32 end of each frame x n | frames

``doc_id`` ascends within a block, documents without an id come last (their doc_id is 0), blocks ascend by (shard, number).
An id takes 2 bytes where the tokenizer's vocabulary allows it, else 4. The blocks are cells of a table that
Spark commits to the shared folder (so a lost executor leaves no torn file, and any store that Spark writes will do), beside
their first and last doc_id, by which :func:`read_document` finds one document. :func:`export_files` makes plain ``.uzt``
files of them, which :class:`Block` reads by offset.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from umbraframe.llm.bpe_transducer import tokenizer_path
from umbraframe.llm.common import new_path, ready, table, whole_text
from umbraframe.llm.pretok import library_tokenizer, text_parts

MAGIC = b"UZT2"
HEAD = 48
END_ID = 2
#: The dictionary's sample: the documents of the lowest hashes, at most so many, and so many bytes of the ids of each.
SAMPLE, SAMPLE_BYTES = 2_000, 16_384
DICTIONARY_BYTES = 65_536
BLOCK_BYTES, BLOCK_DOCS = 4_000_000, 4_096
SALTS = 1_024


class Frames:
    """Compressor and decompressor with one dictionary."""

    def __init__(self, dictionary: bytes, level: int = 3):
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO) if dictionary else None
        options = {"dict_data": shared} if shared else {}
        self.out = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True, **options)
        self.back = zstandard.ZstdDecompressor(**options)
        self.digest = hashlib.sha256(dictionary).digest()

    def compress(self, ids: np.ndarray, width: int) -> bytes:
        return self.out.compress(ids.astype(f"<u{width}").tobytes())

    def decompress(self, frame: bytes, width: int) -> np.ndarray:
        return np.frombuffer(self.back.decompress(frame), f"<u{width}")


def pack(docs: list[tuple[int | None, int, bytes]], digest: bytes, width: int) -> bytes:
    """A block of (doc_id, tokens, frame), in the order given: those without an id last."""
    ends = np.cumsum([len(f) for _, _, f in docs]).astype("<u4")
    parts = [np.array([d or 0 for d, _, _ in docs], "<i8").tobytes(), np.array([n for _, n, _ in docs], "<u4").tobytes(), ends.tobytes()]
    return struct.pack("<4s32sIII", MAGIC, digest, len(docs), width, sum(d is None for d, _, _ in docs)) + b"".join(parts) + b"".join(f for _, _, f in docs)


class Block:
    """A block over any buffer; documents are read one by one."""

    def __init__(self, buffer, frames: Frames):
        magic, digest, n, self.width, nulls = struct.unpack_from("<4s32sIII", buffer)
        if magic != MAGIC or digest != frames.digest:
            raise ValueError("not a block of this dictionary")
        self.buffer, self.frames, self.at, self.named = memoryview(buffer), frames, HEAD + 16 * n, n - nulls
        self._ids = np.frombuffer(buffer, "<i8", n, HEAD)
        self.tokens = np.frombuffer(buffer, "<u4", n, HEAD + 8 * n)
        self.ends = np.frombuffer(buffer, "<u4", n, HEAD + 12 * n)

    def doc_ids(self) -> list[int | None]:
        return [*self._ids[: self.named].tolist(), *[None] * (len(self._ids) - self.named)]

    def places(self, doc_id: int) -> range:
        """Where the documents of an id stand."""
        return range(*(int(np.searchsorted(self._ids[: self.named], doc_id, side)) for side in ("left", "right")))

    def ids(self, i: int) -> np.ndarray:
        start = int(self.ends[i - 1]) if i else 0
        return self.frames.decompress(bytes(self.buffer[self.at + start : self.at + int(self.ends[i])]), self.width)


def id_width(path: str, end_id: int | None) -> int:
    """Bytes an id, by the highest of the tokenizer's file."""
    from tokenizers import Tokenizer

    return 2 if max([end_id or 0, *Tokenizer.from_file(path).get_vocab(True).values()]) < 1 << 16 else 4


def trained(parts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of the samples; where they are too few to train on, their last bytes are the dictionary as they are."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, [p for p in parts if len(p) >= 8]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


def train_dictionary(docs: DataFrame, path: str, kind: str, width: int, sample: int = SAMPLE) -> bytes:
    """From the first ``SAMPLE_BYTES`` of the ids of at most ``sample`` documents; empty for an empty table.

    Ids are made where the texts lie and one task trains on them: 32 MB at most, and neither texts nor ids reach the driver.
    """
    key = F.xxhash64("doc_id", "text")
    last = docs.select(key.alias("_key")).orderBy("_key").limit(sample).agg(F.max("_key")).first()[0]
    if last is None:
        return b""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = library_tokenizer(path, kind)
        for batch in batches:
            ids = tokenizer.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i[: SAMPLE_BYTES // width].astype(f"<u{width}").tobytes() for i in ids], pa.binary())], ["key", "part"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sorted(x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([trained([p for _, p in parts])], pa.binary())], ["dictionary"])

    # Rows that repeat have one key: limited again, where only the sample is left.
    chosen = docs.select(key.alias("key"), "text").filter(F.col("key") <= last).transform(ready).mapInArrow(encode, "key long, part binary").limit(sample)
    return bytes(chosen.repartition(1).mapInArrow(train, "dictionary binary").first()[0])


def write_store(docs: DataFrame, out_dir: str, path: str, kind: str = "word", end_id: int | None = END_ID, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """Write the blocks of all documents below ``out_dir`` and return the dictionary (also kept there).

    Defined cases: a null text is empty and is stored as the end id alone; ids may be negative; rows with a null id come last;
    repeated rows are stored each; an empty table gives a store without blocks; other columns are ignored.
    """
    spark, width = docs.sparkSession, id_width(path, end_id)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    dictionary = train_dictionary(slim, path, kind, width)
    shared = spark.sparkContext.broadcast(dictionary)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, frames = library_tokenizer(path, kind), Frames(shared.value)
        for batch in batches:
            for part, texts in text_parts(batch.column(1)):
                ids = tokenizer.encode(texts)
                if end_id is not None:
                    ids = [np.append(i, np.uint32(end_id)) for i in ids]
                coded = pa.array([frames.compress(i, width) for i in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(map(len, ids), pa.int64()), coded], ["doc_id", "n_tokens", "frame"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, held, size, number, start = hashlib.sha256(shared.value).digest(), [], 0, 0, 0

        def flush():
            nonlocal held, size, number, start
            n, named = sum(x[1] for x in held), [x[0] for x in held if x[0] is not None]
            row = [[shard], [number], [start], [n], [len(held)], [named[0] if named else None], [named[-1] if named else None], [pack(held, digest, width)]]
            start, number, held, size = start + n, number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], list(names))

        shard = None
        for batch in batches:
            for shard_id, doc, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = shard_id
                held.append((doc, n, frame))
                size += len(frame)
                if size >= BLOCK_BYTES or len(held) >= BLOCK_DOCS:
                    yield flush()
        if held:
            yield flush()

    names, kinds = ("shard", "number", "start_in_shard", "n_tokens", "n_docs", "first_id", "last_id", "block"), (pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary())
    coded = slim.transform(ready).mapInArrow(compress, "doc_id long, n_tokens long, frame binary")
    # Sampling the ranges would run the encoder twice: it is written first, a fraction of the text's size.
    stage = f"{out_dir}/frames"
    coded.write.parquet(stage)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One id, or one whole row, may repeat very often: its rows go by their frames, then by salts, to several ranges.
    order = [F.col("doc_id").asc_nulls_last(), F.col("n_tokens"), F.xxhash64("frame"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))]
    frames = spark.read.parquet(stage).select("doc_id", "n_tokens", "frame", order[2].alias("_tie"), order[3].alias("_salt"))
    order = [order[0], "n_tokens", "_tie", "_salt"]
    dealt = frames.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "n_tokens", "frame").transform(ready).mapInArrow(blocks, "shard int, number int, start_in_shard long, n_tokens long, n_docs long, first_id long, last_id long, block binary").write.parquet(f"{out_dir}/blocks")
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").write.parquet(f"{out_dir}/dictionary")
    return dictionary


def read_store(spark: SparkSession, out_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers) from the blocks."""
    dictionary = bytes(spark.read.parquet(f"{out_dir}/dictionary").first()[0])
    shared = spark.sparkContext.broadcast(dictionary)
    stored = spark.read.parquet(f"{out_dir}/blocks")
    # One row a shard, of which there are as many as partitions at most.
    shards = stored.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).select("shard", F.coalesce("before", F.lit(0)).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = Frames(shared.value)
        for batch in batches:
            for start, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = Block(raw, frames)
                tokens = block.tokens.astype(np.int64)
                starts = start + np.cumsum(tokens) - tokens
                crcs = [zlib.crc32(block.ids(i).astype("<u4").tobytes()) for i in range(len(tokens))]
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids(), pa.int64()), pa.array(starts), pa.array(tokens), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = stored.join(F.broadcast(shards), "shard").select((F.col("before") + F.col("start_in_shard")).alias("start"), "block")
    return placed.transform(ready).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, out_dir: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents of one doc_id: only blocks whose range holds it are read, and only its frames expanded."""
    frames = Frames(bytes(spark.read.parquet(f"{out_dir}/dictionary").first()[0]))
    held = spark.read.parquet(f"{out_dir}/blocks").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("shard", "number").select("block")
    blocks = (Block(bytes(row.block), frames) for row in held.toLocalIterator())
    return [block.ids(i) for block in blocks for i in block.places(doc_id)]


def export_files(spark: SparkSession, out_dir: str, folder: str) -> int:
    """Plain ``.uzt`` files and ``dictionary.zdict`` in a local folder, one block at a time through the driver."""
    import os

    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/dictionary.zdict", "wb") as f:
        f.write(bytes(spark.read.parquet(f"{out_dir}/dictionary").first()[0]))
    n = 0
    for row in spark.read.parquet(f"{out_dir}/blocks").orderBy("shard", "number").toLocalIterator():
        with open(f"{folder}/{row.shard:05d}-{row.number:05d}.uzt", "wb") as f:
            f.write(bytes(row.block))
        n += 1
    return n


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out_dir = new_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), out_dir, tokenizer_path("word_bpe_49k.json"))
    return read_store(spark, out_dir)
