"""Token counts through a digest cache.

The cache is a Parquet table of (content digest, tokenizer digest, n_tokens). Texts are joined to it by the
SHA-256 of their content and of the tokenizer file; of the distinct contents that miss, one row each is encoded,
and their counts are appended. The content is normalised only by taking null as empty: any other change to
a text could change its count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraframe.llm.bpe_transducer import tokenizer_path
from umbraframe.llm.common import new_path, ready, table, whole_text, written
from umbraframe.llm.pretok import library_tokenizer, text_parts

LIMIT = 512
#: Contents of more than this part of the rows are joined under salts.
HOT = 1_024
CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer file: another version of it misses all that was stored."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def distinct_misses(keyed: DataFrame, slim: DataFrame, stored: DataFrame, salts: int = 16) -> DataFrame:
    """(content, text), one row for each distinct content that ``stored`` lacks.

    keyed: doc_id, text, content; slim: doc_id, content of the same rows, written. Of a content's rows the one with the smallest
    id stands for it, so only that row's text is shuffled. Where this row itself repeats (same id, same content), the join's
    skewed partitions are split by the planner, and its copies are then combined under salts: no task gathers them all.
    """
    each = slim.groupBy("content", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    chosen = each.groupBy("content").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n")).alias("one")).join(stored, "content", "left_anti")
    chosen = written(chosen.select(F.col("content").alias("_content"), F.col("one.doc_id").alias("_one"), F.col("one.n").alias("_n")), "count-chosen")
    # As many rows as contents: these joins are merges at every size. Id and content together: no hot content meets in one task.
    of = lambda some: keyed.join(some.hint("merge"), (F.col("content") == F.col("_content")) & F.col("doc_id").eqNullSafe(F.col("_one")), "left_semi")
    single = of(chosen.filter("_n = 1")).select("content", "text")
    if not chosen.filter("_n > 1").head(1):
        return single
    again = of(chosen.filter("_n > 1")).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    again = again.groupBy("content", "_salt").agg(F.first("text").alias("text")).groupBy("content").agg(F.first("text").alias("text"))
    return single.unionByName(again)


def count_tokens(docs: DataFrame, cache_dir: str, path: str, kind: str = "byte", limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit. Appends what missed to the cache.

    Defined cases: a null text is empty (0 bytes, 0 tokens); null ids are kept; repeated rows each get a row
    and are encoded once; an empty table gives no rows and leaves the cache as it is; other columns are ignored.
    """
    spark, version = docs.sparkSession, tokenizer_digest(path)
    keyed = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).withColumn("content", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    slim = written(keyed.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "count-digests")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_dir)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir).filter(F.col("tokenizer") == version)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = library_tokenizer(path, kind)
        for batch in batches:
            for part, texts in text_parts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(tokenizer.counts(texts), pa.int64())], ["content", "n_tokens"])

    counted = distinct_misses(keyed, slim, stored).transform(ready).mapInArrow(run, "content binary, n_tokens long")
    counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_dir)
    # Two runs that append at once may store a content twice.
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir).filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return spread_join(slim, known).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def spread_join(slim: DataFrame, known: DataFrame, salts: int = 16) -> DataFrame:
    """Rows with their content's count. One content may hold a third of the rows: contents of more than 1/``HOT`` of the rows, fewer
    than ``HOT`` contents at any size, are salted on both sides; all others go to the join once."""
    hot = slim.groupBy("content").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * HOT > slim.count())
    hot = F.broadcast(written(hot.select(F.col("content").alias("_hot")), "count-hot"))
    marked = lambda some: some.join(hot, F.col("content") == F.col("_hot"), "left")
    last = F.when(F.col("_hot").isNotNull(), F.lit(salts - 1)).otherwise(F.lit(0))
    left = marked(slim).withColumn("_salt", F.pmod(F.xxhash64("doc_id"), last + 1).cast("int")).drop("_hot")
    right = marked(known).withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
    return left.join(right, ["content", "_salt"]).drop("_salt")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of its own for each run, so that every run counts all of its texts.
    return count_tokens(table(spark, sf_dir, "documents"), new_path(spark, "token-cache"), tokenizer_path())
