"""Exact dedup by content sort.

Texts are normalised (runs of white space become one space), dealt out by sampled splitters over
``(first bytes, 64-bit hash, salt)`` and sorted externally by ``(first bytes, hash, salt, whole text, id)``,
so equal texts lie side by side. Neighbouring rows are compared by their whole normalised text; each run of
equals yields its smallest id and its length. The salt splits a text with very many copies over tasks;
the runs of one text under different salts (at most ``salts`` rows a text) meet again by SHA-256 of the text.

The splitters are sampled over short keys, never over whole texts, so the sample that reaches the driver is
bounded by the number of partitions. Only DataFrame operations; one shuffle of the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from umbraframe.llm.common import SPACE, table, whole_text, written

PREFIX = 24
SALTS = 64


def normalised(col: str = "text"):
    return F.regexp_replace(whole_text(col), SPACE, " ")


def _merged(docs: DataFrame, id_col: str, text_col: str, salts: int, partitions: int | None) -> DataFrame:
    """One row per input row: doc_id, _sha, keep_id, group_size."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("_norm"))
    keyed = slim.select(
        "doc_id",
        "_norm",
        F.substring("_norm", 1, PREFIX).alias("_head"),
        F.xxhash64("_norm").alias("_hash"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("_salt"),
    )
    # A window over keys that hold the range keys needs no exchange of its own, only the external sort.
    dealt = keyed.repartitionByRange(n, "_head", "_hash", "_salt")
    run = Window.partitionBy("_head", "_hash", "_salt", "_norm")
    runs = dealt.select(
        "doc_id",
        "_salt",
        F.unhex(F.sha2(F.col("_norm").cast("binary"), 256)).alias("_sha"),
        F.min("doc_id").over(run).alias("_run_min"),
        F.count(F.lit(1)).over(run).alias("_run_size"),
    )
    # Both uses below read these few bytes a row, not the texts again.
    runs = written(runs, "content-runs")
    # One row a run, then at most ``salts`` rows a text: the window's groups are bounded.
    leaders = runs.groupBy("_sha", "_salt").agg(F.min("_run_min").alias("_run_min"), F.max("_run_size").alias("_run_size"))
    text = Window.partitionBy("_sha")
    merged = leaders.select("_sha", "_salt", F.min("_run_min").over(text).alias("keep_id"), F.sum("_run_size").over(text).alias("group_size"))
    return runs.select("doc_id", "_sha", "_salt").join(merged, ["_sha", "_salt"]).drop("_salt")


def dedup_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, partitions: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Defined cases: a null text equals an empty one; a null id never beats another id, and of a text that has
    only null ids every row is kept by null (kept is true); repeated rows with the same id and text share
    ``kept``, as they are the same document; an empty table gives no rows; other columns are ignored.
    """
    return _merged(docs, id_col, text_col, salts, partitions).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows (same id, equal text) one stays."""
    merged = _merged(docs, id_col, text_col, SALTS, None)
    kept = merged.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(F.col("doc_id").alias("_keep"), F.col("_sha").alias("_keep_sha")).agg(F.count(F.lit(1)).alias("_rows"))
    kept = written(kept, "content-kept").hint("merge")  # grows with the input: never broadcast
    sha = F.unhex(F.sha2(normalised(text_col).cast("binary"), 256))
    both = docs.withColumn("_sha_of", sha).join(kept, F.col(id_col).eqNullSafe(F.col("_keep")) & (F.col("_sha_of") == F.col("_keep_sha")), "left_semi")
    if kept.filter("_rows > 1").head(1):  # only then is there a row to drop, and a second shuffle worth it
        both = both.dropDuplicates([id_col, "_sha_of"])
    return both.drop("_sha_of")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_plan(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
