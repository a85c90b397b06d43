"""Whole files as texts, and masked texts out with the private map kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraframe.operators.masking import restore_rows


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_stdin(spark: SparkSession, stream) -> DataFrame:
    """path "-" and all that a stream holds, as one text."""
    return spark.createDataFrame([("-", stream.read())], "path string, text string")


def write_masked(masked: DataFrame, key: str, out: str, map_out: str | None = None) -> None:
    """The masked columns as Parquet; originals only where a place for them is named."""
    masked.drop("restore").write.parquet(out)
    if map_out:
        restore_rows(masked, key).orderBy(key, "placeholder").write.parquet(map_out)
