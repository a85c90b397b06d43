"""The same stateless masking on a stream: each row is one request, so no watermark or state is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from umbraframe.operators.detect import Detector
from umbraframe.operators.masking import mask_fields


def mask_stream(stream: DataFrame, text_col: str = "text", detector: Detector | None = None) -> DataFrame:
    """Adds status, masked and restore to a streaming (or batch) table of texts; the text itself goes."""
    masked = mask_fields(stream.withColumn("_fields", F.array(text_col)).drop(text_col), "_fields", detector)
    return masked.withColumn("masked", F.try_element_at("masked_fields", F.lit(1))).drop("masked_fields")


def start(stream: DataFrame, out: str, checkpoint: str, text_col: str = "text") -> StreamingQuery:
    """Masked texts to Parquet, without the private map."""
    return mask_stream(stream, text_col).drop("restore").writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
