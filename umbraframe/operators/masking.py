"""Masking and restoring of requests. One row is one request with one numbering; a row that fails carries its reason only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraframe.functions import spans as S
from umbraframe.functions.names import FULL, mask_name
from umbraframe.functions.words import subword_counts, words
from umbraframe.operators.detect import Detector, RuleDetector

SEND, FAILED, TIMED_OUT, SMUGGLED, OVER_BUDGET = "send", "drop_filter_failed", "drop_timed_out", "drop_separator", "drop_budget"


def with_tokens(df: DataFrame, text_col: str = "text", spans_col: str = "spans", protected: Column | None = None) -> DataFrame:
    """Adds ``_tokens``: valid spans, cut around the framing (or without those equal to a protected string), trimmed, merged and numbered.

    In steps, as a lambda would evaluate an expression that it names again for each span.
    """
    text = F.col(text_col)
    df = df.withColumn("_valid", S.valid(F.col(spans_col), text)).withColumn("_bars", S.framing(text))
    free = S.around(F.col("_valid"), F.col("_bars")) if protected is None else S.not_equal_to(F.col("_valid"), text, protected)
    df = df.withColumn("_merged", S.merged(S.trimmed(free, text)))
    df = df.withColumn("_keys", F.transform("_merged", lambda s: S.key_of(s["label"])))
    return df.withColumn("_tokens", S.numbered(F.col("_merged"), F.col("_keys"))).drop("_valid", "_bars", "_merged", "_keys")


def mask_spans(df: DataFrame, text_col: str = "text", spans_col: str = "spans", protected: Column | None = None) -> DataFrame:
    """Adds ``masked`` and ``restore`` (placeholder -> original); both null where text or spans are."""
    text = F.col(text_col)
    tokens = with_tokens(df, text_col, spans_col, protected)
    return tokens.withColumn("masked", S.spliced(text, F.col("_tokens"))).withColumn("restore", F.when(text.isNotNull(), S.restore_map(text, F.col("_tokens")))).drop("_tokens")


def mask_fields(df: DataFrame, fields_col: str = "fields", detector: Detector | None = None, words_cap: int | None = None, tokens_cap: int | None = None, tokenizer: str | None = None) -> DataFrame:
    """The fields of a row masked together: adds ``status``, ``masked_fields`` and ``restore``; input columns but the fields stay.

    A budget counts the words of all fields and their framing (``words_cap``), or their subwords by a tokenizer file (``tokens_cap``).

    A request with the separator inside a field is refused before detection; one whose framing does not survive is dropped.
    No fields are a success with no fields.
    """
    fields, n = F.col(fields_col), F.size(fields_col)
    blob = df.withColumn("_blob", S.joined_fields(fields)).withColumn("_n", n)
    intact = F.coalesce(S.split_fields(F.col("_blob"), F.col("_n")) == fields, F.lit(False)) & ~F.exists(fields, lambda f: f.contains(S.RS * 2))
    blob = blob.withColumn("_early", F.when(fields.isNull() | F.exists(fields, lambda f: f.isNull()), FAILED).when(~intact, SMUGGLED))
    if words_cap is not None:
        blob = blob.withColumn("_early", F.coalesce("_early", F.when(F.size(F.regexp_extract_all("_blob", F.lit(r"(?U)\S+"), F.lit(0))) > words_cap, OVER_BUDGET)))
    if tokens_cap is not None:
        counted = subword_counts(tokenizer)(words(F.when(F.col("_early").isNull(), F.col("_blob"))))
        blob = blob.withColumn("_early", F.coalesce("_early", F.when(F.aggregate(counted, F.lit(0), lambda a, n: a + n) > tokens_cap, OVER_BUDGET)))
    # A refused row has no text from here on.
    blob = blob.withColumn("_blob", F.when(F.col("_early").isNull(), F.col("_blob"))).drop(fields_col)
    found = (detector or RuleDetector())(blob, "_blob").withColumnRenamed("spans", "_spans")
    late = F.coalesce("_timed_out", F.lit(False)) if "_timed_out" in found.columns else F.lit(False)
    masked = mask_spans(found.withColumn("_late", late), "_blob", "_spans").withColumn("masked_fields", S.split_fields(F.col("masked"), F.col("_n")))
    status = F.when(F.col("_n") == 0, SEND).when(F.col("_early").isNotNull(), F.col("_early")).when(F.col("_late"), TIMED_OUT).when(F.col("masked_fields").isNull(), FAILED).otherwise(SEND)
    masked = masked.withColumn("status", status)
    sent = F.col("status") == SEND
    return (
        masked.withColumn("masked_fields", F.when(F.col("_n") == 0, F.array().cast("array<string>")).when(sent, F.col("masked_fields")))
        .withColumn("restore", F.when(sent, F.coalesce("restore", F.create_map().cast("map<string,string>"))))
        .drop("_blob", "_n", "_early", "_spans", "_late", "_timed_out", "masked")
    )


def sanitize(df: DataFrame, text_col: str = "text", detector: Detector | None = None, first: str = "", last: str = "", protected: tuple[str, ...] = ()) -> DataFrame:
    """One text a row: outer white space trimmed, the user's name masked, then its spans. Blank text gives null."""
    text = mask_name(F.regexp_replace(F.col(text_col), r"(?U)^\s+|\s+$", ""), first, last, FULL)
    df = df.withColumn("_text", F.when(text != "", text))
    found = (detector or RuleDetector())(df, "_text").withColumnRenamed("spans", "_spans").drop("_timed_out")
    found = found.withColumn("_spans", F.when(F.col("_text").isNotNull(), F.col("_spans")))
    return mask_spans(found, "_text", "_spans", F.array(*[F.lit(p) for p in protected]).cast("array<string>")).drop("_text", "_spans")


def restore_replies(replies: DataFrame, masked: DataFrame, key: str, reply_col: str = "reply", labels: tuple[str, ...] | None = S.LABELS) -> DataFrame:
    """Replies with the originals of their request put back; a reply without a request restores nothing."""
    maps = masked.select(key, F.col("restore").alias("_map"))
    originals = F.coalesce("_map", F.create_map().cast("map<string,string>"))
    return replies.join(maps, key, "left").withColumn("restored", S.restored(F.col(reply_col), originals, labels)).drop("_map")


def restore_rows(masked: DataFrame, key: str) -> DataFrame:
    """The private map as rows (key, placeholder, original), for a table of its own."""
    return masked.select(key, F.explode_outer(F.map_entries("restore")).alias("e")).filter("e IS NOT NULL").select(key, F.col("e.key").alias("placeholder"), F.col("e.value").alias("original"))


def decision(value: Column, timed_out: Column) -> Column:
    """The status of an outcome."""
    return F.when(timed_out, TIMED_OUT).when(value.isNull(), FAILED).otherwise(SEND)


def probe(df: DataFrame, anchors: tuple[str, ...], covered_col: str = "covered", least: int = 2) -> DataFrame:
    """found, missed and passes from the texts that spans covered (null: the detector did not run)."""
    all_anchors = F.array(*[F.lit(a) for a in anchors])
    covered = F.coalesce(F.col(covered_col), F.array().cast("array<string>"))
    found = F.filter(all_anchors, lambda a: F.exists(covered, lambda c: c.contains(a)))
    return df.withColumn("ran", F.col(covered_col).isNotNull()).withColumn("found", found).withColumn("missed", F.array_except(all_anchors, found)).withColumn("passes", F.col("ran") & (F.size("found") >= least))


def probe_run(spark: SparkSession, detector: Detector, text: str, anchors: tuple[str, ...], least: int = 2) -> tuple[bool, int]:
    """(ran, anchors found) of one planted text through a detector, as a rollback's probe takes it."""
    found = detector(spark.createDataFrame([(text,)], "text string"), "text")
    row = probe(found.withColumn("covered", F.transform("spans", lambda s: S.part(F.col("text"), s["start"], s["end"]))), anchors, least=least).first()
    return row.ran, len(row.found)


def cancellable(spark: SparkSession, tag: str, run: Callable[[], object]) -> object:
    """run() with its jobs under a tag: :func:`cancel` from another thread ends it by an error, never by a partial result."""
    spark.sparkContext.addJobTag(tag)
    try:
        return run()
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)
