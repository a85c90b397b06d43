"""One query per operator over the test tables: (spark, sf_dir) -> DataFrame of flat columns."""

from __future__ import annotations

import errno
import io
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraframe.functions import names, words
from umbraframe.functions import spans as S
from umbraframe.functions.shipping import ship
from umbraframe.functions.words import MAX_WIDTH
from umbraframe.operators import detect, masking
from umbraframe.sources import models

CAP, BUDGET = 200, 500
ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
#: Stand-ins that SQL can follow: characters of a subword, and what takes a word's place in texts with emoji.
SUBWORD = 4
EMOJI = ("👍", "❤️", "👩‍🚀🎉", "✂a")
FIRST, LAST = "Thonti", "Erou"
HEADER = "user: assistant:"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def detected(spark, sf_dir) -> DataFrame:
    return detect.RuleDetector()(docs(spark, sf_dir))


def exploded(df: DataFrame, spans: str = "spans") -> DataFrame:
    # Outer, then without nulls: an inner explode would have its input's size tested first, by expressions evaluated anew.
    return df.select("doc_id", F.explode_outer(spans).alias("s")).filter("s IS NOT NULL").select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.label").alias("label"))


def words_with_offsets(spark, sf_dir):
    x = docs(spark, sf_dir).select("doc_id", F.posexplode(words.words_with_offsets(F.col("text"))).alias("pos", "w"))
    return x.select("doc_id", "pos", F.col("w.text").alias("word"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))


def word_count_budget(spark, sf_dir):
    n = F.size(words.words(F.col("text")))
    return docs(spark, sf_dir).select("doc_id", n.alias("n"), F.when(n == 0, "empty").when(n > BUDGET, masking.OVER_BUDGET).otherwise(masking.SEND).alias("status"))


def subwords(spark, sf_dir) -> DataFrame:
    """doc_id and the subword counts of its words: one for each SUBWORD characters begun."""
    return docs(spark, sf_dir).select("doc_id", F.transform(words.words(F.col("text")), lambda w: F.ceil(F.length(w) / SUBWORD).cast("int")).alias("counts"))


def window_plan(spark, sf_dir):
    x = subwords(spark, sf_dir).select("doc_id", F.posexplode(words.window_plan(F.col("counts"), CAP)).alias("w", "p"))
    return x.select("doc_id", "w", F.col("p.first").alias("first"), F.col("p.last").alias("last"))


def window_budget(spark, sf_dir):
    """Whether a text passes: dropped as a whole where one word alone, or all together, go over their limits."""
    x = subwords(spark, sf_dir).withColumn("n_tokens", F.aggregate("counts", F.lit(0), lambda a, n: a + n))
    plan = words.window_plan(F.col("counts"), CAP // 50)
    return x.withColumn("p", plan).select("doc_id", "n_tokens", F.when(F.col("n_tokens") > BUDGET * 2, masking.OVER_BUDGET).when(F.col("p").isNull(), masking.FAILED).otherwise(masking.SEND).alias("status"))


def preamble_lengths(spark, sf_dir):
    """Of each conversation the tokens before its text, with its turns' words as label tokens."""
    counted = by_row(lambda x: words.preamble_length(x), "long")
    c = turns(spark, sf_dir).select("conv_id", F.transform("fields", lambda t: F.size(words.words(t))).alias("counts"))
    return c.select("conv_id", counted("counts").alias("n_tokens"))


def model_inputs(spark, sf_dir):
    """Sums over each window's tensors: ids, spans that fit, their last words, and the words' numbers at their first subwords."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, (first, last) in enumerate(words.plan(counts, CAP) or []):
                    x = detect.build_inputs([[7, 8], [9]], [[5] * n for n in counts[first:last]])
                    fits = x["span_mask_int64"][0] == 1
                    rows.append((doc, w, x["input_ids"].shape[1], int(fits.sum()), int(x["span_idx"][0][fits, 1].sum()), int(x["words_mask"].sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int64(), pa.int32(), *[pa.int64()] * 4), strict=True)], names)

    ship(spark)
    names = ["doc_id", "w", "n_ids", "n_spans", "sum_last", "sum_words"]
    return subwords(spark, sf_dir).mapInArrow(run, "doc_id long, w int, n_ids long, n_spans long, sum_last long, sum_words long")


def by_row(f, kind: str):
    """A column function of one Python value a row, in Arrow batches: the engine's own driver-side functions on tables."""

    def made(*columns):
        ship()

        @F.arrow_udf(kind)
        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for values in batches:
                yield pa.array([f(*row) for row in zip(*(v.to_pylist() for v in values), strict=True)], ARROW[kind])

        @F.arrow_udf(kind)
        def run_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for values in batches:
                yield pa.array([f(v) for v in values.to_pylist()], ARROW[kind])

        return run_one(*columns) if len(columns) == 1 else run(*columns)

    return made


def detect_label(label):
    def query(spark, sf_dir):
        df = docs(spark, sf_dir).withColumn("spans", detect.pattern_spans(F.col("text"), detect.RULES[label], label))
        return exploded(df)

    return query


def trim_spans(spark, sf_dir):
    wide = F.transform("spans", lambda s: S.span(F.greatest(s["start"] - 2, F.lit(0)), F.least(s["end"] + 2, F.length("text")), s["label"]))
    return exploded(detected(spark, sf_dir).select("doc_id", S.trimmed(wide, F.col("text")).alias("spans")))


def overlapping(df: DataFrame) -> DataFrame:
    """Spans and, beside each, one that starts in its middle and reaches 30 further."""
    more = F.transform("spans", lambda s: S.span(s["start"] + 5, F.least(s["end"] + 30, F.length("text")), F.lit("address")))
    return df.withColumn("spans", F.concat("spans", more))


def merge_spans(spark, sf_dir):
    return exploded(overlapping(detected(spark, sf_dir)).select("doc_id", S.merged(F.col("spans")).alias("spans")))


def protect_markers(spark, sf_dir):
    """Spans less the white space runs of line feeds, which stand in for framing."""
    x = overlapping(detected(spark, sf_dir))
    barred = x.withColumn("_bars", S.markers(F.col("text"), r"[\x20\n]+"))
    return exploded(barred.select("doc_id", S.around(F.col("spans"), F.col("_bars")).alias("spans")))


def number_placeholders(spark, sf_dir):
    x = masking.with_tokens(detected(spark, sf_dir)).select("doc_id", F.explode_outer("_tokens").alias("s")).filter("s IS NOT NULL")
    return x.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.token").alias("token"))


def mask_documents(spark, sf_dir):
    x = masking.mask_spans(detected(spark, sf_dir))
    return x.select("doc_id", "masked", F.size("restore").alias("n_spans"))


def restore_map_rows(spark, sf_dir):
    return masking.restore_rows(masking.mask_spans(detected(spark, sf_dir)), "doc_id")


def restore_roundtrip(spark, sf_dir):
    x = masking.mask_spans(detected(spark, sf_dir))
    return x.select("doc_id", S.restored(F.col("masked"), F.col("restore")).alias("restored"))


def garbled(restored_by):
    def query(spark, sf_dir):
        x = masking.mask_spans(detected(spark, sf_dir)).filter(F.size("restore") > 0)
        reply = F.concat(F.lit("re [EMAIL_ADDRESS_99] and [SECTION_2]: "), F.col("masked"))
        return x.select("doc_id", S.restored(reply, F.col("restore"), restored_by).alias("restored"))

    return query


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; one of this machine only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = tempfile.mkdtemp(prefix="umbraframe-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def replies_join(spark, sf_dir):
    """A reply of the whole masked text to each document; to every third one more, of a key that no request has."""
    # Written, as both sides of the join would mask all documents.
    path = shared_path(spark, "masked")
    masking.mask_spans(detected(spark, sf_dir)).select("doc_id", "masked", "restore").write.parquet(path)
    x = spark.read.parquet(path)
    keys = F.when(F.col("doc_id") % 3 == 1, F.array(F.col("doc_id"), -1 - F.col("doc_id"))).otherwise(F.array("doc_id"))
    replies = x.select(F.explode(keys).alias("doc_id"), F.col("masked").alias("reply"))
    return masking.restore_replies(replies, x, "doc_id").select("doc_id", "restored")


def turns(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))), lambda t: t["text"])
    return c.groupBy("conv_id").agg(ordered.alias("fields"))


def join_split_fields(spark, sf_dir):
    x = turns(spark, sf_dir).withColumn("blob", S.joined_fields(F.col("fields")))
    back = S.split_fields(F.col("blob"), F.size("fields"))
    return x.select("conv_id", F.length("blob").alias("n_chars"), F.posexplode(back).alias("i", "field"))


def shared_fields(spark, sf_dir) -> DataFrame:
    """Requests of four neighbouring documents each, as fields of one numbering."""
    return docs(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 4).alias("request")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]).alias("fields"))


def mask_fields_shared_map(spark, sf_dir):
    x = masking.mask_fields(shared_fields(spark, sf_dir))
    return x.select("request", "status", F.size("restore").alias("n_spans"), F.posexplode_outer("masked_fields").alias("i", "masked"))


def separator_smuggle_drop(spark, sf_dir):
    x = turns(spark, sf_dir)
    x = x.withColumn("fields", F.when(F.col("conv_id") % 3 == 0, F.concat("fields", F.array(F.lit(f"a{S.SEPARATOR}b")))).otherwise(F.col("fields")))
    y = masking.mask_fields(x)
    return y.select("conv_id", "status", F.coalesce(F.size("masked_fields"), F.lit(-1)).alias("n_fields"))


def name_mask(scope):
    def query(spark, sf_dir):
        return docs(spark, sf_dir).select("doc_id", names.mask_name(F.col("text"), FIRST, LAST if scope == names.FULL else "", scope).alias("masked"))

    return query


def name_mask_transcript(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.concat(F.lit(HEADER + "\n"), F.coalesce("role", F.lit("")), F.lit("|"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[|\n]", " ")).alias("text"))
    return c.select("conv_id", "turn", names.mask_transcript(F.col("text"), HEADER, "thonti").alias("masked"))


def window_logits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Made-up logits in steps of a quarter of all words, in each window of the plan, at all of the model's widths."""
    w = words_with_offsets(spark, sf_dir).select(F.col("doc_id").alias("id"), "pos", "start", "end")
    n = F.col("last") - F.col("first")
    cells = window_plan(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("w").alias("window"), F.col("first").alias("first_word"), n.alias("n_words"))
    for name, last in (("start_word", F.col("n_words") - 1), ("width", F.lit(MAX_WIDTH - 1)), ("label_index", F.lit(len(S.LABELS) - 1))):
        cells = cells.withColumn(name, F.explode(F.sequence(F.lit(0), last)))
    value = (F.col("id") * 7 + (F.col("first_word") + F.col("start_word")) * 31 + F.col("width") * 1009 + F.col("label_index") * 613 + F.col("window") * 5) % 9973
    return cells.withColumn("logit", value.cast("double") / 4 - 2490), w


def logits_decode(spark, sf_dir):
    """Spans of whole texts by their windows; those in the words that two windows share come from each."""
    x = detect.decode_logits(*window_logits(spark, sf_dir), S.LABELS, 0.3)
    return x.select(F.col("id").alias("doc_id"), "window", "start", "end", "label", "width", "label_index")


def emoji_word(word, pos):
    """The word at a place, of which two in each seven are taken by emoji (the last of EMOJI only looks like one)."""
    return F.when(pos % 7 < 2, F.element_at(F.array(*[F.lit(e) for e in EMOJI]), (F.floor(pos / 7) % len(EMOJI) + 1).cast("int"))).otherwise(word)


def emoji_words(spark, sf_dir) -> DataFrame:
    """doc_id, pos, word, start, end of all words, some of them taken by emoji."""
    return words_with_offsets(spark, sf_dir).withColumn("word", emoji_word(F.col("word"), F.col("pos")))


def neutral_words(spark, sf_dir):
    return emoji_words(spark, sf_dir).select("doc_id", "pos", words.is_emoji(F.col("word")).alias("is_emoji"), words.neutral(F.col("word")).alias("encoded"))


def emoji_spans(spark, sf_dir):
    """Spans of one to three words from every word, summed by document and width; those of emoji only are dropped."""
    w = docs(spark, sf_dir).filter("doc_id IS NOT NULL").select("doc_id", words.words_with_offsets(F.col("text")).alias("w"))
    logits = F.array_repeat(F.lit(2.0), F.size("w") * 3)  # of each word at three widths, for the first label
    emoji = F.transform("w.text", lambda t, i: words.is_emoji(emoji_word(t, i)))
    windows = w.select(F.col("doc_id").alias("id"), F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), emoji.alias("is_emoji"), logits.alias("logits"))
    kept = detect.decode_rows(windows, S.LABELS[:1], 0.3, 3).groupBy(F.col("id").alias("doc_id"), "width")
    return kept.agg(F.count(F.lit(1)).alias("n_spans"), F.sum("start").alias("sum_start"), F.sum("end").alias("sum_end"))


def protect_exact(spark, sf_dir):
    """Spans but those whose whole text is that of the document's first."""
    first = F.transform(F.slice("spans", 1, 1), lambda s: S.part(F.col("text"), s["start"], s["end"]))
    x = overlapping(detected(spark, sf_dir)).withColumn("_first", first)
    return exploded(x.select("doc_id", S.not_equal_to(F.col("spans"), F.col("text"), F.col("_first")).alias("spans")))


def valid_spans(spark, sf_dir):
    """Spans, and beside each one that is reversed, empty, before the text or past its end, by the place it has."""
    k = lambda s: s["start"] % 4
    odd = F.transform("spans", lambda s: S.span(F.when(k(s) == 2, -1).when(k(s) == 1, s["end"]).otherwise(s["start"]), F.when(k(s) == 0, s["start"]).when(k(s) == 3, F.length("text") + s["start"] % 2).otherwise(s["end"]), s["label"]))
    return exploded(detected(spark, sf_dir).select("doc_id", S.valid(F.concat("spans", odd), F.col("text")).alias("spans")))


def restore_map_order(spark, sf_dir):
    x = masking.mask_spans(detected(spark, sf_dir))
    return x.select("doc_id", F.array_join(F.array_sort(F.map_keys("restore")), ",").alias("placeholders"))


def sql_functions(spark, sf_dir):
    """The SQL functions on the documents: names masked, replies restored, entities counted by the table function."""
    from umbraframe.functions.sql import register

    register(spark)
    masking.mask_spans(detected(spark, sf_dir)).select("doc_id", "text", "masked", "restore").createOrReplaceTempView("masked_documents")
    found = "(SELECT doc_id, count(*) AS n FROM masked_documents, LATERAL detect_pii(text) GROUP BY doc_id)"
    return spark.sql(f"""SELECT m.doc_id, mask_name(text, '{FIRST}', '', 'given') AS named, restore_pii(masked, restore) AS restored, CAST(coalesce(n, 0) AS INT) AS n_spans
        FROM masked_documents m LEFT JOIN {found} f ON m.doc_id = f.doc_id""")


def label_histogram(spark, sf_dir):
    return exploded(detected(spark, sf_dir)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def probe_verdict(spark, sf_dir):
    """For each document, anchors found in what its spans cover; the anchors here are parts of the test data."""
    x = detected(spark, sf_dir).withColumn("covered", F.when(F.length("text") > 0, F.transform("spans", lambda s: S.part(F.col("text"), s["start"], s["end"]))))
    y = masking.probe(x, ("@mail", "555-", ".1"))
    return y.select("doc_id", F.size("found").alias("n_found"), F.size("missed").alias("n_missed"), "passes")


def safe_component(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.regexp_replace("p_name", "[^A-Za-z0-9]", "-")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("COM1."), F.col("p_brand"))).otherwise(F.col("p_name")).alias("name"))
    return s.select("p_partkey", "name", by_row(models.safe_component, "boolean")("name").alias("ok"))


def pin_predecessor(spark, sf_dir):
    """Each order of a customer as a version: the one before it in the list of pins."""

    def before(versions):
        pins = [models.ModelPin(v, "", "", "", 1) for v in versions]
        return [p.version if p else "-1" for p in (models.predecessor(pins, v) for v in versions)]

    versions = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda o: o["o_orderkey"].cast("string"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(versions.alias("versions"))
    o = o.withColumn("previous", by_row(before, "array<string>")("versions"))
    o = o.select("o_custkey", F.explode(F.arrays_zip("versions", "previous")).alias("x"))
    return o.select("o_custkey", F.col("x.versions").cast("long").alias("o_orderkey"), F.col("x.previous").cast("long").alias("previous"))


def disk_budget(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("n_chars", F.lit(0)).cast("long").alias("n"))
    o = o.withColumn("x", by_row(lambda n: list(models.disk_needed(n)), "array<long>")("n"))
    return o.select("doc_id", F.col("x")[0].alias("to_install"), F.col("x")[1].alias("to_unpack"))


def file_digests(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", by_row(lambda t: models.digest_of(io.BytesIO(t.encode())), "string")("text").alias("sha256"))


def digest_compare(spark, sf_dir):
    """Digests against themselves in other letter cases, and against those of another text."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.sha2(F.col("p_name"), 256).alias("a"))
    p = p.withColumn("b", F.when(F.col("p_partkey") % 3 == 0, F.upper("a")).when(F.col("p_partkey") % 3 == 1, F.sha2(F.col("p_partkey").cast("string"), 256)).otherwise(F.col("a")))
    return p.select("p_partkey", by_row(models.same_digest, "boolean")("a", "b").alias("same"))


def progress(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("n"))
    return o.select("l_orderkey", "l_linenumber", by_row(models.progress, "double")("n", F.lit(32)).alias("share"))


def failure_kinds(spark, sf_dir):
    """The kind of each order's made-up failure, by its key."""
    made = (lambda: OSError(errno.ENOSPC, ""), lambda: PermissionError(errno.EACCES, ""), lambda: TimeoutError(), lambda: ConnectionResetError(), lambda: OSError(errno.EROFS, ""), lambda: ValueError(), lambda: models.InstallError("offline"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return o.select("o_orderkey", by_row(lambda k: models.classify(made[k % 7]()), "string")("o_orderkey").alias("kind"))


def pin_plausible(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.regexp_replace("p_name", " ", "_")).otherwise(F.col("p_name")).alias("version"), ((F.col("p_partkey") % 5) * 25_000_000_000 - 25_000_000_000).alias("size"))
    return p.select("p_partkey", by_row(lambda v, n: models.ModelPin(v, "", "", "", n).plausible(), "boolean")("version", "size").alias("plausible"))


def decisions(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/orders.parquet")
    value = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))
    return x.select("o_orderkey", masking.decision(value, F.col("o_orderkey") % 7 == 0).alias("status"))


def sanitize(spark, sf_dir):
    x = masking.sanitize(docs(spark, sf_dir).withColumn("text", F.concat(F.lit("  "), F.col("text"), F.lit("\n"))))
    return x.select("doc_id", "masked")


def mask_stream_smoke(spark, sf_dir):
    """The documents as a stream: read, masked and written by micro-batches, then read back."""
    from umbraframe.streaming.masking import start

    out = shared_path(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents*.parquet").select("doc_id", "text")
    start(stream, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("doc_id", "status", "masked")
