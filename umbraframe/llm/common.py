"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraframe.functions.shipping import ship

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Matches of a text that one fold gathers.
BLOCK = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); where none is named, a temporary one on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        path = tempfile.mkdtemp(prefix="umbraframe-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that operators have written within it. What is returned from within must be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        release_memory()
        release_heap(spark)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with the :func:`scratch` it belongs to, if any."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read again: cuts the lineage durably."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    release_heap(spark)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(col: str | Column = "text") -> Column:
    """A text with null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def matches(text: Column, pattern: str | Column) -> Column:
    """array<struct<start,end,value>> of leftmost non-overlapping matches, in code points, end exclusive.

    Catalyst has no positions of matches; they follow from the lengths of what lies between matches
    (``split``) and of the matches themselves, which both walk the same matcher.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    spans = "array<struct<start:int,end:int,value:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    def moved(block, by):
        return F.transform(block["out"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))

    def shifted(blocks):
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        before = F.aggregate(blocks, none, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, before, moved))

    # A fold copies what it has gathered at each step, so it runs over blocks of matches, and once over the blocks.
    # The arrays of one element bind a value to a name: a lambda evaluates what it names anew for each element.
    pairs = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, g: F.struct(g.alias("gap"), m.alias("value")))
    blocks = F.transform(F.array(pairs), lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: F.aggregate(F.slice(p, i * BLOCK + 1, F.lit(BLOCK)), zero, step)))
    return F.when(F.size(found) > 0, F.transform(blocks, shifted)[0]).otherwise(F.array().cast(spans))


def kind_spans(found: Column, kind: str, order: int) -> Column:
    """Spans of one kind, comparable by start, then order of kinds."""
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("ord"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` by start, then order of kinds, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sql_quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def sql_matches(kind: str, order: int, pattern: str, keep: str = "true") -> str:
    """DuckDB's (r, kind, ord, value, start, end) of a pattern's matches in d (r, text)."""
    p = sql_quoted(pattern)
    return f"""(SELECT r, '{kind}' AS kind, {order} AS ord, value, start, start + length(value) AS "end" FROM (
  SELECT r, ms[i] AS value, list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda m: length(m))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gs FROM d) WHERE len(ms) > 0)) WHERE {keep})"""


def release_memory() -> None:
    """Gives back to the system what earlier stages of this Python worker have freed: workers are used again and again."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: What the last collection of :func:`release_heap` left committed.
_LEFT = [0]


def release_heap(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage once its heap holds more than half of its bound.

    Plans, task metrics and broadcasts of finished jobs are garbage that the JVM lets grow to the bound; a full collection
    gives that memory back to the system and lets Spark delete the shuffle files of tables that are gone. Where live objects hold
    the heap up, it is not collected again before it grows by a quarter.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > max(runtime.maxMemory() // 2, _LEFT[0] * 5 // 4):
        spark._jvm.System.gc()
        _LEFT[0] = runtime.totalMemory()


def ready(df: DataFrame) -> DataFrame:
    """``df``, once the Python workers can import this package."""
    ship(df.sparkSession)
    return df
