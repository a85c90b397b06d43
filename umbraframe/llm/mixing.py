"""Mixing sources to target weights by Pareto order sampling.

A document's expected number of copies falls with its length: min(``MAX_COPIES``, c / (1 + bits of its size)), where c is such
that its source's expected words are the source's target. So a few very long documents do not fill a source's share. The whole
part is allotted with certainty. The rest, a fraction f that differs between the documents of a source, is the inclusion
probability of one more copy: documents are ranked by random odds divided by inclusion odds, ``(u / (1 - u)) / (f / (1 - f))``,
and taken in that order while their words fit what is left of the target, so each source's sample has a fixed size in words.
What a whole document too many would miss is closed in ``ROUNDS`` rounds: each adds (or, past the target, gives back) the one
copy whose size is nearest to the gap, where that brings the source nearer to its target.

No source is gathered into one task: words are summed by source and by one of ``BUCKETS`` slices of the rank, which finds the
slice in which the target is crossed; only that slice is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from umbraframe.llm.common import WORD, table, whole_text, written

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = "mix-1"
BUCKETS = 4096
SALTS = 32
ROUNDS = 4


def size_of(col: str = "text") -> Column:
    return F.regexp_count(whole_text(col), F.lit(WORD)).cast("long")


def random_of(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from seed and id: 52 bits of MD5, the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target from (source, source_size): a table with one row a source.

    Targets share the total by weight, weights repeating over sources by code point with null last; what
    exceeds ``max_copies`` times a source's size is reshared by weight. In the order of cap / weight the capped
    sources come first, so one running sum finds the level at which none is above its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, everything = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = caps.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    )
    level = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return levels.withColumn("_level", level).select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce("_level", F.lit(float("inf")))).alias("target"))


def _with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Each row with its source's columns. Rows of one source are dealt over SALTS keys, as one may hold a third of all."""
    spread = per_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "_source")
    salted = rows.withColumn("_salt_of", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt_of") == F.col("_salt"))).drop("_source", "_salt", "_salt_of")


def share_of(size: Column) -> Column:
    """What a document's expected copies are in proportion to within its source: one part in 1 + the bits of its size."""
    return F.lit(1.0) / (F.length(F.bin(size)) + 1)


def expected_copies(max_copies: int) -> Column:
    """Of a row with its source's source_size, target and level."""
    return F.when(F.col("target") >= F.col("source_size") * max_copies, F.when(F.col("source_size") > 0, F.lit(float(max_copies))).otherwise(0.0)).otherwise(F.least(F.lit(float(max_copies)), F.col("level") * share_of(F.col("size"))))


def source_levels(by_bits: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """source, source_size, target, level (the c of the module's text) and rest, the words of the target beyond whole copies.

    by_bits: source, bits, size (any of that many bits), words: a few rows a source. In the order of bits the documents
    that reach ``max_copies`` come first, so one running sum finds the level.
    """
    each = by_bits.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("share", share_of(F.col("size")))
    order = Window.partitionBy("source").orderBy("bits")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    filled = (F.col("target") - max_copies * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.nullif(F.sum(F.col("share") * F.col("words")).over(after), F.lit(0.0))
    each = each.withColumn("_level", filled)
    level = F.min(F.when(max_copies / F.col("share") >= F.col("_level"), F.struct("bits", "_level"))).over(Window.partitionBy("source"))["_level"]
    each = each.withColumn("level", F.coalesce(level, F.lit(float("inf"))))
    whole = F.floor(expected_copies(max_copies)) * F.col("words")
    return each.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("level").alias("level"), (F.first("target") - F.sum(whole)).alias("rest"))


def plan_rows(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """Copies for rows (_row, doc_id, source, size), a table that has been written: _row, doc_id, source, size, source_size, target, copies."""
    by_bits = written(rows.groupBy("source", F.length(F.bin("size")).alias("bits")).agg(F.max("size").alias("size"), F.sum("size").alias("words")), "mix-bits")
    targets = source_targets(by_bits.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_copies)
    targets = written(source_levels(by_bits, targets, max_copies), "mix-targets")
    ranked = _with_source(rows.withColumn("u", random_of(F.col("doc_id"), seed)), targets)
    ranked = ranked.withColumn("_expected", expected_copies(max_copies)).withColumn("whole", F.floor("_expected")).withColumn("f", F.col("_expected") - F.col("whole")).drop("_expected", "level")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("f") / (1 - F.col("f")))
    ranked = ranked.withColumn("rank", F.when(F.col("f") > 0, odds)).withColumn("slice", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS).cast("int"))
    ranked = written(ranked.drop("u"), "mix-ranked")
    up_to = Window.partitionBy("source").orderBy("slice")
    crossed = (
        ranked.filter("f > 0").groupBy("source", "slice").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        .withColumn("upto", F.sum("words").over(up_to))
        .filter("upto > rest")
        .groupBy("source")
        .agg(F.min(F.struct("slice", (F.col("upto") - F.col("words")).alias("before"))).alias("x"))
        .select("source", F.col("x.slice").alias("cross"), F.col("x.before").alias("before"))
    )
    edges = targets.select("source").join(crossed.withColumnRenamed("source", "_c"), F.col("source").eqNullSafe(F.col("_c")), "left")
    edges = edges.select("source", F.coalesce("cross", F.lit(BUCKETS + 1)).alias("cross"), F.coalesce("before", F.lit(0)).alias("before"))
    marked = _with_source(ranked, written(edges, "mix-edges"))
    tied = Window.partitionBy("source").orderBy("rank", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, 0)
    edge = marked.filter("f > 0 AND slice = cross").withColumn("_upto", F.col("before") + F.sum("size").over(tied)).filter("_upto <= rest").select(F.col("_row").alias("_in"))
    marked = marked.join(edge, F.col("_row") == F.col("_in"), "left").withColumn("extra", F.when((F.col("f") > 0) & ((F.col("slice") < F.col("cross")) | F.col("_in").isNotNull()), 1).otherwise(0))
    marked = written(marked.drop("_in", "cross", "before", "slice"), "mix-marked")
    # The one copy that best closes what is left: a minimum by source, combined before the shuffle. One row a source and round.
    gaps = marked.groupBy("source").agg((F.first("rest") - F.sum(F.col("extra") * F.col("size"))).alias("gap"))
    closing = None
    for _ in range(ROUNDS):
        gaps = written(gaps, "mix-gaps")
        free = marked.filter("f > 0 AND size > 0")
        if closing is not None:
            free = free.join(closing.select(F.col("_closes")), F.col("_row") == F.col("_closes"), "left_anti")
        apart, far = F.abs(F.col("size") - F.abs("gap")), F.abs("gap")
        best = (
            _with_source(free, gaps)
            .filter((apart < far) & (F.col("extra") == F.when(F.col("gap") > 0, 0).otherwise(1)))
            .groupBy("source")
            .agg(F.min(F.struct(apart.alias("apart"), "rank", "doc_id", "_row", "size", F.signum("gap").alias("by"))).alias("x"))
            .select("source", F.col("x._row").alias("_closes"), F.col("x.size").alias("_size"), F.col("x.by").cast("int").alias("_by"))
        )
        best = written(best, "mix-closing")
        closing = best if closing is None else closing.unionByName(best)
        gaps = gaps.join(best.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", (F.col("gap") - F.coalesce(F.col("_by") * F.col("_size"), F.lit(0))).alias("gap"))
    copies = F.col("whole") + F.col("extra") + F.coalesce("_by", F.lit(0))
    return marked.join(closing.select("_closes", "_by"), F.col("_row") == F.col("_closes"), "left").select("_row", "doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source.

    Defined cases: a null source is a source of its own, last in order; a null text has size 0; documents of
    size 0 take 0 words; sources of size 0 have target 0; repeated rows count each; ties in rank go by id, then
    size; an empty table gives no rows. No document takes more than ``max_copies`` times its size.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), F.monotonically_increasing_id().alias("_row"))
    plan = plan_rows(written(slim, "mix-sizes"), weights, max_copies, seed)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """The mixed table: each document as often as it is taken, with its own columns."""
    numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    slim = written(numbered.select("doc_id", "source", size_of().alias("size"), "_row"), "mix-sizes")
    copies = plan_rows(slim, weights, max_copies, seed).filter("copies > 0").select(F.col("_row").alias("_of"), "copies")
    return numbered.join(copies.hint("merge"), F.col("_row") == F.col("_of")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


_START = r"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS k FROM d GROUP BY source
), c AS (
  SELECT *, CAST(1 + (k - 1) % 3 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c
), t AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, cap / weight) FROM l WHERE cap / weight >= level)) AS target FROM l
), n AS (
  SELECT source, length(bin(size)) AS bits, CAST(sum(size) AS DOUBLE) AS words, 1.0::DOUBLE / (1 + length(bin(size))) AS share FROM d GROUP BY source, bits
), o AS (
  SELECT n.*, t.source_size, t.target,
         (t.target - 3 * coalesce(sum(words) OVER (PARTITION BY n.source ORDER BY bits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / nullif(sum(share * words) OVER (PARTITION BY n.source ORDER BY bits ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS filled
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT source, any_value(source_size) AS source_size, any_value(target) AS target,
         coalesce(arg_min(filled, bits) FILTER (WHERE 3 / share >= filled), 'inf'::DOUBLE) AS level FROM o GROUP BY source
), e AS (
  SELECT o.*, q.level, CASE WHEN o.target >= 3 * o.source_size THEN CASE WHEN o.source_size > 0 THEN 3.0::DOUBLE ELSE 0 END ELSE least(3.0::DOUBLE, q.level * share) END AS expected
  FROM o JOIN q ON o.source IS NOT DISTINCT FROM q.source
), f AS (
  SELECT source, bits, source_size, target, floor(expected) AS whole, expected - floor(expected) AS f, target - sum(floor(expected) * words) OVER (PARTITION BY source) AS rest FROM e
), a AS (
  SELECT d.*, f.source_size, f.target, f.whole, f.f, f.rest, CASE WHEN f.f > 0 THEN (d.u / (1 - d.u)) / (f.f / (1 - f.f)) END AS rank
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source AND length(bin(d.size)) = f.bits
), m0 AS (
  SELECT *, CASE WHEN f > 0 AND sum(CASE WHEN f > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size, r ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS extra,
         0 AS more FROM a
)"""
#: One round of closing: the copy to add to or to take from each source.
_ROUND = """, g{k} AS (
  SELECT source, any_value(rest) - sum((extra + more) * size) AS gap FROM m{j} GROUP BY source
), x{k} AS (
  SELECT r, gap FROM (
    SELECT m.r, g.gap, row_number() OVER (PARTITION BY m.source ORDER BY abs(m.size - abs(g.gap)), m.rank, m.doc_id, m.r) AS n
    FROM m{j} m JOIN g{k} g ON m.source IS NOT DISTINCT FROM g.source
    WHERE m.more = 0 AND m.extra = CASE WHEN g.gap > 0 THEN 0 ELSE 1 END AND m.f > 0 AND m.size > 0 AND abs(m.size - abs(g.gap)) < abs(g.gap)
  ) WHERE n = 1
), m{k} AS (
  SELECT m.* EXCLUDE (more), more + coalesce(CAST(sign(x.gap) AS INTEGER), 0) AS more FROM m{j} m LEFT JOIN x{k} x USING (r)
)"""
_END = f"""
SELECT doc_id, size, source_size, target, CAST(whole + extra + more AS INTEGER) AS copies, CAST(whole + extra + more AS BIGINT) * size AS taken, source FROM m{ROUNDS}
"""
SQL = _START + "".join(_ROUND.format(k=k, j=k - 1) for k in range(1, ROUNDS + 1)) + _END
