"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of 16 or more characters of ``[A-Za-z0-9+/_=-]``, cut at placeholder words such as ``example``, so that those
never hide what stands beside them. Its class is hex (hex digits of one case), base32 or base64 (the rest). A window slides over it
by one character; the counts of its characters change by the one that enters and the one that leaves, and so does the sum
of c * log2(c) from which the entropy follows. Candidates of 24 characters or more take a window of 24, shorter ones of 16.
Windows at or over the class's threshold are joined into spans, unless the candidate is on the allow-list.
Only DataFrame operations; one pass over the texts, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraframe.llm.common import joined_spans, kind_spans, matches, sql_matches, sql_quoted, table, whole_text

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy maximal runs: asking for the least length in the pattern keeps the same matches.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: class, in the order in which they are tried -> (pattern of the whole candidate, (characters in a window, least bits a character) for long, then for short ones)
CLASSES = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", ((24, 3.0), (16, 2.9))),
    "base32": (r"^[A-Z2-7]+=*$", ((24, 3.7), (16, 3.5))),
    "base64": (r"^.*$", ((24, 3.9), (16, 3.7))),
}
#: Candidates are cut at these.
PLACEHOLDERS = r"(?i:example|placeholder|changeme|your_|dummy|xxxxxx)"
#: Candidates that are no secrets: digits, one letter case only, UUIDs, paths of words.
ALLOWED = (
    r"^[0-9_=+/-]+$",
    r"^[a-z_=+/-]+$",
    r"^[A-Z]?[a-z_=+/-]+$",
    r"^[A-Z_=+/-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)


def high_entropy(candidate: Column, window: int, least: float) -> Column:
    """array<struct<start,end>> (0-based in the candidate) of its joined windows of ``least`` bits or more."""
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    codes = F.filter(codes, lambda c: c > 0)

    def f(c):  # c * log2(c), 0 for 0
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    zero = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"),
        F.lit(0.0).alias("clogc"),
        F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
    )

    def step(acc, x):
        new, old = x["new"], x["old"]
        counts = acc["counts"]
        gone = F.when(old > 0, F.element_at(counts, old + 1)).otherwise(F.lit(0))
        came = F.element_at(counts, new + 1) - F.when(new == old, 1).otherwise(0)
        clogc = acc["clogc"] + F.when(old > 0, f(gone - 1) - f(gone)).otherwise(F.lit(0.0)) + f(came + 1) - f(came)
        after = F.transform(counts, lambda v, i: v + F.when(i == new, 1).otherwise(0) - F.when((old > 0) & (i == old), 1).otherwise(0))
        end = acc["at"] + 1
        bits = F.lit(float(window)).cast("double")
        hot = (end >= window) & ((F.log2(bits) - clogc / bits) >= F.lit(least - 1e-9))
        last = F.try_element_at(acc["spans"], F.lit(-1))
        joined = F.when(
            hot & last.isNotNull() & (last["end"] >= end - window),
            F.concat(F.slice(acc["spans"], F.lit(1), F.size(acc["spans"]) - 1), F.array(F.struct(last["start"].alias("start"), end.alias("end")))),
        ).when(hot, F.concat(acc["spans"], F.array(F.struct((end - window).alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct(after.alias("counts"), clogc.alias("clogc"), end.alias("at"), joined.alias("spans"))

    leaving = F.concat(F.array_repeat(F.lit(0), window), codes)
    steps = F.zip_with(codes, F.slice(leaving, F.lit(1), F.size(codes)), lambda n, o: F.struct(n.alias("new"), o.alias("old")))
    return F.aggregate(steps, zero, step, lambda acc: acc["spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: dict = CLASSES, allowed: tuple = ALLOWED) -> DataFrame:
    """One row per input row: doc_id, base (array of pattern spans), found (all spans, entropy spans too).

    Spans are structs (start, ord, end, kind) in code points. An entropy span inside a pattern span is not
    repeated. Defined cases: a null text is empty; an empty text or table has no spans; a run of one repeated
    character has no entropy and gives none; repeated rows each get a row; other columns are ignored.
    """
    text = whole_text(text_col)
    raw = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).select(
        "doc_id",
        matches(F.col("_text"), ASSIGN).alias("_assign"),
        matches(F.col("_text"), ACCESS).alias("_access"),
        matches(F.col("_text"), HEX).alias("_hex"),
        matches(F.col("_text"), CANDIDATE).alias("_candidates"),
    )
    assigned = F.filter("_assign", lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= 8)
    based = raw.withColumn("base", F.concat(kind_spans(assigned, "assign", 0), kind_spans(F.col("_access"), "access", 1), kind_spans(F.col("_hex"), "hex", 2)))

    none = F.array().cast("array<struct<start:int,end:int>>")
    part = lambda start, end, value: F.struct(start.alias("start"), F.substring(value, start + 1, end - start).alias("value"))

    def cut(m):
        """(start in the text, string) of what stands around the placeholders of a candidate."""
        value, whole = m["value"], F.array(F.struct(F.lit(0).alias("start"), m["value"].alias("value")))
        ends = F.transform(matches(value, PLACEHOLDERS), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
        around = lambda at: F.zip_with(F.concat(F.array(F.lit(0)), at["end"]), F.concat(at["start"], F.array(F.length(value))), lambda s, e: part(s, e, value))
        parts = F.when(value.rlike(PLACEHOLDERS), F.transform(F.array(ends), around)[0]).otherwise(whole)
        return F.transform(parts, lambda p: F.struct((m["start"] + p["start"]).alias("start"), p["value"].alias("value")))

    def hot(p):
        value, spans = p["value"], none
        for pattern, windows in reversed(classes.values()):
            found = none
            for window, least in reversed(windows):
                found = F.when(F.length(value) >= window, high_entropy(value, window, least)).otherwise(found)
            spans = F.when(value.rlike(pattern), found).otherwise(spans)
        barred = F.lit(False)
        for pattern in allowed:
            barred = barred | value.rlike(pattern)
        spans = F.when(barred, none).otherwise(spans)
        return F.transform(spans, lambda s: F.struct((p["start"] + s["start"]).alias("start"), F.lit(3).alias("ord"), (p["start"] + s["end"]).alias("end"), F.lit("entropy").alias("kind")))

    based = based.withColumn("_parts", F.flatten(F.transform("_candidates", cut)))
    entropic = F.flatten(F.transform("_parts", hot))
    new = F.when(F.size("_candidates") > 0, F.filter(entropic, lambda e: ~F.exists("base", lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"])))).otherwise(F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>"))
    return based.select("doc_id", "base", F.concat("base", new).alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("found")).alias("spans"))


def _sql() -> str:
    """The same by definition: the entropy of every window from its own counts."""
    kinds = [sql_matches("assign", 0, ASSIGN, f"length(regexp_extract(value, '{sql_quoted(ASSIGN)}', 2)) >= 8"), sql_matches("access", 1, ACCESS), sql_matches("hex", 2, HEX)]
    def longest_of(f):
        return "CASE " + " ".join(f"WHEN regexp_matches(value, '{p}') THEN CASE " + " ".join(f"WHEN length(value) >= {w} THEN {f(w, least)}" for w, least in ws) + " END" for p, ws in CLASSES.values()) + " END"

    barred = " OR ".join(f"regexp_matches(value, '{p}')" for p in ALLOWED)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({" UNION ALL ".join(kinds)}),
c AS ({sql_matches("entropy", 3, CANDIDATE)}),
cuts AS (SELECT r, start, string_split_regex(value, '{PLACEHOLDERS}') AS gs, regexp_extract_all(value, '{PLACEHOLDERS}') AS ms FROM c),
parts AS (SELECT r, start + list_sum(list_transform(gs[1:j], lambda x: length(x))) - length(gs[j]) + coalesce(list_sum(list_transform(ms[1:j-1], lambda x: length(x))), 0) AS start, gs[j] AS value
  FROM (SELECT *, unnest(range(1, len(gs) + 1)) AS j FROM cuts)),
ruled AS (SELECT r, start, value, {longest_of(lambda w, least: w)} AS n, {longest_of(lambda w, least: least)} AS least FROM parts WHERE length(value) >= 16 AND NOT ({barred})),
windows AS (SELECT *, unnest(range(0, length(value) - n + 1)) AS k FROM ruled),
counts AS (SELECT r, start, n, least, k, ch, count(*) AS x FROM (SELECT *, unnest(string_split(substr(value, k + 1, n), '')) AS ch FROM windows) GROUP BY ALL),
hot AS (SELECT r, start, n, k FROM counts GROUP BY r, start, n, least, k HAVING -sum(x * 1.0 / n * log2(x * 1.0 / n)) >= least - 1e-9),
fresh AS (SELECT *, CASE WHEN k <= lag(k) OVER (PARTITION BY r, start ORDER BY k) + n THEN 0 ELSE 1 END AS new_ FROM hot),
islands AS (SELECT *, sum(new_) OVER (PARTITION BY r, start ORDER BY k) AS island FROM fresh),
entropy AS (SELECT r, 'entropy' AS kind, 3 AS ord, start + min(k) AS start, start + max(k) + any_value(n) AS "end" FROM islands GROUP BY r, start, island),
kept AS (SELECT * FROM entropy e WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = e.r AND b.start <= e.start AND e."end" <= b."end")),
b AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, ord) AS s FROM base GROUP BY r),
a AS (SELECT r, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, ord) AS s FROM (SELECT r, kind, ord, start, "end" FROM base UNION ALL SELECT r, kind, ord, start, "end" FROM kept) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(a.s, '') AS spans
FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r)
"""


SQL = _sql()
