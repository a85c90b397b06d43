"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that give entities away.

The protected entities are the values that the patterns find. A term (three or more letters, lower case, outside
e-mail addresses) co-occurs with each entity of its document, wherever they stand. Over the whole corpus,

* n(t, e): documents that hold t and e, of at least ``SUPPORT`` different texts,
* n(t): documents that hold t, n(e): documents that hold e, N: all documents (every row is a document in all four),
* disclosure of e by t: P(e | t) = n(t, e) / n(t), and the information log2(P(e | t) / P(e)) in bits.

A term of at least ``BITS`` bits and P(e | t) of at least ``GENERALISE`` is generalised, from ``REMOVE`` on
removed, wherever it stands, beside the patterns' own spans. Only DataFrame operations. The patterns run once over each text; what
they find is written, with the texts that hold an entity. Terms are gathered from those, and only terms that can still pass
are counted corpus-wide: beside a broadcast table of them while it is within ``BROADCAST_ROWS`` and ``BROADCAST_BYTES``,
beyond that from counts of all words that are combined before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraframe.llm.common import joined_spans, kind_spans, matches, sql_matches, table, whole_text, written

LOCAL = r"[A-Za-z0-9._%+-]"
#: A match starts at the end of the one before or where a run starts: no start inside a run can be leftmost.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: As for emails: a start inside a run of digits is never leftmost, and no run is given back.
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Greedy maximal runs: asking for the least number of digits keeps the same matches. Possessive loops need no stack.
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{3,}"

SUPPORT = 3
BITS = 4.0
GENERALISE = 0.5
REMOVE = 0.9
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16_000_000
SALTS = 32
KINDS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "cut": ""}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def step(acc, i):
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, d * 2).otherwise(d)
        return acc + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0


def small_ip(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> array<struct<start,end,value>> by the fixed patterns, in the order of kinds."""
    n = lambda m: F.length(digits(m["value"]))
    held = lambda mark, found: F.when(text.contains(mark), found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
    return {
        "email": held("@", matches(text, EMAIL)),
        "ip": F.filter(matches(text, IP), lambda m: small_ip(m["value"])),
        "card": F.filter(matches(text, CARD), lambda m: (n(m) >= 14) & (n(m) <= 19) & luhn(digits(m["value"]))),
        "phone": held("+", F.filter(matches(text, PHONE), lambda m: (n(m) >= 10) & (n(m) <= 15))),
    }


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that name a row by its id and text; rows that repeat share it."""
    name = F.when(doc_id.isNull(), F.lit("n")).otherwise(F.concat(F.lit("i"), doc_id.cast("string")))
    return F.unhex(F.md5(F.concat(name, F.lit("\0"), text).cast("binary")))


def _entities() -> Column:
    """The different entities of a row of found spans."""
    def named(kind):
        plain = {"email": F.lower, "ip": lambda v: v}.get(kind, digits)
        return lambda m: F.concat(F.lit(f"{kind}:"), plain(m["value"]))

    return F.array_distinct(F.concat(*[F.transform(kind, named(kind)) for kind in ("email", "ip", "card", "phone")]))


def _words_of(text: Column) -> Column:
    """Different terms; of the patterns' spans, only those of e-mail addresses have letters."""
    outside = F.when(text.contains("@"), F.regexp_replace(text, EMAIL, " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(outside), F.lit(TERM), F.lit(0)))


def _small(terms: DataFrame) -> bool:
    """Whether a written table of terms may be broadcast: by its rows and its bytes."""
    rows, size = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def candidate_pairs(told: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(term, entity, n_both) that can still pass, and (entity, n_entity), with entities by number.

    told: _row, _told (the text), entities, of every row with an entity. Bounds that lose no term spare the corpus-wide count
    most of them: n(t, e) is at most n(e), the information at most log2(1 / P(e)), and n(t) at least the documents in which
    t stands with any entity.
    """
    held_by = told.select("_row", F.xxhash64("_told").alias("_sha"), F.explode("entities").alias("name")).groupBy("_row", "_sha", "name").agg(F.count(F.lit(1)).alias("_n"))
    found = held_by.groupBy("name").agg(F.sum("_n").alias("n_entity"), F.countDistinct("_sha").alias("n_texts"), *[F.bit_xor(F.xxhash64("_row", F.lit(i))).alias(f"_rows{i}") for i in (0, 1)])
    found = found.filter((F.col("n_texts") >= SUPPORT) & (F.col("n_entity") * F.lit(2.0**BITS) <= total * (1 + 1e-9)))
    # Entities of the same documents have the same counts with every term; one stands for them.
    found = written(found.groupBy("n_entity", "_rows0", "_rows1").agg(F.min("name").alias("name")).select("name", "n_entity", F.monotonically_increasing_id().alias("entity")), "pii-entities")
    most = found.agg(F.max("n_entity")).first()[0] or 0
    of = held_by.select(F.col("_row").alias("_held"), "name").join(found, "name").groupBy("_held").agg(F.collect_list(F.struct("entity", "n_entity")).alias("_of"))
    of = written(of, "pii-held-by")
    beside = told.join(of.select("_held"), F.col("_row") == F.col("_held"), "left_semi").select("_row", F.xxhash64("_told").alias("_sha"), F.explode(_words_of(F.col("_told"))).alias("term"))
    beside = written(beside, "pii-beside")
    near = beside.groupBy("term").agg(F.count(F.lit(1)).alias("n_near")).filter((F.col("n_near") >= SUPPORT) & (F.col("n_near") * GENERALISE <= most))
    # Only a term's entities of enough documents: a row's words meet its entities after the bounds.
    met = beside.join(near, "term").join(of, F.col("_row") == F.col("_held"))
    met = met.select("term", "_sha", "n_near", F.explode(F.filter("_of", lambda e: e["n_entity"] >= F.col("n_near") * GENERALISE)["entity"]).alias("entity"))
    pairs = met.groupBy("term", "entity", "n_near").agg(F.count(F.lit(1)).alias("n_both"), F.countDistinct("_sha").alias("n_texts"))
    pairs = pairs.filter((F.col("n_both") >= SUPPORT) & (F.col("n_texts") >= SUPPORT) & (F.col("n_both") / F.col("n_near") >= GENERALISE))
    return written(pairs.select("term", "entity", "n_both"), "pii-pairs"), found.select("entity", "n_entity")


def disclosing_terms(docs: DataFrame, told: DataFrame) -> DataFrame:
    """(_row, term, cut) for each row that holds a term over a threshold. docs: _row, _text; told: as of :func:`candidate_pairs`."""
    total = docs.select("_row").count()
    pairs, entities = candidate_pairs(told, total)
    terms = written(pairs.select("term").distinct(), "pii-terms")
    words = docs.select("_row", F.explode(_words_of(F.col("_text"))).alias("term"))
    held = None
    if not terms.head(1):
        n_term = terms.select("term", F.lit(0).cast("long").alias("n_term"))
    elif _small(terms):
        held = written(words.join(F.broadcast(terms), "term"), "pii-held")
        n_term = held.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    else:
        n_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).join(terms, "term")
    scored = pairs.join(n_term, "term").join(entities, "entity").withColumn("p", F.col("n_both") / F.col("n_term"))
    scored = scored.withColumn("bits", F.log2(F.col("p") / (F.col("n_entity") / F.lit(float(max(total, 1))))))
    over = scored.filter((F.col("p") >= GENERALISE) & (F.col("bits") >= BITS)).groupBy("term").agg((F.max("p") >= REMOVE).alias("cut"))
    over = written(over, "pii-over")
    if not over.head(1):
        return docs.select("_row").limit(0).select("_row", F.lit("").alias("term"), F.lit(False).alias("cut"))
    held = words if held is None else held
    if _small(over):
        return held.join(F.broadcast(over), "term").select("_row", "term", "cut")
    # One term may stand in very many rows: both sides are salted.
    salted = over.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return held.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(salted, ["term", "_salt"]).select("_row", "term", "cut")


def term_spans(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """_of_row and terms, the spans (start, ord, end, kind) of the terms that each row holds; one row for each that holds some."""
    held = written(rows.groupBy("_row").agg(F.collect_set(F.struct("term", "cut")).alias("_terms")).withColumnRenamed("_row", "_held"), "pii-rows")
    texts = docs.join(held, F.col("_row") == F.col("_held"))
    cut = F.transform(F.filter("_terms", lambda t: t["cut"]), lambda t: t["term"])
    any_term = F.concat(F.lit(r"(?U)(?<!\p{L})(?i:"), F.array_join(F.transform("_terms", lambda t: t["term"]), "|"), F.lit(r")(?!\p{L})"))
    texts = texts.select("_held", "_text", cut.alias("_cut"), any_term.alias("_pattern")).select("_held", "_cut", matches(F.col("_text"), F.col("_pattern")).alias("_at"))
    gone = lambda m: F.array_contains(F.col("_cut"), F.lower(m["value"]))
    at = F.transform("_at", lambda m: F.struct(m["start"].alias("start"), F.when(gone(m), 5).otherwise(4).alias("ord"), m["end"].alias("end"), F.when(gone(m), "cut").otherwise("term").alias("kind")))
    return written(texts.select(F.col("_held").alias("_of_row"), at.alias("terms")).dropDuplicates(["_of_row"]), "pii-term-spans")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, _row (see :func:`row_key`), base (pattern spans), found (all spans) as structs (start, ord, end, kind).

    Kinds beside the patterns' are ``term`` (to generalise) and ``cut`` (to remove). A term inside a pattern's
    span is not repeated. Defined cases: a null text is empty; empty texts and tables have no spans; repeated
    rows each get a row and count as a document each in every count, but copies of one text never suffice as support; other columns
    are ignored.
    """
    text = whole_text(text_col)
    numbered = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), row_key(F.col(id_col), text).alias("_row"))
    kinds = ("email", "ip", "card", "phone")
    spotted = numbered.select("*", *[c.alias(k) for k, c in base_spans(F.col("_text")).items()])
    some = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    spotted = written(spotted.select("doc_id", "_row", *kinds, F.when(some, F.col("_text")).alias("_told")), "pii-spans")
    told = spotted.filter("_told IS NOT NULL").select("_row", "_told", _entities().alias("entities"))
    rows = disclosing_terms(numbered.select("_row", "_text"), told)
    base = F.concat(*[kind_spans(F.col(k), k, i) for i, k in enumerate(kinds)])
    based = spotted.select("doc_id", "_row", base.alias("base"))
    if not rows.head(1):
        return based.withColumn("found", F.col("base"))
    joined = based.join(term_spans(numbered, rows), F.col("_row") == F.col("_of_row"), "left")
    new = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.select("doc_id", "_row", "base", F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.concat("base", new)).alias("found"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with each span replaced by its kind's label; of overlapping spans the first, then longest, counts."""
    spans = F.array_sort("found")
    labels = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(F.col("_text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.element_at(labels, s["kind"])).alias("out")))

    done = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.length("_text"))))
    text = whole_text(text_col)
    numbered = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), row_key(F.col(id_col), text).alias("_row"))
    spans_of = find(docs, id_col, text_col).select(F.col("_row").alias("_of"), "found").dropDuplicates(["_of"])
    return numbered.join(spans_of, F.col("_row") == F.col("_of")).select("doc_id", done.alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("found")).alias("spans"))


def _sql() -> str:
    """The same by definition: all pairs of terms and entities counted over all documents, without any bound."""
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    number = "regexp_replace(value, '[^0-9]', '', 'g')"
    twice = "2 * CAST(substr(n, j, 1) AS INTEGER)"
    luhn = f"list_sum(list_transform(range(1, length(n) + 1), lambda j: CASE WHEN (length(n) - j) % 2 = 0 THEN CAST(substr(n, j, 1) AS INTEGER) WHEN {twice} > 9 THEN {twice} - 9 ELSE {twice} END)) % 10 = 0".replace("n, j", f"{number}, j").replace("length(n)", f"length({number})")
    octets = "list_bool_and(list_transform(string_split(value, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(x AS INTEGER), 999) <= 255))"
    kinds = [
        sql_matches("email", 0, email), sql_matches("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", octets),
        sql_matches("card", 2, r"[0-9](?:[\x20-]?[0-9])+", f"length({number}) BETWEEN 14 AND 19 AND {luhn}"), sql_matches("phone", 3, PHONE, f"length({number}) BETWEEN 10 AND 15"),
    ]
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS MATERIALIZED ({" UNION ALL ".join(kinds)}),
entities AS (SELECT DISTINCT r, kind || ':' || CASE kind WHEN 'email' THEN lower(value) WHEN 'ip' THEN value ELSE {number} END AS entity FROM base),
words AS MATERIALIZED (SELECT DISTINCT r, unnest(regexp_extract_all(lower(regexp_replace(text, '{email}', ' ', 'g')), '\\pL{{3,}}')) AS term FROM d),
n_entity AS (SELECT entity, count(*) AS n_entity FROM entities GROUP BY entity),
n_term AS (SELECT term, count(*) AS n_term FROM words GROUP BY term),
pairs AS (SELECT term, entity, count(*) AS n_both FROM entities JOIN words USING (r) JOIN d USING (r) GROUP BY term, entity HAVING count(DISTINCT text) >= {SUPPORT}),
over AS (SELECT term, max(n_both / n_term) >= {REMOVE} AS cut FROM pairs JOIN n_term USING (term) JOIN n_entity USING (entity)
  WHERE n_both / n_term >= {GENERALISE} AND log2(n_both / n_term / (n_entity / (SELECT count(*) FROM d))) >= {BITS} GROUP BY term),
told AS (SELECT DISTINCT r FROM words JOIN over USING (term)),
runs AS {sql_matches("run", 4, r"\pL+").replace("FROM d)", "FROM d SEMI JOIN told USING (r))")},
terms AS (SELECT r, CASE WHEN cut THEN 'cut' ELSE 'term' END AS kind, CASE WHEN cut THEN 5 ELSE 4 END AS ord, start, "end" FROM runs JOIN over ON lower(value) = term
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = runs.r AND b.start < runs."end" AND runs.start < b."end")),
b AS (SELECT r, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, ord) AS s FROM base GROUP BY r),
a AS (SELECT r, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, ord) AS s FROM (SELECT r, kind, ord, start, "end" FROM base UNION ALL SELECT * FROM terms) GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(a.s, '') AS spans
FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r)
"""


SQL = _sql()
