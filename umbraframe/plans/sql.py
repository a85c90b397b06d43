"""The queries' results in DuckDB's SQL."""

from __future__ import annotations

from umbraframe.functions.spans import LABELS, label_key
from umbraframe.functions.words import EMOJI_RANGES, JOINER_RANGES, MAX_WIDTH
from umbraframe.operators.detect import RULES
from umbraframe.plans.queries import BUDGET, CAP, EMOJI, FIRST, HEADER, LAST, SUBWORD
from umbraframe.sources.models import RESERVED

DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def found(pattern: str, label: str, order: int, source: str = "docs", key: str = "doc_id") -> str:
    """(key, text, start, end, label, ord, i) of the matches of a pattern."""
    return f"""SELECT {key}, text, i, {order} AS ord, '{label}' AS label,
      CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda m: length(m))), 0) AS INTEGER) AS start,
      CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + list_sum(list_transform(ms[1:i], lambda m: length(m))) AS INTEGER) AS "end"
    FROM (SELECT {key}, text, ms, gs, CAST(unnest(range(1, len(ms) + 1)) AS INTEGER) AS i FROM
      (SELECT {key}, text, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs FROM {source}) WHERE len(ms) > 0)"""


def spans(source: str = "docs", key: str = "doc_id") -> str:
    return "spans AS (" + " UNION ALL ".join(found(p, k, i, source, key) for i, (k, p) in enumerate(RULES.items())) + ")"


def merged(source: str = "spans", key: str = "doc_id", name: str = "merged") -> str:
    return f"""{name}_f AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY {key} ORDER BY start, ord, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {source}),
{name}_g AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY start, ord, i ROWS UNBOUNDED PRECEDING) AS island FROM {name}_f),
{name} AS (SELECT {key}, any_value(text) AS text, island, min(start) AS start, max("end") AS "end", arg_min(label, fresh * -1.0) AS label FROM {name}_g GROUP BY {key}, island)"""


TOKENS = r"""keyed AS (SELECT *, trim(regexp_replace(upper(label), '[^A-Z0-9]+', '_', 'g'), '_') AS k FROM merged),
tokens AS (SELECT *, '[' || k || '_' || row_number() OVER (PARTITION BY doc_id, k ORDER BY start) || ']' AS token FROM keyed),
cuts AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS from_ FROM tokens),
pieces AS (SELECT doc_id, string_agg(substr(text, from_ + 1, start - from_) || token, '' ORDER BY start) AS body, max("end") AS last_, count(*) AS n FROM cuts GROUP BY doc_id),
masked AS (SELECT d.doc_id, d.text, coalesce(p.body, '') || substr(d.text, coalesce(p.last_, 0) + 1) AS masked, coalesce(p.n, 0) AS n FROM docs d LEFT JOIN pieces p USING (doc_id))"""
MASK = f"WITH {DOCS}, {spans()}, {merged()}, {TOKENS} "
SCRUB = r"\[(?:" + "|".join(map(label_key, LABELS)) + r")_[0-9]+\]"
REPLY = "'re  and ' || {} || ': ' || text"

TURNS = "turns AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn, role, coalesce(text, '')) AS fields FROM conversations GROUP BY conv_id)"
GS = "chr(30) || chr(30)"
SEP = "' ' || chr(30) || chr(30) || chr(30) || ' '"
WIDE = """wide AS (SELECT doc_id, text, i, ord, label, start, "end" FROM spans UNION ALL SELECT doc_id, text, i, ord + 10, 'address', start + 5, CAST(least("end" + 30, length(text)) AS INTEGER) FROM spans)"""
RULE_ORDER = "CASE label " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(LABELS)) + " END"

WORDS = r"""w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS word, generate_subscripts(regexp_extract_all(text, '\S+'), 1) AS i, string_split_regex(text, '\S+') AS gs FROM docs),
  o AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, word, CAST(sum(length(word) + length(gs[i])) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS INTEGER) AS e FROM w),
  words AS (SELECT doc_id, pos, word, CAST(e - length(word) AS INTEGER) AS s, e FROM o)"""
# Windows of words whose subwords fit: where a window that begins at a word ends, then from each window to the next.
PLAN = f"""counted AS (SELECT doc_id, pos, CAST(ceil(length(word) / {SUBWORD}.0) AS BIGINT) AS n FROM words),
  fit AS (SELECT doc_id FROM counted GROUP BY doc_id HAVING max(n) <= {{cap}}),
  b AS (SELECT doc_id, pos, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS b FROM counted SEMI JOIN fit USING (doc_id)
        UNION ALL SELECT doc_id, count(*), sum(n) FROM counted SEMI JOIN fit USING (doc_id) GROUP BY doc_id),
  ends AS (SELECT doc_id, pos, CAST(max(pos) OVER (PARTITION BY doc_id ORDER BY b RANGE BETWEEN CURRENT ROW AND {{cap}} FOLLOWING) AS BIGINT) AS last, max(pos) OVER (PARTITION BY doc_id) AS n FROM b),
  windows AS (WITH RECURSIVE r AS (SELECT doc_id, 0 AS w, CAST(0 AS BIGINT) AS first, last, n FROM ends WHERE pos = 0 AND n > 0
        UNION ALL SELECT r.doc_id, r.w + 1, e.pos, e.last, r.n FROM r JOIN ends e ON e.doc_id = r.doc_id AND e.pos = greatest(r.first + 1, r.last - least({MAX_WIDTH} - 1, r.last - r.first - 1)) WHERE r.last < r.n)
      SELECT doc_id, CAST(w AS INTEGER) AS w, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM r)"""
_CLASS = lambda ranges: "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"
EMOJI_WORDS = f"""emoji AS (SELECT doc_id, pos, CASE WHEN pos % 7 < 2 THEN [{", ".join(f"'{e}'" for e in EMOJI)}][1 + (pos // 7) % {len(EMOJI)}] ELSE word END AS word, s, e FROM words),
  marked AS (SELECT *, regexp_matches(word, '^(?:{_CLASS(EMOJI_RANGES)}{_CLASS(JOINER_RANGES)}*)+$') AS is_emoji FROM emoji)"""
#: A name that stands alone, by what may not stand beside it; twice, as one match takes what stands before the next.
def named(text: str, forms: str, token: str = "[USER]") -> str:
    once = "regexp_replace({}, '(^|[^\\pL\\pN_])(?i:" + forms + r")($|[^\pL\pN_])', '\1" + token + r"\2', 'g')"
    return once.format(once.format(text))


_G, _F = FIRST, LAST
FULL_FORMS = rf"{_G}\s+{_F}|{_F},?\s+{_G}|{_G[0]}\.?\s+{_F}|{_G}{_F}|{_G}\.{_F}"
GIVEN = rf"replace(regexp_replace(regexp_replace({{}}, '\b((?i:{FIRST})\s+\p{{{{Lu}}}})', chr(1) || '\1', 'g'), '(^|[^\pL\pN_\x01])(?i:{FIRST})($|[^\pL\pN_])', '\1[USER]\2', 'g'), chr(1), '')"
CUTS = r"""(SELECT doc_id, label, start, ps, ms, CAST(unnest(range(1, len(ps) + 1)) AS INTEGER) AS j FROM
  (SELECT doc_id, label, start, string_split_regex(substr(text, start + 1, "end" - start), '[ \n]+') AS ps, regexp_extract_all(substr(text, start + 1, "end" - start), '[ \n]+') AS ms FROM wide))"""
_AT = "start + coalesce(list_sum(list_transform(ps[1:j-1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:j-1], lambda x: length(x))), 0)"

SQL = {
    "words_with_offsets": rf"WITH {DOCS}, w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS word, generate_subscripts(regexp_extract_all(text, '\S+'), 1) AS i, string_split_regex(text, '\S+') AS gs FROM docs), o AS (SELECT *, CAST(sum(length(word) + length(gs[i])) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS INTEGER) AS e FROM w) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, word, CAST(e - length(word) AS INTEGER) AS start, e AS \"end\" FROM o".replace('\\"', '"'),
    "word_count_budget": rf"WITH {DOCS} SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS n, CASE WHEN n = 0 THEN 'empty' WHEN n > {BUDGET} THEN 'drop_budget' ELSE 'send' END AS status FROM docs",
    "window_plan": f"WITH {DOCS}, {WORDS}, {PLAN.format(cap=CAP)} SELECT doc_id, w, first, last FROM windows",
    "window_budget": f"WITH {DOCS}, {WORDS}, c AS (SELECT doc_id, sum(CAST(ceil(length(word) / {SUBWORD}.0) AS INTEGER)) AS t, max(ceil(length(word) / {SUBWORD}.0)) AS m FROM words GROUP BY doc_id) SELECT doc_id, CAST(coalesce(t, 0) AS INTEGER) AS n_tokens, CASE WHEN coalesce(t, 0) > {BUDGET * 2} THEN 'drop_budget' WHEN coalesce(m, 0) > {CAP // 50} THEN 'drop_filter_failed' ELSE 'send' END AS status FROM docs LEFT JOIN c USING (doc_id)",
    "preamble_lengths": rf"WITH {TURNS} SELECT conv_id, CAST(3 + list_sum(list_transform(fields, lambda t: 1 + len(regexp_extract_all(t, '\S+')))) AS BIGINT) AS n_tokens FROM turns",
    "model_inputs": f"""WITH {DOCS}, {WORDS}, {PLAN.format(cap=CAP)}, x AS (SELECT w.doc_id, w.w, c.pos - w.first AS k, w.last - w.first AS n, c.n AS t FROM windows w JOIN counted c ON c.doc_id = w.doc_id AND c.pos >= w.first AND c.pos < w.last)
      SELECT doc_id, w, CAST(sum(t) + 8 AS BIGINT) AS n_ids, CAST(sum(least({MAX_WIDTH}, n - k)) AS BIGINT) AS n_spans, CAST(sum(least({MAX_WIDTH}, n - k) * k + least({MAX_WIDTH}, n - k) * (least({MAX_WIDTH}, n - k) - 1) // 2) AS BIGINT) AS sum_last, CAST(sum(k + 1) AS BIGINT) AS sum_words FROM x GROUP BY doc_id, w""",
    "neutral_words": f"WITH {DOCS}, {WORDS}, {EMOJI_WORDS} SELECT doc_id, pos, is_emoji, CASE WHEN is_emoji THEN '-' ELSE word END AS encoded FROM marked",
    "emoji_spans": f"""WITH {DOCS}, {WORDS}, {EMOJI_WORDS}, x AS (SELECT a.doc_id, a.pos, a.s, b.e, b.pos - a.pos AS width FROM marked a JOIN marked b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.pos <= a.pos + 2)
      SELECT doc_id, CAST(width AS INTEGER) AS width, count(*) AS n_spans, CAST(sum(s) AS BIGINT) AS sum_start, CAST(sum(e) AS BIGINT) AS sum_end
      FROM x WHERE EXISTS (SELECT 1 FROM marked m WHERE m.doc_id = x.doc_id AND m.pos >= x.pos AND m.pos <= x.pos + x.width AND NOT m.is_emoji) GROUP BY doc_id, width""",
    "protect_markers": f"""WITH {DOCS}, {spans()}, {WIDE} SELECT doc_id, CAST({_AT} AS INTEGER) AS start, CAST({_AT} + length(ps[j]) AS INTEGER) AS "end", label FROM {CUTS} WHERE ps[j] <> ''""",
    "protect_exact": f"""WITH {DOCS}, {spans()}, {WIDE}, f AS (SELECT doc_id, arg_min(substr(text, start + 1, "end" - start), ord * 1000000 + i) AS t FROM spans GROUP BY doc_id)
      SELECT doc_id, start, "end", label FROM wide JOIN f USING (doc_id) WHERE substr(text, start + 1, "end" - start) <> t""",
    "valid_spans": f"""WITH {DOCS}, {spans()} SELECT doc_id, start, "end", label FROM spans UNION ALL SELECT doc_id, start, CASE start % 4 WHEN 3 THEN CAST(length(text) AS INTEGER) ELSE "end" END, label FROM spans WHERE start % 4 = 3 AND start % 2 = 0""",
    "restore_map_order": MASK + "SELECT m.doc_id, coalesce((SELECT string_agg(token, ',' ORDER BY token) FROM tokens t WHERE t.doc_id = m.doc_id), '') AS placeholders FROM masked m",
    "replies_join": MASK + f"SELECT doc_id, text AS restored FROM docs UNION ALL SELECT -1 - doc_id, regexp_replace(masked, '{SCRUB}', '', 'g') FROM masked WHERE doc_id % 3 = 1",
    "mask_fields_shared_map": f"""WITH {DOCS}, {spans()}, {merged()}, keyed AS (SELECT *, doc_id // 4 AS request, trim(regexp_replace(upper(label), '[^A-Z0-9]+', '_', 'g'), '_') AS k FROM merged),
      fields AS (SELECT doc_id, text, doc_id // 4 AS request, CAST(row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id, text) - 1 AS INTEGER) AS i FROM docs),
      tokens AS (SELECT *, '[' || k || '_' || row_number() OVER (PARTITION BY request, k ORDER BY doc_id, start) || ']' AS token FROM keyed),
      cuts AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS from_ FROM tokens),
      pieces AS (SELECT doc_id, string_agg(substr(text, from_ + 1, start - from_) || token, '' ORDER BY start) AS body, max("end") AS last_ FROM cuts GROUP BY doc_id),
      n AS (SELECT request, count(*) AS n FROM tokens GROUP BY request)
      SELECT f.request, 'send' AS status, CAST(coalesce(n, 0) AS INTEGER) AS n_spans, f.i, coalesce(body, '') || substr(f.text, coalesce(last_, 0) + 1) AS masked FROM fields f LEFT JOIN pieces USING (doc_id) LEFT JOIN n ON n.request = f.request""",
    "sql_functions": MASK + f"SELECT doc_id, {GIVEN.format('text')} AS named, text AS restored, CAST(coalesce(c, 0) AS INTEGER) AS n_spans FROM docs LEFT JOIN (SELECT doc_id, count(*) AS c FROM spans GROUP BY doc_id) USING (doc_id)",
    "name_mask_full": f"WITH {DOCS} SELECT doc_id, {named('text', FULL_FORMS)} AS masked FROM docs",
    "name_mask_transcript": f"SELECT conv_id, turn, '{HEADER}' || chr(10) || coalesce(role, '') || '|' || {GIVEN.format("regexp_replace(coalesce(text, ''), '[|\n]', ' ', 'g')")} AS masked FROM conversations",
    "digest_compare": "SELECT p_partkey, p_partkey % 3 <> 1 OR sha256(p_name) = sha256(CAST(p_partkey AS VARCHAR)) AS same FROM part",
    "progress": "SELECT l_orderkey, l_linenumber, least(1.0::DOUBLE, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) / 32) AS share FROM lineitem",
    "failure_kinds": "SELECT o_orderkey, ['space', 'permission', 'offline', 'offline', 'permission', 'download', 'offline'][1 + o_orderkey % 7] AS kind FROM orders",
    "pin_plausible": f"SELECT p_partkey, regexp_matches(CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '_') ELSE p_name END, '^[A-Za-z0-9._-]+$') AND (p_partkey % 5) * 25000000000 - 25000000000 BETWEEN 1 AND 99999999999 AS plausible FROM part",
    **{f"detect_{name}": f'WITH {DOCS} SELECT doc_id, start, "end", label FROM ({found(RULES[label], label, 0)})' for name, label in (("email", "email address"), ("ipv4", "ip address"), ("phone", "phone number"), ("token", "access token"))},
    "trim_spans": rf"""WITH {DOCS}, {spans()}, x AS (SELECT doc_id, text, label, greatest(start - 2, 0) AS a, least("end" + 2, length(text)) AS b FROM spans),
      y AS (SELECT *, a + length(regexp_extract(substr(text, a + 1, b - a), '^[\s(\[{{"''“‘«¿¡]*')) AS c FROM x),
      z AS (SELECT doc_id, label, c, b - length(regexp_extract(substr(text, c + 1, b - c), '[\s.,?!;:…)\]}}"''”’»]*$')) AS d FROM y)
      SELECT doc_id, CAST(c AS INTEGER) AS start, CAST(d AS INTEGER) AS "end", label FROM z WHERE d > c""",
    "merge_spans": f'WITH {DOCS}, {spans()}, {WIDE}, {merged("wide")} SELECT doc_id, start, "end", label FROM merged',
    "number_placeholders": MASK + 'SELECT doc_id, start, "end", token FROM tokens',
    "mask_documents": MASK + "SELECT doc_id, masked, CAST(n AS INTEGER) AS n_spans FROM masked",
    "restore_map_rows": MASK + 'SELECT doc_id, token AS placeholder, substr(text, start + 1, "end" - start) AS original FROM tokens',
    "restore_roundtrip": f"WITH {DOCS} SELECT doc_id, text AS restored FROM docs",
    "restore_garbled_default": MASK + f"SELECT doc_id, {REPLY.format("'[SECTION_2]'")} AS restored FROM masked WHERE n > 0",
    "restore_garbled_any": MASK + f"SELECT doc_id, {REPLY.format(chr(39) * 2)} AS restored FROM masked WHERE n > 0",
    "join_split_fields": f"WITH {TURNS}, b AS (SELECT conv_id, fields, length({GS} || {SEP} || array_to_string(fields, {SEP}) || {SEP} || {GS}) AS n_chars FROM turns) SELECT conv_id, CAST(n_chars AS INTEGER) AS n_chars, CAST(generate_subscripts(fields, 1) - 1 AS INTEGER) AS i, unnest(fields) AS field FROM b",
    "separator_smuggle_drop": f"WITH {TURNS} SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'drop_separator' ELSE 'send' END AS status, CAST(CASE WHEN conv_id % 3 = 0 THEN -1 ELSE len(fields) END AS INTEGER) AS n_fields FROM turns",
    "name_mask_given": f"WITH {DOCS} SELECT doc_id, {GIVEN.format('text')} AS masked FROM docs",
    "logits_decode": f"""WITH {DOCS}, {WORDS}, {PLAN.format(cap=CAP)},
      c AS (SELECT doc_id, w, first, last - first AS n, sw, width, li FROM windows, unnest(range(0, last - first)) AS a(sw), range(0, {MAX_WIDTH}) AS b(width), range(0, {len(LABELS)}) AS d(li) WHERE sw + width < last - first),
      k AS (SELECT * FROM c WHERE 1 / (1 + exp(-(((doc_id * 7 + (first + sw) * 31 + width * 1009 + li * 613 + w * 5) % 9973) / 4.0 - 2490))) > 0.3)
      SELECT k.doc_id, w AS "window", x.s AS start, y.e AS "end", [{", ".join(f"'{x}'" for x in LABELS)}][li + 1] AS label, CAST(width AS INTEGER) AS width, CAST(li AS INTEGER) AS label_index
      FROM k JOIN words x ON x.doc_id = k.doc_id AND x.pos = k.first + k.sw JOIN words y ON y.doc_id = k.doc_id AND y.pos = k.first + k.sw + k.width""",
    "label_histogram": f"WITH {DOCS}, {spans()} SELECT label, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM spans GROUP BY label",
    "probe_verdict": f"""WITH {DOCS}, {spans()}, c AS (SELECT doc_id, substr(text, start + 1, "end" - start) AS t FROM spans),
      h AS (SELECT doc_id, max(CAST(contains(t, '@mail') AS INTEGER)) + max(CAST(contains(t, '555-') AS INTEGER)) + max(CAST(contains(t, '.1') AS INTEGER)) AS n FROM c GROUP BY doc_id)
      SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_found, CAST(3 - coalesce(n, 0) AS INTEGER) AS n_missed, d.text <> '' AND coalesce(n, 0) >= 2 AS passes FROM docs d LEFT JOIN h USING (doc_id)""",
    "safe_component": f"WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN regexp_replace(p_name, '[^A-Za-z0-9]', '-', 'g') WHEN 1 THEN 'COM1.' || p_brand ELSE p_name END AS name FROM part) SELECT p_partkey, name, regexp_matches(name, '^[A-Za-z0-9._-]+$') AND name NOT IN ('.', '..') AND upper(split_part(name, '.', 1)) NOT IN ({', '.join(repr(x) for x in sorted(RESERVED))}) AS ok FROM s",
    "pin_predecessor": "SELECT o_custkey, o_orderkey, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), -1) AS previous FROM orders",
    "disk_budget": "SELECT doc_id, coalesce(n_chars, 0) * 5 // 2 AS to_install, coalesce(n_chars, 0) * 3 // 2 AS to_unpack FROM documents",
    "file_digests": f"WITH {DOCS} SELECT doc_id, sha256(text) AS sha256 FROM docs",
    "decisions": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'drop_timed_out' WHEN o_orderstatus = 'F' OR o_orderpriority IS NULL THEN 'drop_filter_failed' ELSE 'send' END AS status FROM orders",
    "sanitize": MASK + r"SELECT doc_id, CASE WHEN regexp_matches(text, '\S') THEN regexp_replace(regexp_replace(masked, '^\s+', ''), '\s+$', '') END AS masked FROM masked",
    "mask_stream_smoke": MASK + "SELECT doc_id, 'send' AS status, masked FROM masked",
}
