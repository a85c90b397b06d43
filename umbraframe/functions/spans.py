"""Span algebra over arrays of struct<start,end,label>: code points, end exclusive. All Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels in model order.
LABELS = (
    "phone number", "email address", "credit card number", "address", "social security number", "date of birth",
    "bank account number", "password", "pin code", "ip address", "dollar amount", "passport number",
    "driver license number", "tax id", "api key", "access token", "secret key",
)
# White space and these characters are trimmed from a span's start and end.
LEADING = "([{\"'“‘«¿¡"
TRAILING = ".,?!;:…)]}\"'”’»"
# What frames the fields of a request (record separators).
RS = "\x1e"
GUARD, SEPARATOR, MARKER = RS * 2, f" {RS * 3} ", RS + "{2,3}"

SPAN = "struct<start:int,end:int,label:string>"
SPANS = f"array<{SPAN}>"
MATCHES = "array<struct<start:int,end:int,value:string>>"
#: Elements that one fold gathers, as it copies what it has at each step; characters of a text's chunk.
BLOCK, CHUNK = 128, 4096


def none() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, label: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.alias("label"))


def part(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once: a lambda evaluates an expression that it names anew for each element."""
    return F.transform(F.array(value), f)[0]


def chunked(text: Column) -> Column:
    """The text in chunks, so that a part of it is found without walking all that stands before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """:func:`part` of a text in chunks."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.floor((F.greatest(end, start + 1) - 1) / CHUNK).cast("int")
    return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start - first * CHUNK + 1, end - start)


def blocks(items: Column) -> Column:
    """An array (with at least one element) in arrays of BLOCK."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of a pattern's leftmost matches that do not overlap.

    Catalyst has no places of matches; they follow from the lengths of the matches and of what lies between them. A fold
    runs over each block of matches and once over the blocks: linear in a text's length and matches.
    """
    none_yet = F.struct(F.lit(0).alias("at"), F.array().cast(MATCHES).alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    def placed(found):
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        pairs = F.zip_with(found, gaps, lambda m, g: F.struct(g.alias("gap"), m.alias("value")))
        return F.when(F.size(found) > 0, bound(bound(pairs, lambda p: F.transform(blocks(p), lambda b: F.aggregate(b, none_yet, step))), shifted)).otherwise(F.array().cast(MATCHES))

    def shifted(each):
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        before = F.aggregate(each, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(each, before, lambda x, by: F.transform(x["out"], lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["value"].alias("value")))))

    return F.when(text.isNotNull(), bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed))


def key_of(label: Column) -> Column:
    """The placeholder key: upper case, runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.upper(label), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def label_key(label: str) -> str:
    import re

    return re.sub("[^A-Z0-9]+", "_", label.upper()).strip("_")


def valid(spans: Column, text: Column) -> Column:
    """Without spans that are empty, reversed or out of range."""
    return bound(F.length(text), lambda n: F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= n)))


def _escaped(chars: str) -> str:
    return "".join("\\" + c if c in "()[]{}\\^-.?!" else c for c in chars)


def trimmed(spans: Column, text: Column) -> Column:
    """Edges moved past white space and punctuation; spans that trim to nothing go."""

    def trim(s, chunks):
        covered = cut(chunks, s["start"], s["end"])
        start = s["start"] + F.length(F.regexp_extract(covered, rf"(?U)^[\s{_escaped(LEADING)}]*", 0))
        kept = cut(chunks, start, s["end"])
        return span(start, s["end"] - F.length(F.regexp_extract(kept, rf"(?U)(?<![\s{_escaped(TRAILING)}])[\s{_escaped(TRAILING)}]*$", 0)), s["label"])

    return bound(chunked(text), lambda chunks: F.filter(F.transform(spans, lambda s: trim(s, chunks)), lambda s: s["end"] > s["start"]))


def markers(text: Column, pattern: str = MARKER) -> Column:
    """Spans of the framing in a joined text."""
    return F.transform(matches(text, pattern), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def framing(text: Column) -> Column:
    """:func:`markers`, without a walk over the many texts that have none."""
    return F.when(text.contains(RS * 2), markers(text)).when(text.isNotNull(), F.array().cast("array<struct<start:int,end:int>>"))


def around(spans: Column, barred: Column) -> Column:
    """Each span less the barred intervals: the pieces that remain, in order."""

    def cut(pieces, m):
        return F.flatten(
            F.transform(
                pieces,
                lambda p: F.when((m["end"] <= p["start"]) | (m["start"] >= p["end"]), F.array(p)).otherwise(
                    F.filter(F.array(span(p["start"], m["start"], p["label"]), span(m["end"], p["end"], p["label"])), lambda q: q["end"] > q["start"])
                ),
            )
        )

    return F.flatten(F.transform(spans, lambda s: F.aggregate(barred, F.array(span(s["start"], s["end"], s["label"])), cut)))


def not_equal_to(spans: Column, text: Column, protected: Column) -> Column:
    """Without spans whose whole text is one of the protected strings."""
    return bound(chunked(text), lambda chunks: F.filter(spans, lambda s: ~F.array_contains(protected, cut(chunks, s["start"], s["end"]))))


def merged(spans: Column) -> Column:
    """Spans that overlap or touch become one, with the label of the first; the order of equal starts is that given."""
    numbered = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["end"].alias("end"), s["label"].alias("label")))
    zero = F.struct(F.lit(None).cast(SPAN).alias("last"), none().alias("out"))

    def join(acc, s):
        last = acc["last"]
        joins = last.isNotNull() & (s["start"] <= last["end"])
        longer = F.when(joins, span(last["start"], F.greatest(last["end"], s["end"]), last["label"])).otherwise(span(s["start"], s["end"], s["label"]))
        return F.struct(longer.alias("last"), F.when(joins | last.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(last))).alias("out"))

    def block(acc, some):
        inner = F.aggregate(some, F.struct(acc["last"].alias("last"), none().alias("out")), join)
        return bound(inner, lambda x: F.struct(x["last"].alias("last"), F.concat(acc["out"], x["out"]).alias("out")))

    whole = lambda ordered: F.aggregate(blocks(ordered), zero, block, lambda acc: F.concat(acc["out"], F.array(acc["last"])))
    return F.when(F.size(spans) > 0, bound(F.array_sort(numbered), whole)).when(spans.isNotNull(), none())


def numbered(spans: Column, keys: Column) -> Column:
    """array<struct<start,end,label,token>>: placeholders numbered by key in reading order. keys: :func:`key_of` each label."""
    placed = F.zip_with(F.transform(spans, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), keys, lambda x, k: F.struct(x["i"].alias("i"), x["s"].alias("s"), k.alias("k")))

    def one(x, n):
        token = F.concat(F.lit("["), x["k"], F.lit("_"), (n + 1).cast("string"), F.lit("]"))
        return F.struct(x["i"].alias("i"), x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["s"]["label"].alias("label"), token.alias("token"))

    # By key, of which there are as many as labels, then back into their order.
    each = bound(placed, lambda all_: F.flatten(F.transform(F.array_distinct(keys), lambda k: F.transform(F.filter(all_, lambda x: x["k"] == k), one))))
    return F.transform(F.array_sort(each), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label"), x["token"].alias("token")))


def spliced(text: Column, tokens: Column) -> Column:
    """The text with each span replaced by its token. tokens should be a column, as each span looks at the one before."""

    def pieces(chunks):
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(tokens, i)["end"])
        each = F.transform(tokens, lambda s, i: F.concat(cut(chunks, before(i), s["start"]), s["token"]))
        tail = cut(chunks, F.coalesce(F.try_element_at(tokens, F.lit(-1))["end"], F.lit(0)), F.length(text))
        return F.concat(F.array_join(each, ""), tail)

    return F.when(text.isNotNull(), bound(chunked(text), pieces))


def restore_map(text: Column, tokens: Column) -> Column:
    """placeholder -> original."""
    return bound(chunked(text), lambda chunks: F.map_from_entries(F.transform(tokens, lambda s: F.struct(s["token"], cut(chunks, s["start"], s["end"])))))


def scrub_pattern(labels: tuple[str, ...] | None = LABELS) -> str:
    """Placeholders of these labels' keys, or of any key."""
    return r"\[[A-Z0-9_]+_[0-9]+\]" if labels is None else r"\[(?:" + "|".join(map(label_key, labels)) + r")_[0-9]+\]"


def restored(text: Column, originals: Column, labels: tuple[str, ...] | None = LABELS) -> Column:
    """Originals put back, longest placeholder first, then placeholders that are left over removed.

    With labels None any placeholder-shaped text is left over, but nothing is touched where the map is empty.
    """
    entries = F.array_sort(F.map_entries(originals), lambda a, b: F.when(F.length(a["key"]) != F.length(b["key"]), F.length(b["key"]) - F.length(a["key"])).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    back = F.aggregate(entries, text, lambda acc, e: F.replace(acc, e["key"], e["value"]))
    scrubbed = F.regexp_replace(back, scrub_pattern(labels), "")
    return F.when(F.size(originals) == 0, text).otherwise(scrubbed) if labels is None else scrubbed


def joined_fields(fields: Column) -> Column:
    return F.array_join(F.concat(F.array(F.lit(GUARD)), fields, F.array(F.lit(GUARD))), SEPARATOR)


def split_fields(text: Column, count: Column) -> Column:
    """The fields between intact guards, or null if their number is another."""
    parts = F.split(text, SEPARATOR, -1)
    whole = (F.size(parts) == count + 2) & (F.element_at(parts, 1) == GUARD) & (F.element_at(parts, -1) == GUARD)
    return F.when(whole, F.slice(parts, F.lit(2), F.greatest(count, F.lit(0))))
