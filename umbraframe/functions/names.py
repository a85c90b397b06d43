"""Masking of a user's own name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[USER]"
FULL, GIVEN_TOO = "full", "given"


def name_pattern(first: str, last: str = "", scope: str = FULL) -> str | None:
    """A Java pattern of the forms in which the name occurs; None where there is nothing to look for.

    Given then family, family then given, initial and last family name, joined, dotted, and (in the wider scope, or
    without a family name) the given name alone if it has three letters and no capitalised word follows.
    """
    given, family = first.strip(), last.split()
    if not given:
        return None
    g, f = re.escape(given), [re.escape(x) for x in family]
    forms = []
    if f:
        forms += [r"\s+".join([g, *f]), r",?\s+".join(f) + r",?\s+" + g, re.escape(given[0]) + r"\.?\s+" + f[-1], g + "".join(f), g + r"\." + r"\.".join(f)]
    if (scope == GIVEN_TOO or not f) and len(given) >= 3:
        forms.append(g + r"(?-i:(?!\s+\p{Lu}))")
    return r"(?U)\b(?i:" + "|".join(forms) + r")\b(?:\s*\(you\))?" if forms else None


def mask_name(text: Column, first: str, last: str = "", scope: str = FULL, token: str = TOKEN) -> Column:
    pattern = name_pattern(first, last, scope)
    return text if pattern is None else F.regexp_replace(text, pattern, token.replace("\\", "\\\\").replace("$", "\\$"))


def mask_transcript(text: Column, header: str | None, first: str, last: str = "", token: str = TOKEN) -> Column:
    """A transcript (first line equal to the header) keeps what stands before the first bar of each line; other text is masked whole."""
    whole = mask_name(text, first, last, GIVEN_TOO, token)
    if header is None:
        return whole
    line = lambda x: F.when(F.instr(x, "|") > 0, F.concat(F.substring(x, F.lit(1), F.instr(x, "|")), mask_name(F.substring(x, F.instr(x, "|") + 1, F.length(x)), first, last, GIVEN_TOO, token))).otherwise(mask_name(x, first, last, GIVEN_TOO, token))
    lines = F.split(text, "\n", -1)
    return F.when(F.element_at(lines, 1) == header, F.array_join(F.transform(lines, line), "\n")).otherwise(whole)
