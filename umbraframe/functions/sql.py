"""The engine in SQL: ``mask_name``, ``restore_pii`` and the table function ``detect_pii``."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from umbraframe.functions.names import FULL, TOKEN, name_pattern
from umbraframe.functions.spans import LABELS, scrub_pattern
from umbraframe.operators.detect import FASTER, RULES


@lru_cache(256)
def _name(first: str, last: str, scope: str):
    import regex

    pattern = name_pattern(first, last, scope)
    return None if pattern is None else regex.compile(pattern.removeprefix("(?U)"))


@F.pandas_udf(StringType())
def mask_name(text: pd.Series, first: pd.Series, last: pd.Series, scope: pd.Series) -> pd.Series:
    def one(t, f, s, scope):
        pattern = None if t is None else _name(f or "", s or "", scope or FULL)
        return t if pattern is None else pattern.sub(lambda m: TOKEN, t)

    return pd.Series([one(*row) for row in zip(text, first, last, scope, strict=True)], dtype=object)


class DetectPii:
    """(start, end, label, score) of each span that the rules find, as RuleDetector does; their score is 1."""

    def eval(self, text: str):
        import regex

        for label, pattern in RULES.items():
            faster, held = FASTER.get(pattern, (pattern, ""))
            if text and held in text:
                for m in regex.finditer(faster, text):
                    yield m.start(), m.end(), label, 1.0


def register(spark: SparkSession) -> None:
    """mask_name(text, first, last, scope), restore_pii(reply, originals) and detect_pii(text) for this session's SQL."""
    from umbraframe.functions.shipping import ship

    ship(spark)
    spark.udf.register("mask_name", mask_name)
    spark.udtf.register("detect_pii", F.udtf(DetectPii, returnType="start int, end int, label string, score double"))
    # Catalyst inlines this one: as in functions.spans.restored.
    order = "CASE WHEN length(a.key) <> length(b.key) THEN length(b.key) - length(a.key) WHEN a.key < b.key THEN -1 WHEN a.key > b.key THEN 1 ELSE 0 END"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION restore_pii(reply STRING, originals MAP<STRING, STRING>) RETURNS STRING RETURN
        regexp_replace(aggregate(array_sort(map_entries(coalesce(originals, CAST(map() AS MAP<STRING, STRING>))), (a, b) -> {order}), reply, (acc, e) -> replace(acc, e.key, e.value)), r'{scrub_pattern(LABELS)}', '')""")
