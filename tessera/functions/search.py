"""Text search: words of the query in any order, the last one as a prefix.

The score and the marks are this library's own: 0.1 for each matching word, falling with the
square of the rank of the match, over the number of query words; matches in ``<b>``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"[^\p{L}\p{N}]+"


def terms(query: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+|_", query.lower()) if t]


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c.cast("string")), SPLIT), lambda w: w != "")


def matches(c: Column, query: str) -> Column:
    *whole, last = terms(query) or [""]
    if not last:
        return F.lit(False)
    found = F.exists(words(c), lambda w: w.startswith(last))
    for t in whole:
        found &= F.array_contains(words(c), t)
    return found


def score(c: Column, query: str) -> Column:
    ts = terms(query)
    hit = lambda w: F.lit(False) if not ts else _any(w, ts)
    n = F.size(F.filter(words(c), hit))
    parts = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, i: a + F.lit(0.1) / (i * i))
    return F.when(n > 0, parts / max(1, len(ts))).otherwise(F.lit(0.0))


def _any(w: Column, ts: list[str]) -> Column:
    found = w.startswith(ts[-1])
    for t in ts[:-1]:
        found |= w == t
    return found


def headline(c: Column, query: str) -> Column:
    *whole, last = terms(query) or [""]
    if not last:
        return c
    pattern = "|".join([*(re.escape(t) + r"(?![\p{L}\p{N}])" for t in whole), re.escape(last) + r"[\p{L}\p{N}]*"])
    return F.regexp_replace(c, rf"(?i)(?<![\p{{L}}\p{{N}}])({pattern})", "<b>$1</b>")
