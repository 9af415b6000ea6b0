"""Text measures used by the detectors.  All native expressions, no Python UDF."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipstride.functions.intervals import overlap

# What counts as shouting, and the lengths texts are cut to for display.
EMPHASIS = r"(?U)\b[A-Z]{2,}\b"
HINT_CHARS = 60
SHORTLIST_CHARS = 220


def word_count(words: Column, text: Column) -> Column:
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    return (
        F.when(F.size(words) > 0, F.size(words))
        .when(text.isNotNull(), F.size(tokens))
        .otherwise(F.lit(0))
    )


def clean_keywords(keywords: Sequence[str]) -> list[str]:
    return [k.strip().lower() for k in keywords if k.strip()]


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    lowered = F.lower(text)
    total = F.lit(0)
    for keyword in clean_keywords(keywords):
        total = total + F.regexp_count(lowered, F.lit(rf"(?U)\b{re.escape(keyword)}\b"))
    return total


def emotion_hits(text: Column, keywords: Sequence[str]) -> Column:
    """Whole-word keywords, exclamation marks and fully capitalised words."""
    marks = F.regexp_count(text, F.lit("!")) + F.regexp_count(text, F.lit(EMPHASIS))
    return F.coalesce(keyword_hits(text, keywords) + marks, F.lit(0)).cast("long")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def collapse(parts: Column) -> Column:
    """Join the non-blank parts with single spaces."""
    return squeeze(F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), " "))


def segment_text(words: Column, text: Column, start: Column, end: Column) -> Column:
    """The words spoken inside [start, end]; the whole text only without word timings."""
    inside = F.filter(
        words, lambda w: overlap(w["start_sec"], w["end_sec"], start, end) > 0.0
    )
    spoken = F.array_join(F.transform(inside, lambda w: F.trim(w["word"])), " ")
    return F.when(F.size(words) > 0, spoken).otherwise(F.trim(text))


def head(text: Column, chars: int | None) -> Column:
    """The first characters, or all of them."""
    return text if chars is None else F.substring(text, 1, chars)
