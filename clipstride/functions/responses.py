"""Reading what a language model answered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings accepted for each field, most preferred first.
START_KEYS = ("start_sec", "startSec", "start")
END_KEYS = ("end_sec", "endSec", "end")
REASON_KEYS = ("reason", "description")
CONFIDENCE_KEYS = ("confidence", "score")
STRICT = {"allowSingleQuotes": "false"}


# Fixed formats of answers: an array in a fenced block, a flat object, a list of numbers.
FENCED_ARRAY = r"(?s)```(?:json)?\s*(\[.*?\])\s*```"
FLAT_OBJECT = r"\{[^{}]+\}"
NUMBER_LIST = r"\[[\d,\s]*\]"


def highlight_objects(raw: Column) -> Column:
    """The JSON objects of an answer as strings, by the first reading that works.

    What stands between the first and the last bracket, if it is one array; else an array in a fenced block; else any
    loose flat objects.
    """
    text = F.trim(raw)

    def elements(candidate: Column) -> Column:
        # the reader stops behind the first value: inside another array, more text is an error or a second element
        alone = F.from_json(F.concat(F.lit("["), F.nullif(candidate, F.lit("")), F.lit("]")), "array<string>", STRICT)
        return F.when(F.size(alone) == 1, F.from_json(candidate, "array<string>", STRICT))

    bracketed = elements(F.regexp_extract(text, r"(?s)\[.*\]", 0))
    fenced = elements(F.regexp_extract(text, FENCED_ARRAY, 1))
    loose = F.regexp_extract_all(text, F.lit(FLAT_OBJECT), F.lit(0))
    return F.coalesce(bracketed, fenced, loose)


def moment_fields(obj: Column) -> Column:
    """One object as a moment struct, or null when it must be rejected.

    A key that is present decides, even when its value is unusable.
    """
    keys = F.json_object_keys(obj)
    names = (*START_KEYS, *END_KEYS, *REASON_KEYS, *CONFIDENCE_KEYS)
    values = F.from_json(obj, ", ".join(f"`{n}` string" for n in names), STRICT)

    def first_of(spellings: tuple[str, ...], default: str) -> Column:
        out = F.when(F.array_contains(keys, spellings[0]), values[spellings[0]])
        for name in spellings[1:]:
            out = out.when(F.array_contains(keys, name), values[name])
        return out.otherwise(F.lit(default))

    start = first_of(START_KEYS, "-1").try_cast("double")
    end = first_of(END_KEYS, "-1").try_cast("double")
    confidence = first_of(CONFIDENCE_KEYS, "0.5").try_cast("double")
    usable = keys.isNotNull() & confidence.isNotNull() & (start >= 0) & (end >= 0) & (end > start)
    return F.when(
        usable,
        F.struct(
            start.alias("start_sec"), end.alias("end_sec"),
            F.coalesce(first_of(REASON_KEYS, ""), F.lit("None")).alias("reason"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"),
        ),
    )


def index_list(raw: Column, n: Column) -> Column:
    """Indices below ``n`` in the order given, without repeats."""
    listed = F.regexp_extract(raw, NUMBER_LIST, 0)
    numbers = F.regexp_extract_all(F.when(listed != "", listed).otherwise(raw), F.lit(r"\d+"), F.lit(0))
    parsed = F.transform(numbers, lambda x: x.try_cast("long"))
    return F.array_distinct(F.filter(parsed, lambda x: x.isNotNull() & (x < n)))


def model_score(raw: Column) -> Column:
    """The first number, brought to 0..1; scales of 10 and 100 are recognised."""
    value = F.nullif(F.regexp_extract(raw, r"\d*\.?\d+", 0), F.lit("")).try_cast("double")
    scaled = F.when(value > 10, value / 100.0).when(value > 1, value / 10.0).otherwise(value)
    return F.when(scaled.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))
