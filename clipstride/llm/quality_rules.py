"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit a rule;
policies (versioned sets of rules) and ablations are bit operations on it and never read a text again.
All of it is column expressions: nothing is shuffled to build a ledger, and an ablation shuffles one row
per distinct bit pattern and task.

Null text counts as empty: no words, every rule on shares passes, ``too_few_words`` fails. Repeated rows are judged one
by one. Extra columns are carried along; a column named like a ledger column is replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the contract: what separates words, symbols, window length.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")


class Rule(NamedTuple):
    """A document fails if ``fails`` (SQL over the measurements) is true. The place in RULES is its bit."""

    name: str
    fails: str


#: Bits are never reused: a new rule goes to the end.
RULES = (
    Rule("too_few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("many_symbols", "100 * n_symbols > 25 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("words_too_short", "n_words > 0 AND word_chars < 2 * n_words"),
    Rule("words_too_long", "word_chars > 16 * n_words"),
    Rule("mostly_upper_case", "100 * n_upper > 50 * word_chars"),
    Rule("many_exclamations", "100 * n_bangs > 30 * n_words"),
)
BASE = ("too_few_words", "repeated_windows")

#: Versioned policies; a document is kept if it fails none of a policy's rules.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "many_symbols", "repeated_lines", "words_too_short", "words_too_long"),
    "v3": tuple(r.name for r in RULES),
}
CURRENT = "v3"


def mask(names: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    bits = {r.name: 1 << i for i, r in enumerate(RULES)}
    return sum(bits[n] for n in set(names))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add MEASURES (long) of every whole text.

    Windows of five words are compared by 64-bit hashes; two different ones of a document agree with odds of 1e-11 in
    the longest texts. Only texts that hold a repeat sort their windows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    out = docs.withColumn("__words", F.array_remove(F.split(body, SPACES, -1), ""))
    size = F.size("__words")
    windows = F.when(size >= WINDOW, F.transform(
        F.sequence(F.lit(1), size - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("__words"), i, F.lit(WINDOW)))))
    out = out.withColumn("__lines", lines).withColumn("__windows", windows)
    out = out.withColumn("__sorted", F.when(
        F.size(F.array_distinct("__windows")) < F.size("__windows"),
        F.sort_array(F.transform("__windows", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    # places of windows that equal a neighbour in key order, then in text order
    same = lambda x, i: (
        ((i > 0) & (F.get("__sorted", i - 1)["k"] == x["k"])) | (F.get("__sorted", i + 1)["k"] == x["k"]))
    out = out.withColumn("__places", F.sort_array(F.transform(
        F.filter("__sorted", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("__places", lambda p, i: F.least(F.coalesce(F.get("__places", i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    # never other than 0, but not known before the run: filters on measurements stay behind this projection, where the optimizer
    # would else put a copy of every expression they need into them
    zero = F.least(F.spark_partition_id(), F.lit(0))
    long = lambda c: c.cast("long") + zero
    out = out.withColumns({
        "n_words": long(size),
        "word_chars": long(F.char_length(F.regexp_replace(body, SPACES, ""))),
        "n_symbols": long(F.regexp_count(body, F.lit(SYMBOLS))),
        "n_dup_lines": long(F.size("__lines") - F.size(F.array_distinct("__lines"))),
        "n_repeat_words": long(F.coalesce(covered, F.lit(0).cast("long"))),
        "n_lines": long(F.size("__lines")),
        "n_upper": long(F.char_length(F.regexp_replace(body, r"[^\p{Lu}]+", ""))),
        "n_bangs": long(F.char_length(F.regexp_replace(body, "[^!]+", ""))),
    })
    return out.drop("__words", "__lines", "__windows", "__sorted", "__places")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``fail_bits`` (long) of every document."""
    out = measured(docs, text)
    bits = F.lit(0).cast("long")
    for place, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << place)).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("fail_bits", bits)


def passes(policy: tuple[str, ...]) -> Column:
    """Whether a ledger row fails no rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def judged(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and the policy's verdict ``kept``."""
    return ledger(docs).withColumns({"base_failed": ~passes(BASE), "kept": passes(POLICIES[policy]) & passes(BASE)})


def kept(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, unchanged."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("text"))
    return ledger(rows).where(passes(POLICIES[policy])).select("__row.*")


def patterns(rows: DataFrame) -> DataFrame:
    """Documents per distinct failure pattern: at most 2 ** rules rows, whatever the input."""
    return rows.groupBy("fail_bits").agg(F.count("*").alias("n_docs"))


def ablations(rows: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """For every policy and rule of it: documents kept, kept without the rule, and those only this rule rejects."""
    plan = F.array(*[
        F.struct(F.lit(v).alias("policy"), F.lit(n).alias("rule"), F.lit(mask(names)).cast("long").alias("policy_bits"),
                 F.lit(mask((n,))).cast("long").alias("rule_bit"))
        for v, names in policies.items() for n in names])
    failed = F.col("fail_bits").bitwiseAND(F.col("policy_bits"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n_docs"))), F.lit(0)).cast("long")
    return patterns(rows).select("*", F.inline(plan)).groupBy("policy", "rule").agg(
        count(failed == 0).alias("n_kept"),
        count(failed.bitwiseAND(F.bitwise_not("rule_bit")) == 0).alias("n_kept_without"),
        count(failed == F.col("rule_bit")).alias("n_only_this"),
        count(failed.bitwiseAND(F.col("rule_bit")) != 0).alias("n_failing"))
