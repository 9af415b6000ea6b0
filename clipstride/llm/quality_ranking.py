"""Document quality by Bradley-Terry ranking.

Scores are linear in a document's features. They are learned from preference pairs (a document labelled 1 is better
than one labelled 0) by logistic loss on feature differences, so no intercept is learned; a score quantile, the share of
label 0 among the labelled rows, is the threshold. Labels are used up to a documented bound (``SAMPLE`` rows, picked by
hash); every document is scored from its whole text, in one pass without a shuffle.

Null and empty texts have all features zero and get the score of that. Repeated rows get equal scores. Labels that are null or neither
0 nor 1 are not used; without both labels every score is 0.5. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipstride.llm.words import chunks, column_of, in_sample, words_of
from clipstride.operators.store import written

#: Bounds of what is fitted on: labelled rows, and pairs drawn from them.
SAMPLE, PAIRS = 6000, 40_000
RIDGE, STEPS = 1e-3, 60

FEATURES = ("log_words", "word_length", "symbols", "bangs", "upper", "digits", "distinct", "adjacent", "repeated_pairs", "repeated_lines", "marked_words", "letters")


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    words = words_of(texts)
    count = len(texts)
    out = np.zeros((count, len(FEATURES)))
    n = words.counts()
    some, per = n > 0, np.maximum(n, 1)
    owner = np.repeat(np.arange(count), n)
    distinct = words.distinct

    def total(of_word) -> np.ndarray:
        return np.bincount(owner, weights=np.asarray(of_word, float)[words.codes], minlength=count)

    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)
    counted = lambda pattern: pc.count_substring_regex(distinct, pattern).to_numpy(zero_copy_only=False)
    chars = np.maximum(total(length), 1)
    symbols, letters = counted(r"[#*$%&|<>]"), counted(r"\pL")
    inside = owner[1:] == owner[:-1]
    pair = owner[:-1][inside]
    both = words.codes[:-1][inside].astype(np.int64) * max(len(distinct), 1) + words.codes[1:][inside]

    def fresh(who: np.ndarray, key: np.ndarray) -> np.ndarray:
        order = np.lexsort((key, who))
        who, key = who[order], key[order]
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (key[1:] != key[:-1])
        return np.bincount(who[new], minlength=count)

    lines = [[x for x in t.split("\n") if x] for t in texts.to_pylist()]
    columns = (
        np.log1p(n), chars / per / 10, total(symbols) / per, total(counted("!")) / per, total(counted(r"\p{Lu}")) / chars,
        total(counted(r"\pN")) / chars, fresh(owner, words.codes) / per,
        np.bincount(pair[words.codes[:-1][inside] == words.codes[1:][inside]], minlength=count) / per,
        (np.bincount(pair, minlength=count) - fresh(pair, both)) / per,
        np.array([1 - len(set(x)) / max(len(x), 1) if x else 0 for x in lines]), total(symbols > 0) / per, total(letters) / chars)
    for place, column in enumerate(columns):
        out[:, place] = np.where(some, column, 0)
    return out


class Model(NamedTuple):
    """``score = 1 / (1 + exp(-(weights . features - threshold)))``."""

    weights: np.ndarray
    threshold: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights - self.threshold, -30, 30)))


def fitted(rows: np.ndarray, good: np.ndarray, seed: int = 7) -> Model:
    """Newton steps on the pairwise loss; pairs are drawn evenly from all better and worse rows."""
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    none = Model(np.zeros(len(FEATURES)), 0.0)
    if not len(better) or not len(worse):
        return none
    draw = np.random.default_rng(seed)
    spread = rows.std(axis=0)
    scale = np.where(spread > 1e-9, spread, 1)
    x = (rows[draw.choice(better, PAIRS)] - rows[draw.choice(worse, PAIRS)]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - 1) / len(x) + RIDGE * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    w = w / scale
    ranked = np.sort(rows @ w)
    cut = len(worse)  # as many rows below the threshold as are labelled 0
    return Model(w, float((ranked[cut - 1] + ranked[min(cut, len(ranked) - 1)]) / 2))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Weights from at most SAMPLE labelled rows that are not held out; the threshold from all of them.

    It lies halfway between the scores at which as many rows are below as are labelled 0.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", "quality")
    share = min(1.0, 0.95 * SAMPLE / max(usable.count(), 1))
    sample = F.broadcast(usable.where(in_sample(F.xxhash64("doc_id"), share)).limit(SAMPLE))  # the limit is the proven bound
    rows = docs.select("doc_id", "text").join(sample, "doc_id").limit(2 * SAMPLE)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x = features(column_of(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("quality").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "x"])

    # in a fixed order, so that the same rows give the same pairs
    found = rows.mapInArrow(measure, "quality int, x array<double>").orderBy("quality", "x").collect()
    if not found:
        return fitted(np.zeros((0, len(FEATURES))), np.zeros(0, bool))
    model = fitted(np.array([r["x"] for r in found]), np.array([r["quality"] == 1 for r in found]))
    if not model.weights.any():
        return model

    def rank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(features(column_of(batch)) @ model.weights)], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ranked = written(docs.select("doc_id", "text").mapInArrow(rank, f"doc_id {kind}, x double").join(usable, "doc_id").select("x", "quality"))
    total, cut = ranked.agg(F.count("*"), F.count_if(F.col("quality") == 0)).first()
    if not 0 < cut <= total:
        return model
    return model._replace(threshold=(nth(ranked, "x", cut) + nth(ranked, "x", min(cut + 1, total))) / 2)


#: Parts that a range of scores is cut into in one pass.
PARTS = 1024


def nth(rows: DataFrame, column: str, n: int) -> float:
    """The n-th smallest value (from 1) of a finite column, exactly: counts over ever smaller ranges, no sorting."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    x = F.col(column)
    while low < high:
        place = F.least(F.floor((x - low) / (high - low) * PARTS), F.lit(PARTS - 1))
        inside = rows.where(x.between(low, high)).groupBy(place.alias("part")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for part in sorted(inside.collect()):  # PARTS rows at most
            if n <= part["n"]:
                break
            n -= part["n"]
        low, high = part["low"], part["high"]
    return low


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with ``column``, replacing one of that name."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.drop(column)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            value = model.scores(features(column_of(batch)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=[*batch.schema.names, column])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return scored(docs.select("doc_id", "text"), train(docs, labels)).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
