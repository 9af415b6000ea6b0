"""Language of a text by sparse multinomial logistic regression on TF-IDF character n-grams.

Letters in lower case, everything else as one blank; n-grams of one to three characters are hashed to DIMENSIONS
features. Document frequencies come from every training document. The weights are learned by follow-the-regularised-leader
(per-coordinate steps) with an elastic net, whose first part keeps most of them exactly zero; then one temperature is fitted on
rows that were kept aside, so that the score is a calibrated probability. What is learned from is bounded (SAMPLE
labelled rows, evenly by language, picked by hash); every text is read and scored whole.

Null texts and texts without letters give ``und`` with score 0, as does everything if no row is labelled. Repeated
rows give equal rows. The number of languages is that of the label column and assumed to fit the driver. Extra columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipstride.llm.words import chunks, column_of, in_sample

BITS = 13
DIMENSIONS = 1 << BITS
SAMPLE, ASIDE, EPOCHS = 1600, 0.2, 4
#: Of the leader: step size, its start, and the two parts of the elastic net.
ALPHA, BETA, LASSO, RIDGE = 0.5, 1.0, 0.05, 0.5
UNKNOWN = "und"
PIECE = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    total = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(points), PIECE):
        x = points[at : at + PIECE + 2]
        x = np.where(_letters()[x], x, 32).astype(np.uint64)
        a, b, c = x, x[:-1] * np.uint64(0x10FFFF) + x[1:], None
        c = b[:-1] * np.uint64(0x10FFFF) + x[2:]
        for n, key in enumerate((a, b, c)):
            key = (key + np.uint64(n << 62)) * np.uint64(0x9E3779B97F4A7C15)
            own = len(x) - 2 if len(x) == PIECE + 2 else len(key)  # the next piece starts with the last two
            total += np.bincount(((key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)[:own], minlength=DIMENSIONS)
    return total


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # feature x language
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        at, value = tfidf(grams(text), self.idf)
        p = softmax(value @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def tfidf(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the features of a text, of length one."""
    at = np.flatnonzero(count)
    value = (1 + np.log(count[at])) * idf[at]
    return at, value / max(np.sqrt((value * value).sum()), 1e-12)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, seed: int = 11) -> np.ndarray:
    """Weights by follow-the-regularised-leader."""
    z, n = np.zeros((DIMENSIONS, classes)), np.zeros((DIMENSIONS, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > LASSO, -(z - np.sign(z) * LASSO) / ((BETA + np.sqrt(n)) / ALPHA + RIDGE / len(rows)), 0.0)

    draw = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in draw.permutation(len(rows)):
            at, x = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - step * w
            n[at] = ni + g * g
    return weights(z, n)


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least loss on rows not learned from."""
    if not len(labels):
        return 1.0
    unsure = 1 / (len(labels) + 2)  # rows without an error do not prove certainty
    target = np.full(logits.shape, unsure / max(logits.shape[1] - 1, 1))
    target[np.arange(len(labels)), labels] = 1 - unsure
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    loss = [-(target * np.log(softmax(logits / t) + 1e-300)).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, texts = np.zeros(DIMENSIONS, np.int64), 0
    for batch in chunks(batches):
        for text in column_of(batch).to_pylist():
            found += grams(text) > 0
            texts += 1
    yield pa.RecordBatch.from_arrays([pa.array([texts], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))], names=["n", "found"])


def train(docs: DataFrame) -> Model:
    """Learn from rows (text, lang) whose lang is not null."""
    rows = docs.where("lang IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.ones(DIMENSIONS), np.zeros((DIMENSIONS, 0)), 1.0)
    found = rows.mapInArrow(_frequencies, "n long, found array<long>").select("n", F.posexplode("found")).groupBy("pos").agg(
        F.sum("n").alias("n"), F.sum("col").alias("df")).collect()
    df, total = np.zeros(DIMENSIONS), 0
    for r in found:
        df[r["pos"]], total = r["df"], r["n"]
    idf = np.log((1 + total) / (1 + df)) + 1
    share = {k: min(1.0, SAMPLE / len(languages) / n) for k, n in counts.items()}
    limit = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])[F.col("lang")]
    sample = rows.where(in_sample(F.xxhash64("doc_id", "text"), limit)).limit(2 * SAMPLE)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            kept = [(lang, *tfidf(grams(t), idf)) for t, lang in zip(column_of(batch).to_pylist(), batch.column("lang").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _, _ in kept]), pa.array([a.astype("<i4").tobytes() for _, a, _ in kept], pa.binary()),
                pa.array([v.astype("<f4").tobytes() for _, _, v in kept], pa.binary())], names=["lang", "at", "value"])

    sampled = sorted((r["lang"], bytes(r["at"]), bytes(r["value"])) for r in sample.mapInArrow(measure, "lang string, at binary, value binary").collect())
    order = np.random.default_rng(5).permutation(len(sampled))
    x = [(np.frombuffer(sampled[i][1], "<i4"), np.frombuffer(sampled[i][2], "<f4").astype(float)) for i in order]
    y = np.array([languages.index(sampled[i][0]) for i in order], np.int64)
    aside = int(ASIDE * len(x))
    weights = follow(x[aside:], y[aside:], len(languages)) if len(x) > aside else np.zeros((DIMENSIONS, len(languages)))
    logits = np.array([v @ weights[at] for at, v in x[:aside]]).reshape(aside, len(languages))
    return Model(languages, idf, weights, calibrated(logits, y[:aside]))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; held-out rows are not learned from."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    docs = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = train(docs.where("NOT held_out"))

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array([k for k, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "held_out").mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
