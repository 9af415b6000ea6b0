"""Samples and thresholds that hold at any size, and what counts as a letter."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipstride.llm import language_id, quality_ranking
from clipstride.llm.words import column_of, in_sample

SF = "/root/testdata/sf0.001"


def test_shares_are_taken_from_63_bits(spark):
    hashes = [0, 1, 2**40, -(2**62), 2**63 - 1, -1, -(2**63)]
    rows = spark.createDataFrame([(h,) for h in hashes], "h long")
    for share in (0.0, 2.0**-63, 1e-9, 0.25, 0.5, 0.75, 1.0):
        got = {r["h"] for r in rows.where(in_sample(F.col("h"), share)).collect()}
        assert got == {h for h in hashes if ((h % 2**64) >> 1) < share * 2**63}, share
    many = spark.range(200_000).where(in_sample(F.xxhash64("id"), 1e-3)).count()
    assert 120 < many < 290


@pytest.mark.parametrize("values", [[3.0], [1.0, 1.0, 1.0], [0.0, 5e-324], [-1e300, 1e300, 0.1, 0.1], "many"])
def test_nth_equals_sorting(spark, monkeypatch, values):
    draw = random.Random(1)
    values = [draw.choice([draw.gauss(0, 1), 0.25, 1e9 * draw.random()]) for _ in range(700)] if values == "many" else values
    monkeypatch.setattr(quality_ranking, "PARTS", 8)
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for n in sorted({1, len(values), len(values) // 2 + 1, len(values) // 3 + 1}):
        assert quality_ranking.nth(rows, "x", n) == sorted(values)[n - 1]


def test_threshold_is_taken_over_all_labels(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    whole = quality_ranking.train(docs, labels)
    monkeypatch.setattr(quality_ranking, "SAMPLE", 40)
    model = quality_ranking.train(docs, labels)
    assert not np.allclose(model.weights, whole.weights)  # fewer rows are fitted on
    usable = labels.where(F.col("quality").isin(0, 1) & ~quality_ranking.held_out()).join(docs.select("doc_id", "text"), "doc_id")
    rows = usable.select("quality", "text").toArrow()
    x = np.sort(quality_ranking.features(column_of(rows.combine_chunks().to_batches()[0])) @ model.weights)
    cut = sum(q == 0 for q in rows.column("quality").to_pylist())
    assert 0 < cut < len(x) and model.threshold == pytest.approx((x[cut - 1] + x[cut]) / 2)


def test_number_signs_are_no_letters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(["½ ② ²", "12 34", "", None, "Ⅷ", "½ a"])], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.predictions(docs.union(odd)).where("doc_id >= 1000000").collect()}
    assert [found[10**6 + i] for i in range(5)] == [language_id.UNKNOWN] * 5 and found[10**6 + 5] != language_id.UNKNOWN
