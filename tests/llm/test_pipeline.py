"""The pipeline, stage by stage, against what each operator says of the stage's own input."""

import check
import corpus_pipeline
import pytest

import __spark_entry__ as entry
from clipstride.llm import catalog, substring_dedup
from clipstride.operators.store import written
from test_tensored_minhash import brute

SF = "/root/testdata/sf0.001"


def test_queries_equal_their_sql(spark):
    database = check.database(SF)
    for name, sql in catalog.SQL.items():
        same, note = check.compare(entry.queries()[name](spark, SF), database, sql)
        assert same, (name, note)


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    ledger = {r["doc_id"]: r["kept"] for r in catalog.QUERIES["op1_quality_rules"](spark, SF).collect()}
    scores = {r["doc_id"]: r["predicted"] for r in catalog.QUERIES["op9_quality_classifier"](spark, SF).collect()}
    found = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF))
        found.append({r[0] for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == columns
        if name == "simhash_near_dedup":
            least = {component for _, _, component in brute([(r["doc_id"], r["text"]) for r in before.collect()], 5)}
            assert found[-1] == least and docs.count() == len(least)
        if name == "substring_dedup":
            want = {r["doc_id"]: r["n_words"] - r["n_removed"] for r in substring_dedup.digests(before).collect()}
            assert {r["doc_id"]: len(r["text"].encode().split()) for r in docs.collect()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert found[0] == {i for i, kept in ledger.items() if kept}
    assert found[1] == {i for i in found[0] if scores[i]}
    assert found[4] == found[3] == found[2]
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == len(found[4])


def test_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = docs.selectExpr("*", "'x' AS score", "1 AS fp", "2 AS kept", "3 AS __row").unionByName(
        docs.selectExpr("*", "'x' AS score", "1 AS fp", "2 AS kept", "3 AS __row"))
    for frame in (odd, odd.where("false"), odd.withColumn("text", pytest.importorskip("pyspark.sql.functions").lit(None).cast("string"))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = written(stage(spark, frame, SF))
            assert frame.columns == odd.columns, name
        corpus_pipeline.STAGES[-1][1](spark, frame, SF).count()
