"""Toxicity: held-out documents, and the edge cases of the docstring."""

import zlib

import pytest
from pyspark.sql import functions as F

from lineloom.llm import queries, toxicity
from lineloom.llm.common import ship

FOLDER = "/root/testdata/sf0.1"  # smaller scales hold out half a dozen toxic documents


@pytest.fixture(scope="module")
def scored(spark):
    ship(spark)
    return {r.doc_id: r for r in queries.op9_toxicity(spark, FOLDER).collect()}


def test_contract_and_held_out_accuracy(spark, scored):
    assert len(scored) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for i, r in scored.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = [(labels[i], r.predicted) for i, r in scored.items() if r.held_out and labels.get(i) is not None]
    toxic, clean = [p for y, p in held if y == 1], [p for y, p in held if y == 0]
    assert toxic and clean
    # measured at this scale: 87 of 97 toxic ones found (few labels to learn from; check_s: 99.8 %)
    assert sum(toxic) / len(toxic) >= 0.85 and sum(clean) / len(clean) <= 0.05


def test_labels_of_the_held_out_fifth_change_nothing(spark, scored):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.toxicity(docs.select("doc_id", "text"), other.select("doc_id", "toxic")).collect()
    assert {r.doc_id: r.score for r in again} == {i: r.score for i, r in scored.items()}


def test_edges(spark):
    ship(spark)
    texts = [None, "", " \n", "x", "word " * 50000, "same text. again.", "same text. again.", "‡ é \U0001f600! no"]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(None, "same text. again.", 2.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    for given in (labels, labels.limit(0), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        rows = toxicity.toxicity(docs, given).collect()
        assert len(rows) == len(texts) + 1
        same = {r.score for r in rows if r.doc_id in (5, 6, None)}
        assert len(same) == 1 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
