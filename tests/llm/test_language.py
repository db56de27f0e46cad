"""Language identification: code lengths against plain Python, held-out accuracy, edge cases."""

import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lineloom.llm import language, queries, textnp
from lineloom.llm.common import ship

TAUGHT = {"en": ["the cat sat on the mat", "then the hat", "", "that is that"], "de": ["der Hut und die Katze", "süß wie die Maus", "und der Hund"]}


def plain(texts, order, most):
    """A function (context, byte) -> probability, by the definition."""
    n = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        data = bytes(order) + t.encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                n[k][data[i - k : i]][data[i]] += 1
    everything = sum(n[0][b""].values())

    def p(ctx, byte):
        own = n[len(ctx)].get(ctx, Counter())
        kept = {b: c for b, c in own.items() if c * most >= everything}
        lower = (lambda b: p(ctx[1:], b)) if ctx else (lambda b: 1 / 256)
        if not kept:
            return lower(byte)
        whole = sum(own.values()) + len(own)
        if byte in kept:
            return kept[byte] / whole
        return (1 - sum(kept.values()) / whole) * lower(byte) / (1 - sum(map(lower, kept)))

    return p


@pytest.fixture(scope="module")
def taught(spark):
    ship(spark)
    ids = (i for i in range(1000) if crc32(str(i).encode()) % 5)
    rows = [(next(ids), t, lang) for lang, texts in TAUGHT.items() for t in texts]
    return spark.createDataFrame([*rows, (next(ids), None, "en"), (next(ids), "no language", None)], "doc_id bigint, text string, lang string")


@pytest.mark.parametrize("most", [200_000, 20])
def test_code_lengths_equal_plain_python(taught, most):
    trees = language.train(taught, order=3, most=most)
    assert [t.langs for t in trees] == [["de", "en"]]
    texts = ["the hat", "die Mäuse", "", "xyz \U0001f600", "th", "und und und"]
    got = language.code_lengths(pa.array(texts), trees[0])
    for k, lang in enumerate(trees[0].langs):
        p = plain(TAUGHT[lang], 3, most)
        for row, t in enumerate(texts):
            data = bytes(3) + t.encode()
            assert got[row, k] == pytest.approx(sum(-math.log2(p(data[i - 3 : i], data[i])) for i in range(3, len(data))), abs=1e-9)


def test_probabilities_sum_to_one(taught):
    (trees,) = language.train(taught, order=3, most=50)
    for ctx in (b"\0\0\0", b"the", b" th", b"zzz", b"zzt", b"\0\0d", "ü".encode() + b"z"):
        key = np.array([int.from_bytes(ctx + bytes([b]), "big") for b in range(256)], np.uint64)
        assert np.exp2(-trees.bits(key)).sum(axis=0) == pytest.approx([1.0, 1.0], abs=1e-9)


def test_parts_of_languages_and_of_texts_do_not_matter(spark, taught, monkeypatch):
    docs = taught.select("doc_id", "text")
    whole = sorted(map(tuple, language.identify(docs, language.train(taught)).collect()), key=str)
    long = pa.array(["the Hund and " * 500])
    (trees,) = language.train(taught)
    bits = language.code_lengths(long, trees)
    monkeypatch.setattr(language, "PASS_ENTRIES", 1)
    parts = language.train(taught)
    assert [t.langs for t in parts] == [["de"], ["en"]]
    again = sorted(map(tuple, language.identify(docs, parts).collect()), key=str)
    assert [r[:2] for r in again] == [r[:2] for r in whole] and [r[2] for r in again] == pytest.approx([r[2] for r in whole])
    monkeypatch.setattr(textnp, "BLOCK", 100)
    assert language.code_lengths(long, trees) == pytest.approx(bits)


def test_held_out_texts_of_the_given_table(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [r for r in queries.op13_language_id(spark, folder).collect() if r.held_out]
    assert len(rows) > 100 and {r.doc_id for r in rows} == {i for i in truth if crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(spark, taught):
    rows = [(900, None, "en"), (901, "", None), (902, "12 34 !", "de"), (903, "der Hut", None), (None, "the cat", "xx"), (903, "der Hut", None)]
    docs = taught.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).selectExpr("doc_id", "text", "lang", "1 as bits", "'q' as lang_pred")
    out = language.language_id(docs)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "bits"]
    got = [tuple(r) for r in out.collect() if r.doc_id is None or r.doc_id >= 900]
    assert sorted((r[0] or 0, r[2], r[3] > 0.5) for r in got) == [(0, "en", True), (900, "und", False), (901, "und", False), (902, "und", False), (903, "de", True), (903, "de", True)]
    assert [r[1] for r in got if r[0] is None] == [True]
    assert language.language_id(docs.limit(0)).count() == 0
    nothing = language.language_id(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
