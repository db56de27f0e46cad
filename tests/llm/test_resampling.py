"""Importance resampling against its SQL and against plain Python."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import duckdb

from lineloom.llm import queries, resampling, textnp
from lineloom.llm.common import ship

WORDS = [f"w{i}é" if i % 3 else f"W{i}" for i in range(50)]


def features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=5, least=20):
    bucket = lambda f: crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    rows = [(i, *features(x)) for i, x in docs]
    for _, _, fs in rows:
        s.update(map(bucket, fs))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for i, n, fs in rows:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    place = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((r[0], *r[2:], place.get(id(r))) for r in out), key=str)


def corpus():
    some = lambda i, n: " ".join(WORDS[(i * k * k + k) % (7 + i % 40)] for k in range(n))
    docs = [(i, some(i, 5 + i % 60)) for i in range(200)]
    docs += [(200, None), (201, ""), (202, " \n "), (203, "`a{b}C_9"), (204, some(3, 25)), (205, some(3, 25)), (206, "x" * 5000 + " y"), (None, some(5, 30))]
    return docs, [some(4, 40), None, "", some(9, 3)]


def test_equals_plain_python(spark):
    ship(spark)
    docs, target = corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = resampling.importance_resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=30)
    assert sorted((tuple(r)[:1] + tuple(r)[2:] for r in got.collect()), key=str) == brute(docs, target, percent=30)


def test_equals_its_sql(spark, tmp_path):
    docs, target = corpus()
    docs = [r for r in docs if r[0] is not None]
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(t,) for t in target], "text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = queries.op11_importance_resampling(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(resampling.ORACLE).fetchall(), key=str)
    assert sum(r["rank"] is not None for r in got) == 5 * sum(features(t)[0] >= 20 for _, t in docs) // 100


def test_long_texts_in_parts_count_as_whole(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    text = " ".join(WORDS[(k * k) % 50] for k in range(3000)) + " " + "z" * 700 + " end of it"
    whole = sum(r.bucket_counts(10000) for _, _, r in resampling.blocks(pa.array([text])))
    monkeypatch.setattr(textnp, "BLOCK", 300)
    parts = list(resampling.blocks(pa.array([text])))
    assert len(parts) > 10 and np.array_equal(sum(r.bucket_counts(10000) for _, _, r in parts), whole)
    gain = np.arange(10000)
    assert sum(int(r.sums(gain, 1)[1][0]) for _, _, r in parts) == int((whole * gain).sum())
    assert sum(int(r.n_words[0]) for _, _, r in parts) == 3004


def test_runs_are_the_distinct_ngrams():
    import numpy as np

    raw = np.frombuffer(b"a b a b c a b", np.uint8)
    r = resampling.Runs(raw, np.array([0, 7, 13]))  # "a b a b" and " c a b"
    assert [len(code[there]) for code, _, there, _ in r.sizes] == [3, 3, 3]
    assert [int(counted.sum()) for _, _, _, counted in r.sizes] == [7, 5, 3]


def test_minds_no_column_name_and_no_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b " * 20, "x", 5), (1, "a b " * 20, "x", 5), (2, None, "y", 6)], "doc_id bigint, text string, rank string, score int")
    target = spark.createDataFrame([], "text string")
    out = resampling.importance_resample(docs, target, keep_cols=("rank", "score"), percent=50)
    assert out.columns == ["doc_id", "rank", "score", "n_words", "n_features", "weight", "score", "rank"]
    rows = sorted(map(tuple, out.collect()), key=str)
    assert [r[:4] for r in rows] == [(1, "x", 5, 40), (1, "x", 5, 40), (2, "y", 6, 0)] and sorted(r[-1] or 0 for r in rows) == [0, 0, 1]
    assert resampling.importance_resample(docs.limit(0), target).count() == 0
