"""Stages of the pipeline on null ids, repeated rows and documents without lines."""

import corpus_pipeline as C

from lineloom.llm.common import ship

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def text(seed, n=60):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def table(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def ordered(rows):
    return sorted(((r[0], r[1]) for r in rows), key=str)


def test_near_duplicates_keeps_one_row_of_each_component(spark):
    near = text(1).replace("w1x30", "other")
    alone = [(None, text(2)), (None, text(3)), (None, None), (5, ""), (5, ""), (8, " \n")]
    # 1 heads a component and also names a row of another text, whose own component has the smaller id 0
    docs = [(1, text(1)), (1, text(1)), (4, near), (None, text(1)), (1, text(6)), (0, text(6)), (None, text(7)), (None, text(7)), *alone]
    got = C.near_duplicates(spark, table(spark, docs), "").collect()
    assert ordered(got) == ordered([(1, text(1)), (0, text(6)), (None, text(7)), *alone])
    assert got[0].__fields__ == C.COLUMNS


def test_line_runs_keeps_what_lost_nothing(spark):
    run = "\n".join(text(f"l{i}", 12) for i in range(8))
    docs = [(1, run), (2, run), (3, text(9)), (4, ""), (5, None), (6, " \n "), (None, text(10))]
    got = C.line_runs(spark, table(spark, docs), "").collect()
    assert ordered(got) == ordered([d for d in docs if d[0] != 2])
    assert all(r.n_chars == len(r.text or "") for r in got)


def test_run_equals_brute_force(spark, tmp_path):
    """All five stages on a small corpus: rules and line runs by their SQL, the others pair by pair."""
    import duckdb
    import public_tokenizers as P
    import sentencepiece
    from brute import shingles

    from lineloom.llm import line_dedup, quality

    def prose(seed, n, lines=1):
        words = [f"t{seed}q{i}" for i in range(n)]
        step = -(-n // lines)
        return "\n".join(" ".join(words[i : i + step]) for i in range(0, n, step))

    licence = prose("licence", 80, 4)
    item = prose("item", 30) + ". " + prose("answer", 5) + "."
    docs = [(i, prose(i, 70 + i, 3)) for i in range(12)]
    docs += [(20 + i, prose(f"l{i}", 60, 2) + "\n" + licence) for i in range(3)]  # a run of lines in three documents
    docs += [(30, prose(3, 73, 1).replace("t3q40", "other")), (31, prose(3, 73, 1)), (32, prose(3, 73, 1))]  # near and exact copies
    docs += [(40, prose("c", 60) + " " + item + " " + prose("d", 60)), (41, item.replace("titemq7 ", "") + " " + prose("e", 60))]
    docs += [(50, "too short"), (51, None), (52, ""), (53, "again and again " * 40), (None, prose("null", 90, 3))]
    spark.createDataFrame([(i, t, "en", f"https://h{(i or 0) % 3}.example/x", len(t or "")) for i, t in docs], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    ship(spark)
    got = C.run(spark, str(tmp_path)).collect()

    con = duckdb.connect()
    con.execute(f"create table documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    kept = {r[0] for r in con.execute(f"select doc_id from ({quality.ORACLE}) where kept").fetchall()}
    rows = con.execute("select * from documents").fetchall()
    rows = [r for r in rows if r[0] in kept]
    con.execute("delete from documents where doc_id not in (select unnest(?)) or (doc_id is null and ?)", [[i for i in kept if i is not None], None not in kept])
    # the SQL has no null ids: the row stands before all others, as the operator's order has it
    con.execute("update documents set doc_id = -1 where doc_id is null")
    text = {r[0]: (r[1] or "").split("\n") for r in con.execute("select doc_id, text from documents").fetchall()}
    gone = line_dedup.ORACLE.split("n AS (SELECT doc_id, count(*)")[0].rstrip().rstrip(",")
    removed = {}
    for d, i in con.execute(gone + " SELECT doc_id, i FROM gone").fetchall():
        removed.setdefault(d, set()).add(i)
    after = {}
    for d, lines in text.items():
        solid = [k for k, x in enumerate(lines) if x.strip()]
        bad = {solid[i - 1] for i in removed.get(d, ())}
        if solid and len(bad) == len(solid):
            continue
        after[d] = "\n".join(x for k, x in enumerate(lines) if k not in bad)
    sets = {d: shingles(t) for d, t in after.items()}
    root = {d: d for d in after}
    for a in sorted(after):
        for b in sorted(after):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]), key=lambda d: (d == -1, d))
                root = {d: low if r == high else r for d, r in root.items()}
    final = {d: t for d, t in after.items() if root[d] == d and item not in t and d != 41}
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in got) == sorted(final)
    assert {40, 41, 50, 53}.isdisjoint(final) and 20 in final and {0, 1, 2, -1} <= set(final) and len({30, 31, 32, 3} & set(final)) == 1
    for r in got:
        assert r.ids == sp.encode(final[-1 if r.doc_id is None else r.doc_id] or "") and r.round_trip


def test_quality_stage_judges_equal_rows_by_their_own_hosts(spark):
    ship(spark)
    good, short = text(1), [(i, "few words", "en", "bad", 9) for i in range(10, 60)]
    rows = [(1, good, "en", "bad", 1), (1, good, "en", "fine", 1), (None, good, "en", None, 1), *((i, text(i), "en", "fine", 1) for i in range(2, 6)), (7, None, "en", "fine", 0), *short]
    got = C.quality_rules(spark, spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as _rk", "2 as kept"), "").collect()
    assert {(r.doc_id, r.source) for r in got} == {(1, "fine"), (None, None), (2, "fine"), (3, "fine"), (4, "fine"), (5, "fine")}
    assert got[0].__fields__ == C.COLUMNS
    assert C.quality_rules(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
