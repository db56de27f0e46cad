"""Token counts against the library, line deletion against its SQL."""

import duckdb
import public_tokenizers as P

from lineloom.llm import line_dedup, queries, token_counts
from lineloom.llm.common import ship


def test_token_counts_equal_the_library(spark):
    import tokenizers

    ship(spark)
    path = P.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    texts = [None, "", " ", "plain words, and more words", "Don't  \n\n stop\t‡ ñ 12345", "x" * 3000, "\U0001f600\U0001f600 <|endoftext|> tail ", "plain words, and more words"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "q r"), (3, texts[3])], "doc_id bigint, text string")
    rows = token_counts.token_counts(docs, path, limit=5).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = ("q r" if r.doc_id is None else texts[r.doc_id]) or ""
        n = len(tok.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 5)


def test_line_dedup_equals_its_sql(spark, tmp_path):
    line = lambda s: " ".join(f"{s}{i}" for i in range(9))
    run = "\n".join(line(f"r{i}w") for i in range(8))
    texts = [run, None, "", f"{line('a')}\n{run}\n{line('b')}", f"{run}\n{run}", " \n", f"{line('c')}\n{line('a')}", run]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(line_dedup.ORACLE).fetchall())
    got = queries.op2_line_dedup(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == want
    assert sum(r.n_removed for r in got) > 0


def test_line_dedup_minds_no_column_name(spark):
    run = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) for i in range(4))
    docs = spark.createDataFrame([(1, run, "a", 5, "b"), (2, run, "c", 6, "d"), (None, run, "e", 7, "f"), (None, None, "g", 8, "h"), (2, run, "c", 6, "d")], "doc_id bigint, text string, gone string, _rk bigint, id string")
    out = line_dedup.line_dedup(docs)
    assert out.columns == ["doc_id", "text", "gone", "_rk", "id", "n_lines", "n_removed"]
    rows = sorted(out.collect(), key=str)
    assert sorted((r.gone, r._rk, r.id) for r in rows) == [("a", 5, "b"), ("c", 6, "d"), ("c", 6, "d"), ("e", 7, "f"), ("g", 8, "h")]
    assert {r.gone: r.text for r in rows} == {"a": "", "c": "", "e": run, "g": None}  # the null id comes first
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_takes_long_texts_whole(spark):
    lines = [" ".join(f"l{i}w{j}" for j in range(5)) for i in range(20000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["first", *lines[-6:], "last"])), (3, "\n".join(lines[:3]))], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.line_dedup(docs).collect()}
    assert got[1][0] == 0 and got[2] == (6, "first\nlast") and got[3][0] == 0
