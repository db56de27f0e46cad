"""Deletion of repeated line runs.

The corpus is a set of sequences of line IDs.  Prefix doubling ranks, round by
round, all suffixes by their first 1, 2, 4, ... lines; suffixes of equal rank
form the intervals whose common prefix is at least that long.  A run that has
``min_words`` words has at most ``min_words`` lines, so doubling stops there.
Every shortest window of ``min_words`` words is located in its interval by the
ranks at its two ends (as in a sparse table); in each interval all windows but
the first are later copies, and their lines are deleted.  The union of those
windows is exactly the union of all maximal repeated runs of ``min_words`` or
more words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .common import stage

MIN_WORDS = 20


def _lines(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, rk, i, h1, h2, nw): every line that has a word, numbered within its text, with a 128-bit digest and its words."""
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rk"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, raw, off in textnp.blocks(b.column(2)):
                h1, h2, start, end, wb = textnp.words(raw, off, True, textnp.NEWLINE, textnp.AS_IS)
                _, ws, _, _ = textnp.words(raw, off)
                nw = np.searchsorted(ws, end) - np.searchsorted(ws, start)
                doc = np.searchsorted(wb, np.arange(len(start)), "right") - 1
                some = nw > 0
                h1, h2, nw, doc = h1[some], h2[some], nw[some], doc[some]
                first = np.searchsorted(doc, doc)
                take = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array((np.arange(len(doc)) - first).astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(nw.astype(np.int32))],
                    names=["id", "rk", "i", "h1", "h2", "nw"],
                )

    return src.mapInArrow(run, f"id {kind}, rk bigint, i int, h1 bigint, h2 bigint, nw int")


def _windows(runs: DataFrame, min_words: int) -> DataFrame:
    """(d, i, l): windows of ``l`` lines from ``i`` that have ``min_words`` words but not without their first or without their last line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, starts, lengths = [], [], []
            for row in range(b.num_rows):
                lines = b.column(1)[row].values
                i = lines.field("i").to_numpy()
                cum = np.concatenate([[0], np.cumsum(lines.field("nw").to_numpy().astype(np.int64))])
                for cut in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i) != 1) + 1):
                    a, z = int(cut[0]), int(cut[-1]) + 1
                    c = cum[a : z + 1]
                    # from each start the first sufficient end; from each end the last sufficient start
                    s = np.arange(z - a)
                    e = np.searchsorted(c, c[:-1] + min_words)
                    ok = e <= z - a
                    pairs = set(zip(s[ok].tolist(), e[ok].tolist(), strict=True))
                    e2 = np.arange(1, z - a + 1)
                    s2 = np.searchsorted(c, c[1:] - min_words, "right") - 1
                    ok = s2 >= 0
                    pairs |= set(zip(s2[ok].tolist(), e2[ok].tolist(), strict=True))
                    for x, y in pairs:
                        keys.append(row)
                        starts.append(int(i[a]) + x)
                        lengths.append(y - x)
            take = pa.array(keys, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32())], names=["d", "i", "l"])

    return runs.mapInArrow(run, f"d {runs.schema['d'].dataType.simpleString()}, i int, l int")


def removed_lines(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, rk, gone): per text with deletions, the numbers of the lines to delete among its lines that have a word."""
    lines = stage(_lines(docs, text_col, id_col), "lines")
    # IDs of repeated lines only: any longer repeat consists of them.
    ids = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "rk", "i")).alias("first")).where("n > 1")
    pos = stage(
        lines.join(ids.select("h1", "h2"), ["h1", "h2"]).select(F.struct("id", "rk").alias("d"), "i", "nw", "h1", "h2").distinct(), "line-positions"
    )
    runs = pos.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("i", "nw"))).alias("lines"))
    wins = stage(_windows(runs, min_words), "line-windows")
    longest = wins.agg(F.max("l")).first()[0] or 0
    spark = docs.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def ranked(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
        """Distinct pairs with a rank that rises in their sorted order over all partitions."""
        order = pairs.select(a, b).distinct().repartitionByRange(parts, a, b).sortWithinPartitions(a, b)
        return stage(order.withColumn("r", F.monotonically_increasing_id()), name)

    level = stage(pos.join(ranked(pos, "h1", "h2", "rank-1"), ["h1", "h2"]).select("d", "i", "r"), "level-1")
    k, keyed = 0, None
    while (1 << k) <= max(longest, 1):
        h = 1 << k
        own = wins.where((F.col("l") >= h) & (F.col("l") < 2 * h))
        ends = (
            own.join(level.withColumnRenamed("r", "r1"), ["d", "i"])
            .withColumn("j", F.col("i") + F.col("l") - h)
            .join(level.select("d", F.col("i").alias("j"), F.col("r").alias("r2")), ["d", "j"])
            .select("d", "i", "l", "r1", "r2")
        )
        keyed = ends if keyed is None else keyed.unionByName(ends)
        if 2 * h > longest:
            break
        pairs = level.withColumnRenamed("r", "a").join(level.select("d", (F.col("i") - h).alias("i"), F.col("r").alias("b")), ["d", "i"])
        pairs = stage(pairs, f"pairs-{2 * h}")
        level = stage(pairs.join(ranked(pairs, "a", "b", f"rank-{2 * h}"), ["a", "b"]).select("d", "i", "r"), f"level-{2 * h}")
        k += 1
    keyed = stage(keyed, "line-intervals")
    firsts = keyed.groupBy("l", "r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "i")).alias("first")).where("n > 1")
    later = keyed.join(firsts, ["l", "r1", "r2"]).where(F.struct("d", "i") != F.col("first"))
    return (
        later.select("d", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("l") - 1)).alias("x"))
        .groupBy("d")
        .agg(F.sort_array(F.collect_set("x")).alias("gone"))
        .select(F.col("d.id").alias("id"), F.col("d.rk").alias("rk"), "gone")
    )


def line_dedup(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later copies of repeated line runs deleted from ``text_col``, plus n_lines and n_removed.

    Lines are equal byte by byte; lines without a word take no part and stay.
    A line goes if and only if some run of at least ``min_words`` words that
    holds it stands earlier, in (id, text hash, line) order with null ids first.
    Rows equal in id and text are one document: they neither delete nor differ
    from each other.  Null texts stay null, empty ones empty, n_lines 0.
    Columns of ``docs`` named n_lines or n_removed are replaced, other names
    don't matter.  Texts are taken whole, a long one as a block of its own.
    """
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    at = names.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # no name of a column matters
    key, text = f"c{names.index(id_col)}", f"c{at}"
    gone = removed_lines(plain, text_col=text, id_col=key, min_words=min_words).select(F.col("id").alias("_id"), F.col("rk").alias("_rk2"), "gone")
    joined = plain.withColumn("_rk", F.xxhash64(key, text)).join(gone, (F.col("_rk") == F.col("_rk2")) & F.col(key).eqNullSafe(F.col("_id")), "left").select(*plain.columns, "gone")
    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields) + ", n_lines int, n_removed int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, removed = [], [], []
            for text, drop in zip(b.column(at), b.column(b.num_columns - 1), strict=True):
                text, drop = text.as_py(), drop.as_py()
                lines = text.split("\n") if text else []
                solid = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
                counts.append(len(solid))
                removed.append(len(drop or ()))
                if drop:
                    bad = {solid[i] for i in drop}
                    text = "\n".join(x for i, x in enumerate(lines) if i not in bad)
                texts.append(text)
            cols = b.columns[:-1]
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int32()), pa.array(removed, pa.int32())], names=[*(f"c{i}" for i in range(len(names))), "n_lines", "n_removed"])

    return joined.mapInArrow(run, out_schema).toDF(*names, "n_lines", "n_removed")


ORACLE = rf"""
WITH raw AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
ln AS (
  SELECT doc_id, ord, line, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS nw
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS ord FROM raw)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (
  SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM ln),
arr AS (SELECT doc_id, list(line ORDER BY i) AS a FROM ln GROUP BY doc_id),
w AS (
  SELECT x.doc_id, x.i AS s, y.i AS e FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.i BETWEEN x.i AND x.i + {MIN_WORDS} - 1
  WHERE y.upto - x.upto + x.nw >= {MIN_WORDS}
    AND (y.upto - y.nw - x.upto + x.nw < {MIN_WORDS} OR y.upto - x.upto < {MIN_WORDS})),
k AS (SELECT w.*, array_to_string(a[s:e], chr(10)) AS body FROM w JOIN arr USING (doc_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY e - s, body ORDER BY doc_id, s) AS copy FROM k),
gone AS (SELECT DISTINCT f.doc_id, ln.i FROM f JOIN ln ON ln.doc_id = f.doc_id AND ln.i BETWEEN s AND e WHERE copy > 1),
n AS (SELECT doc_id, count(*) AS n_lines, count(gone.i) AS n_removed FROM ln LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id),
kept AS (
  SELECT all_l.doc_id, string_agg(all_l.line, chr(10) ORDER BY all_l.ord) AS body
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS ord FROM raw) all_l
  LEFT JOIN ln USING (doc_id, ord) LEFT JOIN gone ON gone.doc_id = all_l.doc_id AND gone.i = ln.i
  WHERE gone.i IS NULL GROUP BY all_l.doc_id)
SELECT raw.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.body, '')) AS kept_sha256
FROM raw LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
