"""Importance resampling toward a target distribution, by hashed word n-grams.

A block's words become ids, and the suffix array of the ids, in the order of a
suffix's first three words, brings equal n-grams side by side: its LCP runs are
the distinct n-grams.  Each run is hashed once and its bucket goes back to all
its occurrences.  A first pass counts buckets over all documents and all target
texts, a second one sums each document's gains; the draw is a Gumbel top-k,
ranked by one range sort of narrow rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnp
from .common import stage

BUCKETS = 10_000
LONGEST = 3
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Runs:
    """Suffix array and LCP of a block's words; ``skip`` words at its beginning were counted before and only complete later runs."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, skip: int = 0):
        h, self.start, end, wb = textnp.words(raw, off, space=_OUTSIDE)
        n = len(h)
        self.n_words = np.diff(wb)
        self.n_words[:1] -= skip
        _, first, word = np.unique(h, return_index=True, return_inverse=True)
        low = textnp._LOWER[raw].tobytes()
        words = [low[a:z] for a, z in zip(self.start[first].tolist(), end[first].tolist(), strict=True)]
        doc = np.repeat(np.arange(len(off) - 1), np.diff(wb))
        # ids from 1 on, 0 beyond the text's end; a block has less than 2**21 words
        ids = np.zeros((LONGEST, n), np.int64)
        ids[0] = word + 1
        for k in range(1, LONGEST):
            ids[k, :-1] = np.where(doc[1:] == doc[:-1], ids[k - 1, 1:], 0)
        key = (ids[0] << 42) | (ids[1] << 21) | ids[2]
        sa = np.argsort(key)
        self.doc, key = doc[sa], key[sa]
        apart = key[1:] ^ key[:-1]
        self.lcp = (apart < 1 << 42).astype(np.int8) + (apart < 1 << 21) + (apart == 0)
        spaced = [b" " + w for w in words]
        self.sizes = []
        crc = np.zeros(n, np.uint32)
        for size in range(1, LONGEST + 1):
            begin = np.flatnonzero(np.append(True, self.lcp < size)) if n else np.zeros(0, np.int64)
            at = sa[begin]
            last = ids[size - 1, at]
            there = last > 0
            begin_of = crc[begin[there]].tolist()
            tails = words if size == 1 else spaced
            code = np.zeros(len(begin), np.uint32)
            code[there] = list(map(crc32, [tails[i] for i in (last[there] - 1).tolist()], begin_of))
            long = np.diff(np.append(begin, n))
            crc = np.repeat(code, long)
            counted = np.repeat(there, long) & (sa + size - 1 >= skip)
            self.sizes.append((code, long, there, counted))

    def buckets(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per n-gram size: bucket of each run, occurrences of it that count, and which suffixes those are."""
        for code, long, _, counted in self.sizes:
            if len(long):
                yield (code % np.uint32(n)).astype(np.int64), np.add.reduceat(counted.astype(np.int64), np.cumsum(long) - long), counted

    def bucket_counts(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for bucket, times, _ in self.buckets(n):
            out += np.bincount(bucket, times, n).astype(np.int64)
        return out

    def sums(self, gains: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text its number of n-grams and the sum of their buckets' gains."""
        count, total = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        for (bucket, _, counted), (_, long, _, _) in zip(self.buckets(len(gains)), self.sizes, strict=False):
            doc = self.doc[counted]
            count += np.bincount(doc, minlength=texts)
            total += np.bincount(doc, np.repeat(gains[bucket], long)[counted], texts).astype(np.int64)
        return count, total


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, Runs]]:
    """(first row, end row, runs) of all texts; a long text comes in parts, each with the last words of the part before."""
    for i, j, raw, off in textnp.blocks(texts):
        if len(raw) <= 2 * textnp.BLOCK:
            yield i, j, Runs(raw, off)
            continue
        breaks = np.flatnonzero(_OUTSIDE[raw])  # one long text
        at, back, skip = 0, 0, 0
        while at < len(raw):
            k = int(np.searchsorted(breaks, at + textnp.BLOCK))
            at = int(breaks[k]) if k < len(breaks) else len(raw)
            part = Runs(raw[back:at], np.array([0, at - back]), skip)
            yield i, j, part
            skip = min(LONGEST - 1, len(part.start))
            back = back + int(part.start[-skip]) if skip else at


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): occurrences of n-grams by bucket over whole texts; at most ``buckets`` rows leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, r in blocks(b.column(0)):
                total += r.bucket_counts(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return texts.select(F.col(text_col).alias("t")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Log-likelihood ratio of each bucket, target over corpus, in thousandths, rounded down; one number per bucket reaches the driver."""
    both = bucket_counts(docs, text_col, buckets).withColumn("corpus", F.lit(True)).unionByName(bucket_counts(target, text_col, buckets).withColumn("corpus", F.lit(False)))
    s, t = [0] * buckets, [0] * buckets
    for r in both.toLocalIterator():
        (s if r["corpus"] else t)[r["bucket"]] = r["n"]
    big_s, big_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * big_s / ((a + 1.0) * big_t))) for a, b in zip(s, t, strict=True)], np.int64)


def scores(docs: DataFrame, gain: np.ndarray, *, text_col: str = "text", id_col: str = "doc_id", keep_cols: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """id, ``keep_cols``, n_words, n_features, weight and score (weight plus Gumbel noise from the id) of every row; row-local."""
    kept = (id_col, *keep_cols)
    src = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)), F.col(text_col).alias("t"))
    names = [f"c{i}" for i in range(len(kept))]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", n_words bigint, n_features bigint, weight bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, count, total = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for i, j, r in blocks(b.column(b.num_columns - 1)):
                c, w = r.sums(gain, j - i)
                words[i:j] += r.n_words
                count[i:j] += c
                total[i:j] += w
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(words), pa.array(count), pa.array(total)], names=[*names, "n_words", "n_features", "weight"])

    out = src.mapInArrow(run, schema)
    u = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("c0").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return out.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(u))))


def importance_resample(
    docs: DataFrame, target: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", keep_cols: tuple[str, ...] = (), percent: int = 5, min_words: int = 20, buckets: int = BUCKETS, seed: int = 42
) -> DataFrame:
    """Every row's id, ``keep_cols``, n_words, n_features, weight, score and rank: 1, 2, ... for the drawn, null for the others.

    Drawn without replacement, with chances that follow the importance weights,
    are floor(percent * N / 100) of the N rows with at least ``min_words``
    words, by descending score, ties to the smaller id (null ids last, as if
    empty text in the noise).  Words are runs of ASCII letters and digits and
    of all other characters beyond ASCII, A-Z lower-cased.  Null, empty and
    word-less texts have no features and weight 0.  Repeated rows are rows of
    their own.  Whole texts count, a long one in parts of about a megabyte.
    Other columns of ``docs`` don't matter, kept ones may have any name: they
    come first, in the order given.  An empty table gives an empty result, an
    empty target only smoothing.
    """
    kept = (id_col, *keep_cols)
    names = [f"c{i}" for i in range(len(kept))]
    scored = stage(scores(docs, gains(docs, target, text_col, buckets), text_col=text_col, id_col=id_col, keep_cols=keep_cols, seed=seed).withColumn("uid", F.monotonically_increasing_id()), "resampling-scores")
    spark = docs.sparkSession
    able = F.col("n_words") >= min_words
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("score"), F.col("c0").asc_nulls_last(), F.col("uid")]
    ordered = scored.where(able).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = stage(ordered, "resampling-order")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # a row per partition of the sort
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    place = F.col("before") + row + 1
    ranked = ordered.join(F.broadcast(offsets), part == F.col("part")).withColumn("rank", F.when(place <= F.floor(F.lit(percent) * F.col("all") / 100), place))
    columns = [*names, "n_words", "n_features", "weight", "score", "rank"]
    out = ranked.select(*columns).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("bigint")).select(*columns))
    return out.toDF(*kept, *columns[len(kept) :])


#: Checksum table: entry b is what byte b does to a register of zeros; entry 0 is 0.
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = [crc32(bytes([b])) ^ crc32(b"\0") for b in range(256)]
ORACLE = rf"""
WITH src AS (SELECT doc_id, 0 AS side, text FROM documents UNION ALL SELECT NULL, 1, text FROM benchmark),
wd AS (SELECT row_number() OVER () AS r, doc_id, side, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM src),
oc AS (
  SELECT r, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM wd),
per AS (SELECT r, side, g, count(*) AS n FROM oc GROUP BY ALL),
hx AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM per)),
gb AS (
  SELECT g, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(x), 2), lambda i: CAST((strpos('0123456789ABCDEF', x[i]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 1 AS BIGINT))),
         lambda c, b: xor(c >> 8, {_TABLE}[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM hx),
pb AS (SELECT r, side, bucket, sum(n) AS n FROM per JOIN gb USING (g) GROUP BY ALL),
ct AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM pb GROUP BY bucket),
tot AS (SELECT CAST(sum(s) + {BUCKETS} AS DOUBLE) AS s, CAST(sum(t) + {BUCKETS} AS DOUBLE) AS t FROM ct),
gn AS (SELECT bucket, CAST(floor(1000 * ln((ct.t + 1.0::DOUBLE) * tot.s / ((ct.s + 1.0::DOUBLE) * tot.t))) AS BIGINT) AS gain FROM ct, tot),
wt AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM pb JOIN gn USING (bucket) WHERE side = 0 GROUP BY r),
sc AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM wd LEFT JOIN wt USING (r) WHERE side = 0),
rk AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS k, 5 * (count(*) FILTER (n_words >= 20) OVER ()) // 100 AS most FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= most THEN k END AS rank FROM rk
"""
