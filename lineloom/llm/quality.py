"""Host-level quality rules.

Each text is measured against document rules; rule failures are aggregated by
host, failure rates are shrunk with a beta prior fitted to the hosts themselves,
and the host verdict is joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, stage, words_of

MIN_WORDS = 50
RULES = ("few_words", "repeats", "symbols", "dup_lines")


def _windows(words: Column) -> Column:
    """64-bit hashes of all 3-word windows, by position; null for fewer than 4 words."""
    n = F.size(words)
    return F.when(n >= 4, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))


def _covered(ranked: Column) -> Column:
    """Words lying in a window that has an equal one; ``ranked`` holds (hash, position) in order.

    Equal hashes are neighbours; the positions of their windows are put in order,
    and each contributes the words up to the next one, three at most.
    """
    same = lambda i, j: F.coalesce(F.get(ranked, i)["h"] == F.get(ranked, j)["h"], F.lit(False))
    at = F.array_compact(
        F.transform(F.sequence(F.lit(0), F.size(ranked) - 1), lambda i: F.when(same(i, i - 1) | same(i, i + 1), F.get(ranked, i)["i"]))
    )
    return F.aggregate(
        F.sort_array(at),
        F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(3), i - acc["last"])).alias("sum"), i.alias("last")),
        lambda acc: acc["sum"],
    )


def measure(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all bigint) to ``docs``.

    Words, windows and ranked windows are columns of their own, each computed
    once; only texts with a repeated window get theirs ranked.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(F.col("_t"), "\n", -1), lambda x: x.rlike(WORD))
    repeats = F.size(F.array_distinct("_win")) < F.size("_win")
    return (
        docs.withColumn("_t", text)
        .withColumn("_w", words_of(F.col("_t")))
        .withColumn("_ln", lines)
        .withColumn("n_symbols", F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("bigint"))
        .drop("_t")
        .withColumn("n_words", F.size("_w").cast("bigint"))
        .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("bigint"))
        .withColumn("n_dup_lines", (F.size("_ln") - F.size(F.array_distinct("_ln"))).cast("bigint"))
        .withColumn("_win", _windows(F.col("_w")))
        .drop("_w", "_ln")
        .withColumn("_rank", F.when(repeats, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .drop("_win")
        .withColumn("n_repeat_words", F.when(F.col("_rank").isNull(), F.lit(0).cast("bigint")).otherwise(_covered(F.col("_rank"))))
        .drop("_rank")
    )


def failures() -> dict[str, Column]:
    """The document rules, each true where a document fails; integer arithmetic only."""
    return {
        "few_words": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "dup_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_words"),
    }


def host_verdicts(measured: DataFrame, *, host_col: str = "source", reject_rate: float = 0.5) -> DataFrame:
    """One row per host: n_docs, and for each rule its failures and shrunk rate; ``rejected`` if a shrunk rate is over ``reject_rate``.

    The prior of each rule is a beta whose mean and strength match mean and
    variance of the hosts' raw rates (method of moments, strength held to
    [2, 1000]); a host's rate is its posterior mean, so small hosts lean on the
    rest.  Null is a host like any other.
    """
    per_host = measured.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(cond.cast("bigint")).alias(f"fail_{name}") for name, cond in failures().items()]
    )
    moments = per_host.agg(
        *[F.avg(F.col(f"fail_{r}") / F.col("n_docs")).alias(f"m_{r}") for r in RULES],
        *[F.coalesce(F.var_samp(F.col(f"fail_{r}") / F.col("n_docs")), F.lit(0.0)).alias(f"v_{r}") for r in RULES],
    )
    out = per_host.join(F.broadcast(moments))  # a single row
    for r in RULES:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        strength = F.when(v > 0, F.greatest(F.lit(2.0), F.least(F.lit(1000.0), m * (1 - m) / v - 1))).otherwise(F.lit(1000.0))
        out = out.withColumn(f"rate_{r}", (F.col(f"fail_{r}") + m * strength) / (F.col("n_docs") + strength))
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | (F.col(f"rate_{r}") > reject_rate)
    return out.select("host", "n_docs", *[f"fail_{r}" for r in RULES], *[f"rate_{r}" for r in RULES], rejected.alias("rejected"))


def quality_rules(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", reject_rate: float = 0.5, keep_cols: list[str] | None = None) -> DataFrame:
    """Measures, ``base_failed``, ``host_rejected`` and ``kept`` for every row of ``docs``.

    A document fails on its own with fewer than 50 words or when more than half
    of its words lie in repeated 3-word windows.  Otherwise its host decides:
    it is kept unless the host is rejected.  Null and empty texts have no words
    and fail; repeated rows each get their row; an empty table gives no rows.
    Measures are staged once and read twice; the join to hosts carries no text.
    Kept columns come first, in the order given; one with the name of an output
    is left out, other names don't matter.  Texts are measured whole.
    """
    outputs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept"]
    names = [c for c in (["doc_id"] if keep_cols is None else keep_cols) if c not in outputs]
    cols = [f"k{i}" for i in range(len(names))]
    plain = docs.select(*(F.col(c).alias(k) for c, k in zip(names, cols, strict=True)), F.col(host_col).alias("_host"), F.col(text_col).alias("_text"))
    facts = stage(measure(plain, text_col="_text").drop("_text"), "quality")
    hosts = host_verdicts(facts, host_col="_host", reject_rate=reject_rate).select(F.col("host").alias("_h"), F.col("rejected").alias("_rejected"))
    rules = failures()
    return (
        facts.join(hosts, F.col("_host").eqNullSafe(F.col("_h")), "left")
        .withColumn("base_failed", rules["few_words"] | rules["repeats"])
        .withColumn("host_rejected", F.coalesce("_rejected", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
        .select(*cols, *outputs)
        .toDF(*names, *outputs)
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents),
wins AS (
  SELECT rid, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS win
  FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM wins) WHERE c > 1),
cov AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM rep, unnest([0, 1, 2]) AS o(k) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, source, len(w) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (rid)),
f AS (
  SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 10 * n_symbols > n_words AS f3, 100 * n_dup_lines > 30 * n_words AS f4 FROM m),
h AS (
  SELECT source, count(*) AS n, count(*) FILTER (f1) AS a1, count(*) FILTER (f2) AS a2, count(*) FILTER (f3) AS a3, count(*) FILTER (f4) AS a4 FROM f GROUP BY source),
long AS (SELECT source, n, unnest([a1, a2, a3, a4]) AS a, unnest([1, 2, 3, 4]) AS r FROM h),
prior AS (SELECT r, avg(a / n) AS mu, coalesce(var_samp(a / n), 0) AS v FROM long GROUP BY r),
post AS (
  SELECT source, (a + mu * s) / (n + s) AS rate FROM (
    SELECT long.*, mu, CASE WHEN v > 0 THEN greatest(2.0, least(1000.0, mu * (1 - mu) / v - 1)) ELSE 1000.0 END AS s FROM long JOIN prior USING (r))),
bad AS (SELECT source, bool_or(rate > 0.5) AS rejected FROM post GROUP BY source)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words,
       (f1 OR f2) AS base_failed, coalesce(rejected, false) AS host_rejected, NOT (f1 OR f2) AND NOT coalesce(rejected, false) AS kept
FROM f LEFT JOIN bad ON f.source IS NOT DISTINCT FROM bad.source
"""
