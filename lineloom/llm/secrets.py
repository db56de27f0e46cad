"""Secret scans: pattern rules plus character Markov models.

Two first-order character models, one of random strings and one of ordinary
identifiers, are trained from labelled samples.  A token whose per-character
log-likelihood ratio favours the random model is reported beside the rules'
matches.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import EMPTY_SPANS, in_order, match_spans, spans_text

KINDS = ["assign", "access", "hex", "random"]
#: Rule patterns; Java's (?i) folds ASCII letters only. Fixed values.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Model tokens: 16 or more of these characters, at least one letter and one digit.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{16,}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"


def base_spans(text: Column) -> Column:
    """The rules' spans (assign, access, hex), each kind leftmost and non-overlapping."""
    return F.concat(
        match_spans(text, ASSIGN, "assign", lambda v: F.length(F.regexp_extract(v, ASSIGN, 1)) >= 6),
        match_spans(text, ACCESS, "access", lambda v: F.length(v) >= 20),
        match_spans(text, HEX, "hex"),
    )


def labelled_samples(docs: DataFrame, *, text_col: str = "text", sample_docs: int = 300, n_random: int = 3000) -> DataFrame:
    """(sample, is_random) strings to train on.

    Random: ``n_random`` digests cut to 16-40 characters in hex, base64 and upper
    base-36-like alphabets.  Ordinary: words of ``sample_docs`` documents (those
    of smallest text hash; a bound on the labelled sample, not on what is
    scanned), bare and joined into snake, kebab, path and camel identifiers with
    short numbers.
    """
    spark = docs.sparkSession
    r = spark.range(n_random)
    d = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 512)
    body = (
        F.when(F.col("id") % 3 == 0, d)
        .when(F.col("id") % 3 == 1, F.regexp_replace(F.base64(F.unhex(d)), r"\s", ""))
        .otherwise(F.upper(F.regexp_replace(F.base64(F.unhex(d)), r"[\s+/=]", "")))
    )
    random = r.select(F.substring(body, F.lit(1), (16 + F.col("id") % 25).cast("int")).alias("sample"), F.lit(True).alias("is_random"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    # only hashes are sorted; texts of the sample alone move
    least = texts.select("h").distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    few = texts.where(F.col("h") <= F.lit(least)).select("t").distinct()
    w = F.filter(F.split("t", r"[^A-Za-z]+"), lambda x: F.length(x) >= 2)

    def joined(i: Column) -> Column:
        a, b, c = (F.get("w", i + k) for k in (-1, 0, 1))
        num = (F.abs(F.hash(a, i)) % 1000).cast("string")
        return (
            F.when(i % 5 == 0, F.concat_ws("_", a, b, c))
            .when(i % 5 == 1, F.concat_ws("-", a, b, num))
            .when(i % 5 == 2, F.concat_ws("/", a, b, c))
            .when(i % 5 == 3, F.concat(a, F.initcap(b), F.initcap(c), num))
            .otherwise(F.concat(b, c))
        )

    long = few.select(w.alias("w")).where(F.size("w") >= 3)
    ordinary = long.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), joined)).alias("sample"), F.lit(False).alias("is_random"))
    return random.unionByName(ordinary)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character pair (row-major over ALPHABET), add-half smoothed.

    Pair counts are aggregated on the cluster; the driver receives at most
    2 x 67 x 67 of them.
    """
    s = samples.select("is_random", F.regexp_replace("sample", "[^A-Za-z0-9+/_=-]", "").alias("s")).where(F.length("s") >= 2)
    pairs = s.select("is_random", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring(F.col("s"), i, F.lit(2)))).alias("p"))
    n = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    counts = {True: [0.5] * (n * n), False: [0.5] * (n * n)}
    for row in pairs.groupBy("is_random", "p").count().collect():
        counts[row["is_random"]][at[row["p"][0]] * n + at[row["p"][1]]] += row["count"]
    out = [0.0] * (n * n)
    for i in range(n):
        t, f = sum(counts[True][i * n : i * n + n]), sum(counts[False][i * n : i * n + n])
        for j in range(i * n, i * n + n):
            out[j] = round(math.log(counts[True][j] / t) - math.log(counts[False][j] / f), 4)
    return out


def llr(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio per character pair of ``token``."""
    n = len(ALPHABET)
    model = F.expr("array(" + ",".join(f"{x}D" for x in table) + ")")
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
    return F.aggregate(
        codes,
        F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last")),
        lambda acc, c: F.struct(
            (acc["sum"] + F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.coalesce(F.get(model, acc["last"] * n + c), F.lit(0.0)))).alias("sum"), c.alias("last")
        ),
        lambda acc: acc["sum"] / F.greatest(F.lit(1), F.length(token) - 1),
    )


def fit_threshold(samples: DataFrame, table: list[float], recall: float = 0.98, default: float = 2.0) -> tuple[float, float, float]:
    """The highest ratio that still finds ``recall`` of held-out random strings, then the shares of random and of ordinary ones over it.

    Ratios are counted in steps of 0.05; those few hundred counts reach the
    driver.  Without random strings it is ``default``.
    """
    step = F.floor(llr(F.col("sample"), table) * 20).cast("int")
    rows = samples.where(F.length("sample") >= 16).groupBy(step.alias("b")).agg(F.count_if("is_random").alias("t"), F.count_if(~F.col("is_random")).alias("f")).orderBy(F.desc("b")).collect()
    n_t, n_f, over_t, over_f = sum(r["t"] for r in rows), sum(r["f"] for r in rows), 0, 0
    if not n_t:
        return default, math.nan, math.nan
    for r in rows:  # at b / 20 all from there on are over
        over_t, over_f = over_t + r["t"], over_f + r["f"]
        if over_t >= recall * n_t:
            return r["b"] / 20, over_t / n_t, over_f / max(n_f, 1)


def secret_scan(docs: DataFrame, *, text_col: str = "text", samples: DataFrame | None = None, threshold: float | None = None, keep_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep_cols`` and ``spans`` (array of start, end, kind; code points, in order) for every row.

    Rule spans always stay; a model token (kind ``random``) is added where its
    mean log-likelihood ratio is over ``threshold`` and it touches no rule span.
    The threshold is fitted to a fifth of the samples that don't train, if none
    is given.
    Null and empty texts have no spans; repeated rows each get theirs; an empty
    table trains on the generated strings alone.  Row-local apart from training.
    Kept columns may have any name: they come first, in the order given.  Texts
    are taken whole; spans of a long one grow with its matches.
    """
    labelled = samples if samples is not None else labelled_samples(docs, text_col=text_col)
    taught = F.pmod(F.xxhash64("sample"), F.lit(5)) != 0
    table = train(labelled.where(taught))
    threshold = fit_threshold(labelled.where(~taught), table)[0] if threshold is None else threshold
    kept = [f"k{i}" for i in range(len(keep_cols))]
    text = F.coalesce(F.col("t"), F.lit(""))
    plain = docs.select(*(F.col(c).alias(k) for c, k in zip(keep_cols, kept, strict=True)), F.col(text_col).alias("t"))
    found = plain.select(*kept, base_spans(text).alias("_base"), match_spans(text, TOKEN, "random").alias("_tokens"))
    extra = F.filter(
        F.col("_tokens"),
        lambda t: ~F.exists(F.col("_base"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])) & (llr(t["value"], table) > threshold),
    )
    both = F.when(F.size("_base") + F.size("_tokens") == 0, F.expr(EMPTY_SPANS)).otherwise(F.concat("_base", extra))
    return found.select(*kept, in_order(both, KINDS).alias("spans")).toDF(*keep_cols, "spans")


def digest(found: DataFrame, base_kinds: list[str]) -> DataFrame:
    """Counts per base kind, hash of the base spans and text of all spans."""

    def of(kind: str) -> Column:
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["kind"].isin(base_kinds))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in base_kinds],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )

