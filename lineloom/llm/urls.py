"""URL filter lists: every URL becomes a few host-suffix/path-prefix expressions that are looked up by hash.

A rule names a host (with its subdomains) and a path prefix.  A URL's
expressions are its host suffixes times the path-prefix lengths that rules use;
their short hash prefixes are joined with the rules' on equality, full digests
confirm, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path prefix, verdict) of the registered query.  Fixed values.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; a null url or one without ``://`` has both empty."""
    url = F.col(url_col)
    rest = F.substring_index(F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "?", 1), "#", 1)
    ok = F.coalesce(url.contains("://"), F.lit(False))
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    return pages.withColumn("host", F.when(ok, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")).withColumn(
        "path", F.when(ok, F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)).otherwise("")
    )


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` -> [a.b.c, b.c, c]: the whole host and what follows each dot."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def url_filter(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", prefix_bits: int = 32, default: str = "allow", salts: int = 16) -> DataFrame:
    """Every row of ``pages`` with host, path, rule (``host + path`` of the winning rule, else null) and verdict.

    Only the distinct lengths of rule paths are expanded, so a URL yields host
    labels x lengths expressions whatever the length of the rule list.  Distinct
    host/path-prefix expressions are looked up once (millions of pages of one
    host share them), the rule side is spread over ``salts`` so that a hot
    prefix is dealt to several tasks.  Longest host, then longest path wins;
    of equal rules ``block`` wins.  Null or malformed urls, and urls that fit
    no rule, get ``default``.  Repeated rows each get their row; columns of
    ``pages`` named host, path, rule or verdict are replaced, other names don't
    matter; a long url is compared as far as the longest rule path.  The path-prefix
    lengths in use are gathered to the driver (bounded by the longest path).
    """
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    pages = pages.drop("host", "path", "rule", "verdict")
    names = pages.columns
    plain = pages.toDF(*(f"c{i}" for i in range(len(names))))  # no name of a column matters
    base = with_host_and_path(plain, f"c{names.index(url_col)}")
    longest = max(lengths, default=0)
    key = F.struct(F.col("host").alias("host"), F.substring(F.col("path"), 1, longest).alias("head"))
    keys = base.select(key.alias("k")).distinct()
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length(F.col("k.head")))
    exprs = keys.select("k", F.explode(host_suffixes(F.col("k.host"))).alias("s")).select(
        "k", "s", F.explode(F.transform(prefixes, lambda n: F.substring(F.col("k.head"), F.lit(1), n))).alias("p")
    )

    def digest(h: str, p: str) -> Column:
        return F.sha2(F.concat(F.col(h), F.lit("\n"), F.col(p)), 256)

    hexes = max(1, prefix_bits // 4)
    exprs = exprs.withColumn("d", digest("s", "p")).select(
        "k", F.substring("d", 1, hexes).alias("short"), "d", (F.xxhash64("k.host", "k.head") % salts).alias("salt")
    )
    listed = (
        rules.withColumn("d", digest("host", "path"))
        .select("host", "path", "verdict", "d", F.substring("d", 1, hexes).alias("short"))
        .groupBy("short", "d", "host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("salt", F.explode(F.sequence(F.lit(-(salts - 1)).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    )
    hits = (
        exprs.alias("e")
        .join(listed.alias("r"), ["short", "salt"])
        .where(F.col("e.d") == F.col("r.d"))
        .groupBy("k")
        .agg(
            F.max(
                F.struct(
                    F.length("r.host").alias("a"), F.length("r.path").alias("b"), F.col("r.verdict").alias("verdict"), F.concat("r.host", "r.path").alias("rule")
                )
            ).alias("best")
        )
        .select(F.col("k.host").alias("_h"), F.col("k.head").alias("_p"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("_v"))
    )
    joined = base.join(hits, (F.col("host") == F.col("_h")) & (F.substring(F.col("path"), 1, longest) == F.col("_p")), "left")
    return joined.withColumn("verdict", F.coalesce("_v", F.lit(default))).select(*plain.columns, "host", "path", "rule", "verdict").toDF(*names, "host", "path", "rule", "verdict")


ORACLE = r"""
WITH rules(rhost, rpath, rverdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (
  SELECT page_id, row_number() OVER () AS rid, url IS NOT NULL AND contains(url, '://') AS ok,
         regexp_replace(regexp_replace(url, '^.*?://', '', 's'), '[?#].*$', '', 's') AS rest FROM pages),
b AS (
  SELECT rid, page_id,
         CASE WHEN ok THEN translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN ok THEN regexp_extract(rest, '^[^/]*(.*)$', 1, 's') ELSE '' END AS path FROM u),
m AS (
  SELECT b.*, r.*, row_number() OVER (PARTITION BY rid ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC, rverdict DESC) AS k
  FROM b LEFT JOIN rules r ON (b.host = r.rhost OR ends_with(b.host, '.' || r.rhost)) AND starts_with(b.path, r.rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE k = 1
"""
