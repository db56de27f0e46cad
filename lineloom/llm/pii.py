"""Personal data by weak supervision.

Candidate spans get votes from a pattern, a gazetteer and a context labeler.
Expectation-maximisation on the vote patterns of the whole corpus estimates how
reliable each labeler is; its posteriors are the soft labels of a logistic span
classifier.  Only aggregated patterns (a few hundred rows, whatever the input)
reach the driver.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_order, match_spans, stage

BASE_KINDS = ["email", "ip", "card", "phone"]
EXTRA_KINDS = ["number", "iban", "handle"]
KINDS = BASE_KINDS + EXTRA_KINDS
#: Rule patterns; possessive where nothing can be given back, so that matching is iterative. Fixed values.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Looser candidates that only the method can add.
NUMBER = r"(?<![A-Za-z0-9+@.(-])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,4}+(?![A-Za-z0-9@])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
HANDLE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9.-]++"
#: Gazetteers: top-level domains, account countries, card and dialling prefixes. Fixed values.
TLDS = "com org net edu gov info biz io de fr es it uk us eu ch at nl be".split()
COUNTRIES = "DE FR ES IT GB CH AT NL BE LU PT IE PL SE NO DK FI".split()
CUES = r"(?i)(?:tel|phone|fon|fax|call|mobile|cell|contact|mail|write|card|visa|iban|account|konto|ssn|passport|id|ip|host|address)[^A-Za-z]{0,6}$"


def octets_fit(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """12 to 19 digits whose check sum (every second one from the right doubled) ends in 0."""
    d = F.filter(F.split(F.reverse(digits_of(v)), ""), lambda c: c != "")
    total = F.aggregate(
        F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int")))),
        F.lit(0),
        lambda a, x: a + x,
    )
    n = F.length(digits_of(v))
    return F.when((n >= 12) & (n <= 19), total % 10 == 0).otherwise(F.lit(False))


def base_spans(text: Column, context: int = 0) -> Column:
    n = lambda v: F.length(digits_of(v))
    return F.concat(
        match_spans(text, EMAIL, "email", context=context),
        match_spans(text, IP, "ip", octets_fit, context=context),
        match_spans(text, CARD, "card", luhn, context=context),
        match_spans(text, PHONE, "phone", lambda v: (n(v) >= 9) & (n(v) <= 15), context=context),
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(c: Column) -> Column:
    """struct<pattern, gazetteer, context> votes in {-1, 0, 1} of a candidate."""
    v, k = c["value"], c["kind"]
    shape = _vote(
        k.isin(BASE_KINDS)
        | ((k == "number") & v.rlike(r"^(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"))
        | ((k == "iban") & (F.length(F.regexp_replace(v, " ", "")) >= 15))
        | ((k == "handle") & v.rlike(r"\.[A-Za-z]{2,}$")),
        F.lit(True),
    )
    tld = F.lower(F.regexp_extract(v, r"\.([A-Za-z]+)$", 1))
    listed = (
        F.when(k.isin("email", "handle"), _vote(tld.isin(TLDS), F.lit(True)))
        .when(k == "iban", _vote(F.substring(v, 1, 2).isin(COUNTRIES), F.lit(True)))
        .when(k == "card", _vote(v.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), F.lit(True)))
        .when(k == "phone", _vote(v.rlike(r"^\+(?:1|33|34|44|49|39|41|43)"), F.lit(True)))
        .otherwise(F.lit(0))
    )
    cue = _vote(c["before"].rlike(CUES), F.length(c["before"]) >= 8)
    return F.struct(shape.alias("pattern"), listed.alias("gazetteer"), cue.alias("context"))


def features(c: Column) -> Column:
    """Discrete features of the span classifier: kind, digit-count band, separators, clear left edge."""
    n = F.length(digits_of(c["value"]))
    return F.struct(
        c["kind"].alias("kind"),
        F.when(n < 7, 0).when(n < 10, 1).when(n < 12, 2).otherwise(3).alias("band"),
        c["value"].rlike(r"[\x20().-]").cast("int").alias("sep"),
        ((c["before"] == "") | c["before"].rlike(r"[\s(:=,;]$")).cast("int").alias("edge"),
    )


def reliabilities(patterns: dict[tuple[int, int, int], int], rounds: int = 50) -> tuple[float, dict, dict]:
    """EM of a two-class model with labelers independent given the class: prior, P(vote | class), posterior per pattern."""
    total = sum(patterns.values()) or 1
    prior = 0.5
    start = {1: 0.6, 0: 0.3, -1: 0.1}
    p = {1: [dict(start) for _ in range(3)], 0: [{v: start[-v] for v in start} for _ in range(3)]}
    post: dict = {}
    for _ in range(rounds):
        for pat in patterns:
            a, b = math.log(prior), math.log(1 - prior)
            for i, v in enumerate(pat):
                a += math.log(p[1][i][v])
                b += math.log(p[0][i][v])
            post[pat] = 1 / (1 + math.exp(max(-500.0, min(500.0, b - a))))
        mass = sum(post[x] * n for x, n in patterns.items())
        prior = min(0.99, max(0.01, (mass + 1) / (total + 2)))
        for i in range(3):
            for v in (-1, 0, 1):
                p[1][i][v] = (1 + sum(post[x] * n for x, n in patterns.items() if x[i] == v)) / (3 + mass)
                p[0][i][v] = (1 + sum((1 - post[x]) * n for x, n in patterns.items() if x[i] == v)) / (3 + total - mass)
    return prior, p, post


def fit_classifier(rows: list[tuple[tuple, float, float]], rounds: int = 300, rate: float = 1.0, l2: float = 1e-3) -> dict:
    """Logistic regression over one-hot features from (feature tuple, weight, mean soft label); plain gradient steps."""
    w: dict = {}
    total = sum(n for _, n, _ in rows) or 1.0
    for _ in range(rounds):
        g: dict = {}
        for f, n, y in rows:
            z = sum(w.get(x, 0.0) for x in f)
            e = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * n / total
            for x in f:
                g[x] = g.get(x, 0.0) + e
        for x, e in g.items():
            w[x] = w.get(x, 0.0) - rate * (e + l2 * w.get(x, 0.0))
    return w


def personal_data(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5, context: int = 24, keep_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep_cols`` and ``spans`` (array of start, end, kind; code points, in order) for every row.

    Rule spans (email, ip, card, phone) always stay; candidates of the other
    kinds that touch none of them are added where the trained classifier's
    probability is over ``threshold``.  Null and empty texts have no spans;
    repeated rows each get theirs; with no candidates at all nothing is added.
    Candidates are staged once (no text in them) and read for the vote counts
    and for the result.
    Kept columns may have any name: they come first, in the order given.  Texts
    are taken whole; spans of a long one grow with its matches.
    """
    kept = [f"k{i}" for i in range(len(keep_cols))]
    text = F.coalesce(F.col("t"), F.lit(""))
    plain = docs.select(*(F.col(c).alias(k) for c, k in zip(keep_cols, kept, strict=True)), F.col(text_col).alias("t"))
    extras = F.concat(*[match_spans(text, p, k, context=context) for p, k in ((NUMBER, "number"), (IBAN, "iban"), (HANDLE, "handle"))])
    found = stage(plain.select(*kept, base_spans(text, context).alias("_base"), extras.alias("_more")), "pii")
    clear = F.filter("_more", lambda t: ~F.exists(F.col("_base"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    found = found.withColumn("_more", clear)
    voted = (
        found.select(F.explode(F.concat("_base", "_more")).alias("c"))
        .select(votes(F.col("c")).alias("v"), features(F.col("c")).alias("f"))
        .groupBy("v", "f")
        .count()
        .collect()
    )
    voted.sort(key=str)  # one order of the sums, whatever the shuffle's
    patterns: dict = {}
    for r in voted:
        key = tuple(r["v"])
        patterns[key] = patterns.get(key, 0) + r["count"]
    _, _, post = reliabilities(patterns) if patterns else (0.5, {}, {})
    grouped: dict = {}
    for r in voted:
        f = ("bias", *((n, r["f"][n]) for n in ("kind", "band", "sep", "edge")), *((n, r["v"][n]) for n in ("gazetteer", "context")))
        n, y = grouped.get(f, (0.0, 0.0))
        grouped[f] = (n + r["count"], y + r["count"] * post[tuple(r["v"])])
    w = fit_classifier([(f, n, y / n) for f, (n, y) in grouped.items()])

    def score(c: Column) -> Column:
        f, v = features(c), votes(c)
        z = F.lit(round(w.get("bias", -1.0), 9))
        for key, value in w.items():
            if key == "bias":
                continue
            src = f if key[0] in ("kind", "band", "sep", "edge") else v
            z = z + F.when(src[key[0]] == key[1], round(value, 9)).otherwise(0.0)
        return z

    cut = math.log(threshold / (1 - threshold))
    added = F.filter("_more", lambda c: score(c) > cut)
    return found.select(*kept, in_order(F.concat("_base", added), KINDS).alias("spans")).toDF(*keep_cols, "spans")
