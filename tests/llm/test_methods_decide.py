"""Secrets and personal data that no rule matches: found by the models, refused by constant ones."""

import base64
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from lineloom.llm import pii, secrets
from lineloom.llm.common import ship

FOLDER = "/root/testdata/sf0.001"
WORDS = "customer invoice monthly report payment gateway session handler config default storage backup archive index table user profile update manager service".split()


def planted():
    """Strings of neither assign, access nor hex form, and ordinary identifiers with numbers."""
    r = random.Random(7)
    strings = [base64.b64encode(r.randbytes(r.randint(12, 30))).decode().rstrip("=") for _ in range(120)]
    strings += ["".join(r.choice(string.ascii_uppercase + string.digits) for _ in range(r.randint(18, 32))) for _ in range(60)]
    strings += ["".join(r.choice("0123456789abcdef") for _ in range(r.randint(17, 23))) for _ in range(60)]
    pick = lambda: r.sample(WORDS, 3)
    plain = ["_".join(pick()) + f"_{r.randint(1, 2024)}" for _ in range(120)] + ["-".join(pick()) + f"-v{r.randint(1, 9)}" for _ in range(60)]
    plain += ["".join(w.title() for w in pick()) + str(r.randint(1, 99)) for _ in range(60)]
    shaped = re.compile(secrets.TOKEN)
    return [[x for x in xs if shaped.fullmatch(x) and not x.startswith("AKIA")] for xs in (strings, plain)]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")


def scan(spark, docs, **settings):
    strings, plain = planted()
    rows = [(1_000_000 + i, f"the value {s} stands here") for i, s in enumerate(strings)] + [(2_000_000 + i, f"the value {s} stands here") for i, s in enumerate(plain)]
    out = secrets.secret_scan(docs.unionByName(spark.createDataFrame(rows, docs.schema)), samples=secrets.labelled_samples(docs), **settings)
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in out.where("doc_id >= 1000000").collect()}
    hit = [found[1_000_000 + i] == [("random", 10, 10 + len(s))] for i, s in enumerate(strings)]
    false = [bool(found[2_000_000 + i]) for i in range(len(plain))]
    return sum(hit) / len(hit), sum(false) / len(false)


def test_random_strings_are_found_and_identifiers_refused(spark, docs):
    recall, false = scan(spark, docs)
    assert recall >= 0.95 and false <= 0.05


def test_a_constant_model_finds_none(spark, docs, monkeypatch):
    monkeypatch.setattr(secrets, "train", lambda samples: [0.0] * len(secrets.ALPHABET) ** 2)
    assert scan(spark, docs, threshold=1.0) == (0.0, 0.0)


def test_threshold_of_held_out_samples(spark, docs):
    samples = secrets.labelled_samples(docs)
    taught = F.pmod(F.xxhash64("sample"), F.lit(5)) != 0
    table = secrets.train(samples.where(taught))
    cut, recall, false = secrets.fit_threshold(samples.where(~taught), table)
    r = samples.where(~taught & (F.length("sample") >= 16)).select("is_random", (secrets.llr(F.col("sample"), table) >= cut).alias("over"))
    got = {(x.is_random, x.over): x["count"] for x in r.groupBy("is_random", "over").count().collect()}
    share = lambda c: got.get((c, True), 0) / (got.get((c, True), 0) + got.get((c, False), 0))
    assert (recall, false) == (pytest.approx(share(True)), pytest.approx(share(False))) and recall > 0.95 and false < 0.05
    assert secrets.fit_threshold(samples.where("false"), table)[0] == 2.0


FOUND = {
    "call me at 555-123-4567 today": ("number", 11, 23), "my ssn: 123-45-6789 please": ("number", 8, 19), "iban: DE89 3704 0044 0532 0130 00 thanks": ("iban", 6, 33), "write to john.doe (at) example.com soon": ("handle", 9, 34),
    "Tel 212 555 0199 now": ("number", 4, 16), "account DE89370400440532013000 ok": ("iban", 8, 30),
}
REFUSED = ["scores 12-34-56-78 games", "code XX00 ABCD EFGH JKLM item", "meet bob (at) noon today", "range 1000-2000-3000 units", "pages 12.14.16 of it", "model AB12 CD34 EF56 GH78 sold", "steps 10 20 30 40 done"]


def personal(spark, docs):
    rows = [(1_000_000 + i, t) for i, t in enumerate([*FOUND, *REFUSED])]
    out = pii.personal_data(docs.unionByName(spark.createDataFrame(rows, docs.schema))).where("doc_id >= 1000000")
    return [[(s.kind, s.start, s.end) for s in r.spans] for r in out.orderBy("doc_id").collect()]


def test_candidates_are_accepted_and_refused(spark, docs):
    assert personal(spark, docs) == [[x] for x in FOUND.values()] + [[]] * len(REFUSED)


def test_without_a_classifier_none_is_accepted(spark, docs, monkeypatch):
    monkeypatch.setattr(pii, "fit_classifier", lambda rows: {"bias": -1.0})
    assert personal(spark, docs) == [[]] * (len(FOUND) + len(REFUSED))
