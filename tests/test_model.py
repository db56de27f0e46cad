"""Attribution by brute force over coalitions, the model store, metrics of the fitted model against SQL, ranking."""

import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom import registry
from lineloom.operators import attribution, model_store, risk

FOLDER = "/root/testdata/sf0.001"
NODES = "tree int, node int, left int, right int, feature int, threshold double, cover double, value double"
#: Two trees; the first asks feature 0 twice on one path, the second has a feature the first lacks.
TREES = [
    (0, 0, 1, 2, 0, 0.5, 100.0, 0.0), (0, 1, 3, 4, 1, 0.3, 60.0, 0.0), (0, 2, 5, 6, 2, -1.0, 40.0, 0.0), (0, 3, 7, 8, 0, 0.2, 25.0, 0.0), (0, 4, -1, -1, -1, None, 35.0, 2.0), (0, 5, -1, -1, -1, None, 10.0, -1.0),
    (0, 6, -1, -1, -1, None, 30.0, 4.0), (0, 7, -1, -1, -1, None, 5.0, 7.0), (0, 8, -1, -1, -1, None, 20.0, -3.0),
    (1, 0, 1, 2, 3, 0.0, 90.0, 0.0), (1, 1, -1, -1, -1, None, 80.0, 0.5), (1, 2, 3, 4, 0, 0.7, 10.0, 0.0), (1, 3, -1, -1, -1, None, 9.0, 1.5), (1, 4, -1, -1, -1, None, 1.0, -6.0),
]


def value(tree, known, x, node=0):
    """Expectation of a tree where only ``known`` features are asked, by the definition."""
    _, _, left, right, feature, threshold, cover, v = tree[node]
    if left < 0:
        return v
    if feature in known:
        return value(tree, known, x, left if x[feature] <= threshold else right)
    return sum(tree[c][6] / cover * value(tree, known, x, c) for c in (left, right))


def coalitions(trees, x, n):
    """Shapley values by all subsets of the features."""
    f = lambda s: sum(value(t, s, x) for t in trees)
    out = []
    for j in range(n):
        rest = [i for i in range(n) if i != j]
        out.append(sum(math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) * (f({*s, j}) - f(set(s))) for k in range(n) for s in itertools.combinations(rest, k)))
    return out


def test_shapley_values_equal_all_coalitions(spark):
    nodes = spark.createDataFrame(TREES, NODES)
    trees = [{r[1]: r for r in TREES if r[0] == t} for t in (0, 1)]
    x = np.array(list(itertools.product([0.1, 0.4, 0.6, 0.9], [0.2, 0.5], [-2.0, 0.0], [-1.0, 1.0], [3.0])))
    tree = attribution.leaves(nodes)
    got = attribution.shapley(tree, x)
    for row, phi in zip(x, got, strict=True):
        assert phi == pytest.approx(coalitions(trees, row, 5), abs=1e-12)
        assert attribution.expected(tree) + phi.sum() == pytest.approx(sum(value(t, set(range(5)), row) for t in trees))
    assert not got[:, 4].any()  # no tree asks for it


def test_random_trees(spark):
    rng = np.random.default_rng(5)

    def grow(tree, depth, node=0, cover=1000.0):
        if depth == 0 or cover < 4:
            tree[node] = (0, node, -1, -1, -1, None, cover, float(rng.normal()))
            return
        a = float(rng.integers(1, int(cover) - 1))
        tree[node] = (0, node, 2 * node + 1, 2 * node + 2, int(rng.integers(0, 6)), float(rng.normal()), cover, 0.0)
        grow(tree, depth - 1, 2 * node + 1, a)
        grow(tree, depth - 1, 2 * node + 2, cover - a)

    for _ in range(3):
        tree = {}
        grow(tree, 5)
        x = rng.normal(size=(8, 6))
        got = attribution.shapley(attribution.leaves(spark.createDataFrame(list(tree.values()), NODES)), x)
        for row, phi in zip(x, got, strict=True):
            assert phi == pytest.approx(coalitions([tree], row, 6), abs=1e-12)


def test_ensembles_beyond_the_bound_are_refused(spark):
    with pytest.raises(ValueError, match="14 nodes"):
        attribution.leaves(spark.createDataFrame(TREES, NODES), most=13)


def test_drivers_are_the_largest_and_significant(spark):
    frame = spark.createDataFrame([(1, 0.1, 0.2, -2.0, -1.0, None)], "id int, a double, b double, c double, d double, e double")
    out = attribution.attribute(frame, spark.createDataFrame(TREES, NODES), list("abcde"), labels={"a": ("first", "kin")}, top=5)
    (r,) = out.collect()
    phi = coalitions([{n[1]: n for n in TREES if n[0] == t} for t in (0, 1)], [0.1, 0.2, -2.0, -1.0, 0.0], 5)
    assert [d.feature for d in r.drivers] == [f for f in sorted("abcde", key=lambda f: -abs(phi["abcde".index(f)])) if f != "e"]
    assert r.base + sum(d.contribution for d in r.drivers) == pytest.approx(r.margin) and r.id == 1
    assert [(d.label, d.family) for d in r.drivers if d.feature == "a"] == [("first", "kin")]


@pytest.fixture(scope="module")
def fitted(spark):
    frame = registry._risk_frame(spark, FOLDER)
    return frame, risk.fit(frame, rounds=8)


def test_contributions_add_up_to_the_model_margin(spark, fitted):
    frame, model = fitted
    rows = frame.where(risk.role(F.col("line")) == "validate").limit(300)
    out = attribution.attribute(rows, attribution.ensemble(spark, model.trees), risk.FEATURES, top=17, least=0.0)
    raw = model.trees.transform(risk._vectors(rows)).select("line", "station", "vehicle", "rawPrediction").collect()
    want = {(r.line, r.station, r.vehicle): r.rawPrediction[1] for r in raw}
    got = out.collect()
    assert len(got) == 300
    for r in got:
        assert r.margin == pytest.approx(want[r.line, r.station, r.vehicle], abs=1e-9)
        assert r.base + sum(d.contribution for d in r.drivers) == pytest.approx(r.margin, abs=1e-6)


def test_model_ranks_faults_first(spark):
    """On lines that it hasn't seen, of the next larger scale; a model that ranks at random has 0.5 and the baseline."""
    card = registry.QUERIES["risk_model_card"](spark, "/root/testdata/sf0.01").first()
    assert card.roc_auc > 0.75 and card.pr_auc > 3 * card.pr_auc_baseline and card.precision_at_40 > 0.3
    for b in card.reliability:  # calibrated, within two standard errors and a little
        assert abs(b.predicted - b.observed) < 2.5 * (b.predicted * (1 - b.predicted) / b.n) ** 0.5 + 0.05


def test_metrics_equal_their_sql_on_the_model_scores(spark, fitted, tmp_path):
    frame, model = fitted
    d = model.predict(frame.where(risk.role(F.col("line")) == "validate")).select(F.expr("line * 3000000 + station").alias("station"), "vehicle", F.round("p", 6).alias("p"), F.col("label").alias("y"))
    d.coalesce(1).write.parquet(str(tmp_path / "rt"))
    con = duckdb.connect()
    sql = registry.ORACLES["risk_metrics"]
    body = sql[sql.index(", tot AS") + 2 :]
    (want,) = con.execute(f"WITH rt AS (SELECT * FROM read_parquet('{tmp_path}/rt/*.parquet')), {body}").fetchall()
    names = [c[0] for c in con.description]
    got = risk.metrics(spark.read.parquet(str(tmp_path / "rt"))).first()
    assert [got[n] for n in names] == [pytest.approx(v, abs=1e-9) for v in want]


def test_lines_are_dealt_whole(spark):
    roles = spark.range(1992, 2006).select(F.col("id").alias("line"), risk.role(F.col("id")).alias("r")).collect()
    assert [sum(x.r == k for x in roles) for k in ("train", "calibrate", "validate")] == [8, 2, 4]


def test_store_keeps_one_model_and_gives_equal_scores(spark, fitted, tmp_path):
    frame, model = fitted
    store = model_store.ModelStore(spark, f"file://{tmp_path}/models")
    calls = []

    def made():
        calls.append(1)
        return model

    a, b = model_store.key({"x": 1}, {"rows": 3}), model_store.key({"x": 2}, {"rows": 3})
    assert a != b and len(a) == 16 and a == model_store.key({"x": 1}, {"rows": 3})
    assert store.load(a) is None and store.names() == []
    store.get(a, made)
    again = store.get(a, made)
    assert calls == [1] and store.names() == [a]
    rows = frame.limit(200)
    p = lambda m: sorted((r.line, r.station, r.vehicle, r.p) for r in m.predict(rows).select("line", "station", "vehicle", "p").collect())
    assert p(again) == p(model)
    store.get(b, made)
    assert store.names() == [b] and store.load(a) is None  # the other one is stale
    for part in (tmp_path / "models" / f"risk-{b}" / "trees" / "data").glob("*"):
        part.unlink()
    store.get(b, made)  # a damaged one is fitted anew
    assert len(calls) == 3 and store.load(b) is not None
    assert [x.name for x in (tmp_path / "models").iterdir() if not x.name.endswith(".crc")] == [f"risk-{b}"]


def test_fingerprint_minds_rows_not_order(spark):
    rows = [(1, "a"), (2, None), (2, None)]
    make = lambda r: model_store.fingerprint(spark.createDataFrame(r, "x int, y string"))
    assert make(rows) == make(rows[::-1]) != make(rows[:2])


def test_documents_hold_each_stations_scores(spark):
    rows = {(r.line, r.station): r for r in registry.QUERIES["risk_documents"](spark, FOLDER).collect()}
    drivers = registry.QUERIES["risk_drivers"](spark, FOLDER).collect()
    assert sum(len(r.scores) for r in rows.values()) == len(drivers)
    for d in drivers[:50]:
        r = rows[d.line, d.station]
        assert r.scores[d.vehicle] == pytest.approx(100 * d.risk, abs=0.051) and [x.contribution for x in r.drivers[d.vehicle]] == [pytest.approx(x.contribution, abs=6e-4) for x in d.drivers]
        assert r.peak_risk_pct == max(r.scores.values()) and len(d.drivers) <= 3
    card = registry.QUERIES["risk_model_card"](spark, FOLDER).first()
    assert set(card.importances) == set(risk.FEATURES) and card.rows == len(drivers) and len(card.key) == 16
