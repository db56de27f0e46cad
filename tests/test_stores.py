"""Limits that are written and read back, the stored alarm index, files without a usable row."""

import re

import pytest
from pyspark.sql import functions as F

from lineloom import registry
from lineloom.config import ADAPTED as T
from lineloom.config import Oven
from lineloom.operators import limits
from lineloom.operators.alarm_index import AlarmIndex
from lineloom.sources import ingest

FOLDER = "/root/testdata/sf0.001"


def calibrated(spark, **kinds):
    return spark.createDataFrame([(k, v, 0.1) for k, v in kinds.items()], "kind string, limit double, validation_rate double")


def test_limits_are_appended_and_the_latest_valid_counts(spark, tmp_path):
    path = f"file://{tmp_path}/limits"
    assert limits.latest(spark, path) == {} and limits.thresholds({}, T, Oven()) == (T, Oven())
    assert limits.append(spark, path, calibrated(spark, ewma=3.0, cusum=5.0), "first") == 1
    assert limits.append(spark, path, calibrated(spark, ewma=3.5, cusum=6.0, tau=2.8)) == 2
    assert limits.append(spark, path, calibrated(spark, ewma=-1.0)) == 3  # no limit at all
    assert limits.latest(spark, path) == {"ewma": 3.5, "cusum": 6.0, "tau": 2.8}
    th, o = limits.thresholds(limits.latest(spark, path), T, Oven())
    assert (th.ewma_l, th.cusum_h, o.z_crit, th.alert) == (3.5, 6.0, 2.8, T.alert)
    limits.revoke(spark, path, 2, "wrong line")
    assert limits.latest(spark, path) == {"ewma": 3.0, "cusum": 5.0}
    kept = limits.versions(spark, path).orderBy("version").collect()
    assert [(r.version, r.revoked, r.note) for r in kept if not r.revoked] == [(1, False, "first"), (2, False, ""), (3, False, "")] and len(kept) == 4
    assert limits.append(spark, path, calibrated(spark, ewma=4.0)) == 4


@pytest.fixture(scope="module")
def index(spark):
    alarms = registry.QUERIES["flags_since"](spark, FOLDER).cache()
    return alarms, AlarmIndex.write(alarms, buckets=8)


def test_index_gives_what_the_alarms_are(index):
    alarms, stored = index
    rows = lambda d: sorted(map(tuple, d.select(alarms.columns).collect()), key=str)
    assert rows(stored.window(5, 220, 260)) == rows(alarms.where("station = 5 and vehicle between 220 and 260")) != []
    assert rows(stored.upto(230)) == rows(alarms.where("vehicle <= 230")) and rows(stored.window(5, 9000, 9001)) == []
    spark = alarms.sparkSession
    asked = spark.createDataFrame([(5, 260), (7, 230), (999, 230)], "station bigint, t bigint")
    got = sorted((r.t, r.station, r.vehicle, r.type) for r in stored.windows(asked, 20).collect())
    assert got == sorted((t, r.station, r.vehicle, r.type) for r in alarms.collect() for s, t in ((5, 260), (7, 230)) if r.station == s and t - 20 <= r.vehicle <= t)


def test_index_reads_one_bucket_and_pushes_the_range(index):
    _, stored = index
    tree = stored.window(5, 220, 260)._jdf.queryExecution().executedPlan()
    files = lambda rdd: sum(len(p.files()) for p in rdd.partitions())
    assert files(tree.collectLeaves().head().inputRDD()) == 1
    assert files(stored.rows()._jdf.queryExecution().executedPlan().collectLeaves().head().inputRDD()) > 1
    sc = stored.spark.sparkContext
    plan = sc._jvm.PythonSQLUtils.explainString(stored.window(5, 220, 260)._jdf.queryExecution(), "formatted")
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "EqualTo(station,5)" in pushed and "GreaterThanOrEqual(vehicle,220)" in pushed and "LessThanOrEqual(vehicle,260)" in pushed
    asked = stored.spark.createDataFrame([(s, t) for s in range(9) for t in (230, 260)], "station bigint, t bigint").hint("merge")
    plan = stored.windows(asked, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the times asked for; not the index


def test_a_file_without_a_usable_row_raises(spark, tmp_path):
    st = spark.createDataFrame([(1, "ASIA", True)], "station bigint, area string, instrumented boolean")
    (tmp_path / "f.csv").write_text("vehicle_id,product_variant,station_id\n ,X,ASI-0001\nA,X,NO-1\n")
    raw = ingest.read_csv(spark, str(tmp_path / "f.csv"))
    with pytest.raises(ingest.DatasetError, match="no row can be used"):
        ingest.load(raw, st, strict=False)
    with pytest.raises(ingest.DatasetError, match="blank_vehicle"):
        ingest.load(raw, st)


def test_latent_defects_count_as_events(spark):
    from lineloom.operators import report

    summary = registry.QUERIES["backtest_summary"](spark, FOLDER)
    inj = spark.createDataFrame([("a", "latent_defect", 2), ("b", "trend", 1)], "id string, kind string, station bigint")
    alarms = spark.createDataFrame([(9, 5, False), (4, 6, False), (1, 7, False), (3, 8, True)], "station bigint, at bigint, is_bot boolean")
    base = summary.first()
    for available, origin, found in ((True, 2, True), (True, None, False), (False, None, False)):
        exposure = spark.createDataFrame([(available, origin)], "available boolean, origin bigint")
        r = report.validation(summary, inj, alarms, exposure).first()
        assert (r.latent_defect_scenarios, r.latent_origin_identified, r.latent_origin_station) == (1, found, origin)
        assert r.evaluated_events == base.evaluated_events + 1 and r.detected_events == base.detected_events + found and r.false_positive_stations == [4, 9]
