"""Series operators on hand-checked fixtures, and registered queries against their SQL at the smallest scale."""

import compare
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lineloom import config, registry
from lineloom.functions import series as S
from lineloom.operators import business, detect
from lineloom.sources import ingest

FOLDER = "/root/testdata/sf0.001"


def frame(spark, values):
    return spark.createDataFrame([("a", i + 1, float(v)) for i, v in enumerate(values)], "k string, vehicle bigint, v double")


def out(df, col):
    return [r[col] for r in df.orderBy("vehicle").collect()]


def test_ewma(spark):
    assert out(S.ewma(frame(spark, [1, 1, 1]), "v", ["k"]), "ewma") == pytest.approx([0.2, 0.36, 0.488])
    e, want = 0.0, []
    values = [(i * 37 % 11) - 5 for i in range(1300)]  # crosses two blocks
    for v in values:
        e = 0.2 * v + 0.8 * e
        want.append(e)
    assert out(S.ewma(frame(spark, values), "v", ["k"]), "ewma") == pytest.approx(want, abs=1e-9)


def test_cusum(spark):
    assert out(S.cusum(frame(spark, [-1, 2, 1, -5, 1]), F.col("v"), ["k"]), "cusum") == [0, 2, 3, 0, 1]


def test_latch(spark):
    d = S.latch(frame(spark, [1, 1, 0, -1, 0, 1]), F.col("v") == 1, F.col("v") == -1, ["k"])
    assert out(d, "fires") == [True, False, False, False, False, True]


def test_padded_sum_and_rows_since(spark):
    d = S.rows_since(frame(spark, [5, 1, 1, 1]).withColumn("s", S.padded_sum("v", ["k"], 3)), F.col("v") == 5, ["k"], out="r")
    assert out(d, "s") == [15, 11, 7, 3] and out(d, "r") == [0, 1, 2, 3]
    gaps = frame(spark, [0, 1, 0, 0, 1]).withColumn("vehicle", F.col("vehicle") * 7 % 36)  # neither dense nor from 1
    assert out(S.rows_since(gaps, F.col("v") == 1, ["k"], out="r"), "r") == [200, 0, 1, 2, 0]


def test_interp_and_economics(spark):
    d = spark.createDataFrame([(0.0,), (17.5,), (50.0,)], "x double").select(S.interp(F.col("x"), (0.0, 5.0, 10.0, 20.0, 40.0), (0.05, 0.35, 0.6, 0.78, 0.85)).alias("y"))
    assert [r["y"] for r in d.collect()] == pytest.approx([0.05, 0.735, 0.85])
    m = spark.createDataFrame([(100.0, 17.5, 62.1, 19.5, 4.0, 1.88, 420.0)], "recall double, lag double, nominal_uph double, recoverable_uph double, events_per_run double, false_alarms_per_run double, vehicles_per_run double")
    r = business.economics(m).first()
    assert (r["defects_prevented"], r["vehicles_recovered"], r["net_usd"]) == (1204, 1500, 3741006)


QUICK = [
    "bottlenecks", "scored_readings", "baseline_cells", "injected_readings", "flags_union", "parameter_correlation", "padded_rolls", "line_throughput", "latent_trace", "latent_exposure", "station_topology", "latest_operations", "cusum_series", "rolling_ols",
    "state_stations", "state_at_times", "state_document", "line_state", "spc_cross_causal", "line_flags", "line_bottlenecks", "line_false_alarms", "line_backtest", "stream_alarms", "stream_oven_alarms", "backtest_summary", "false_alarm_profile", "calibration_sweep", "calibrated_bottlenecks", "validation", "validation_report", "alarm_window", "alarm_windows", "economics", "thermal_regression", "oven_tau_alarms", "risk_features", "risk_labels", "risk_metrics", "risk_reliability",
    "export_rows", "export_truth", "ingest_operations", "ingest_readings", "ingest_errors", "ingest_truth",
]


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, name):
    assert compare.compare(spark, compare.duck(FOLDER), name, FOLDER).startswith("ok")


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 12 and {r["vehicle"] == r["detected_at"] for r in rows} == {True}


def test_every_query_has_sql_but_those_of_the_model(spark):
    assert set(registry.QUERIES) - set(entry.oracle_sql()) == {"risk_scores", "risk_drivers", "risk_documents", "risk_model_card"}


def test_settings_from_json():
    assert config.load('{"alert": 2.5}', config.Thresholds).alert == 2.5
    assert config.load('{"lead": [0, 1]}', config.Economics).lead == (0, 1)
    with pytest.raises(ValueError, match="alerts"):
        config.load('{"alerts": 2.5}', config.Thresholds)


def test_manual_stations_have_no_readings(spark):
    rows = registry.QUERIES["scored_readings"](spark, FOLDER).select("station").distinct().collect()
    assert rows and all(r["station"] % 3 for r in rows)


def test_cells_of_few_readings_fall_back_to_the_specification(spark):
    rows = [(1, v, "A", 1, True, 10.0 + v % 3) for v in range(1, 10)]
    wide = spark.createDataFrame(rows, "station bigint, vehicle bigint, variant string, supplier_lot bigint, instrumented boolean, heat double")
    spec = {"heat": (10.0, 2.0)}
    got = detect.score(wide, config.Thresholds(), parameters=["heat"], spec=spec).orderBy("vehicle").collect()
    assert [r["z_heat"] for r in got[:3]] == [0.5, 1.0, 0.0] and {r["source_heat"] for r in got} == {"spec_fallback"}
    none = detect.score(wide, config.Thresholds(), parameters=["heat"]).collect()
    assert {(r["z_heat"], r["source_heat"]) for r in none} == {(0.0, "unavailable")}


def test_scans_of_the_plans(spark):
    """One scan of the line items for the scores, two for the alarms (the second for the one-row limit)."""
    for name, most in (("scored_readings", 1), ("flags_union", 2)):
        plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.split("\n") if "FileScan" in x and "l_suppkey" in x]
        assert len(scans) <= most, (name, len(scans))
        assert "o_order" not in plan


def test_csv_rules(spark, tmp_path):
    st = spark.createDataFrame([(1, "ASIA", True), (3, "ASIA", False)], "station bigint, area string, instrumented boolean")
    head = "timestamp,vehicle_id,product_variant,station_id,parameter,value,cycle_time_seconds,queue_length,utilization_pct,manual_outcome\n"

    def read(body, name):
        (tmp_path / name).write_bytes(body.encode() if isinstance(body, str) else body)
        return ingest.read_csv(spark, str(tmp_path / name))

    good = "\ufeff" + head + "2,B,,ASI-0001,tax,1.5,50,,,\n1,A,X,ASI-0001,tax,2.5,,3,71,\n2,B,,ASI-0001,,,51,,,Pass\n3,C,X,ASI-0003,,,,,,fail\n"
    ops, values, vehicles = ingest.load(read(good, "good.csv"), st)
    assert sorted(map(tuple, vehicles.collect())) == [("A", 1), ("B", 2), ("C", 3)]
    assert sorted(map(tuple, ops.select("vehicle", "variant", "cycle_time", "queue", "utilization", "manual_outcome").collect())) == [
        (1, "X", 0.0, 3, 71.0, None), (2, "Unknown", 51.0, 0, 0.0, "pass"), (3, "X", 0.0, 0, 0.0, "fail")
    ]
    assert sorted(map(tuple, values.collect())) == [(1, 1, "tax", 2.5), (1, 2, "tax", 1.5)]
    for row, rule in (
        ("1,A,X,NO-0001,,,,,,", "unknown_station"), ("1, ,X,ASI-0001,,,,,,", "blank_vehicle"), ("1,A,X,ASI-0001,,,,many,,", "bad_metric"), ("1,A,X,ASI-0001,,,,49.4,2,71", "bad_outcome"),
        ("1,A,X,ASI-0003,tax,1,,,,", "manual_station"), ("1,A,X,ASI-0001,colour,1,,,,", "unknown_parameter"), ("1,A,X,ASI-0001,tax,high,,,,", "bad_value"),
    ):
        with pytest.raises(ingest.DatasetError, match=rule):
            ingest.load(read(head + row + "\n", f"{rule}.csv"), st)
    for body, text in ((head, "no rows"), ("vehicle_id,station_id\nA,B\n", "product_variant"), (head.encode() + b"1,A\xff,X,ASI-0001,,,,,,\n", "UTF-8")):
        with pytest.raises(ingest.DatasetError, match=text):
            read(body, f"bad{len(body)}.csv")

