"""Steps whose work must grow no faster than the input: by plans, and against plain Python."""

import math

import duckdb
from pyspark.sql import functions as F

from lineloom import registry
from lineloom.config import Oven
from lineloom.functions import series as S
from lineloom.operators import detect, oven, report, risk


def test_time_constants_shuffle_readings_not_candidates(spark):
    """No row per candidate; blocks of vehicles, and vehicles that lack zones, come out as in plain Python."""
    o = Oven(window=5, grid=40)
    rows = [(7, v, 25.0 + 19 * z, round(150 + 20 * math.sin(v * 1.7 + z) + z, 4)) for v in range(1, 41) for z in range(4) if (v + z) % 5]
    rd = spark.createDataFrame(rows, "oven bigint, vehicle bigint, dwell double, temperature double")
    was, oven.BLOCK = oven.BLOCK, 7
    try:
        fits = oven.tau_fit(rd, o)
    finally:
        oven.BLOCK = was
    assert "Generate" not in fits._jdf.queryExecution().executedPlan().toString()
    grid, vehicles = [round(0.6 * o.tau + i * 1.2 * o.tau / (o.grid - 1), 6) for i in range(o.grid)], sorted({v for _, v, _, _ in rows})
    want = []
    for i in range(o.window - 1, len(vehicles)):
        last = [(d, t) for _, v, d, t in rows if v in vehicles[i - o.window + 1 : i + 1]]

        def sse(tau, last=last):
            r = [round(t - (o.ambient + (o.setpoint - o.ambient) * (1 - math.exp(-d / tau))), 6) for d, t in last]
            return round(sum(x * x for x in r) - sum(r) ** 2 / len(r), 4)

        want.append((7, vehicles[i], min(grid, key=lambda tau: (sse(tau), tau))))
    assert sorted(map(tuple, fits.collect())) == want


def test_cusums_of_four_digits_round_to_three_as_in_the_sql(spark):
    values = [x / 10000 for x in range(40005, 42000, 10)] + [-4.0535, 0.0, 4.1]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "z double").select(S.rounded("z", 3)).collect()]
    assert got == [duckdb.execute("select round(?::double, 3)", [v]).fetchall()[0][0] for v in values]
    assert got[values.index(4.0535)] == 4.053


def test_pages_count_positions_from_the_given_first(spark):
    """As the SQL of state_document: (pos - 1) // 200, where position 0 is on page 0 too."""
    cols = "t int, pos bigint, station bigint, area string, status string, gap_method string, health_score double, operation int, open_flags array<int>, n_flags bigint"
    states = spark.createDataFrame([(1, p, p, "a", "healthy", "m", 1.0, 0, [], 0) for p in range(401)], cols)
    pages = {r.page: r.n for r in report.state_pages(states, first=1).select("page", F.col("n")).collect()}
    assert pages == {0: 201, 1: 200}


def test_composite_queries_run_shared_steps_once(spark, monkeypatch):
    """Scores of the coverage levels, and the alarms and oven fits of the validation report, are made once."""
    calls = dict.fromkeys(("score", "tau_fit", "with_flags"), 0)

    def counted(module, name):
        real = getattr(module, name)

        def run(*args, **kwargs):
            calls[name] += 1
            return real(*args, **kwargs)

        monkeypatch.setattr(module, name, run)

    # plans only: a staged table is an empty one
    monkeypatch.setattr(registry, "stage", lambda df, name: spark.createDataFrame([], df.schema))
    counted(registry.D, "score")
    counted(registry.D, "with_flags")
    counted(registry.O, "tau_fit")
    registry.QUERIES["coverage_study"](spark, "/root/testdata/sf0.001")
    assert calls["score"] == 1
    calls.update(dict.fromkeys(calls, 0))
    registry.QUERIES["validation_report"](spark, "/root/testdata/sf0.001")
    assert calls["tau_fit"] == 1 and calls["with_flags"] == 2


def test_queries_keep_to_methods_that_the_jvm_compiles(spark):
    """The scores' projection is one method of some 30,000 bytes; the JVM interprets what has more than 8,000."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(limit)
    try:
        registry.QUERIES["scored_readings"](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(limit)) == 8000
        spark.conf.set(limit, 5000)
        registry.QUERIES["scored_readings"](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(limit)) == 5000
    finally:
        spark.conf.unset(limit)


def test_exported_rows_need_no_join_with_their_readings(spark):
    """The line items are read and shuffled once."""
    plan = registry.QUERIES["export_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_suppkey") and plan.count("Window") == 1


def test_alerts_upstream_without_a_vehicle_s_whole_line(spark):
    """Against plain Python, with gaps in the stations; no window over a vehicle's stations is left in the features."""
    seats = [1, 2, 4, 7, 8, 20]
    rows = [(line, s, v, (s * v + line) % 4) for line in (1, 2) for s in seats for v in range(1, 9)]
    df = spark.createDataFrame(rows, "line bigint, station bigint, vehicle bigint, alerts bigint")
    got = {(r.line, r.station, r.vehicle): r.up for r in risk.upstream(df.where("alerts > 0"), df, ["line", "station"]).collect()}
    n = {r[:3]: r[3] for r in rows}
    want = {(x, s, v): sum(n[x, t, v] for t in seats[max(0, i - 3) : i]) for x in (1, 2) for i, s in enumerate(seats) for v in range(1, 9)}
    assert got == {k: v for k, v in want.items() if v}
    plan = registry.K.features(*_frames(spark), parameters=["discount", "quantity"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(vehicle" not in plan


def _frames(spark):
    line = "station bigint, vehicle bigint, supplier_lot bigint, variant string, operator string, cycle_time double, queue bigint, utilization double, manual_outcome string"
    flagged = "station bigint, vehicle bigint, supplier_lot bigint, z_discount double, z_quantity double, flags array<struct<severity:string>>"
    return spark.createDataFrame([], line), spark.createDataFrame([], flagged)


def test_planning_of_alarms_derives_no_filters_from_their_columns(spark):
    """What Spark derives from the columns of all rules once took nearly all of planning, and the driver's memory at any size of the tables."""
    qe = registry.QUERIES["flags_since"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    qe.executedPlan()
    rules, took = qe.tracker().rules().iterator(), {}
    while rules.hasNext():
        r = rules.next()
        took[r._1().rpartition(".")[2]] = r._2().totalTimeNs()
    assert sum(t for r, t in took.items() if r.startswith("InferFilters")) < 0.25 * sum(took.values())


def test_rules_share_their_windows(spark):
    """Two over scores for all rules but the EWMA, which has three more with its latches; each window copies every column."""
    sc = registry.stage(registry._narrow(registry._scored(spark, "/root/testdata/sf0.001")), "scored")
    windows = lambda *rules: detect.with_flags(sc, registry.T, rules, registry.P)._jdf.queryExecution().sparkPlan().toString().count("Window [")
    assert windows("point", "trend", "cross_parameter") <= 3
    assert windows(*detect.RULES, "cross_parameter") <= 6


def test_exports_on_their_way_back_are_packed(spark):
    """An export's text takes many times the disk of its input; read back, packed rows are the same."""
    rows = registry.QUERIES["export_rows"](spark, "/root/testdata/sf0.001")
    back = registry._csv(spark, rows, "packed")
    assert all(f.endswith(".csv.gz") for f in back.inputFiles())
    c = sorted(set(back.columns) & set(rows.columns))
    assert back.count() == rows.count() and back.select("vehicle_id").exceptAll(rows.select("vehicle_id")).isEmpty() and len(c) == len(rows.columns)
