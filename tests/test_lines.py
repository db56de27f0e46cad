"""Many lines in one job, states and traces at many times, causal variants: by cut tables and by plans."""

import re

import pytest
from pyspark.sql import functions as F

from lineloom import registry
from lineloom.config import ADAPTED as T
from lineloom.operators import detect, report, risk
from lineloom.sources import adapters

FOLDER = "/root/testdata/sf0.001"
LINES = ["line", "station"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def wide(spark):
    return adapters.with_faults(adapters.line(spark, FOLDER), adapters.by_station(spark, registry.ANY)).cache()


def test_lines_come_out_as_each_line_alone(spark):
    every = adapters.line_faults(adapters.lines(spark, FOLDER)).cache()
    flags = detect.flags(detect.with_flags(detect.score(every, T, keys=LINES), T, keys=LINES), LINES)
    bots = detect.bottlenecks(every, T, LINES)
    for year in (1995, 2001):
        one = every.where(F.col("line") == year).drop("line")
        assert rows(flags.where(F.col("line") == year).drop("line")) == rows(detect.flags(detect.with_flags(detect.score(one, T), T)))
        assert rows(bots.where(F.col("line") == year).drop("line")) == rows(detect.bottlenecks(one, T))
    assert {r.fault for r in every.select("fault").distinct().collect()} == {None, "trend", "cross_parameter", "bottleneck"}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan)), len([x for x in plan.split("\n") if "FileScan" in x and "l_suppkey" in x])


def test_many_lines_need_no_more_shuffles_than_one(spark):
    one = detect.with_flags(detect.score(adapters.line(spark, FOLDER), T), T, ("point", "trend", "cross_parameter"))
    many = detect.with_flags(detect.score(adapters.lines(spark, FOLDER), T, keys=LINES), T, ("point", "trend", "cross_parameter"), keys=LINES)
    assert exchanges(one) == exchanges(many) == (1, 1)


def test_states_at_many_times_equal_single_ones(spark, wide):
    sc = detect.score(wide, T, manual=True).cache()
    flagged, st, bots = detect.with_flags(sc, T), adapters.stations(spark, FOLDER), registry._bottlenecks(spark, FOLDER).cache()
    times = [1, 90, 300, 5000]
    together = report.state_at(st, flagged, bots, times).cache()
    for t in times:
        assert rows(together.where(F.col("t") == t)) == rows(report.state_at(st, flagged, bots, [t]))
        cut = report.state_at(st, detect.with_flags(sc, T).where(F.col("vehicle") <= t), bots.where(F.col("detected_at") <= t), [t])
        assert rows(together.where(F.col("t") == t)) == rows(cut)
    pages = report.state_pages(together, page=4).collect()
    assert {(p.t, p.page): len(p.stations) for p in pages if p.t == 90} == {(90, 0): 4, (90, 1): 4, (90, 2): 2}
    first = next(p for p in pages if (p.t, p.page) == (90, 0)).stations
    assert [s.station for s in first] == sorted(s.station for s in first) and first[1].operation.vehicle <= 90


def test_states_scan_the_line_items_at_most_twice(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(registry, "stage", lambda df, name: staged.append((name, exchanges(df)[1])) or df.sparkSession.createDataFrame([], df.schema))
    out = registry.QUERIES["state_at_times"](spark, FOLDER)
    assert dict(staged) == {"scored": 1, "constraints": 1} and exchanges(out)[1] == 0


def spread(spark, n=420):
    """Five stations of a line: two parameters that move together at some vehicles, an inspection station that fails when the second did."""
    noise = lambda v, k: ((v * 7919 + k * 104729) % 1000) / 500 - 1
    out = []
    for s in (1, 2, 4, 5, 7):
        for v in range(1, n + 1):
            bad = v > 250 and v % 7 == 3
            a, b = noise(v, s), 0.6 * noise(v, s) + 0.4 * noise(v, s + 50)
            out.append((s, v, "A", (v - 1) // 30, True, "fail" if s == 7 and bad else "pass", a + (2.0 if s == 2 and bad else 0.0), b + (1.0 if s == 2 and bad else 0.0)))
    return spark.createDataFrame(out, "station bigint, vehicle bigint, variant string, supplier_lot bigint, instrumented boolean, manual_outcome string, heat double, force double")


PAIR = ["heat", "force"]


def test_traces_at_many_times_equal_those_of_cut_tables(spark):
    sc = detect.score(spread(spark), T, parameters=PAIR).cache()
    times = [255, 300, 350, 420]
    found = report.latent_ranking_at(sc, 7, "force", times, exclude=(), parameters=PAIR)
    found = found.cache()
    per = {r.t: r["count"] for r in found.groupBy("t").count().collect()}
    assert set(per) == {350, 420}  # fewer than eight failures before
    for t in times:
        alone = report.latent_ranking_at(sc.where(F.col("vehicle") <= t), 7, "force", [t], exclude=(), parameters=PAIR)
        assert rows(found.where(F.col("t") == t)) == rows(alone)
    best = max(found.where(F.col("t") == 420).collect(), key=lambda r: abs(r.t_statistic))
    assert (best.station, best.parameter) == (2, "heat")


def test_causal_alarms_do_not_change_with_what_follows(spark):
    sc = detect.score(spread(spark), T, parameters=PAIR).cache()
    th = T.__class__(**{**T.__dict__, "cross_z": 0.8, "cross_corr": 0.3})
    alarms = lambda d, causal: rows(detect.flags(detect.with_flags(d, th, parameters=PAIR, causal=causal)).where("vehicle <= 260 and type = 'cross_parameter'"))
    cut = sc.where("vehicle <= 260")
    assert alarms(sc, True) == alarms(cut, True) and len(alarms(sc, True)) > 10


def test_constant_parameters_have_no_correlation(spark):
    sc = detect.score(spread(spark).withColumn("force", F.lit(1.0)), T, parameters=PAIR)
    assert detect.correlations(sc, PAIR).count() == 0
    assert detect.flags(detect.with_flags(sc, T, ("cross_parameter",), PAIR, causal=True)).count() == 0


def test_causal_lot_means_know_only_the_lot_so_far(spark):
    d = spark.createDataFrame([(1, 1, 0, 2.0), (2, 1, 0, 4.0), (1, 2, 0, 6.0), (1, 3, 1, 9.0)], "station bigint, vehicle bigint, supplier_lot bigint, z double")
    mean = lambda causal: {r[0]: r[1] for r in risk.lot_means(d, F.col("z"), F.lit(1), [], causal)[0].collect()}
    assert mean(False) == {0: 4.0, 1: 9.0} and mean(True) == {1: 3.0, 2: 4.0, 3: 9.0}


def test_backtest_of_a_line(spark):
    faults = spark.createDataFrame([(1, 5, "trend", 50, 70), (1, 6, "bottleneck", 40, 60), (2, 5, "trend", 50, 70)], "line bigint, station bigint, kind string, first bigint, last bigint")
    flags = spark.createDataFrame([(1, 5, 30), (1, 5, 55), (1, 9, 60), (1, 6, 50)], "line bigint, station bigint, vehicle bigint")
    bots = spark.createDataFrame([(1, 6, 90), (3, 1, 10)], "line bigint, station bigint, detected_at bigint")
    got = {r.line: tuple(r)[1:] for r in report.line_backtest(faults, flags, bots).collect()}
    # line 1: both faults found 5 and 50 vehicles late; alarms at 9 and, of the other sort, at 6 are false
    assert got == {1: (2, 2, 100.0, 50.0, 2, 27.5), 2: (1, 0, 0.0, None, 0, None), 3: (0, 0, None, 0.0, 1, None)}
