"""All line-analytics queries, with the SQL each is compared against."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import ADAPTED as T
from .config import PLANT
from .functions import series as S
from .operators import attribution as X
from .operators import business as B
from .operators import detect as D
from .operators import limits as L
from .operators import model_store as M
from .operators import oven as O
from .operators import report as R
from .operators import risk as K
from .operators.alarm_index import AlarmIndex
from .plans.oracles import AT, INSPECTION, ORACLES, TIMES
from .sources import adapters as A
from .sources import ingest as I
from .sources.staging import fresh_path, shared_dir, stage
from .streaming import alarms as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

ANY = lambda kind: kind != "bottleneck"
SLOW = lambda kind: kind == "bottleneck"


#: Bytes of a generated method that the JVM still compiles. Fixed value.
COMPILED = 8000


def query(f):
    """Registers ``f``.  Rows of many parameters give projections whose generated methods the JVM would only interpret; with
    Spark's limit at the JVM's own they run as expressions that are compiled piece by piece.  A lower limit that was set stays.

    Spark derives filters from what holds of a plan's rows; over the alarm rules' many columns that list grows with each
    projection until it fills the driver, whatever the rows.  So none are derived.
    """

    @functools.wraps(f)
    def run(spark, d):
        limit = "spark.sql.codegen.hugeMethodLimit"
        spark.conf.set(limit, min(COMPILED, int(spark.conf.get(limit))))
        spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
        return f(spark, d)

    QUERIES[f.__name__] = run
    return run


#: All parameters that are scored, and of them those of the oven model, weights in the health score, those kept out of back-traces.
P = list(PLANT)
MODELS = {p: x.model for p, x in PLANT.items() if x.model}
WEIGHTS = {p: x.weight for p, x in PLANT.items()}
UNTRACED = tuple(p for p, x in PLANT.items() if not x.traced)


def _faulty(spark, d, rule=A.instrumented):
    return A.with_faults(O.with_ovens(A.line(spark, d, rule)), A.by_station(spark, ANY))


def _scored(spark, d, rule=A.instrumented):
    return D.score(_faulty(spark, d, rule), T, parameters=P, models=MODELS)


def _flagged(spark, d, rules=(*D.RULES, "cross_parameter")):
    """The rules over scores that are written once: they are read for the limit and for the rules, without the columns no rule reads."""
    return D.with_flags(stage(_narrow(_scored(spark, d)), "scored"), T, rules, P)


def _slowed(spark, d):
    return A.slowed(A.line(spark, d), A.by_station(spark, SLOW))


def _bottlenecks(spark, d):
    return D.bottlenecks(_slowed(spark, d), T)


@query
def operations(spark, d):
    return A.operations(spark, d).drop("order_key", "instrumented", *A.PARAMETERS)


@query
def injected_readings(spark, d):
    long = A.readings(_faulty(spark, d), {"value": "", "fault": "fault_"})
    return long.where("fault is not null").select("station", "vehicle", "parameter", F.round("value", 6).alias("value"), "fault")


@query
def baseline_cells(spark, d):
    # means of money end in ties at the digit rounded to; both engines round them up
    return D.baseline_cells(_faulty(spark, d), T).select("station", "parameter", "variant", F.round(F.col("mean") + 1e-7, 5).alias("mean"), F.round(F.col("std") + 1e-7, 5).alias("std"), "n")


@query
def scored_readings(spark, d):
    return D.scored_readings(_scored(spark, d), P).select("station", "vehicle", "parameter", "z", "baseline_source", "baseline_n")


@query
def ewma_series(spark, d):
    e = S.ewma(_scored(spark, d), {f"e_{p}": f"z_{p}" for p in P}, D.STATION, T.lam)
    return A.readings(e.withColumns({f"e_{p}": F.when(F.col(f"z_{p}").isNotNull(), F.col(f"e_{p}")) for p in P}), {"ewma": "e_"}, P).select("station", "parameter", "vehicle", F.round(F.round("ewma", 9) + 1e-10, 6).alias("ewma"))


@query
def spc_point(spark, d):
    return D.flags(_flagged(spark, d, ("point",)))


@query
def spc_persistent(spark, d):
    return D.flags(_flagged(spark, d, ("persistent",)))


@query
def spc_trend(spark, d):
    return D.flags(_flagged(spark, d, ("trend",)))


@query
def spc_cross(spark, d):
    return D.flags(_flagged(spark, d, ("cross_parameter",))).drop("z")


@query
def flags_union(spark, d):
    """All alarms of the line: the rules on every score, and the ovens' time constants."""
    physics = O.tau_flags(O.tau_alarms(O.tau_fit(O.oven_readings(A.line(spark, d))), T))
    return _rules(spark, d).unionByName(physics)


def _rules(spark, d):
    """The rules' alarms."""
    return D.flags(_flagged(spark, d))


def _narrow(df, *more, keys=D.STATION):
    """Of scored rows what the rules and the features read: the fewer columns, the less every window copies."""
    return df.select(*keys, "vehicle", "supplier_lot", *(f"z_{p}" for p in P), *(more or (f"n_{p}" for p in P)))


@query
def cusum_series(spark, d):
    return D.constraint_series(_slowed(spark, d), T).select("station", "vehicle", F.col("cusum_sigma").alias("cusum"))


@query
def rolling_ols(spark, d):
    return D.constraint_series(_slowed(spark, d), T).where("slope_t is not null").select("station", "vehicle", "slope_t")


@query
def bottlenecks(spark, d):
    return D.starving(_bottlenecks(spark, d), A.stations(spark, d))


@query
def parameter_correlation(spark, d):
    return D.correlations(_scored(spark, d), P).withColumn("r", F.round("r", 6))


@query
def rolling_median(spark, d):
    m = _scored(spark, d).withColumns({f"m_{p}": F.round(F.col(f"z_{p}") - S.rolling_median(f"z_{p}", D.STATION, T.detrend), 6) for p in P})
    return A.readings(m, {"detrended": "m_"}, P).select("station", "parameter", "vehicle", "detrended")


@query
def padded_rolls(spark, d):
    """Padded sum, mean, maximum and slope of the cycle time, and operations since the last failure."""
    o = S.padded_slope(A.line(spark, d), "cycle_time", D.STATION, 10, out="slope_10")
    o = S.rows_since(o, F.col("manual_outcome") == "fail", D.STATION, out="since_fail")
    rolls = {"sum_20": S.padded_sum("cycle_time", D.STATION, 20), "mean_10": S.padded_mean("cycle_time", D.STATION, 10), "max_10": S.padded_max("cycle_time", D.STATION, 10)}
    return o.withColumns(rolls).select("station", "vehicle", *(F.round(c, 6).alias(c) for c in rolls), (F.round("slope_10", 6) + 0.0).alias("slope_10"), "since_fail")


@query
def line_throughput(spark, d):
    return R.line_throughput(A.line(spark, d), AT)


@query
def throughput_loss(spark, d):
    return R.throughput_loss(A.line(spark, d), AT)


@query
def latest_operations(spark, d):
    return R.latest_operations(A.line(spark, d), AT)


@query
def station_series(spark, d):
    """The last 120 readings of each parameter of one station."""
    w = Window.partitionBy("parameter").orderBy(F.desc("vehicle"))
    sc = D.scored_readings(_scored(spark, d).where((F.col("station") == 5) & (F.col("vehicle") <= AT)), P)
    return sc.withColumn("_k", F.row_number().over(w)).where("_k <= 120").select("parameter", "vehicle", "z")


@query
def flags_since(spark, d):
    return D.flags(_flagged(spark, d).where(F.col("vehicle").between(200, AT)))


@query
def visible_bottlenecks(spark, d):
    return _bottlenecks(spark, d).where(F.col("detected_at") <= AT).select("station", "detected_at")


@query
def deviation_heatmap(spark, d):
    f = D.flags(_flagged(spark, d, D.RULES))
    return f.groupBy("station").pivot("parameter", P).agg(F.max(F.abs("z")))


@query
def area_counts(spark, d):
    return A.stations(spark, d).groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.count_if("instrumented").alias("instrumented"))


def _all_rows(spark, d):
    """Every operation with its scores and alarms, those without instruments too; the scored rows are written once."""
    sc = stage(D.score(_faulty(spark, d), T, parameters=P, models=MODELS, manual=True), "scored")
    return sc, D.with_flags(sc, T, parameters=P)


def _states(spark, d, times):
    sc, rows = _all_rows(spark, d)
    return sc, R.state_at(A.stations(spark, d), rows, stage(_bottlenecks(spark, d), "constraints"), times, parameters=P, weights=WEIGHTS)


@query
def state_stations(spark, d):
    return _states(spark, d, [AT])[1].select("station", "area", "instrumented", "health_score", "gap_method", "status")


@query
def state_at_times(spark, d):
    """Stations as known at several times, in one pass."""
    _, s = _states(spark, d, TIMES)
    return s.select("t", "station", "health_score", "gap_method", "status", F.col("operation.vehicle").alias("vehicle"), F.col("operation.manual_outcome").alias("outcome"), "worst_cycle", F.size("open_flags").alias("n_open"), "n_flags", "constraints")


@query
def state_document(spark, d):
    """The state as one JSON text per time and page of stations."""
    pages = R.state_pages(_states(spark, d, [150, AT])[1], first=1)
    station = lambda x: F.struct(*(x[c].alias(c) for c in ("station", "area", "status", "gap_method", "health_score")), x["operation"]["vehicle"].alias("vehicle"), F.size(x["open_flags"]).alias("open_flags"))
    return pages.select("t", "page", "n", "alerts", "warnings", "flags_so_far", F.to_json(F.transform("stations", station), {"ignoreNullFields": "false"}).alias("stations"))


@query
def line_state(spark, d):
    """The whole line at several times: counts, rate, losses and back-trace, nested parts as JSON."""
    sc, s = _states(spark, d, TIMES)
    out = R.line_state_at(stage(s, "states"), R.latent_trace_at(sc, INSPECTION, "tax", TIMES, UNTRACED, parameters=P))
    return out.select("t", "n_stations", "instrumented", "alert", "warning", "healthy", "flags", "constraints", "throughput.line_uph", "throughput.takt_s", "throughput.constraint_station", "throughput.recoverable_uph", *(F.to_json(c).alias(c) for c in ("loss", "trace")))


@query
def latent_trace_at(spark, d):
    """The back-trace as it was known at several times."""
    return R.latent_trace_at(_scored(spark, d), INSPECTION, "tax", TIMES, UNTRACED, parameters=P)


@query
def spc_cross_causal(spark, d):
    """The cross-parameter rule with the correlations known at each vehicle."""
    return D.flags(D.with_flags(_scored(spark, d), T, ("cross_parameter",), P, causal=True)).drop("z")


@query
def backtest_scenarios(spark, d):
    return R.backtest_scenarios(A.injections(spark), R.alarms_of(_rules(spark, d), _bottlenecks(spark, d)))


@query
def backtest_summary(spark, d):
    alarms = stage(R.alarms_of(_rules(spark, d), _bottlenecks(spark, d)), "alarms")
    return R.backtest_summary(A.injections(spark), alarms)


@query
def false_alarm_profile(spark, d):
    return R.false_alarm_profile(line_false_alarms(spark, d))


@query
def coverage_study(spark, d):
    """Detection with fewer instrumented stations."""
    bots, levels = stage(_bottlenecks(spark, d), "constraints"), (0.7, 0.5, 0.3)
    # each level's stations are among the highest's, and a station's scores and alarms depend on no other; the EWMA limit does
    sc = stage(_scored(spark, d, A.covered(max(levels))), "scored")
    alike = stage(D.flags(D.with_flags(sc, T, tuple(r for r in (*D.RULES, "cross_parameter") if r != "persistent"), P)), "flags")
    parts = []
    for level in levels:
        rule = A.covered(level)
        here = rule(F.col("station"))
        flags = alike.where(here).unionByName(D.flags(D.with_flags(sc.where(here), T, ("persistent",), P)))
        summary = R.backtest_summary(A.injections(spark), stage(R.alarms_of(flags, bots), "alarms"))
        n = A.stations(spark, d).agg(F.count_if(rule(F.col("station"))).alias("instrumented_stations"), F.count_if(~rule(F.col("station"))).alias("manual_stations"))
        parts.append(summary.select(F.lit(level).alias("level"), "recall", "precision", "bottleneck_recall", "median_detection_lag").crossJoin(F.broadcast(n)))  # one row each
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _quiet(spark, d):
    """All lines without their faults: their rows, and written once their scores and their ovens' time constants."""
    wide = A.lines(spark, d)
    sc = stage(D.score(O.with_ovens(wide), T, parameters=P, models=MODELS, keys=LINES), "lines")
    return wide, sc, stage(O.tau_fit(O.oven_readings(wide, per=["line"]), per=["line"]), "tau")


def _peaks(wide, sc, fits):
    sigma = D.ewma_limit(sc, dataclasses.replace(T, ewma_l=1.0), P, ["line"])
    return B.peaks(sc, sigma, D.constraint_series(wide, T, LINES), O.tau_scores(fits, T, per=["line"]), P, T.lam)


@query
def calibration_sweep(spark, d):
    """Of each detector the lowest limit that keeps false alarms within a third of one per line, on fitting and on validating lines."""
    return _calibrated(*_quiet(spark, d))


def _calibrated(wide, sc, fits):
    grids = {"ewma": (1.5, 0.1, 126), "cusum": (2.0, 0.25, 233), "tau": (2.0, 0.1, 121)}
    return B.calibration(stage(_peaks(wide, sc, fits), "peaks"), grids, 1.0 / 3)


@query
def calibrated_bottlenecks(spark, d):
    """The constraints under the limits that the calibration has written and the detector has read back."""
    path = fresh_path(spark, "limits")
    L.append(spark, path, calibration_sweep(spark, d))
    th, _ = L.thresholds(L.latest(spark, path), T, O.Oven())
    return D.bottlenecks(_slowed(spark, d), th).select("station", "vehicle", "cusum")


@query
def validation(spark, d):
    inj = A.injections(spark)
    rules = stage(_rules(spark, d).select("station", "vehicle"), "flags")
    alarms = stage(R.alarms_of(rules, _bottlenecks(spark, d)), "alarms")
    exposure = R.latent_exposure(_scored(spark, d), rules, INSPECTION, "tax", UNTRACED, parameters=P)
    return R.validation(R.backtest_summary(inj, alarms), inj, alarms, exposure)


@query
def validation_report(spark, d):
    """The validation with the false alarms and the calibrated limits, as one document."""
    quiet = _quiet(spark, d)
    return R.report(validation(spark, d), R.false_alarm_profile(_false_alarms(*quiet)), _calibrated(*quiet))


@query
def alarm_window(spark, d):
    """Alarms of one station in a range of vehicles, from the stored index."""
    return AlarmIndex.write(D.flags(_flagged(spark, d))).window(5, 200, AT)


@query
def alarm_windows(spark, d):
    """Open alarms of all stations at several times, from the stored index."""
    asked = A.stations(spark, d).select("station", F.explode(F.array(*(F.lit(t) for t in TIMES))).alias("t"))
    return AlarmIndex.write(D.flags(_flagged(spark, d))).windows(asked, 20).select("t", "station", "parameter", "vehicle", "type")


@query
def inspection_failures(spark, d):
    return R.inspection_failures(_scored(spark, d).where(F.col("station") == INSPECTION), "tax")


@query
def latent_trace(spark, d):
    return R.latent_trace(_scored(spark, d), INSPECTION, "tax", UNTRACED, parameters=P)


@query
def latent_exposure(spark, d):
    return R.latent_exposure(_scored(spark, d), _rules(spark, d), INSPECTION, "tax", UNTRACED, parameters=P)


@query
def lot_mean_abs_z(spark, d):
    sc = D.scored_readings(_scored(spark, d), P)
    return sc.groupBy("supplier_lot").agg(F.round(F.avg(F.abs("z")) + 1e-9, 6).alias("lot_mean_abs_z"), F.count(F.lit(1)).alias("n"))


@query
def economics(spark, d):
    return B.economics(B.measured(backtest_summary(spark, d), line_throughput(spark, d), false_alarm_profile(spark, d)))


@query
def rollout(spark, d):
    return B.rollout(economics(spark, d))


@query
def retrofit(spark, d):
    n = A.stations(spark, d).agg(F.count(F.lit(1)).alias("n_stations"))
    return B.retrofit(economics(spark, d), B.coverage_slope(coverage_study(spark, d)), n)


@query
def station_topology(spark, d):
    return A.topology(spark)


@query
def thermal_regression(spark, d):
    f = O.thermal_regression(O.oven_readings(A.line(spark, d)), T)
    return f.select("station", *((F.round(c, 5) + 0.0).alias(c) for c in ("slope", "intercept", "sigma")), "n")


@query
def thermal_residuals(spark, d):
    rd = O.oven_readings(A.line(spark, d))
    return O.residuals(rd, O.thermal_regression(rd, T)).withColumn("residual", F.col("residual") + 0.0)


@query
def oven_tau_fit(spark, d):
    return O.tau_fit(O.oven_readings(A.line(spark, d)))


@query
def oven_tau_alarms(spark, d):
    return O.tau_alarms(O.tau_fit(O.oven_readings(A.line(spark, d))), T)


def _features(spark, d):
    rd = O.oven_readings(A.line(spark, d))
    return K.features(A.operations(spark, d), stage(_narrow(_flagged(spark, d), "flags"), "flagged"), O.residuals(rd, O.thermal_regression(rd, T)), T, P)


@query
def risk_features(spark, d):
    return _features(spark, d).select("station", "vehicle", *((F.round(F.col(c) + 1e-9, 5) + 0.0).alias(c) for c in K.FEATURES))


@query
def risk_labels(spark, d):
    return K.labels(A.line(spark, d), K.truth_of(A.injections(spark)))


def _rated(spark, d):
    """A fixed score of the operations, for the metrics: the longer a cycle, the higher."""
    y = risk_labels(spark, d).withColumnRenamed("label", "y")
    p = A.line(spark, d).select("station", "vehicle", F.round(F.col("cycle_time") / 100 + F.col("queue") / 100, 6).alias("p"))
    return p.join(y, ["station", "vehicle"])


@query
def risk_metrics(spark, d):
    return K.metrics(stage(_rated(spark, d), "rated"))


@query
def risk_reliability(spark, d):
    return K.reliability(_rated(spark, d))


LINES = ["line", "station"]


def _lines_flagged(spark, d, causal=False):
    """All lines with their faults, scored and with their alarms; lines go through every window by (line, station)."""
    sc = D.score(A.line_faults(O.with_ovens(A.lines(spark, d))), T, parameters=P, models=MODELS, keys=LINES)
    sc = stage(_narrow(sc, keys=LINES), "lines")
    return D.with_flags(sc, T, parameters=P, keys=LINES, causal=causal)


@query
def line_flags(spark, d):
    return D.flags(_lines_flagged(spark, d), LINES)


@query
def line_bottlenecks(spark, d):
    return D.bottlenecks(A.line_faults(A.lines(spark, d)), T, LINES).select(*LINES, "vehicle", "cusum", "slope_t", "queue_z")


@query
def line_false_alarms(spark, d):
    """Alarms of every line without its faults, all of them false."""
    return _false_alarms(*_quiet(spark, d))


def _false_alarms(wide, sc, fits):
    flags = D.flags(D.with_flags(sc, T, parameters=P, keys=LINES), LINES)
    physics = O.tau_alarms(fits, T, per=["line"])
    return R.line_false_alarms(wide, flags, D.bottlenecks(wide, T, LINES), physics)


@query
def line_backtest(spark, d):
    faults = A.line_faults(A.lines(spark, d)).where("fault is not null").groupBy(*LINES, F.col("fault").alias("kind")).agg(F.min("vehicle").alias("first"), F.max("vehicle").alias("last"))
    return R.line_backtest(faults, line_flags(spark, d), line_bottlenecks(spark, d).withColumn("detected_at", F.col("vehicle")))


def _risk_frame(spark, d):
    """Features and labels of every line, staged."""
    wide = A.with_operator(A.line_faults(A.lines(spark, d)), spark, d)
    rd = O.oven_readings(A.lines(spark, d), per=["line"])
    thermal = O.residuals(rd, O.thermal_regression(rd, T, per=["line"]), per=["line"])
    feats = K.features(wide, stage(_narrow(_lines_flagged(spark, d, causal=True), "flags", keys=LINES), "flagged"), thermal, T, P, keys=LINES, causal=True)
    truth = A.line_faults(A.lines(spark, d)).where("fault is not null").select(*LINES, "vehicle")
    return stage(feats.join(K.labels(wide, truth, keys=LINES), [*LINES, "vehicle"]), "risk-frame")


def _risk_model(spark, d, frame, rounds=40):
    """The stored model of these settings and lines, or one that is fitted now."""
    settings = {"thresholds": dataclasses.asdict(T), "parameters": {p: dataclasses.asdict(x) for p, x in PLANT.items()}, "oven": dataclasses.asdict(O.Oven()), "features": K.FEATURES, "horizon": K.HORIZON, "roles": K.ROLES, "rounds": rounds, "faults": [A.ONSET, A.LENGTH, A.SLOPE, A.SHIFT, A.SLOWER]}
    store = M.ModelStore(spark, f"{shared_dir(spark)}/lineloom-models")
    name = M.key(settings, M.fingerprint(A.table(spark, d, "lineitem")))
    return store, name, store.get(name, lambda: K.fit(frame, rounds))


def _validated(spark, d):
    """Calibrated risks of the validation lines, with the model's place."""
    frame = _risk_frame(spark, d)
    store, name, model = _risk_model(spark, d, frame)
    return model, store.place(name), model.predict(frame.where(K.role(F.col("line")) == "validate"))


@query
def risk_scores(spark, d):
    """Calibrated risk of each line, station and vehicle of the lines that neither trained nor calibrated."""
    return _validated(spark, d)[2].select(*LINES, "vehicle", F.round("p", 6).alias("risk"), "label")


@query
def risk_drivers(spark, d):
    """The three features that moved each of these scores most, with all that the model adds up to."""
    _, place, scored = _validated(spark, d)
    out = X.attribute(scored, X.stored_ensemble(spark, f"{place}/trees"), K.FEATURES, labels=K.LABELS)
    return out.select(*LINES, "vehicle", F.round("p", 6).alias("risk"), F.round("margin", 9).alias("margin"), F.round("base", 9).alias("base"), "drivers")


@query
def risk_documents(spark, d):
    """Per line and station its scores and their drivers by vehicle, as maps."""
    s = risk_drivers(spark, d)
    by_vehicle = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("vehicle", c))))  # noqa: E731  a station's vehicles of one line
    share = F.round(100 * F.col("risk"), 1).alias("risk_pct")
    named = F.transform("drivers", lambda x: F.struct(x["label"].alias("label"), x["family"].alias("family"), F.round(x["contribution"], 3).alias("contribution"))).alias("causes")
    return s.select(*LINES, "vehicle", share, named).groupBy(*LINES).agg(F.max("risk_pct").alias("peak_risk_pct"), F.max_by("vehicle", F.struct("risk_pct", -F.col("vehicle"))).alias("peak_vehicle"), by_vehicle("risk_pct").alias("scores"), by_vehicle("causes").alias("drivers"))


@query
def risk_model_card(spark, d):
    """One row on the model: where it comes from, what it is for, how it did on the validation lines."""
    model, place, scored = _validated(spark, d)
    rated = stage(scored.select("line", "station", "vehicle", "p", F.col("label").alias("y")), "rated")
    curve = K.reliability(rated).agg(F.array_sort(F.collect_list(F.struct("bin", "predicted", "observed", "n"))).alias("reliability"))  # ten at most
    used = {r: sum(x == r for x in K.ROLES) for r in ("train", "calibrate", "validate")}
    card = {"model": f"{model.trees.getNumTrees} boosted trees", "key": place.rpartition("-")[2], "target": f"a fault at the station within {K.HORIZON} vehicles", "attribution": "Shapley values of the margin", "calibration": "isotonic", "split": ", ".join(f"{n} of {len(K.ROLES)} lines {r}" for r, n in used.items())}
    importances = F.create_map(*(x for f, g in model.importances().items() for x in (F.lit(f), F.lit(g))))
    return K.metrics(rated).crossJoin(F.broadcast(curve)).select(*(F.lit(v).alias(k) for k, v in card.items()), importances.alias("importances"), "*")  # one row each


@query
def export_rows(spark, d):
    return I.export_rows(A.line(spark, d), A.stations(spark, d))


@query
def export_truth(spark, d):
    return I.export_truth(A.injections(spark), A.stations(spark, d))


def _csv(spark, df, name, kind="data"):
    """``df`` by way of CSV files, packed: as text they take many times the input's disk."""
    path = fresh_path(spark, name)
    I.write_csv(df, path, "gzip")
    return I.read_csv(spark, path, kind)


def _damaged(rows):
    """Exported rows with one of the faults that the rules look for, by vehicle number."""
    n = F.expr("cast(substr(vehicle_id, 3) as int)")
    broken = lambda k, c, v: F.when(n % 97 == k, F.lit(v)).otherwise(F.col(c).cast("string"))
    return rows.withColumns({"station_id": broken(1, "station_id", "XXX-0000"), "queue_length": broken(2, "queue_length", "many"), "manual_outcome": broken(3, "manual_outcome", "maybe"), "parameter": broken(4, "parameter", "colour"), "value": broken(5, "value", "high"), "vehicle_id": broken(6, "vehicle_id", " ")})  # noqa: E501


@query
def ingest_operations(spark, d):
    ops, _, _ = I.load(_csv(spark, export_rows(spark, d), "data"), A.stations(spark, d))
    return ops


@query
def ingest_readings(spark, d):
    _, values, _ = I.load(_csv(spark, export_rows(spark, d), "data"), A.stations(spark, d), strict=False)
    return values


@query
def ingest_errors(spark, d):
    c = I.checked(_csv(spark, _damaged(export_rows(spark, d)), "damaged"), A.stations(spark, d))
    return c.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query
def ingest_truth(spark, d):
    st = A.stations(spark, d)
    raw = export_truth(spark, d)
    area = raw.where("confirmed_by = 'inj1'").withColumn("station_id", F.expr("concat(left(station_id, 3), '-*')")).withColumn("event_end", F.lit("nobody")).withColumn("confirmed_by", F.lit("group"))
    rows = _csv(spark, raw.unionByName(area), "truth", "truth")
    _, _, vehicles = I.load(_csv(spark, export_rows(spark, d), "data"), st)
    return I.truth(rows, vehicles, st).withColumn("errors", F.array_join("errors", ","))


@query
def stream_alarms(spark, d):
    """Every rule of a station as a stream, delivered out of order and restarted between deliveries."""
    wide = A.slowed(_faulty(spark, d), A.by_station(spark, SLOW))
    sc = stage(D.score(wide, T, parameters=P, models=MODELS, manual=True), "scored")
    limit = D.ewma_limit(sc, T, P).first()[0]
    alarms, _ = W.replay(W.station_rows(sc, D.constraint_series(sc, T), P), W.StationAlarms(limit, T, P))
    return alarms.select(F.col("key").alias("station"), "parameter", "vehicle", "type", S.rounded("z", 3).alias("z"))


@query
def stream_oven_alarms(spark, d):
    """The oven's time constant as a stream."""
    rd = stage(O.oven_readings(A.line(spark, d)), "oven")
    alarms, _ = W.replay(W.oven_rows(rd, stage(O.tau_fit(rd), "tau"), T, 10), W.OvenAlarms(O.Oven(), 10))
    return alarms.select(F.col("key").alias("oven"), "vehicle", "type", "z")


ORACLES = {k: v for k, v in ORACLES.items() if k in QUERIES}
