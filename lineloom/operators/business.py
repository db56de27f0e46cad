"""Business case, rollout, retrofit, coverage and calibration: all from measured inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PHASES, SENSORS, Economics
from ..functions import series as S


def measured(backtest: DataFrame, throughput: DataFrame, false_alarms: DataFrame) -> DataFrame:
    """The one row that the business case takes, from the backtest, the line rate and the fault-free profile (one row each)."""
    return (
        backtest.select(F.coalesce("recall", F.lit(0.0)).alias("recall"), F.coalesce("median_detection_lag", F.lit(0.0)).alias("lag"), F.col("bottleneck_events").cast("double").alias("events_per_run"))
        .crossJoin(F.broadcast(throughput.select("nominal_uph", "recoverable_uph")))
        .crossJoin(F.broadcast(false_alarms.select(F.col("total_false_alarms_per_run").alias("false_alarms_per_run"), "vehicles_per_run")))
    )


def economics(m: DataFrame, e: Economics = Economics()) -> DataFrame:
    """Annual case of one-row measurements: recall, lag, nominal and recoverable rate, constraint events, false alarms and vehicles per run."""
    act = S.interp(F.greatest(F.col("lag"), F.lit(0.0)), e.lead, e.actionable)
    runs = e.vehicles_per_year / F.greatest(F.col("vehicles_per_run"), F.lit(1))
    defects = e.vehicles_per_year * e.defect_rate * F.col("recall") / 100 * act
    rec = F.least(0.5 * F.col("recoverable_uph") / F.col("nominal_uph") * F.col("lag") * F.col("events_per_run") * runs * act, F.lit(e.max_share * e.vehicles_per_year))
    cost = F.col("false_alarms_per_run") * runs * e.investigation
    rework, scrap, thr = defects * e.rework_cost, defects * e.scrap_rate * e.scrap_cost, rec * e.margin
    net = rework + scrap + thr - cost
    out = {"actionable": F.round(act, 3), "defects_prevented": F.round(defects), "rework_usd": F.round(rework), "scrap_usd": F.round(scrap), "vehicles_recovered": F.round(rec), "throughput_usd": F.round(thr), "investigation_usd": F.round(cost), "net_usd": F.round(net), "net_low_usd": F.round(net * (1 - e.band)), "net_high_usd": F.round(net * (1 + e.band))}  # noqa: E501
    return m.select(*[v.alias(k) for k, v in out.items()])


def rollout(case: DataFrame, phases=PHASES) -> DataFrame:
    """Payback of the rollout phases against the annual net benefit; null where nothing pays back."""
    cost, weeks = sum(p[2] for p in phases), sum(p[1] for p in phases)
    net = F.col("net_usd")
    return case.select(
        F.lit(float(cost)).alias("total_cost_usd"), F.lit(float(weeks)).alias("total_weeks"), net.alias("annual_net_usd"), F.when(net > 0, F.round(cost / (net / 12), 1)).alias("payback_months"),
        F.round(100 * (net - cost) / F.nullif(F.lit(float(cost)), F.lit(0.0)), 1).alias("first_year_roi_pct"),
    )


def coverage_slope(levels: DataFrame) -> DataFrame:
    """Recall lost per point of coverage between the highest and the lowest level (one row)."""
    ends = levels.agg(*(f(F.struct("level", "recall")).alias(n) for n, f in (("hi", F.max), ("lo", F.min))))
    span = F.nullif(F.col("hi.level") - F.col("lo.level"), F.lit(0.0))
    return ends.select(F.round((F.col("hi.recall") - F.col("lo.recall")) / span / 100, 3).alias("recall_lost_per_coverage_point"))


def retrofit(case: DataFrame, slope: DataFrame, n_stations: DataFrame, plan=SENSORS) -> DataFrame:
    """Per sensor item its cost, the coverage it adds and what the recall regained is worth."""
    spark = case.sparkSession
    items = spark.createDataFrame([(name, len(at), float(len(at) * unit)) for name, at, unit in plan], "item string, station_count bigint, total_cost_usd double")
    d = items.crossJoin(F.broadcast(case.select("net_usd"))).crossJoin(F.broadcast(slope)).crossJoin(F.broadcast(n_stations))  # one row each
    gain = F.col("station_count") / F.col("n_stations")
    value = F.nullif(F.col("net_usd") * F.col("recall_lost_per_coverage_point") * gain, F.lit(0.0))
    return d.select("item", "station_count", "total_cost_usd", F.round(gain, 6).alias("coverage_gain"), F.round(value).alias("annual_value_usd"), F.when(value > 0, F.round(F.col("total_cost_usd") / (value / 12), 1)).alias("payback_months"))


def peaks(scored: DataFrame, sigma: DataFrame, constraint: DataFrame, taus: DataFrame, parameters: list[str], lam: float) -> DataFrame:
    """(run, kind, peak) of lines without faults: per station its largest |EWMA| in the line's ``sigma`` (line, ewma_limit) and
    its largest CUSUM, per oven the largest |z| of its time constant.  As alarms latch, a limit raises one if and only if the
    peak is over it.  Lines of even number fit, odd ones validate."""
    e = S.ewma(scored, {f"_e_{p}": f"z_{p}" for p in parameters}, ["line", "station"], lam)
    ew = e.groupBy("line", "station").agg(F.max(F.greatest(*(F.abs(F.round(f"_e_{p}", 9)) for p in parameters))).alias("m")).join(F.broadcast(sigma), "line")  # a row per line
    parts = [
        ew.select("line", F.lit("ewma").alias("kind"), F.round(F.col("m") / F.col("ewma_limit"), 6).alias("peak")),
        constraint.groupBy("line", "station").agg(F.max("cusum_sigma").alias("peak")).select("line", F.lit("cusum").alias("kind"), "peak"),
        taus.groupBy("line", "oven").agg(F.max(F.abs("z")).alias("peak")).select("line", F.lit("tau").alias("kind"), "peak"),
    ]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("line", "run")


def _grid(start: float, step: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(F.lit(start) + i * step, 4))


def calibration(peaks: DataFrame, grids: dict[str, tuple[float, float, int]], share: float) -> DataFrame:
    """Per detector the lowest limit of its grid (start, step, points) at which the false alarms per run stay within ``share``
    on the fitting and on the validating runs; the grid's last value where none does."""
    parts = []
    for kind, (start, step, n) in grids.items():
        grid = _grid(start, step, n)
        runs = peaks.where(F.col("kind") == kind).withColumn("fit", F.col("run") % 2 == 0)
        size = runs.groupBy("kind").agg(F.countDistinct(F.when(F.col("fit"), F.col("run"))).alias("n_fit"), F.countDistinct(F.when(~F.col("fit"), F.col("run"))).alias("n_val"))
        over = runs.select("fit", F.explode(F.filter(grid, lambda x: F.col("peak") > x)).alias("limit")).groupBy("limit").agg(F.count_if("fit").alias("fit"), F.count_if(~F.col("fit")).alias("val"))
        limits = size.select("kind", "n_fit", "n_val", F.explode(grid).alias("limit")).join(over, "limit", "left").na.fill(0, ["fit", "val"])
        fit, val = F.col("fit") / F.greatest("n_fit", F.lit(1)), F.col("val") / F.greatest("n_val", F.lit(1))
        ok = (fit <= share) & (val <= share)
        best = F.coalesce(F.min(F.when(ok, F.col("limit"))), F.max("limit"))
        rates = [F.min_by(x, F.when(ok, F.col("limit")).otherwise(1e6 - F.col("limit"))) for x in (fit, val)]
        parts.append(limits.groupBy("kind").agg(best.alias("limit"), F.round(rates[0], 4).alias("fit_rate"), F.round(rates[1], 4).alias("validation_rate")))
    return reduce(DataFrame.unionByName, parts)
