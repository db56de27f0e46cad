"""Baselines, z-scores and the alarm detectors, over wide rows: one per station and vehicle, one column per parameter.

``lineloom.sources.adapters.line`` gives such rows in one shuffle by station;
nothing here shuffles them again (but the EWMA limit, a row per line, which reads
them a second time).  ``keys`` tell stations apart: with a line in front, many
lines go through the same windows in the same single shuffle.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import THERMAL, Oven, Thresholds
from ..functions import series as S
from ..sources.adapters import PARAMETERS, readings
from .oven import predicted

STATION = ["station"]


def early(th: Thresholds, floor: int = 30, share: int = 2, keys: list[str] = STATION) -> Column:
    """The warm-up prefix: min(warmup, max(floor, n div share)) vehicles of the station's n."""
    n = F.max("vehicle").over(Window.partitionBy(*keys))
    return F.col("vehicle") <= F.least(F.lit(th.warmup), F.greatest(F.lit(floor), F.floor(n / share)))


def baseline_cells(wide: DataFrame, th: Thresholds = Thresholds(), least: int = 12, parameters: list[str] = PARAMETERS) -> DataFrame:
    """mean, std and n per (station, parameter, variant) and, variant null, per (station, parameter), over the warm-up."""
    w = readings(wide.where("instrumented").withColumn("_early", early(th)).where("_early"), {"value": ""}, parameters)
    cells = w.groupingSets([["station", "parameter", "variant"], ["station", "parameter"]], "station", "parameter", "variant").agg(
        F.avg("value").alias("mean"), F.greatest(F.stddev_samp("value"), F.lit(1e-6)).alias("std"), F.count(F.lit(1)).alias("n"), F.grouping("variant").cast("int").alias("pooled")
    )
    return cells.where(F.col("n") >= least)


def score(
    wide: DataFrame, th: Thresholds = Thresholds(), enough: int = 36, least: int = 12, parameters: list[str] = PARAMETERS, spec: dict[str, tuple[float, float]] | None = None,
    keys: list[str] = STATION,
    manual: bool = False,
    models: dict[str, str] | None = None,
    oven: Oven = Oven(),
) -> DataFrame:
    """Adds z_<p> (3 decimals), source_<p> and n_<p> for each parameter: the reading against its variant's mean, shrunk toward
    the pooled one, and the pooled spread.

    A cell of fewer than ``least`` warm-up readings is replaced by the
    parameter's ``spec`` (mean, standard deviation) if it has one.  Without
    any, z is 0 and the source unavailable.  Stations without instruments go,
    or with ``manual`` stay with nulls.

    A parameter that ``models`` tags as thermal is scored by its distance from
    the oven model and the station's warm-up regression on the surroundings
    (columns dwell and ambient), in that regression's spread; it has no baseline
    size.  Where there are too few warm-up readings for one, it is scored as others are.
    """
    df = (wide if manual else wide.where("instrumented")).withColumn("_early", early(th, keys=keys)).withColumns({f"_w_{p}": F.when(F.col("_early"), F.col(p)) for p in parameters})
    cells = {}
    for name, by in (("c", [*keys, "variant"]), ("p", keys)):
        w = Window.partitionBy(*by)
        for p in parameters:
            v = F.col(f"_w_{p}")
            cells |= {f"_m{name}_{p}": F.avg(v).over(w), f"_s{name}_{p}": F.stddev_samp(v).over(w), f"_n{name}_{p}": F.count(v).over(w)}
    df = df.withColumns(cells)
    fits = {p: _thermal_fit(p, keys, oven) for p in parameters if (models or {}).get(p) == THERMAL}
    df = df.withColumns({f"_{c}_{p}": v for p, fit in fits.items() for c, v in fit.items()})
    out = {}
    for p in parameters:
        given = (spec or {}).get(p, (None, None))

        def cell(name: str, p=p, given=given) -> tuple[Column, Column, Column, Column]:
            n, some = F.col(f"_n{name}_{p}"), F.col(f"_n{name}_{p}") >= least
            mean = F.when(some, F.col(f"_m{name}_{p}")).otherwise(F.lit(given[0]).cast("double"))
            std = F.when(some, F.greatest(F.col(f"_s{name}_{p}"), F.lit(1e-6))).otherwise(F.lit(given[1]).cast("double"))
            return mean, std, F.when(some | F.lit(given[0] is not None), n), F.when(some, "empirical").when(F.lit(given[0] is not None), "spec_fallback")

        (cm, cs, cn, cw), (pm, ps, pn, pw) = cell("c"), cell("p")
        delta = cm - pm
        shrink = F.greatest(F.lit(0.0), 1 - (ps * ps / F.greatest(cn, F.lit(1))) / F.greatest(delta * delta, F.lit(1e-12)))
        mixed = cm.isNotNull() & pm.isNotNull() & (pn >= enough)
        mean = F.when(mixed, pm + delta * shrink).otherwise(F.coalesce(cm, pm))
        std = F.when(mixed, ps).otherwise(F.coalesce(cs, ps, F.lit(1.0)))
        there = F.col(p).isNotNull()
        out[f"z_{p}"] = F.when(there, F.when(mean.isNull(), F.lit(0.0)).otherwise(F.round((F.col(p) - mean) / std, 3)))
        out[f"source_{p}"] = F.when(there, F.when(mixed, F.concat(cw, F.lit("+shrunk_variant"))).otherwise(F.coalesce(cw, pw, F.lit("unavailable"))))
        out[f"n_{p}"] = F.when(there, F.when(mixed, pn).otherwise(F.coalesce(cn, pn, F.lit(0))))
        if p in fits:
            modelled = F.col(f"_tn_{p}") >= 20
            out[f"z_{p}"] = F.when(there & modelled, F.round((F.col(f"_off_{p}") - F.col(f"_intercept_{p}") - F.col(f"_slope_{p}") * F.col("ambient")) / F.col(f"_sigma_{p}"), 3)).otherwise(out[f"z_{p}"])
            out[f"source_{p}"] = F.when(there & modelled, "physics_model_residual").otherwise(out[f"source_{p}"])
            out[f"n_{p}"] = F.when(there & modelled, F.lit(0).cast("bigint")).otherwise(out[f"n_{p}"])
    return df.withColumns(out).drop("_early", *cells, *(f"_w_{p}" for p in parameters), *(f"_{c}_{p}" for p, fit in fits.items() for c in fit))


def _thermal_fit(p: str, keys: list[str], o: Oven) -> dict[str, Column]:
    """What the oven model leaves of a reading, and over the warm-up its regression on the ambient: slope 0 if that stands still."""
    w = Window.partitionBy(*keys)
    off = F.col(p) - predicted(F.col("dwell"), F.lit(o.tau), o)
    y, x = F.when(F.col("_early"), off), F.when(F.col("_early") & off.isNotNull(), F.col("ambient"))
    n, sxx, sxy, syy = F.count(y).over(w), F.regr_sxx(y, x).over(w), F.regr_sxy(y, x).over(w), F.regr_syy(y, x).over(w)
    flat = sxx / n <= 1e-18
    slope = F.when(flat, 0.0).otherwise(sxy / F.nullif(sxx, F.lit(0.0)))
    left = F.when(flat, syy).otherwise(F.greatest(F.lit(0.0), syy - sxy * sxy / F.nullif(sxx, F.lit(0.0))))
    return {"off": off, "tn": n, "slope": slope, "intercept": F.avg(y).over(w) - slope * F.avg(x).over(w), "sigma": F.greatest(F.sqrt(left / F.nullif(n - 1, F.lit(0))), F.lit(1e-6))}


def scored_readings(sc: DataFrame, parameters: list[str] = PARAMETERS) -> DataFrame:
    """The scored wide rows in long form."""
    return readings(sc, {"z": "z_", "baseline_source": "source_", "baseline_n": "n_"}, parameters)


def ewma_limit(sc: DataFrame, th: Thresholds, parameters: list[str] = PARAMETERS, per: list[str] = []) -> DataFrame:  # noqa: B006
    """The control limit from the median baseline size: one row, or one per line (``per``)."""
    sizes = sc.select(*per, F.explode(F.array(*(F.col(f"n_{p}") for p in parameters))).alias("n")).where("n is not null")
    n = F.greatest(F.floor(F.percentile(F.when(F.col("n") > 0, F.col("n")).otherwise(1), F.lit(0.5))), F.lit(1))
    return sizes.groupBy(*per).agg((th.ewma_l * F.sqrt(F.lit(th.lam / (2 - th.lam)) + 1.0 / n)).alias("ewma_limit"))


def _complete(df: DataFrame, parameters: list[str]) -> DataFrame:
    """Adds _full_<p>, the z of the vehicles that have all parameters their station has (``_has_<p>``)."""
    full = functools.reduce(Column.__and__, (F.col(f"z_{x}").isNotNull() | ~F.col(f"_has_{x}") for x in parameters))
    return df.withColumns({f"_full_{p}": F.when(full, F.col(f"z_{p}")) for p in parameters})


def _related(p: str, q: str, causal: bool = False, w=None) -> Column:
    """Correlation of two ``_full_`` columns over the vehicles (of a window) that have both; null where one stands still.

    What a station has is the same for its whole run, so there all complete
    vehicles have both; with ``causal`` one may come later than the other.
    """
    x, y = F.col(f"_full_{p}"), F.col(f"_full_{q}")
    if causal:
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    both, sx, sy = (f.over(w) if w is not None else f for f in (F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)))
    return both / F.nullif(sx * sy, F.lit(0.0))


def correlations(sc: DataFrame, parameters: list[str] = PARAMETERS) -> DataFrame:
    """(station, a, b, r): correlation of z between the parameters of a station."""
    pairs = list(itertools.combinations(sorted(parameters), 2))
    has = sc.withColumns({f"_has_{p}": F.count(f"z_{p}").over(Window.partitionBy("station")) > 0 for p in parameters})
    per = _complete(has, parameters).groupBy("station").agg(*(_related(p, q).alias(f"{p}|{q}") for p, q in pairs))
    rows = F.array(*(F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.round(f"{p}|{q}", 9).alias("r")) for p, q in pairs))
    return per.select("station", F.inline(rows)).where("r is not null")


RULES = ("point", "persistent", "trend")
FLAG = ["type", "severity", "parameter", "z", "evidence"]


def with_flags(sc: DataFrame, th: Thresholds, rules: tuple[str, ...] = (*RULES, "cross_parameter"), parameters: list[str] = PARAMETERS, keys: list[str] = STATION, causal: bool = False) -> DataFrame:
    """Adds ``flags``, the alarms that each row raises, as an array of (type, severity, parameter, z, evidence).

    * point: |z| over the alert limit, twice within three readings; closes under the green limit.
    * persistent: |EWMA| over its limit; closes under ``release`` of it.
    * trend: readings of one sign, each further out by ``trend_step``, ending far enough out.
    * cross_parameter: two correlated parameters abnormal at once; closes when none is.

    Each rule is a latch: an episode raises one alarm.  Correlations are those
    of the whole run; ``causal``, those of the vehicles so far, this one included.
    """
    w, k = S.by(keys), th.trend_window
    z = {p: F.col(f"z_{p}") for p in parameters}
    opens, alarms, raw, again = {}, [], {}, {}
    pairs = list(itertools.combinations(sorted(parameters), 2))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0 if causal else Window.unboundedFollowing)

    def alarm(fires: str, kind: str, severity: str, parameter: Column, value: Column, text: str, *args: Column) -> Column:
        return F.when(F.col(fires), F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), parameter.alias("parameter"), value.alias("z"), F.format_string(text, *args).alias("evidence")))

    # each window copies every column of its rows: all rules share two of one order, the first over scores, the second over what it gives
    if "point" in rules:
        raw |= {f"_beyond_{p}": F.sum((F.abs(v) >= th.alert).cast("int")).over(w.rowsBetween(-2, 0)) for p, v in z.items()}
    if "trend" in rules:
        raw |= {"_n": F.row_number().over(w)} | {f"_before_{p}": F.lag(v).over(w) for p, v in z.items()} | {f"_first_{p}": F.lag(v, k - 1).over(w) for p, v in z.items()}
    if "cross_parameter" in rules:
        raw |= {f"_has_{p}": F.count(v).over(so_far) > 0 for p, v in z.items()}
    df = sc.withColumns(raw)
    if "trend" in rules:
        df = df.withColumns({f"_d_{p}": F.round(F.abs(v) - F.abs(f"_before_{p}"), 6) for p, v in z.items()} | {f"_sign_{p}": F.signum(v) for p, v in z.items()}).drop(*(f"_before_{p}" for p in parameters))
        for name, f, c, start in (("lo", F.min, "sign", 1 - k), ("hi", F.max, "sign", 1 - k), ("least", F.min, "d", 2 - k)):
            again |= {f"_{name}_{p}": f(f"_{c}_{p}").over(w.rowsBetween(start, 0)) for p in parameters}
    if "cross_parameter" in rules:
        df = _complete(df, parameters)
        again |= {f"_r_{p}_{q}": F.round(_related(p, q, causal, so_far), 9) for p, q in pairs}
    df = df.withColumns(again).drop(*(c for c in df.columns if c not in sc.columns and c.startswith(("_d_", "_sign_", "_full_", "_has_"))))
    if "point" in rules:
        for p, v in z.items():
            opens[f"_point_{p}"] = ((F.abs(v) >= th.alert) & (F.col(f"_beyond_{p}") >= 2), F.abs(v) < th.green)
            alarms.append(alarm(f"_point_{p}", "point", "alert", F.lit(p), v, f"|z| %.3f, %d of the last 3 beyond {th.alert}", F.abs(v), F.col(f"_beyond_{p}")))
    if "persistent" in rules:
        df = S.ewma(df, {f"_e_{p}": f"z_{p}" for p in parameters}, keys, th.lam).withColumns({f"_e_{p}": F.round(f"_e_{p}", 9) for p in parameters})
        per = [k for k in keys if k != "station"]
        limit = F.broadcast(ewma_limit(sc, th, parameters, per))  # one row, or one per line
        df = df.join(limit, per) if per else df.crossJoin(limit)
        for p in parameters:
            e = F.abs(f"_e_{p}")
            opens[f"_persistent_{p}"] = (e > F.col("ewma_limit"), e < F.col("ewma_limit") * th.release)
            alarms.append(alarm(f"_persistent_{p}", "persistent", "alert", F.lit(p), F.round(f"_e_{p}", 3), "EWMA over %.6f", F.round("ewma_limit", 6)))
    if "trend" in rules:
        for p, v in z.items():
            rise = F.round(F.abs(v) - F.abs(f"_first_{p}"), 6)
            one_way = (F.col(f"_lo_{p}") == F.col(f"_hi_{p}")) & (v != 0)
            opens[f"_trend_{p}"] = (
                (F.col("_n") >= k) & one_way & (F.col(f"_least_{p}") > th.trend_step) & (F.abs(v) >= th.trend_last) & (rise >= th.trend_rise),
                (F.abs(v) < th.green) & (F.col("_n") >= k),
            )
            alarms.append(alarm(f"_trend_{p}", "trend", "warning", F.lit(p), v, f"|z| rose by %.3f over {k} readings", rise))
    if "cross_parameter" in rules:
        abnormal = F.array_compact(F.array(*(F.when(F.abs(z[p]) >= th.cross_z, F.lit(p)) for p in sorted(parameters))))
        some = functools.reduce(Column.__or__, (F.coalesce(F.abs(v) >= th.cross_z, F.lit(False)) for v in z.values()))
        linked = F.lit(False)
        for p, q in pairs:
            linked |= (F.abs(z[p]) >= th.cross_z) & (F.abs(z[q]) >= th.cross_z) & (F.abs(f"_r_{p}_{q}") >= th.cross_corr)
        opens["_cross"] = (F.coalesce(linked, F.lit(False)), ~some)
        alarms.append(alarm("_cross", "cross_parameter", "alert", F.array_join(abnormal, " + "), F.lit(None).cast("double"), "%d correlated parameters abnormal", F.size(abnormal)))
    df = S.latches(df, opens, keys)
    helpers = [c for c in df.columns if c.startswith("_") and c not in sc.columns]
    # few rows raise an alarm, and filtering an array is slow: the others get an empty one
    fired = functools.reduce(Column.__or__, (F.col(name) for name in opens))
    raised = F.array_compact(F.array(*alarms))
    return df.withColumn("flags", F.when(fired, raised).otherwise(F.slice(F.array(alarms[0]), 1, 0))).drop("ewma_limit", *helpers)


def flags(flagged: DataFrame, keys: list[str] = STATION) -> DataFrame:
    """The alarms as rows."""
    return flagged.where(F.size("flags") > 0).select(*keys, "vehicle", F.inline("flags")).select(*keys, "parameter", "vehicle", "type", "severity", "z", "evidence")


def constraint_series(ops: DataFrame, th: Thresholds, keys: list[str] = STATION) -> DataFrame:
    """Every operation of stations with enough of them: CUSUM of cycle time in sigmas, slope's t, queue's z."""
    k = keys
    whole = Window.partitionBy(*keys)
    d = ops.withColumn("rn", S.seq(k)).withColumn("n", F.count(F.lit(1)).over(whole))
    d = d.withColumn("n_warm", F.least(F.lit(th.warmup), F.greatest(F.lit(20), F.floor(F.col("n") / 3)))).where(F.col("n") >= F.greatest(F.lit(th.slope_window), F.col("n_warm")) + 5)
    warm = F.col("rn") <= F.col("n_warm")
    stats = {}
    for name, col in (("c", "cycle_time"), ("q", "queue")):
        x = F.when(warm, F.col(col))
        stats |= {f"mu_{name}": F.avg(x).over(whole), f"sd_{name}": F.greatest(F.stddev_samp(x).over(whole), F.lit(1e-6))}
    d = S.rolling_t(d.withColumns(stats), "cycle_time", k, th.slope_window)
    step = F.when(warm, F.lit(0.0)).otherwise(F.col("cycle_time") - F.col("mu_c") - th.cusum_k * F.col("sd_c"))
    d = S.cusum(d, step, k)
    return d.withColumn("cusum_sigma", F.round(F.col("cusum") / F.col("sd_c"), 6)).withColumn("queue_z", F.round((F.col("queue") - F.col("mu_q")) / F.col("sd_q"), 6)).withColumn("slope_t", F.round("slope_t", 6))


def bottlenecks(ops: DataFrame, th: Thresholds, keys: list[str] = STATION) -> DataFrame:
    """Confirmed constraints: CUSUM of cycle time over its limit with a rising slope or a long queue; latched per station."""
    warm = F.col("rn") <= F.col("n_warm")
    d = constraint_series(ops, th, keys)
    opens = ~warm & (F.col("cusum_sigma") > th.cusum_h) & F.col("slope_t").isNotNull() & ((F.col("slope_t") >= th.slope_t) | (F.col("queue_z") >= th.queue_z))
    d = S.latch(d, opens, ~warm & (F.col("cusum_sigma") < th.cusum_h * th.release), keys)
    text = f"CUSUM %.6f sigma over limit {th.cusum_h}; slope t=%.6f (crit {th.slope_t}); queue z=%.6f"
    return d.where("fires").select(
        *keys, "vehicle", F.col("vehicle").alias("detected_at"), "cycle_time", F.round("mu_c", 2).alias("baseline_cycle"), F.round("cusum_sigma", 4).alias("cusum"),
        F.round("slope_t", 4).alias("slope_t"), F.round("queue_z", 4).alias("queue_z"), F.format_string(text, "cusum_sigma", "slope_t", "queue_z").alias("evidence"),
    )


def starving(bots: DataFrame, stations: DataFrame) -> DataFrame:
    """Constraints with the station that starves behind them, as an array (empty at the line's end)."""
    d = bots.join(stations.select("station", "downstream"), "station", "left")
    return d.withColumn("starving_downstream", F.array_compact(F.array("downstream"))).drop("downstream")
