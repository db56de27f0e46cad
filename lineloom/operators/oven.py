"""Oven model: temperature against dwell time, its regression on the surroundings, and the time constant's drift."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Oven, Thresholds
from ..functions import series as S

#: One line only: no column tells lines apart.
ALONE: list[str] = []


def oven_readings(line: DataFrame, o: Oven = Oven(), drift: tuple[int, int, float] = (240, 350, 55.0), size: int = 10, ambient_swing: float = 4.0, period: int = 120, per: list[str] = ALONE) -> DataFrame:
    """The adapted line's ovens: each ``size`` stations are the zones of one oven, with dwell times by zone.

    The temperature follows the model with the ambient's influence and, as
    noise, what discount and tax are off their middle; the time constant drifts
    linearly to ``drift[2]`` in the given vehicles at every oven of even number.
    ``per`` are the columns that tell lines apart, here and in what follows.
    """
    c = oven_columns(o, drift, size, ambient_swing, period)
    return line.where("instrumented").select(*per, "station", c["oven"].alias("oven"), "vehicle", *(c[x].alias(x) for x in ("dwell", "ambient", "temperature")))


def oven_columns(o: Oven = Oven(), drift: tuple[int, int, float] = (240, 350, 55.0), size: int = 10, ambient_swing: float = 4.0, period: int = 120) -> dict[str, Column]:
    """Oven, dwell, ambient and temperature of a wide row."""
    oven = F.floor((F.col("station") - 1) / size)
    dwell = o.dwell_base + o.dwell_step * ((F.col("station") - 1) % size)
    a, b, end = drift
    tau = F.when((oven % 2 == 0) & F.col("vehicle").between(a, b), o.tau + (end - o.tau) * (F.col("vehicle") - a) / (b - a)).otherwise(F.lit(o.tau))
    ambient = F.round(ambient_swing * F.sin(2 * 3.141592653589793 * F.col("vehicle") / period), 6)
    noise = (F.col("discount") - 0.05) * 10 + (F.col("tax") - 0.04) * 10
    temperature = F.round(predicted(dwell, tau, o) + 0.35 * ambient + noise, 4)
    return {"oven": oven, "dwell": dwell, "ambient": ambient, "temperature": temperature}


def with_ovens(line: DataFrame, o: Oven = Oven()) -> DataFrame:
    """Adds dwell, ambient and temperature to the rows of the ovens' shop (ovens of even number); null elsewhere and where nothing is read."""
    c = oven_columns(o)
    there = F.col("instrumented") & (c["oven"] % 2 == 0)
    return line.withColumns({x: F.when(there, c[x]) for x in ("dwell", "ambient", "temperature")})


def predicted(dwell: Column, tau: Column, o: Oven) -> Column:
    """Temperature after ``dwell`` seconds of first-order heating."""
    return o.ambient + (o.setpoint - o.ambient) * (1 - F.exp(-dwell / tau))


def thermal_regression(rd: DataFrame, th: Thresholds = Thresholds(), o: Oven = Oven(), least: int = 20, per: list[str] = ALONE) -> DataFrame:
    """Per station over the warm-up: the residual's slope on the ambient, intercept and spread; slope 0 if the ambient stands still."""
    n = F.max("vehicle").over(Window.partitionBy(*per, "station"))
    d = rd.withColumn("_n", n).where(F.col("vehicle") <= F.least(F.lit(th.warmup), F.greatest(F.lit(30), F.floor(F.col("_n") / 2))))
    d = d.withColumn("r", F.col("temperature") - predicted(F.col("dwell"), F.lit(o.tau), o))
    y, x = F.col("r"), F.col("ambient")
    g = d.groupBy(*per, "station").agg(
        F.count(F.lit(1)).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"), F.avg(y).alias("my"), F.avg(x).alias("mx"), F.stddev_pop(x).alias("sd")
    ).where(F.col("n") >= least)
    flat = F.col("sd") <= 1e-9
    slope = F.when(flat, 0.0).otherwise(F.col("sxy") / F.col("sxx"))
    left = F.when(flat, F.col("syy")).otherwise(F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")))
    sigma = F.greatest(F.sqrt(left / (F.col("n") - 1)), F.lit(1e-6))
    return g.select(*per, "station", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), sigma.alias("sigma"), "n")


def residuals(rd: DataFrame, fit: DataFrame, o: Oven = Oven(), per: list[str] = ALONE) -> DataFrame:
    """(station, vehicle, residual): standardised distance from model and regression; readings without a fit are left out."""
    d = rd.join(fit.drop("n"), [*per, "station"])  # a row per zone
    z = (F.col("temperature") - predicted(F.col("dwell"), F.lit(o.tau), o) - F.col("intercept") - F.col("slope") * F.col("ambient")) / F.col("sigma")
    return d.select(*per, "station", "vehicle", F.round(z, 3).alias("residual"))


#: Vehicles of an oven whose residuals stand in memory at once, for all candidates.
BLOCK = 512


def tau_fit(rd: DataFrame, o: Oven = Oven(), least: int = 6, per: list[str] = ALONE) -> DataFrame:
    """(oven, vehicle, tau): the time constant that fits the last ``window`` vehicles best, once there are that many.

    For each candidate a vehicle adds its number, sum and sum of squares of
    residuals; windows add vehicles, and the offset goes out with the mean.
    Readings are shuffled once by oven; candidates exist only inside a task.
    """
    step = (1.8 - 0.6) * o.tau / (o.grid - 1)
    grid = np.array([round(0.6 * o.tau + i * step, 6) for i in range(o.grid)])
    schema = rd.select(*per, "oven", "vehicle").schema.add("tau", "double")
    names, w, block, ambient, rise = schema.names, o.window, BLOCK, o.ambient, o.setpoint - o.ambient  # plain values: workers may lack the package

    def fit(key, readings):
        v, dwell, temperature = (readings[c].to_numpy() for c in ("vehicle", "dwell", "temperature"))
        order = np.lexsort((dwell, v))
        v, dwell, temperature = v[order], dwell[order], temperature[order].astype(float)
        vehicles, first = np.unique(v, return_index=True)
        ends = np.append(first, len(v))
        dwells, zone = np.unique(dwell, return_inverse=True)
        model = ambient + rise * (1 - np.exp(-dwells[:, None] / grid))
        at, best = [], []
        for a in range(0, len(vehicles) - w + 1, block):
            b = min(a + block + w - 1, len(vehicles))
            rows = slice(ends[a], ends[b])
            r = np.nan_to_num(np.round(temperature[rows, None] - model[zone[rows]], 6))
            starts = first[a:b] - first[a]
            sums = [np.diff(ends[a : b + 1])[:, None], np.add.reduceat(r, starts), np.add.reduceat(r * r, starts)]
            n, s, q = (sum(x[k : len(x) - w + 1 + k] for k in range(w)) for x in sums)
            ok = n[:, 0] >= least
            at.append(vehicles[a + w - 1 : b][ok])
            best.append(grid[np.argmin(np.round(q - s * s / n, 4), axis=1)][ok])
        at, best = np.concatenate([*at, vehicles[:0]]), np.concatenate([*best, grid[:0]])
        return pa.table([pa.array([k.as_py()] * len(at), k.type) for k in key] + [pa.array(at), pa.array(best)], names=names)

    return rd.select(*per, "oven", "vehicle", "dwell", "temperature").groupBy(*per, "oven").applyInArrow(fit, schema)


def tau_alarms(fits: DataFrame, th: Thresholds = Thresholds(), o: Oven = Oven(), least: tuple[int, int] = (40, 20), per: list[str] = ALONE) -> DataFrame:
    """Latched alarms where an oven's time constant is ``z_crit`` off its warm-up; ovens with too few fits raise none."""
    d = S.latch(tau_scores(fits, th, o, least, per), F.abs("z") >= o.z_crit, F.abs("z") < 0.5 * o.z_crit, [*per, "oven"])
    return d.where("fires").select(*per, "oven", "vehicle", F.lit("physics_thermal_violation").alias("type"), F.lit("alert").alias("severity"), F.round("tau", 4).alias("measured"), F.round(F.col("_m"), 4).alias("expected"), "z")


def tau_scores(fits: DataFrame, th: Thresholds = Thresholds(), o: Oven = Oven(), least: tuple[int, int] = (40, 20), per: list[str] = ALONE) -> DataFrame:
    """Fits with their distance ``z`` from the oven's warm-up, of ovens with enough of them."""
    whole = Window.partitionBy(*per, "oven")
    d = fits.withColumns({"_n": F.count(F.lit(1)).over(whole), "_max": F.max("vehicle").over(whole)})
    base = F.when(F.col("vehicle") <= F.least(F.lit(th.warmup), F.floor(F.col("_max") / 2)), F.col("tau"))
    d = d.withColumns({"_m": F.avg(base).over(whole), "_s": F.greatest(F.stddev_samp(base).over(whole), F.lit(1e-6)), "_b": F.count(base).over(whole)})
    return d.where((F.col("_n") >= least[0]) & (F.col("_b") >= least[1]) & (F.col("_max") >= 3 * o.window)).withColumn("z", F.round((F.col("tau") - F.col("_m")) / F.col("_s"), 4))


def tau_flags(alarms: DataFrame, size: int = 10) -> DataFrame:
    """``tau_alarms`` as alarm rows, under the first station of the oven."""
    text = F.format_string("time constant %.4f s, %.4f s in the warm-up; no single zone need be off", "measured", "expected")
    return alarms.select((F.col("oven") * size + 1).alias("station"), F.lit("oven_tau").alias("parameter"), "vehicle", "type", "severity", F.round("z", 3).alias("z"), text.alias("evidence"))
