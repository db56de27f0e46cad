"""All alarm rules on streams: scored operations by station, oven temperatures by oven, alarm for alarm as in the batch.

Rows may arrive in any order within the watermark's delay.  They wait in list
state until the watermark has passed them; a timer at the earliest one then
hands over all that are due, in order and as arrays.  What a rule needs of the
past (a few last rows, sums, latches) is one small array per key.  What the
batch takes from the warm-up (EWMA limit, means and spreads) is frozen
beforehand; correlations run along, as in the batch's causal variant.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import config
from ..config import Oven, Thresholds
from ..sources.adapters import PARAMETERS
from ..sources.staging import fresh_path

OUT = "key bigint, parameter string, vehicle bigint, type string, z double"
#: Vehicles by which rows may be late (a vehicle is a minute).
DELAY = 30
# the worker that prepares a stream finds no shipped package: processors travel whole
for _module in (sys.modules[__name__], config):
    cloudpickle.register_pickle_by_value(_module)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rolling(x: np.ndarray, width: int) -> np.ndarray:
    """Windows of the last ``width`` rows of each row but the first ``width - 1``."""
    return np.lib.stride_tricks.sliding_window_view(x, width, axis=0)


def latch(opens: np.ndarray, closes: np.ndarray, is_open: bool) -> tuple[np.ndarray, bool]:
    """Where a flip-flop opens, and its state after the last row; set wins over reset."""
    mark = np.where(opens, 1, np.where(closes, 0, -1))
    at = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    state = np.where(at >= 0, mark[np.maximum(at, 0)], int(is_open))
    before = np.concatenate([[int(is_open)], state[:-1]])
    return (mark == 1) & (before == 0), bool(state[-1]) if len(state) else is_open


class Waiting(StatefulProcessor):
    """Keeps rows until the watermark has passed them, then gives them to ``due`` in order of vehicles."""

    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = "vehicle bigint, at bigint, x array<double>"
        self.pending = handle.getListState("pending", fields)
        self.past = handle.getValueState("past", "last bigint, x array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for d in rows:
            at = d["at"].astype("datetime64[ms]").astype("int64")
            values = d[self.columns].to_numpy(float)
            fresh += [(int(v), int(t), x.tolist()) for v, t, x in zip(d["vehicle"], at, values, strict=True)]
        if fresh:
            self.pending.appendList(fresh)
            self.handle.registerTimer(min(t for _, t, _ in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.pending.get())
        ready, later = ([r for r in held if (r[1] <= now) == due] for due in (True, False))
        if not ready:
            return
        self.pending.clear()
        if later:
            self.pending.put([tuple(r) for r in later])
            self.handle.registerTimer(min(r[1] for r in later))
        last, carried = self.past.get() if self.past.exists() else (-1, None)
        # a delivery that comes twice counts once
        due = sorted({(r[0], tuple(r[2])) for r in ready if r[0] > last}, key=lambda r: r[0])
        if due:
            vehicle, x = np.array([r[0] for r in due]), np.array([[np.nan if v is None else v for v in r[1]] for r in due])
            found, carried = self.due(vehicle, x, None if carried is None else np.array([np.nan if v is None else v for v in carried]))
            self.past.update((int(vehicle[-1]), [None if v != v else float(v) for v in carried]))
            if found:
                yield pd.DataFrame([(key[0], *f) for f in found], columns=["key", "parameter", "vehicle", "type", "z"])

    def due(self, vehicle: np.ndarray, x: np.ndarray, past: np.ndarray | None) -> tuple[list[tuple], np.ndarray]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class StationAlarms(Waiting):
    """The point, persistent, trend and cross-parameter rules and the constraint detector of one station."""

    def __init__(self, limit: float, th: Thresholds, parameters: list[str]):
        self.limit, self.th, self.names = limit, th, parameters
        self.columns = [*(f"z_{p}" for p in parameters), "cycle_time", "queue", "n_warm", "mu_c", "sd_c", "mu_q", "sd_q"]
        self.pairs = list(itertools.combinations(range(len(parameters)), 2))

    def due(self, vehicle, x, past):
        th, k, n = self.th, len(self.names), len(vehicle)
        keep = max(th.trend_window, th.slope_window) - 1  # rows that the windows look back on
        sizes = {"tail": keep * (k + 1), "seen": 1, "ewma": k, "open": 3 * k + 2, "cusum": 1, "moments": 1 + 2 * k + len(self.pairs)}
        cuts = np.cumsum([0, *sizes.values()])
        past = np.concatenate([np.full(sizes["tail"], np.nan), np.zeros(cuts[-1] - sizes["tail"])]) if past is None else past
        old = {name: past[a:z] for name, a, z in zip(sizes, cuts[:-1], cuts[1:], strict=True)}
        z, cycle, queue = x[:, :k], x[:, k], x[:, k + 1]
        before = int(old["seen"][0])
        tail = old["tail"].reshape(keep, k + 1)
        long = np.vstack([tail, np.column_stack([z, cycle])])
        now = {"tail": long[-keep:].ravel(), "seen": np.array([before + n]), "open": old["open"].copy()}
        found, far = [], np.abs(z) >= th.alert
        size = np.abs(long[:, :k])
        place = before + 1 + np.arange(n)

        def fire(rule: int, name: str, kind: str, opens: np.ndarray, closes: np.ndarray, value: np.ndarray) -> None:
            fires, now["open"][rule] = latch(opens, closes, bool(old["open"][rule]))
            found.extend((name, int(vehicle[i]), kind, float(value[i])) for i in np.flatnonzero(fires))

        with np.errstate(invalid="ignore", divide="ignore"):
            beyond = rolling(np.vstack([size[keep - 2 : keep] >= th.alert, far]), 3).sum(axis=2)
            ewma = np.empty((n, k))
            e = old["ewma"]
            for i in range(n):  # all parameters at once
                e = np.where(np.isnan(z[i]), e * (1 - th.lam), th.lam * z[i] + (1 - th.lam) * e)
                ewma[i] = e
            now["ewma"] = e
            level = np.abs(np.round(ewma, 9))
            w = th.trend_window
            recent, signs = rolling(size[keep + 1 - w :], w), np.sign(rolling(long[keep + 1 - w :, :k], w))
            rise = np.round(recent[:, :, -1] - recent[:, :, 0], 6)
            steps = np.round(np.diff(recent, axis=2), 6).min(axis=2)
            one_way = (signs.min(axis=2) == signs.max(axis=2)) & (z != 0)
            for j, name in enumerate(self.names):
                fire(j, name, "point", far[:, j] & (beyond[:, j] >= 2), np.abs(z[:, j]) < th.green, z[:, j])
                fire(k + j, name, "persistent", level[:, j] > self.limit, level[:, j] < self.limit * th.release, np.round(ewma[:, j], 3))
                full = place >= w
                fire(2 * k + j, name, "trend", full & one_way[:, j] & (steps[:, j] > th.trend_step) & (np.abs(z[:, j]) >= th.trend_last) & (rise[:, j] >= th.trend_rise), full & (np.abs(z[:, j]) < th.green), z[:, j])
            found += self.cross(vehicle, z, old, now)
            found += self.constraint(vehicle, x[:, k + 2 :], long[:, k], queue, place, old, now)
        return sorted(found, key=lambda f: (f[1], f[2], f[0])), np.concatenate([now[name] for name in sizes])

    def cross(self, vehicle, z, old, now):
        """Two correlated parameters abnormal at once, by the correlation of all vehicles so far."""
        th, k = self.th, z.shape[1]
        has = ~np.isnan(z).all(axis=0) | (old["moments"][1 : 1 + k] != 0)
        whole = ~np.isnan(z[:, has]).any(axis=1) if has.any() else np.zeros(len(z), bool)
        v = np.where(whole[:, None] & has, z, 0.0)
        terms = np.column_stack([whole.astype(float), v, v * v, *(v[:, a] * v[:, b] for a, b in self.pairs)])
        sums = old["moments"] + np.cumsum(terms, axis=0)
        now["moments"] = sums[-1]
        n, total, square, product = sums[:, 0], sums[:, 1 : 1 + k], sums[:, 1 + k : 1 + 2 * k], sums[:, 1 + 2 * k :]
        spread = square - total**2 / n[:, None]
        off = np.abs(z) >= th.cross_z
        linked = np.zeros(len(z), bool)
        for i, (a, b) in enumerate(self.pairs):
            r = np.round((product[:, i] - total[:, a] * total[:, b] / n) / np.sqrt(spread[:, a] * spread[:, b]), 9)
            linked |= off[:, a] & off[:, b] & np.isfinite(r) & (n > 1) & (np.abs(r) >= th.cross_corr)
        fires, now["open"][3 * k] = latch(linked, ~off.any(axis=1), bool(old["open"][3 * k]))
        by_name = sorted(range(k), key=lambda j: self.names[j])
        return [(" + ".join(self.names[j] for j in by_name if off[i, j]), int(vehicle[i]), "cross_parameter", None) for i in np.flatnonzero(fires)]

    def constraint(self, vehicle, warm, cycle, queue, place, old, now):
        """CUSUM of the cycle time over its limit, with a rising slope or a long queue."""
        th, k = self.th, len(self.names)
        n_warm, mu_c, sd_c, mu_q, sd_q = warm[-1]
        now["cusum"] = old["cusum"]
        if np.isnan(mu_c):  # a station with too few vehicles
            return []
        w, early = th.slope_window, place <= n_warm
        step = np.where(early, 0.0, cycle[-len(place) :] - mu_c - th.cusum_k * sd_c)
        c = old["cusum"][0] + np.cumsum(step)
        s = c - np.minimum(0, np.minimum.accumulate(c))
        now["cusum"] = s[-1:]
        sigma, queue_z = np.round(s / sd_c, 6), np.round((queue - mu_q) / sd_q, 6)
        y = rolling(cycle[-(len(place) + w - 1) :], w)
        x = np.arange(w) - (w - 1) / 2
        sxx, my = (x * x).sum(), y.mean(axis=1, keepdims=True)
        sxy, syy = ((y - my) * x).sum(axis=1), ((y - my) ** 2).sum(axis=1)
        se = np.maximum(np.sqrt(np.maximum(0, syy - sxy**2 / sxx) / (w - 2)) / np.sqrt(sxx), 1e-9)
        t = np.where(place >= w, np.round(sxy / sxx / se, 6), np.nan)
        opens = ~early & (sigma > th.cusum_h) & ~np.isnan(t) & ((t >= th.slope_t) | (queue_z >= th.queue_z))
        fires, now["open"][3 * k + 1] = latch(opens, ~early & (sigma < th.cusum_h * th.release), bool(old["open"][3 * k + 1]))
        return [("cycle_time", int(vehicle[i]), "bottleneck", float(np.round(sigma[i], 4))) for i in np.flatnonzero(fires)]


class OvenAlarms(Waiting):
    """Drift of an oven's time constant; a row holds a vehicle's zones (dwell and temperature in turn)."""

    def __init__(self, o: Oven, zones: int):
        self.o, self.zones = o, zones
        self.columns = [*(f"{c}_{i}" for i in range(zones) for c in ("dwell", "temperature")), "mean", "spread"]

    def due(self, vehicle, x, past):
        o, width = self.o, 2 * self.zones
        keep = o.window - 1
        past = np.concatenate([np.full(keep * width, np.nan), [0.0, 0.0]]) if past is None else past
        rows = np.vstack([past[:-2].reshape(keep, width), x[:, :width]])
        before, is_open = int(past[-2]), bool(past[-1])
        grid = np.round(0.6 * o.tau + np.arange(o.grid) * ((1.8 - 0.6) * o.tau / (o.grid - 1)), 6)
        dwell, heat = rows[:, 0::2, None], rows[:, 1::2, None]
        off = np.round(heat - (o.ambient + (o.setpoint - o.ambient) * (1 - np.exp(-dwell / grid))), 6)
        there = ~np.isnan(off)
        off = np.where(there, off, 0.0)
        n, s, q = (rolling(v.sum(axis=1), o.window).sum(axis=2) for v in (there.astype(float), off, off * off))
        with np.errstate(invalid="ignore", divide="ignore"):
            sse = np.round(q - s * s / n, 4)
        full = (before + 1 + np.arange(len(vehicle)) >= o.window) & (n[:, 0] >= 6)
        tau = np.where(full, grid[np.argmin(np.where(np.isnan(sse), np.inf, sse), axis=1)], np.nan)
        mean, spread = x[-1, width:]
        found = []
        if not np.isnan(mean):
            z = np.round((tau - mean) / spread, 4)
            with np.errstate(invalid="ignore"):
                fires, is_open = latch(np.abs(z) >= o.z_crit, np.abs(z) < 0.5 * o.z_crit, is_open)
            found = [("oven_tau", int(vehicle[i]), "physics_thermal_violation", float(z[i])) for i in np.flatnonzero(fires)]
        return found, np.concatenate([rows[-keep:].ravel(), [before + len(vehicle), float(is_open)]])


def clock(vehicle):
    """A vehicle's event time: a minute each."""
    return F.timestamp_seconds(F.lit(1767592800) + 60 * vehicle)


def watched(rows: DataFrame, processor: Waiting) -> DataFrame:
    """Alarms of a stream of (key, vehicle, at, the processor's columns)."""
    late = rows.withWatermark("at", f"{DELAY} minutes")
    return late.groupBy("key").transformWithStateInPandas(processor, OUT, "append", "eventtime")


def replay(rows: DataFrame, processor: Waiting, deliveries: list[DataFrame] | None = None, cut: int = 150, jitter: int = 25) -> tuple[DataFrame, int]:
    """Sends rows through the stream in shuffled deliveries, each by a query that starts anew from the checkpoint; (alarms, rows that came too late).

    A row may come up to ``jitter`` vehicles after its turn.  A last delivery
    of a key of its own closes the stream.
    """
    spark = rows.sparkSession
    source, sink, state = (fresh_path(spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    wide = rows.select("key", "vehicle", clock(F.col("vehicle")).alias("at"), *(F.col(c).cast("double").alias(c) for c in processor.columns))
    if deliveries is None:
        turn = F.floor((F.col("vehicle") + F.pmod(F.col("key") * 7 + F.col("vehicle") * 13, F.lit(jitter))) / cut)
        most = rows.agg(F.max("vehicle")).first()[0]
        deliveries = [wide.where(turn == i) for i in range((most + jitter) // cut + 1)] if most is not None else []
    else:
        deliveries = [d.select(wide.columns) for d in deliveries]
    far = spark.range(1).select(F.lit(-1).cast("bigint").alias("key"), F.lit(10_000_000).cast("bigint").alias("vehicle"), clock(F.lit(10_000_000).cast("bigint")).alias("at"), *(F.lit(None).cast("double").alias(c) for c in processor.columns))
    late, given = 0, spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for part in [*deliveries, far]:
            part.write.mode("append").parquet(source)
            stream = watched(spark.readStream.schema(wide.schema).parquet(source), processor).where("key >= 0")
            query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
            query.awaitTermination()
            late += sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    finally:
        spark.conf.unset(PROVIDER) if given is None else spark.conf.set(PROVIDER, given)
    return spark.read.schema(OUT).parquet(sink), late


def station_rows(scored: DataFrame, constraint: DataFrame, parameters: list[str] = PARAMETERS) -> DataFrame:
    """Scored operations with what the constraint detector takes from the warm-up; ``constraint`` is its series."""
    warm = constraint.groupBy("station").agg(*(F.first(c).alias(c) for c in ("n_warm", "mu_c", "sd_c", "mu_q", "sd_q")))
    return scored.join(warm, "station", "left").select(F.col("station").alias("key"), "vehicle", *(f"z_{p}" for p in parameters), "cycle_time", "queue", "n_warm", "mu_c", "sd_c", "mu_q", "sd_q")


def oven_rows(readings: DataFrame, fits: DataFrame, th: Thresholds, zones: int, least: tuple[int, int] = (40, 20), o: Oven = Oven()) -> DataFrame:
    """A row per oven and vehicle with its zones side by side, and the warm-up's mean and spread of the time constant."""
    per = fits.groupBy("oven").agg(F.count(F.lit(1)).alias("n"), F.max("vehicle").alias("most"))
    base = F.when(F.col("vehicle") <= F.least(F.lit(th.warmup), F.floor(F.col("most") / 2)), F.col("tau"))
    warm = fits.join(per, "oven").groupBy("oven", "n", "most").agg(F.avg(base).alias("mean"), F.greatest(F.stddev_samp(base), F.lit(1e-6)).alias("spread"), F.count(base).alias("b"))
    warm = warm.where((F.col("n") >= least[0]) & (F.col("b") >= least[1]) & (F.col("most") >= 3 * o.window)).select("oven", "mean", "spread")
    listed = readings.groupBy("oven", "vehicle").agg(F.array_sort(F.collect_list(F.struct("dwell", "temperature"))).alias("zs"))  # an oven's zones: a handful
    side = [F.try_element_at("zs", F.lit(i + 1))[c].alias(f"{c}_{i}") for i in range(zones) for c in ("dwell", "temperature")]
    return listed.join(warm, "oven", "left").select(F.col("oven").alias("key"), "vehicle", *side, "mean", "spread")
