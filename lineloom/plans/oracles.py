"""Independent SQL for every line-analytics query."""

from ..config import ADAPTED as T
from ..config import INJECTIONS

_INJ = ", ".join(
    f"('{i}', '{k}', {s}, {p}, CAST({'NULL' if a is None else a} AS BIGINT), CAST({'NULL' if b is None else b} AS BIGINT), CAST({'NULL' if v is None else v} AS BIGINT[]), {z})" for i, k, s, p, a, b, v, z in INJECTIONS
)
_COLS = "id, kind, station, parameters, start, stop, vehicles, size"
INJ = f"inj AS (SELECT *, coalesce(start, list_min(vehicles)) AS first, coalesce(stop, list_max(vehicles)) AS last FROM (VALUES {_INJ}) v({_COLS}))"
MANUAL = "station % 3 <> 0"

OPS = """ops AS (
  SELECT l_suppkey AS station, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS vehicle,
         l_linestatus AS variant, l_quantity AS cycle_time, CAST(l_linenumber AS BIGINT) AS queue, round(100 * (1 - l_discount), 6) AS utilization, o_orderpriority AS operator,
         CASE l_returnflag WHEN 'R' THEN 'fail' WHEN 'A' THEN 'rework' ELSE 'pass' END AS manual_outcome,
         l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
opsl AS (SELECT *, (vehicle - 1) // 30 AS supplier_lot FROM ops),
rd0 AS (SELECT station, vehicle, variant, supplier_lot, unnest(['quantity', 'extendedprice', 'discount', 'tax']) AS parameter, unnest([quantity, extendedprice, discount, tax]) AS value FROM opsl WHERE """ + MANUAL + """)"""

FAULTY = OPS + f""",
{INJ},
sd AS (SELECT station, parameter, stddev_samp(value) AS sd FROM rd0 GROUP BY ALL),
rd AS (
  SELECT r.station, vehicle, variant, supplier_lot, r.parameter,
         value + CASE WHEN i.id IS NULL THEN 0 WHEN kind = 'trend' THEN size * (vehicle - start) * sd ELSE size * sd END AS value, i.id AS fault
  FROM rd0 r JOIN sd USING (station, parameter)
  LEFT JOIN inj i ON i.kind <> 'bottleneck' AND i.station = r.station AND list_contains(parameters, r.parameter) AND (list_contains(vehicles, vehicle) OR vehicle BETWEEN start AND stop))"""

CELLS = FAULTY + f""",
wm AS (SELECT *, max(vehicle) OVER (PARTITION BY station) AS nmax FROM rd),
cells AS (
  SELECT station, parameter, variant, avg(value) AS mean, greatest(stddev_samp(value), 1e-6) AS std, count(*) AS n, grouping(variant) AS pooled
  FROM wm WHERE vehicle <= least({T.warmup}, greatest(30, nmax // 2)) GROUP BY GROUPING SETS ((station, parameter, variant), (station, parameter)) HAVING count(*) >= 12)"""

OVEN = f""",
ov AS (
  SELECT station, (station - 1) // 10 AS oven, vehicle, 25.0 + 19.0 * ((station - 1) % 10) AS dwell, round(4.0 * sin(2 * 3.141592653589793 * vehicle / 120), 6) AS ambient, discount, tax,
         CASE WHEN (station - 1) // 10 % 2 = 0 AND vehicle BETWEEN 240 AND 350 THEN 42.0 + (55.0 - 42.0) * (vehicle - 240) / 110 ELSE 42.0 END AS tau FROM opsl WHERE {MANUAL}),
ort AS (SELECT *, round(25.0 + 153.0 * (1 - exp(-dwell / tau)) + 0.35 * ambient + ((discount - 0.05) * 10 + (tax - 0.04) * 10), 4) AS temperature FROM ov),
ow AS (SELECT *, temperature - (25.0 + 153.0 * (1 - exp(-dwell / 42.0))) AS r, max(vehicle) OVER (PARTITION BY station) AS nv FROM ort),
og AS (
  SELECT station, count(*) AS n, regr_sxx(r, ambient) AS sxx, regr_sxy(r, ambient) AS sxy, regr_syy(r, ambient) AS syy, avg(r) AS my, avg(ambient) AS mx FROM ow
  WHERE vehicle <= least({T.warmup}, greatest(30, nv // 2)) GROUP BY station HAVING count(*) >= 20),
ofit AS (SELECT station, sxy / sxx AS slope, my - sxy / sxx * mx AS intercept, greatest(sqrt(greatest(0, syy - sxy * sxy / sxx) / (n - 1)), 1e-6) AS sigma, n FROM og),
ores AS (SELECT station, vehicle, round((r - intercept - slope * ambient) / sigma, 3) AS residual FROM ow JOIN ofit USING (station))"""
SCORED = CELLS + OVEN + """,
sc0 AS (
  SELECT r.*, c.mean AS cm, c.std AS cs, c.n AS cn, p.mean AS pm, p.std AS ps, p.n AS pn,
         c.mean IS NOT NULL AND p.mean IS NOT NULL AND p.n >= 36 AS mixed
  FROM rd r LEFT JOIN cells c ON c.pooled = 0 AND c.station = r.station AND c.parameter = r.parameter AND c.variant = r.variant
  LEFT JOIN cells p ON p.pooled = 1 AND p.station = r.station AND p.parameter = r.parameter),
sc AS (
  SELECT station, vehicle, variant, supplier_lot, parameter, value, fault,
         CASE WHEN mixed THEN round((value - (pm + (cm - pm) * greatest(0, 1 - (ps * ps / greatest(cn, 1)) / greatest((cm - pm) * (cm - pm), 1e-12)))) / ps, 3)
              WHEN coalesce(cm, pm) IS NULL THEN 0 ELSE round((value - coalesce(cm, pm)) / coalesce(cs, ps), 3) END AS z,
         CASE WHEN mixed THEN 'empirical+shrunk_variant' WHEN coalesce(cm, pm) IS NOT NULL THEN 'empirical' ELSE 'unavailable' END AS baseline_source,
         CASE WHEN mixed THEN pn ELSE coalesce(cn, pn, 0) END AS baseline_n FROM sc0
  UNION ALL SELECT station, vehicle, variant, supplier_lot, 'temperature', temperature, NULL, residual, 'physics_model_residual', 0 FROM ores JOIN ort USING (station, vehicle) JOIN opsl USING (station, vehicle) WHERE oven % 2 = 0)"""


def latched(src: str, opens: str, closes: str, key: str = "station, parameter") -> str:
    return f"""SELECT * FROM (
    SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY vehicle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
    FROM (SELECT *, CASE WHEN {opens} THEN 1 WHEN {closes} THEN 0 END AS mark FROM {src})) WHERE mark = 1 AND coalesce(prev, 0) = 0"""


POINT = f""",
pt AS (SELECT *, sum(CASE WHEN abs(z) >= {T.alert} THEN 1 ELSE 0 END) OVER (PARTITION BY station, parameter ORDER BY vehicle ROWS 2 PRECEDING) AS nb FROM sc),
point AS ({latched("pt", f"abs(z) >= {T.alert} AND nb >= 2", f"abs(z) < {T.green}")}),
f_point AS (SELECT station, parameter, vehicle, 'point' AS type, 'alert' AS severity, z, printf('|z| %.3f, %d of the last 3 beyond {T.alert}', abs(z), CAST(nb AS BIGINT)) AS evidence FROM point)"""
EWMA = f""",
ew AS (
  SELECT a.station, a.parameter, a.vehicle, round(sum({T.lam} * pow(1 - {T.lam}, a.vehicle - b.vehicle) * b.z), 9) AS e
  FROM sc a JOIN sc b ON a.station = b.station AND a.parameter = b.parameter AND b.vehicle BETWEEN a.vehicle - 170 AND a.vehicle GROUP BY ALL)"""
PERSIST = EWMA + f""",
lim AS (SELECT {T.ewma_l} * sqrt({T.lam} / (2 - {T.lam}) + 1.0 / greatest(floor(quantile_cont(CASE WHEN baseline_n > 0 THEN baseline_n ELSE 1 END, 0.5)), 1)) AS lim FROM sc),
el AS (SELECT * FROM ew, lim),
pers AS ({latched("el", "abs(e) > lim", f"abs(e) < lim * {T.release}")}),
f_pers AS (SELECT station, parameter, vehicle, 'persistent' AS type, 'alert' AS severity, round(e, 3) AS z, printf('EWMA over %.6f', round(lim, 6)) AS evidence FROM pers)"""
TREND = f""",
tr0 AS (
  SELECT *, row_number() OVER w AS rn, round(abs(z) - abs(lag(z) OVER w), 6) AS d, abs(lag(z, {T.trend_window - 1}) OVER w) AS z0 FROM sc WINDOW w AS (PARTITION BY station, parameter ORDER BY vehicle)),
tr AS (
  SELECT *, min(sign(z)) OVER (PARTITION BY station, parameter ORDER BY vehicle ROWS {T.trend_window - 1} PRECEDING) AS s0, max(sign(z)) OVER (PARTITION BY station, parameter ORDER BY vehicle ROWS {T.trend_window - 1} PRECEDING) AS s1,
         min(d) OVER (PARTITION BY station, parameter ORDER BY vehicle ROWS {T.trend_window - 2} PRECEDING) AS dmin FROM tr0),
trend AS ({latched("tr", f"rn >= {T.trend_window} AND s0 = s1 AND z <> 0 AND dmin > {T.trend_step} AND abs(z) >= {T.trend_last} AND round(abs(z) - z0, 6) >= {T.trend_rise}", f"abs(z) < {T.green} AND rn >= {T.trend_window}")}),
f_trend AS (SELECT station, parameter, vehicle, 'trend' AS type, 'warning' AS severity, z, printf('|z| rose by %.3f over {T.trend_window} readings', round(abs(z) - z0, 6)) AS evidence FROM trend)"""
CROSS = f""",
np AS (SELECT station, count(DISTINCT parameter) AS k FROM sc GROUP BY station),
fullv AS (SELECT c.station, c.vehicle FROM (SELECT station, vehicle, count(*) AS k FROM sc GROUP BY station, vehicle) c JOIN np ON np.station = c.station AND np.k = c.k),
cr AS (
  SELECT a.station, a.parameter AS pa, b.parameter AS pb, round(corr(a.z, b.z), 9) AS r FROM sc a JOIN sc b ON a.station = b.station AND a.vehicle = b.vehicle AND a.parameter < b.parameter
  JOIN fullv f ON f.station = a.station AND f.vehicle = a.vehicle GROUP BY ALL),
pv AS (SELECT station, vehicle, coalesce(list_sort(list(parameter) FILTER (abs(z) >= {T.cross_z})), []) AS ab FROM sc GROUP BY ALL),
cx AS (
  SELECT station, vehicle, ab, len(ab) AS n_ab,
         EXISTS (SELECT 1 FROM cr WHERE cr.station = pv.station AND abs(r) >= {T.cross_corr} AND list_contains(ab, pa) AND list_contains(ab, pb)) AS hit FROM pv),
cross_ AS ({latched("cx", "hit", "n_ab = 0", "station")}),
f_cross AS (SELECT station, array_to_string(ab, ' + ') AS parameter, vehicle, 'cross_parameter' AS type, 'alert' AS severity, CAST(NULL AS DOUBLE) AS z, printf('%d correlated parameters abnormal', n_ab) AS evidence FROM cross_)"""
#: The same with the correlation of the vehicles up to each one.
CAUSAL = CROSS.replace("SELECT a.station, a.parameter AS pa", "SELECT a.station, a.vehicle, a.parameter AS pa").replace("round(corr(a.z, b.z), 9) AS r", "round(corr(a.z, b.z) OVER (PARTITION BY a.station, a.parameter, b.parameter ORDER BY a.vehicle), 9) AS r").replace("f.vehicle = a.vehicle GROUP BY ALL", "f.vehicle = a.vehicle").replace("cr.station = pv.station AND", "cr.station = pv.station AND cr.vehicle = pv.vehicle AND isfinite(r) AND")
FLAGS = SCORED + POINT + PERSIST + TREND + CROSS + """,
flags AS (SELECT * FROM f_point UNION ALL SELECT * FROM f_pers UNION ALL SELECT * FROM f_trend UNION ALL SELECT * FROM f_cross)"""

# Constraint detector over operations with the bottleneck faults added.
BOTS = f""",
opf AS (
  SELECT o.* REPLACE (cycle_time + CASE WHEN i.id IS NULL THEN 0 ELSE size * (vehicle - start) END AS cycle_time)
  FROM opsl o LEFT JOIN (SELECT * FROM (VALUES {_INJ}) v(id, kind, st, parameters, start, stop, vehicles, size) WHERE kind = 'bottleneck') i ON i.st = o.station AND o.vehicle >= i.start),
b0 AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY vehicle) AS rn, count(*) OVER (PARTITION BY station) AS n FROM opf),
b1 AS (SELECT *, least({T.warmup}, greatest(20, n // 3)) AS nw FROM b0),
b2 AS (
  SELECT *, avg(cycle_time) FILTER (rn <= nw) OVER s AS mu_c, greatest(stddev_samp(cycle_time) FILTER (rn <= nw) OVER s, 1e-6) AS sd_c, avg(queue) FILTER (rn <= nw) OVER s AS mu_q, greatest(stddev_samp(queue) FILTER (rn <= nw) OVER s, 1e-6) AS sd_q,
         regr_sxx(cycle_time, CAST(rn AS DOUBLE)) OVER r AS sxx, regr_sxy(cycle_time, CAST(rn AS DOUBLE)) OVER r AS sxy, regr_syy(cycle_time, CAST(rn AS DOUBLE)) OVER r AS syy
  FROM b1 WHERE n >= greatest({T.slope_window}, nw) + 5
  WINDOW s AS (PARTITION BY station), r AS (PARTITION BY station ORDER BY vehicle ROWS {T.slope_window - 1} PRECEDING)),
b3 AS (
  SELECT *, sum(CASE WHEN rn <= nw THEN 0 ELSE cycle_time - mu_c - {T.cusum_k} * sd_c END) OVER (PARTITION BY station ORDER BY vehicle ROWS UNBOUNDED PRECEDING) AS c,
         CASE WHEN rn >= {T.slope_window} THEN sxy / sxx / greatest(sqrt(greatest(0, syy - sxy * sxy / sxx) / ({T.slope_window} - 2)) / sqrt(sxx), 1e-9) END AS t FROM b2),
b4 AS (SELECT *, round((c - least(0, min(c) OVER (PARTITION BY station ORDER BY vehicle ROWS UNBOUNDED PRECEDING))) / sd_c, 6) AS cs, round((queue - mu_q) / sd_q, 6) AS qz, round(t, 6) AS t6 FROM b3),
bo AS ({latched("b4", f"rn > nw AND cs > {T.cusum_h} AND t6 IS NOT NULL AND (t6 >= {T.slope_t} OR qz >= {T.queue_z})", f"rn > nw AND cs < {T.cusum_h * T.release}", "station")}),
bots AS (SELECT station, vehicle, vehicle AS detected_at, cycle_time, round(mu_c, 2) AS baseline_cycle, round(cs, 4) AS cusum, round(t6, 4) AS slope_t, round(qz, 4) AS queue_z, printf('CUSUM %.6f sigma over limit {T.cusum_h}; slope t=%.6f (crit {T.slope_t}); queue z=%.6f', cs, t6, qz) AS evidence FROM bo)"""
STATIONS = """,
st AS (
  SELECT s_suppkey AS station, s_suppkey AS pos, r_name AS area, s_suppkey % 3 <> 0 AS instrumented, lag(s_suppkey) OVER (ORDER BY s_suppkey) AS upstream, lead(s_suppkey) OVER (ORDER BY s_suppkey) AS downstream
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

TAU = """,
tg AS (SELECT round(0.6 * 42.0 + i * (1.2 * 42.0 / 399), 6) AS tau FROM range(400) t(i)),
tp AS (SELECT oven, vehicle, tg.tau, count(*) AS n, sum(round(temperature - (25.0 + 153.0 * (1 - exp(-dwell / tg.tau))), 6)) AS s, sum(pow(round(temperature - (25.0 + 153.0 * (1 - exp(-dwell / tg.tau))), 6), 2)) AS q FROM ort, tg GROUP BY ALL),
tw AS (SELECT oven, vehicle, tau, sum(n) OVER w AS wn, sum(s) OVER w AS ws, sum(q) OVER w AS wq, count(*) OVER w AS have FROM tp WINDOW w AS (PARTITION BY oven, tau ORDER BY vehicle ROWS 14 PRECEDING)),
tf AS (SELECT oven, vehicle, arg_min(tau, (round(wq - ws * ws / wn, 4), tau)) AS tau FROM tw WHERE have = 15 AND wn >= 6 GROUP BY ALL)"""
TAU_ALARMS = f""",
t1 AS (SELECT *, count(*) OVER (PARTITION BY oven) AS n, max(vehicle) OVER (PARTITION BY oven) AS mx FROM tf), t2 AS (SELECT *, vehicle <= least({T.warmup}, mx // 2) AS b FROM t1),
t3 AS (SELECT *, avg(tau) FILTER (b) OVER o AS m, greatest(stddev_samp(tau) FILTER (b) OVER o, 1e-6) AS s, count(*) FILTER (b) OVER o AS nb FROM t2 WINDOW o AS (PARTITION BY oven)),
t4 AS (SELECT *, round((tau - m) / s, 4) AS z FROM t3 WHERE n >= 40 AND nb >= 20 AND mx >= 45), t5 AS ({latched("t4", "abs(z) >= 3.3", "abs(z) < 0.5 * 3.3", "oven")})"""

AT = 300
INSPECTION = 10
TIMES = [60, 150, 260, 300, 420]


def state(t: int) -> str:
    """Every station as known at vehicle ``t``."""
    return f"""SELECT * FROM (WITH
        lo AS (SELECT station, max(vehicle) AS vehicle, max_by(manual_outcome, vehicle) AS outcome, max(cycle_time) AS worst_cycle FROM opsl WHERE vehicle <= {t} GROUP BY station),
        rf AS (SELECT station, bool_or(severity = 'alert') AS al, count(*) AS n_open FROM flags WHERE vehicle BETWEEN {t - 20} AND {t} GROUP BY station),
        nf AS (SELECT station, bool_or(severity = 'alert') AS al FROM flags WHERE vehicle BETWEEN {t - 10} AND {t} GROUP BY station),
        ff AS (SELECT station, count(*) AS n_flags FROM flags WHERE vehicle <= {t} GROUP BY station),
        bb AS (SELECT station, count(*) AS constraints FROM bots WHERE detected_at <= {t} GROUP BY station),
        rb AS (SELECT DISTINCT station FROM bots WHERE detected_at BETWEEN {t - 20} AND {t}),
        nb AS (SELECT st.station, bool_or(nf.al) AS al FROM st JOIN nf ON nf.station IN (st.upstream, st.downstream) GROUP BY st.station),
        hs AS (SELECT station, round(greatest(0, 100 - 16 * avg(abs(z) * CASE parameter WHEN 'temperature' THEN 1.4 ELSE 1 END)) + 1e-9, 1) AS h FROM sc WHERE vehicle BETWEEN {t - 20} AND {t} GROUP BY station),
        own AS (SELECT st.*, vehicle, outcome, worst_cycle, coalesce(n_open, 0) AS n_open, coalesce(n_flags, 0) AS n_flags, coalesce(constraints, 0) AS constraints, h, nb.al AS nal,
                       CASE WHEN rb.station IS NOT NULL OR rf.al THEN 'alert' WHEN rf.station IS NOT NULL THEN 'warning' ELSE 'healthy' END AS s
                FROM st LEFT JOIN lo USING (station) LEFT JOIN rf USING (station) LEFT JOIN ff USING (station) LEFT JOIN bb USING (station) LEFT JOIN rb USING (station) LEFT JOIN nb USING (station) LEFT JOIN hs USING (station))
        SELECT {t} AS t, station, pos, area, instrumented, h AS health_score, vehicle, outcome, worst_cycle, n_open, n_flags, constraints,
               CASE WHEN instrumented THEN 'instrumented' WHEN outcome IN ('fail', 'rework') OR (outcome = 'pass' AND s = 'healthy') THEN 'manual outcome' ELSE 'adjacent-signal inference' END AS gap_method,
               CASE WHEN instrumented THEN s WHEN outcome IN ('fail', 'rework') THEN 'alert' WHEN outcome = 'pass' AND s = 'healthy' THEN s
                    WHEN s = 'healthy' AND nal IS NOT NULL THEN CASE WHEN nal THEN 'alert' ELSE 'warning' END ELSE s END AS status FROM own)"""


def states(times: list[int]) -> str:
    return " UNION ALL ".join(map(state, times))


def trace(t: int) -> str:
    """The back-trace from the table cut at ``t``, with the median of the rows before."""
    return f"""SELECT * FROM (WITH v AS (SELECT vehicle, z FROM sc WHERE station = {INSPECTION} AND parameter = 'tax' AND vehicle <= {t}),
        failed AS (SELECT vehicle FROM opsl WHERE station = {INSPECTION} AND manual_outcome = 'fail' AND vehicle <= {t} UNION SELECT vehicle FROM v WHERE z <= (SELECT round(avg(z), 9) FROM v) - 2.5),
        bnd AS (SELECT min(vehicle) AS lo, max(vehicle) AS hi FROM failed HAVING count(*) >= 8),
        dt AS (SELECT station, parameter, vehicle, z - median(z) OVER (PARTITION BY station, parameter ORDER BY vehicle ROWS 60 PRECEDING) AS d FROM sc WHERE station < {INSPECTION} AND parameter <> 'quantity' AND vehicle <= {t}),
        pop AS (SELECT dt.*, f.vehicle IS NOT NULL AS bad FROM dt LEFT JOIN failed f USING (vehicle), bnd WHERE f.vehicle IS NOT NULL OR vehicle BETWEEN lo - (hi - lo) AND hi + (hi - lo)),
        wt AS (
          SELECT station, parameter, avg(d) FILTER (bad) AS m1, avg(d) FILTER (NOT bad) AS m2, var_samp(d) FILTER (bad) AS s1, var_samp(d) FILTER (NOT bad) AS s2, count(*) FILTER (bad) AS n1, count(*) FILTER (NOT bad) AS n2 FROM pop GROUP BY ALL),
        rk AS (
          SELECT {t} AS t, station, parameter, round((m1 - m2) / coalesce(nullif(sqrt(s1 / n1 + s2 / n2), 0), 1e-9), 2) AS t_statistic, round((m1 - m2) / coalesce(nullif(sqrt((s1 + s2) / 2), 0), 1e-9), 2) AS effect_size_sigma,
                 round(m1, 3) AS mean_z_failing, round(m2, 3) AS mean_z_passing, n1 AS n_failing FROM wt WHERE n1 >= 8 AND n2 >= 30)
        SELECT *, row_number() OVER (ORDER BY abs(t_statistic) DESC, station, parameter) AS k FROM rk QUALIFY k <= 8)"""



ORACLES = {
    "operations": f"WITH {OPS} SELECT station, vehicle, variant, cycle_time, queue, utilization, operator, supplier_lot, manual_outcome FROM opsl",
    "injected_readings": f"WITH {FAULTY} SELECT station, vehicle, parameter, round(value, 6) AS value, fault FROM rd WHERE fault IS NOT NULL",
    "baseline_cells": f"WITH {CELLS} SELECT station, parameter, variant, round(mean + 1e-7, 5) AS mean, round(std + 1e-7, 5) AS std, n FROM cells",
    "scored_readings": f"WITH {SCORED} SELECT station, vehicle, parameter, z, baseline_source, baseline_n FROM sc",
    "ewma_series": f"WITH {SCORED}{EWMA} SELECT station, parameter, vehicle, round(e + 1e-10, 6) AS ewma FROM ew",
    "spc_point": f"WITH {SCORED}{POINT} SELECT * FROM f_point",
    "spc_persistent": f"WITH {SCORED}{PERSIST} SELECT * FROM f_pers",
    "spc_trend": f"WITH {SCORED}{TREND} SELECT * FROM f_trend",
    "spc_cross": f"WITH {SCORED}{CROSS} SELECT station, parameter, vehicle, type, severity, evidence FROM f_cross",
    "flags_union": f"WITH {FLAGS}{TAU}{TAU_ALARMS} SELECT * FROM flags UNION ALL SELECT oven * 10 + 1, 'oven_tau', vehicle, 'physics_thermal_violation', 'alert', round(z, 3), printf('time constant %.4f s, %.4f s in the warm-up; no single zone need be off', tau, m) FROM t5",
    "cusum_series": f"WITH {OPS}{BOTS} SELECT station, vehicle, cs AS cusum FROM b4",
    "rolling_ols": f"WITH {OPS}{BOTS} SELECT station, vehicle, t6 AS slope_t FROM b4 WHERE t6 IS NOT NULL",
    "bottlenecks": f"WITH {OPS}{BOTS}{STATIONS} SELECT bots.*, CASE WHEN downstream IS NULL THEN [] ELSE [downstream] END AS starving_downstream FROM bots JOIN st USING (station)",
    "parameter_correlation": f"WITH {SCORED}{CROSS} SELECT station, pa AS a, pb AS b, round(r, 6) AS r FROM cr",
    "rolling_median": f"WITH {SCORED} SELECT station, parameter, vehicle, round(z - median(z) OVER (PARTITION BY station, parameter ORDER BY vehicle ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING), 6) AS detrended FROM sc",
    "line_throughput": f"""WITH {OPS}, m AS (SELECT station, max(cycle_time) AS c FROM opsl WHERE vehicle <= {AT} GROUP BY station)
        SELECT round(3600 / max(c), 1) AS line_uph, round(max(c), 2) AS takt_s, (SELECT station FROM m ORDER BY c DESC, station LIMIT 1) AS constraint_station,
               round(3600 / 40.0, 1) AS nominal_uph, round(greatest(0, 3600 / 40.0 - 3600 / max(c)), 2) AS recoverable_uph FROM m""",
    "throughput_loss": f"""WITH {OPS}, m AS (SELECT station, max(cycle_time) AS c FROM opsl WHERE vehicle <= {AT} GROUP BY station)
        SELECT station, round(c, 2) AS cycle_s, 40.0 AS nominal_s, round(c - 40.0, 2) AS excess_s FROM m WHERE c > 40 ORDER BY c DESC, station LIMIT 8""",
    "latest_operations": f"WITH {OPS} SELECT station, vehicle, cycle_time, manual_outcome FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY vehicle DESC) AS k FROM opsl WHERE vehicle <= {AT}) WHERE k = 1",
    "station_series": f"WITH {SCORED} SELECT parameter, vehicle, z FROM (SELECT *, row_number() OVER (PARTITION BY parameter ORDER BY vehicle DESC) AS k FROM sc WHERE station = 5 AND vehicle <= {AT}) WHERE k <= 120",
    "flags_since": f"WITH {FLAGS} SELECT * FROM flags WHERE vehicle BETWEEN 200 AND {AT}",
    "visible_bottlenecks": f"WITH {OPS}{BOTS} SELECT station, detected_at FROM bots WHERE detected_at <= {AT}",
    "deviation_heatmap": f"""WITH {FLAGS} SELECT station, max(abs(z)) FILTER (parameter = 'quantity') AS quantity, max(abs(z)) FILTER (parameter = 'extendedprice') AS extendedprice,
        max(abs(z)) FILTER (parameter = 'discount') AS discount, max(abs(z)) FILTER (parameter = 'tax') AS tax, max(abs(z)) FILTER (parameter = 'temperature') AS temperature FROM flags WHERE type <> 'cross_parameter' GROUP BY station""",
    "area_counts": f"WITH {OPS}{STATIONS} SELECT area, count(*) AS n, count(*) FILTER (instrumented) AS instrumented FROM st GROUP BY area",
    "backtest_scenarios": f"""WITH {FLAGS}{BOTS}
        SELECT i.id, i.kind, i.station, min(CASE WHEN i.kind = 'bottleneck' THEN b.detected_at ELSE f.vehicle END) AS first_hit, min(CASE WHEN i.kind = 'bottleneck' THEN b.detected_at ELSE f.vehicle END) - any_value(i.first) AS lag
        FROM inj i LEFT JOIN flags f ON i.kind <> 'bottleneck' AND f.station = i.station AND f.vehicle BETWEEN i.first - 2 AND i.last + 6
        LEFT JOIN bots b ON i.kind = 'bottleneck' AND b.station = i.station AND b.detected_at >= i.first - 2 WHERE i.kind <> 'latent_defect' GROUP BY i.id, i.kind, i.station""",
    "inspection_failures": f"WITH {SCORED}, v AS (SELECT vehicle, z FROM sc WHERE station = 10 AND parameter = 'tax') SELECT vehicle FROM (SELECT vehicle FROM opsl WHERE station = 10 AND manual_outcome = 'fail' UNION SELECT vehicle FROM v WHERE z <= (SELECT round(avg(z), 9) FROM v) - 2.5)",
    "lot_mean_abs_z": f"WITH {SCORED} SELECT supplier_lot, round(avg(abs(z)) + 1e-9, 6) AS lot_mean_abs_z, count(*) AS n FROM sc GROUP BY supplier_lot",
}

FAILS = """,
v AS (SELECT vehicle, z FROM sc WHERE station = 10 AND parameter = 'tax'),
failed AS (SELECT vehicle FROM opsl WHERE station = 10 AND manual_outcome = 'fail' UNION SELECT vehicle FROM v WHERE z <= (SELECT round(avg(z), 9) FROM v) - 2.5),
bnd AS (SELECT min(vehicle) AS lo, max(vehicle) AS hi FROM failed HAVING count(*) >= 8),
dt AS (SELECT station, parameter, vehicle, z - median(z) OVER (PARTITION BY station, parameter ORDER BY vehicle ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS d FROM sc WHERE station < 10 AND parameter <> 'quantity'),
pop AS (SELECT dt.*, f.vehicle IS NOT NULL AS bad FROM dt LEFT JOIN failed f USING (vehicle), bnd WHERE f.vehicle IS NOT NULL OR vehicle BETWEEN lo - (hi - lo) AND hi + (hi - lo)),
wt AS (
  SELECT station, parameter, avg(d) FILTER (bad) AS m1, avg(d) FILTER (NOT bad) AS m2, var_samp(d) FILTER (bad) AS s1, var_samp(d) FILTER (NOT bad) AS s2, count(*) FILTER (bad) AS n1, count(*) FILTER (NOT bad) AS n2 FROM pop GROUP BY ALL),
rk AS (
  SELECT station, parameter, round((m1 - m2) / coalesce(nullif(sqrt(s1 / n1 + s2 / n2), 0), 1e-9), 2) AS t_statistic, round((m1 - m2) / coalesce(nullif(sqrt((s1 + s2) / 2), 0), 1e-9), 2) AS effect_size_sigma,
         round(m1, 3) AS mean_z_failing, round(m2, 3) AS mean_z_passing, n1 AS n_failing FROM wt WHERE n1 >= 8 AND n2 >= 30)"""
ORACLES["latent_trace"] = f"WITH {SCORED}{FAILS} SELECT * FROM rk ORDER BY abs(t_statistic) DESC, station, parameter LIMIT 8"

SUMMARY = """,
al AS (SELECT station, vehicle AS at, false AS is_bot FROM flags UNION ALL SELECT station, detected_at, true FROM bots),
hits AS (
  SELECT i.id, i.kind, i.station, min(a.at) AS first_hit, min(a.at) - any_value(i.first) AS lag FROM inj i
  LEFT JOIN al a ON a.station = i.station AND a.is_bot = (i.kind = 'bottleneck') AND a.at >= i.first - 2 AND (a.is_bot OR a.at <= i.last + 6) WHERE i.kind <> 'latent_defect' GROUP BY i.id, i.kind, i.station),
named AS (SELECT DISTINCT al.station, is_bot, EXISTS (SELECT 1 FROM inj WHERE inj.station = al.station AND (kind = 'bottleneck') = is_bot) AS ok FROM al),
cnt AS (SELECT count(*) FILTER (NOT is_bot AND ok) AS atp, count(*) FILTER (NOT is_bot AND NOT ok) AS afp, count(*) FILTER (is_bot AND ok) AS btp, count(*) FILTER (is_bot AND NOT ok) AS bfp FROM named),
hs AS (
  SELECT count(first_hit) FILTER (kind <> 'bottleneck') AS ah, count(*) FILTER (kind <> 'bottleneck') AS aa, count(first_hit) FILTER (kind = 'bottleneck') AS bh, count(*) FILTER (kind = 'bottleneck') AS ba,
         round(avg(lag), 1) AS mean_detection_lag, round(quantile_cont(lag, 0.5), 1) AS median_detection_lag, round(quantile_cont(lag, 0.9), 1) AS p90_detection_lag FROM hits),
summary AS (
  SELECT round(100.0 * atp / nullif(atp + afp, 0), 1) AS precision, round(100.0 * ah / nullif(aa, 0), 1) AS recall, afp AS false_positives, round(100.0 * btp / nullif(btp + bfp, 0), 1) AS bottleneck_precision,
         round(100.0 * bh / nullif(ba, 0), 1) AS bottleneck_recall, bfp AS bottleneck_false_positives, mean_detection_lag, median_detection_lag, p90_detection_lag, aa + ba AS evaluated_events, ah + bh AS detected_events, bh AS bottleneck_events FROM cnt, hs)"""


def clean(sql: str) -> str:
    """The same without any fault."""
    return sql.replace("LEFT JOIN inj i ON i.kind <> 'bottleneck' AND", "LEFT JOIN inj i ON false AND").replace("WHERE kind = 'bottleneck') i", "WHERE false) i")


_ALARMS = f"WITH {FLAGS}{BOTS}"
# Many lines: a line's stations get numbers of their own, so that all of the above holds for each line.
_N = 3000000


def by_line(sql: str) -> str:
    """The same over many lines, a station's number being line * 3000000 + station."""
    for a, b in (
        ("SELECT l_suppkey AS station, row_number() OVER (PARTITION BY l_suppkey ORDER BY", f"SELECT year(l_shipdate) * {_N} + l_suppkey AS station, row_number() OVER (PARTITION BY year(l_shipdate), l_suppkey ORDER BY"),
        ("lim AS (SELECT ", f"lim AS (SELECT station // {_N} AS ln, "), (" AS lim FROM sc)", " AS lim FROM sc GROUP BY 1)"), ("el AS (SELECT * FROM ew, lim)", f"el AS (SELECT ew.*, lim FROM ew JOIN lim ON ln = station // {_N})"),
        ("rn0 AS (SELECT max(vehicle) AS n FROM opsl)", f"rn0 AS (SELECT station // {_N} AS ln, max(vehicle) AS n FROM opsl GROUP BY 1)"), ("FROM opsl, rn0)", f"FROM opsl JOIN rn0 ON ln = station // {_N})"),
        ("OVER (PARTITION BY vehicle ORDER BY station ROWS", f"OVER (PARTITION BY station // {_N}, vehicle ORDER BY station ROWS"),
    ):
        sql = sql.replace(a, b)
    return sql


_START = f"(50 + (station % {_N} * 31 + station // {_N} * 17) % 15)"
_KIND = f"CASE WHEN (station % {_N} * 7 + station // {_N} * 13) % 10 = 0 AND vehicle BETWEEN {_START} AND {_START} + 20 THEN ['trend', 'cross_parameter', 'bottleneck'][(station % {_N} + station // {_N}) % 3 + 1] END"


def faulty_lines(sql: str) -> str:
    """``by_line`` with the lines' faults instead of the configured ones."""
    sql = by_line(clean(sql))
    a, b = sql.index("SELECT r.station, vehicle, variant, supplier_lot, r.parameter,"), sql.index("vehicle BETWEEN start AND stop))") + len("vehicle BETWEEN start AND stop))")
    shifted = f"""SELECT r.station, vehicle, variant, supplier_lot, r.parameter, value + CASE WHEN k = 'trend' AND r.parameter = 'quantity' THEN 0.15 * (vehicle - {_START.replace("station", "r.station")} + 1) * sd WHEN k = 'cross_parameter' AND r.parameter IN ('discount', 'tax') THEN 2.5 * sd ELSE 0 END AS value,
      k AS fault FROM (SELECT *, {_KIND} AS k FROM rd0) r JOIN sd USING (station, parameter))"""
    return (sql[:a] + shifted + sql[b:]).replace("CASE WHEN i.id IS NULL THEN 0 ELSE size * (vehicle - start) END AS cycle_time", f"CASE WHEN {_KIND.replace('station', 'o.station')} = 'bottleneck' THEN 0.8 * (vehicle - {_START.replace('station', 'o.station')} + 1) ELSE 0 END AS cycle_time")


_LINE = f"station // {_N} AS line, station % {_N} AS station"
def _coverage(level: int) -> str:
    manual = f"(station * 37) % 100 < {level}"
    return f"""SELECT * FROM (WITH {FLAGS.replace(MANUAL, manual)}{BOTS}{SUMMARY}
      SELECT {level} / 100.0 AS level, recall, precision, bottleneck_recall, median_detection_lag, (SELECT count(*) FILTER ((s_suppkey * 37) % 100 < {level}) FROM supplier) AS instrumented_stations,
             (SELECT count(*) FILTER ((s_suppkey * 37) % 100 >= {level}) FROM supplier) AS manual_stations FROM summary)"""


_LEVELS = " UNION ALL ".join(_coverage(x) for x in (70, 50, 30))


def _grid(kind: str, start: float, step: float, n: int) -> str:
    return f"""SELECT '{kind}' AS kind, CAST(coalesce(min(lim) FILTER (ok), max(lim)) AS DOUBLE) AS "limit", round(arg_min(f, CASE WHEN ok THEN lim ELSE 1e6 - lim END), 4) AS fit_rate, round(arg_min(v, CASE WHEN ok THEN lim ELSE 1e6 - lim END), 4) AS validation_rate FROM (
      SELECT *, f <= {1.0 / 3} AND v <= {1.0 / 3} AS ok FROM (
        SELECT lim, count(*) FILTER (peak > lim AND run % 2 = 0) / greatest(count(DISTINCT run) FILTER (run % 2 = 0), 1) AS f, count(*) FILTER (peak > lim AND run % 2 = 1) / greatest(count(DISTINCT run) FILTER (run % 2 = 1), 1) AS v
        FROM pk, (SELECT round({start} + i * {step}, 4) AS lim FROM range({n}) t(i)) WHERE kind = '{kind}' GROUP BY lim))"""


CALIBRATED = f"""{by_line(clean(SCORED + PERSIST + BOTS))}{TAU}{TAU_ALARMS},
pk AS (SELECT station // {_N} AS run, 'ewma' AS kind, round(max(abs(e)) / (any_value(lim) / {T.ewma_l}), 6) AS peak FROM el GROUP BY station UNION ALL SELECT station // {_N}, 'cusum', max(cs) FROM b4 GROUP BY station
  UNION ALL SELECT oven // {_N // 10}, 'tau', max(abs(z)) FROM t4 GROUP BY oven),
cal AS ({_grid("ewma", 1.5, 0.1, 126)} UNION ALL {_grid("cusum", 2.0, 0.25, 233)} UNION ALL {_grid("tau", 2.0, 0.1, 121)})"""
VALID = f"""{FAILS},
og_ AS (SELECT (SELECT station FROM rk ORDER BY abs(t_statistic) DESC, station, parameter LIMIT 1) AS origin, (SELECT count(*) FROM failed) >= 8 AS available),
fps AS (SELECT coalesce(list(station ORDER BY station), []) AS fps FROM (SELECT DISTINCT station FROM flags WHERE station NOT IN (SELECT station FROM inj WHERE kind <> 'bottleneck'))),
ld AS (SELECT count(*) AS n FROM inj WHERE kind = 'latent_defect'),
valid AS (
  SELECT precision, recall, false_positives, bottleneck_precision, bottleneck_recall, bottleneck_false_positives, mean_detection_lag, median_detection_lag, p90_detection_lag, bottleneck_events, fps AS false_positive_stations, n AS latent_defect_scenarios,
         n > 0 AND available AND origin IS NOT NULL AS latent_origin_identified, origin AS latent_origin_station, evaluated_events + n AS evaluated_events, detected_events + CASE WHEN n > 0 AND available AND origin IS NOT NULL THEN 1 ELSE 0 END AS detected_events
  FROM summary, og_, fps, ld)"""


_W = "(PARTITION BY station ORDER BY vehicle ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def _padded(v: str, w: int) -> str:
    return f"(sum({v}) OVER {_W.format(w - 1)} + greatest(0, {w} - rn) * first_value({v}) OVER (PARTITION BY station ORDER BY vehicle))"


def _slope(v: str, w: int) -> str:
    """Slope by its definition over a list padded on the left."""
    xs = f"list_transform(range({w}), lambda i: i - {(w - 1) / 2})"
    ys = f"list_concat(list_resize([]::DOUBLE[], CAST(greatest(0, {w} - rn) AS BIGINT), CAST(first_value({v}) OVER (PARTITION BY station ORDER BY vehicle) AS DOUBLE)), list({v}::DOUBLE) OVER {_W.format(w - 1)})"
    return f"list_sum(list_transform(list_zip({xs}, {ys}), lambda p: p[1] * p[2])) / {w * (w * w - 1) / 12}"


EXPORT = """,
en AS (SELECT station, substr(area, 1, 3) || '-' || printf('%04d', station) AS station_id, instrumented FROM st),
ex AS (
  SELECT strftime(TIMESTAMP '2026-01-05 06:00:00' + to_minutes(o.vehicle), '%Y-%m-%dT%H:%M:%SZ') AS timestamp, o.vehicle AS v, o.station, printf('V-%04d', o.vehicle) AS vehicle_id, o.variant AS product_variant, station_id, parameter, value,
         cycle_time AS cycle_time_seconds, queue AS queue_length, utilization AS utilization_pct, manual_outcome
  FROM opsl o JOIN en USING (station) LEFT JOIN rd0 r ON r.station = o.station AND r.vehicle = o.vehicle)"""
RISK = f""",
zz AS (SELECT station, vehicle, max(abs(z)) AS zmax, avg(abs(z)) AS zmean FROM sc GROUP BY ALL),
fl AS (SELECT station, vehicle, count(*) FILTER (severity = 'alert') AS alerts, count(*) FILTER (severity = 'warning') AS warnings FROM flags GROUP BY ALL),
lz AS (SELECT supplier_lot, avg(abs(z)) AS lot FROM sc GROUP BY ALL),
rn0 AS (SELECT max(vehicle) AS n FROM opsl),
grd AS (SELECT DISTINCT station, unnest(range(1, n + 1)) AS vehicle FROM opsl, rn0),
f0 AS (
  SELECT g.station, g.vehicle, coalesce(zmax, 0) AS zmax, coalesce(zmean, 0) AS zmean, coalesce(alerts, 0) AS alerts, coalesce(warnings, 0) AS warnings, coalesce(o.cycle_time, 0) AS cycle, coalesce(o.queue, 0) AS queue, coalesce(o.utilization, 0) AS utilization,
         CASE WHEN manual_outcome IN ('fail', 'rework') THEN 1.0 ELSE 0.0 END AS rework, coalesce(abs(residual), 0) AS thermal, coalesce(lot, 0) AS lot, coalesce(TRY_CAST(substr(operator, 1, 1) AS BIGINT) - 1, 0) AS operator_idx, CASE WHEN variant = 'O' THEN 1.0 ELSE 0.0 END AS variant_idx
  FROM grd g LEFT JOIN opsl o USING (station, vehicle) LEFT JOIN zz USING (station, vehicle) LEFT JOIN fl USING (station, vehicle) LEFT JOIN lz ON lz.supplier_lot = o.supplier_lot LEFT JOIN ores USING (station, vehicle)),
f1 AS (
  SELECT *, row_number() OVER (PARTITION BY station ORDER BY vehicle) AS rn, coalesce(sum(alerts) OVER (PARTITION BY vehicle ORDER BY station ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS up,
         vehicle <= least({T.warmup}, max(vehicle) OVER (PARTITION BY station) // 2) AS warm FROM f0),
f2 AS (
  SELECT *, avg(cycle) FILTER (warm) OVER s AS mc, greatest(stddev_samp(cycle) FILTER (warm) OVER s, 1e-6) AS sc_, avg(queue) FILTER (warm) OVER s AS mq, greatest(stddev_samp(queue) FILTER (warm) OVER s, 1e-6) AS sq FROM f1 WINDOW s AS (PARTITION BY station)),
f3 AS (SELECT *, sum(cycle - mc - 0.5 * sc_) OVER (PARTITION BY station ORDER BY vehicle) AS cu, last_value(CASE WHEN alerts > 0 THEN rn END IGNORE NULLS) OVER (PARTITION BY station ORDER BY vehicle) AS la FROM f2),
fe AS (SELECT a.station, a.vehicle, sum(0.2 * pow(0.8, a.vehicle - b.vehicle) * b.zmean) AS e FROM f0 a JOIN f0 b ON a.station = b.station AND b.vehicle BETWEEN a.vehicle - 170 AND a.vehicle GROUP BY ALL),
f4 AS (
  SELECT station, vehicle, max(zmax) OVER {_W.format(9)} AS max_abs_z_10, {_padded("zmean", 10)} / 10 AS mean_abs_z_10, abs(e) AS ewma_abs, {_slope("zmean", 10)} AS z_slope_10, {_padded("alerts", 20)} AS alerts_20, {_padded("warnings", 20)} AS warnings_20,
         coalesce(least(rn - la, 200), 200) AS vehicles_since_alert, (cycle - mc) / sc_ AS cycle_z, (cu - least(0, min(cu) OVER (PARTITION BY station ORDER BY vehicle))) / sc_ AS cycle_cusum, (queue - mq) / sq AS queue_z, utilization,
         {_padded("up", 20)} AS upstream_alerts_20, thermal AS thermal_residual_abs, {_padded("rework", 20)} AS manual_rework_20, operator_idx, lot AS lot_mean_abs_z, variant_idx
  FROM f3 JOIN fe USING (station, vehicle))"""
_FEATURES = ["max_abs_z_10", "mean_abs_z_10", "ewma_abs", "z_slope_10", "alerts_20", "warnings_20", "vehicles_since_alert", "cycle_z", "cycle_cusum", "queue_z", "utilization", "upstream_alerts_20", "thermal_residual_abs", "manual_rework_20", "operator_idx", "lot_mean_abs_z", "variant_idx"]
LABELS = f"""{OPS}, {INJ},
gt AS (SELECT DISTINCT station, unnest(coalesce(vehicles, range(first, last + 1))) AS vehicle FROM inj),
rn0 AS (SELECT max(vehicle) AS n FROM opsl),
grd AS (SELECT DISTINCT station, unnest(range(1, n + 1)) AS vehicle FROM opsl, rn0),
lb AS (SELECT g.station, g.vehicle, CAST(coalesce(bool_or(t.vehicle IS NOT NULL), false) AS INT) AS label FROM grd g LEFT JOIN gt t ON t.station = g.station AND t.vehicle > g.vehicle AND t.vehicle <= g.vehicle + 8 GROUP BY ALL)"""
RATED = LABELS + ", rt AS (SELECT station, vehicle, round(cycle_time / 100 + queue / 100, 6) AS p, label AS y FROM opsl JOIN lb USING (station, vehicle))"

_FALSE = f"""{by_line(clean(_ALARMS))}{TAU}{TAU_ALARMS},
  sn AS (SELECT station // {_N} AS line, count(DISTINCT station) FILTER (k = 'a') AS anomaly, count(DISTINCT station) FILTER (k = 'b') AS bottleneck FROM (SELECT station, 'a' AS k FROM flags UNION ALL SELECT station, 'b' FROM bots) GROUP BY 1),
  ph AS (SELECT oven // {_N // 10} AS line, count(*) AS physics FROM t5 GROUP BY 1),
  per AS (SELECT line, vehicles, coalesce(anomaly, 0) AS anomaly, coalesce(bottleneck, 0) AS bottleneck, coalesce(physics, 0) AS physics FROM (SELECT station // {_N} AS line, max(vehicle) AS vehicles FROM opsl GROUP BY 1) LEFT JOIN sn USING (line) LEFT JOIN ph USING (line))"""
_PROFILE = f"""{_FALSE}, av AS (SELECT avg(anomaly) AS a, avg(bottleneck) AS b, avg(physics) AS p, max(vehicles) AS v, count(*) AS n FROM per)
  SELECT n AS runs, v AS vehicles_per_run, round(a, 2) AS anomaly_false_alarms_per_run, round(b, 2) AS bottleneck_false_alarms_per_run, round(p, 2) AS physics_false_alarms_per_run, round(a + b + p, 2) AS total_false_alarms_per_run,
         round((a + b + p) * 1000 / v, 2) AS false_alarms_per_1000_vehicles, round(v / nullif(a + b + p, 0), 1) AS arl0_vehicles FROM av"""
_CASE = f"""
  sm AS ({_ALARMS}{SUMMARY} SELECT * FROM summary), fa AS ({_PROFILE}), tp AS ({ORACLES["line_throughput"]}),
  m AS (SELECT coalesce(recall, 0) AS recall, coalesce(median_detection_lag, 0) AS lag, bottleneck_events AS ev, nominal_uph AS nom, recoverable_uph AS rec, total_false_alarms_per_run AS fa, vehicles_per_run AS vr FROM sm, tp, fa),
  a AS (SELECT *, greatest(lag, 0) AS x, 78000 / greatest(vr, 1) AS runs FROM m),
  b AS (SELECT *, CASE WHEN x <= 5 THEN 0.05 + x * 0.06 WHEN x <= 10 THEN 0.35 + (x - 5) * 0.05 WHEN x <= 20 THEN 0.6 + (x - 10) * 0.018 WHEN x <= 40 THEN 0.78 + (x - 20) * 0.0035 ELSE 0.85 END AS act FROM a),
  c AS (SELECT *, 78000 * 0.021 * recall / 100 * act AS defects, least(0.5 * rec / nom * lag * ev * runs * act, 0.05 * 78000) AS veh, fa * runs * 310 AS cost FROM b),
  cs AS (SELECT *, defects * 640 + defects * 0.06 * 4200 + veh * 1850 - cost AS net FROM c),
  case_ AS (SELECT round(act, 3) AS actionable, round(defects) AS defects_prevented, round(defects * 640) AS rework_usd, round(defects * 0.06 * 4200) AS scrap_usd, round(veh) AS vehicles_recovered,
       round(veh * 1850) AS throughput_usd, round(cost) AS investigation_usd, round(net) AS net_usd, round(net * 0.7) AS net_low_usd, round(net * 1.3) AS net_high_usd FROM cs)"""

ORACLES |= {
    "line_flags": f"WITH {faulty_lines(FLAGS)} SELECT {_LINE}, * EXCLUDE (station) FROM flags",
    "line_bottlenecks": f"WITH {faulty_lines(FLAGS + BOTS)} SELECT {_LINE}, vehicle, cusum, slope_t, queue_z FROM bots",
    "line_false_alarms": f"{_FALSE} SELECT * FROM per",
    "line_backtest": f"""WITH {faulty_lines(FLAGS + BOTS)},
        fa AS (SELECT station, any_value(k) AS kind, min(vehicle) AS v0, max(vehicle) AS v1 FROM (SELECT *, {_KIND} AS k FROM opsl) WHERE k IS NOT NULL GROUP BY station),
        al AS (SELECT station, vehicle AS v, false AS is_bot FROM flags UNION ALL SELECT station, detected_at, true FROM bots),
        pr AS (SELECT station // {_N} AS line, bool_or(coalesce((kind = 'bottleneck') = is_bot, false)) AS ok, min(v - v0) FILTER ((kind = 'bottleneck') = is_bot AND v >= v0 - 2 AND (is_bot OR v <= v1 + 6)) AS lag FROM al LEFT JOIN fa USING (station) GROUP BY station, is_bot),
        fd AS (SELECT line, count(*) FILTER (ok) AS tp, count(*) FILTER (NOT ok) AS fp, count(lag) AS detected, round(quantile_cont(lag, 0.5), 1) AS median_lag FROM pr GROUP BY line),
        fc AS (SELECT station // {_N} AS line, count(*) AS faults FROM fa GROUP BY 1)
        SELECT line, coalesce(faults, 0) AS faults, coalesce(detected, 0) AS detected, round(100.0 * coalesce(detected, 0) / nullif(faults, 0), 1) AS recall, round(100.0 * tp / nullif(tp + fp, 0), 1) AS precision, coalesce(fp, 0) AS false_positives, median_lag
        FROM fc FULL JOIN fd USING (line)""",
    "padded_rolls": f"""WITH {OPS}, o AS (SELECT *, vehicle AS rn, last_value(CASE WHEN manual_outcome = 'fail' THEN vehicle END IGNORE NULLS) OVER (PARTITION BY station ORDER BY vehicle) AS lf FROM opsl)
        SELECT station, vehicle, round({_padded("cycle_time", 20)}, 6) AS sum_20, round({_padded("cycle_time", 10)} / 10, 6) AS mean_10, round(max(cycle_time) OVER {_W.format(9)}, 6) AS max_10, round({_slope("cycle_time", 10)}, 6) + 0.0 AS slope_10,
               coalesce(least(vehicle - lf, 200), 200) AS since_fail FROM o""",
    "state_stations": f"WITH {FLAGS}{BOTS}{STATIONS} SELECT station, area, instrumented, health_score, gap_method, status FROM ({state(AT)})",
    "state_at_times": f"WITH {FLAGS}{BOTS}{STATIONS} SELECT * EXCLUDE (pos, area, instrumented) FROM ({states(TIMES)})",
    "state_document": f"""WITH {FLAGS}{BOTS}{STATIONS}, s AS ({states([150, AT])}) SELECT t, (pos - 1) // 200 AS page, count(*) AS n, count(*) FILTER (status = 'alert') AS alerts, count(*) FILTER (status = 'warning') AS warnings, CAST(sum(n_flags) AS BIGINT) AS flags_so_far,
        CAST(to_json(list({{'station': station, 'area': area, 'status': status, 'gap_method': gap_method, 'health_score': health_score, 'vehicle': vehicle, 'open_flags': n_open}} ORDER BY pos)) AS VARCHAR) AS stations FROM s GROUP BY ALL""",
    "latent_trace_at": f"WITH {SCORED} {' UNION ALL '.join(map(trace, TIMES))}",
    "line_state": f"""WITH {FLAGS}{BOTS}{STATIONS}, s AS ({states(TIMES)}), trc AS ({' UNION ALL '.join(map(trace, TIMES))}),
        c AS (SELECT t, count(*) AS n_stations, count(*) FILTER (instrumented) AS instrumented, count(*) FILTER (status = 'alert') AS alert, count(*) FILTER (status = 'warning') AS warning, count(*) FILTER (status = 'healthy') AS healthy, CAST(sum(n_flags) AS BIGINT) AS flags,
                     CAST(sum(constraints) AS BIGINT) AS constraints, max(worst_cycle) AS takt, arg_max(station, (worst_cycle, -station)) AS constraint_station FROM s GROUP BY t),
        l0 AS (SELECT t, station, worst_cycle, row_number() OVER (PARTITION BY t ORDER BY worst_cycle DESC, station) AS k FROM s WHERE worst_cycle > 40 QUALIFY k <= 8),
        l AS (SELECT t, CAST(to_json(list({{'station': station, 'cycle_s': round(worst_cycle, 2), 'excess_s': round(worst_cycle - 40, 2)}} ORDER BY k)) AS VARCHAR) AS loss FROM l0 GROUP BY t),
        r AS (SELECT t, CAST(to_json(list({{'station': station, 'parameter': parameter, 't_statistic': t_statistic}} ORDER BY k)) AS VARCHAR) AS trace FROM trc GROUP BY t)
        SELECT c.* EXCLUDE (takt), round(3600 / takt, 1) AS line_uph, round(takt, 2) AS takt_s, round(greatest(0, 3600 / 40.0 - 3600 / takt), 2) AS recoverable_uph, coalesce(loss, '[]') AS loss, coalesce(trace, '[]') AS trace
        FROM c LEFT JOIN l USING (t) LEFT JOIN r USING (t)""",
    "spc_cross_causal": f"WITH {SCORED}{CAUSAL} SELECT station, parameter, vehicle, type, severity, evidence FROM f_cross",
    "backtest_summary": f"{_ALARMS}{SUMMARY} SELECT * FROM summary",
    "false_alarm_profile": _PROFILE,
    "coverage_study": _LEVELS,
    "calibration_sweep": f"WITH {CALIBRATED} SELECT * FROM cal",
    "calibrated_bottlenecks": f"""WITH {OPS}{BOTS}, lm AS (SELECT "limit" AS h FROM (WITH {CALIBRATED} SELECT * FROM cal) WHERE kind = 'cusum'), b5 AS (SELECT b4.*, h FROM b4, lm),
        b6 AS ({latched("b5", f"rn > nw AND cs > h AND t6 IS NOT NULL AND (t6 >= {T.slope_t} OR qz >= {T.queue_z})", f"rn > nw AND cs < h * {T.release}", "station")}) SELECT station, vehicle, round(cs, 4) AS cusum FROM b6""",
    "validation": f"{_ALARMS}{SUMMARY}{VALID} SELECT * FROM valid",
    "validation_report": f"""WITH vd AS ({_ALARMS}{SUMMARY}{VALID} SELECT * FROM valid), fa AS ({_PROFILE}), cl AS (SELECT map(list(kind ORDER BY kind), list("limit" ORDER BY kind)) AS limits FROM (WITH {CALIBRATED} SELECT * FROM cal))
        SELECT CAST(to_json({{'validation': vd, 'false_alarms': fa, 'limits': limits}}) AS VARCHAR) AS document,
               'precision ' || coalesce(CAST(vd.precision AS VARCHAR), '-') || ' %, recall ' || coalesce(CAST(vd.recall AS VARCHAR), '-') || ' %' || chr(10) || 'constraints: precision ' || coalesce(CAST(bottleneck_precision AS VARCHAR), '-') || ' %, recall ' || coalesce(CAST(bottleneck_recall AS VARCHAR), '-') || ' %' || chr(10)
               || 'events found ' || detected_events || ' of ' || evaluated_events || chr(10) || 'false alarms per run ' || total_false_alarms_per_run || ', run length to one ' || coalesce(CAST(arl0_vehicles AS VARCHAR), '-') AS text FROM vd, fa, cl""",
    "alarm_window": f"WITH {FLAGS} SELECT * FROM flags WHERE station = 5 AND vehicle BETWEEN 200 AND {AT}",
    "alarm_windows": f"WITH {FLAGS} SELECT t, station, parameter, vehicle, type FROM flags, (SELECT unnest({TIMES}) AS t) WHERE vehicle BETWEEN t - 20 AND t",
    "latent_exposure": f"""WITH {FLAGS}{FAILS}, r2 AS (SELECT * FROM rk ORDER BY abs(t_statistic) DESC, station, parameter LIMIT 2), r1 AS (SELECT * FROM r2 ORDER BY abs(t_statistic) DESC, station, parameter LIMIT 1),
        fc AS (SELECT count(*) AS failures, min(vehicle) AS ff FROM failed), la AS (SELECT min(vehicle) AS la FROM flags, fc WHERE station = (SELECT station FROM r1) AND vehicle >= ff)
        SELECT failures >= 8 AS available, CASE WHEN failures < 8 THEN 'Only ' || failures || ' inspection failures; need 8 to attribute.' END AS reason, failures, (SELECT station FROM r1) AS origin, (SELECT parameter FROM r1) AS origin_parameter,
               (SELECT CASE WHEN count(*) = 2 THEN round(max(abs(t_statistic)) - min(abs(t_statistic)), 2) END FROM r2) AS separation_margin_t, ff AS first_failure, la AS first_local_alarm,
               CASE WHEN (SELECT count(*) FROM r1) = 1 THEN (SELECT count(*) FROM failed WHERE la IS NULL OR vehicle < la) END AS vehicles_before_local_alarm, la - ff AS local_alarm_lag FROM fc, la""",
    "economics": f"WITH {_CASE} SELECT * FROM case_",
    "rollout": f"WITH {_CASE} SELECT 970000.0 AS total_cost_usd, 68.0 AS total_weeks, net_usd AS annual_net_usd, CASE WHEN net_usd > 0 THEN round(970000.0 / (net_usd / 12), 1) END AS payback_months, round(100 * (net_usd - 970000.0) / 970000.0, 1) AS first_year_roi_pct FROM case_",
    "retrofit": f"""WITH {_CASE}, lv AS ({_LEVELS}), sl AS (SELECT round((arg_max(recall, level) - arg_min(recall, level)) / (max(level) - min(level)) / 100, 3) AS slope FROM lv),
        it(item, station_count, cost) AS (VALUES ('torque', 3, 12600.0), ('vision', 2, 37000.0), ('thermal', 1, 2600.0)),
        va AS (SELECT *, station_count / (SELECT count(*) FROM supplier) AS gain FROM it), vb AS (SELECT *, nullif(net_usd * slope * gain, 0) AS value FROM va, case_, sl)
        SELECT item, CAST(station_count AS BIGINT) AS station_count, CAST(cost AS DOUBLE) AS total_cost_usd, round(gain, 6) AS coverage_gain, round(value) AS annual_value_usd, CASE WHEN value > 0 THEN round(cost / (value / 12), 1) END AS payback_months FROM vb""",
    "thermal_regression": f"WITH {OPS}{OVEN} SELECT station, round(slope, 5) + 0.0 AS slope, round(intercept, 5) + 0.0 AS intercept, round(sigma, 5) + 0.0 AS sigma, n FROM ofit",
    "thermal_residuals": f"WITH {OPS}{OVEN} SELECT station, vehicle, residual + 0.0 AS residual FROM ores",
    "oven_tau_fit": f"WITH {OPS}{OVEN}{TAU} SELECT * FROM tf",
    "oven_tau_alarms": f"""WITH {OPS}{OVEN}{TAU}{TAU_ALARMS}
        SELECT oven, vehicle, 'physics_thermal_violation' AS type, 'alert' AS severity, round(tau, 4) AS measured, round(m, 4) AS expected, z FROM t5""",
    "risk_features": f"WITH {FLAGS}{RISK} SELECT station, vehicle, {', '.join(f'round(CAST({c} AS DOUBLE) + 1e-9, 5) + 0.0 AS {c}' for c in _FEATURES)} FROM f4",
    "risk_labels": f"WITH {LABELS} SELECT station, vehicle, label FROM lb",
    "risk_metrics": f"""WITH {RATED}, tot AS (SELECT count(*) AS n, sum(y) AS pos, round(avg(pow(p - y, 2)), 4) AS brier FROM rt),
        ds AS (SELECT p, count(*) AS k, sum(y) AS y FROM rt GROUP BY p), cm AS (SELECT *, sum(k) OVER (ORDER BY p DESC) AS ck, sum(y) OVER (ORDER BY p DESC) AS cy FROM ds),
        ap AS (SELECT sum(y / (SELECT pos FROM tot) * cy / ck) AS ap FROM cm),
        rks AS (SELECT y, avg(r) OVER (PARTITION BY p) AS r FROM (SELECT *, row_number() OVER (ORDER BY p) AS r FROM rt)), ra AS (SELECT sum(r) FILTER (y = 1) AS rs FROM rks),
        top AS (SELECT y, row_number() OVER (ORDER BY p DESC, station, vehicle) AS k FROM rt)
        SELECT n AS rows, CAST(pos AS BIGINT) AS positives, brier, round(ap, 3) AS pr_auc, round(pos / n, 3) AS pr_auc_baseline, round((rs - pos * (pos + 1) / 2) / (pos * (n - pos)), 3) AS roc_auc, round(round(ap, 3) / greatest(round(pos / n, 3), 1e-9), 1) AS lift,
               (SELECT round(avg(y), 3) FROM top WHERE k <= 40) AS precision_at_40, (SELECT round(avg(y), 3) FROM top WHERE k <= 120) AS precision_at_120 FROM tot, ap, ra""",
    "risk_reliability": f"WITH {RATED} SELECT CAST(least(greatest(floor(p * 10), 0), 9) AS BIGINT) AS bin, round(avg(p) + 1e-9, 3) AS predicted, round(avg(y), 3) AS observed, count(*) AS n FROM rt GROUP BY 1 HAVING count(*) >= 25",
    "export_rows": f"WITH {OPS}{STATIONS}{EXPORT} SELECT * EXCLUDE (v, station) FROM ex",
    "export_truth": f"WITH {OPS}{STATIONS}{EXPORT}, {INJ} SELECT printf('V-%04d', first) AS vehicle_id, station_id, kind AS event_type, printf('V-%04d', first) AS event_start, printf('V-%04d', last) AS event_end, id AS confirmed_by FROM inj JOIN en USING (station)",
    "ingest_operations": f"WITH {OPS} SELECT station, vehicle, printf('V-%04d', vehicle) AS vehicle_id, variant, cycle_time, queue, utilization, manual_outcome FROM opsl",
    "ingest_readings": f"WITH {OPS} SELECT station, vehicle, parameter, value FROM rd0",
    "ingest_errors": f"""WITH {OPS}{STATIONS}{EXPORT}, x AS (SELECT v % 97 AS k, instrumented, v % 97 = 4 OR v % 97 = 5 OR instrumented AS reading FROM ex JOIN en USING (station))
        SELECT error, count(*) AS n FROM (
          SELECT 'unknown_station' AS error FROM x WHERE k = 1 UNION ALL SELECT 'bad_metric' FROM x WHERE k = 2 UNION ALL SELECT 'bad_outcome' FROM x WHERE k = 3 UNION ALL SELECT 'blank_vehicle' FROM x WHERE k = 6
          UNION ALL SELECT 'manual_station' FROM x WHERE k IN (4, 5) AND NOT instrumented UNION ALL SELECT 'unknown_parameter' FROM x WHERE k = 4 AND instrumented UNION ALL SELECT 'bad_value' FROM x WHERE k = 5 AND instrumented) GROUP BY error""",
    "ingest_truth": f"""WITH {OPS}{STATIONS}{EXPORT}, {INJ} SELECT kind, station_id, station, first AS start_vehicle, last AS end_vehicle, id AS confirmed_by, '' AS errors FROM inj JOIN en USING (station)
        UNION ALL SELECT kind, substr(e.station_id, 1, 3) || '-*', g.station, first, first, 'group', '' FROM inj JOIN en e USING (station) JOIN en g ON substr(g.station_id, 1, 3) = substr(e.station_id, 1, 3) WHERE id = 'inj1'""",
}
ORACLES["stream_alarms"] = f"""WITH {SCORED}{POINT}{PERSIST}{TREND}{CAUSAL}{BOTS}, al AS (SELECT station, parameter, vehicle, type, z FROM f_point UNION ALL SELECT station, parameter, vehicle, type, z FROM f_pers UNION ALL SELECT station, parameter, vehicle, type, z FROM f_trend
    UNION ALL SELECT station, parameter, vehicle, type, z FROM f_cross UNION ALL SELECT station, 'cycle_time', vehicle, 'bottleneck', cusum FROM bots) SELECT station, parameter, vehicle, type, round(z, 3) AS z FROM al"""
ORACLES["stream_oven_alarms"] = f"WITH {OPS}{OVEN}{TAU}{TAU_ALARMS} SELECT oven, vehicle, 'physics_thermal_violation' AS type, z FROM t5"
ORACLES["station_topology"] = """
WITH g(g, prefix, area, n, manual, base_cycle) AS (VALUES (0, 'BIW', 'Body', 14, 4, 52.0), (1, 'PNT', 'Paint', 10, 3, 55.0), (2, 'FNL', 'Final', 16, 5, 50.0)),
s AS (SELECT g.*, unnest(range(1, n + 1)) AS k FROM g),
i AS (SELECT *, printf('%s-%02d', prefix, k) AS id, row_number() OVER (ORDER BY g, k) AS pos FROM s)
SELECT pos, id, area, k > manual AS instrumented, CAST(base_cycle AS DOUBLE) AS base_cycle, lag(id) OVER (ORDER BY pos) AS upstream, lead(id) OVER (ORDER BY pos) AS downstream FROM i"""
