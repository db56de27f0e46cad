"""Back-trace, point-in-time state and backtest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as S
from ..sources.adapters import PARAMETERS


def inspection_failures(sc: DataFrame, parameter: str, cut: float = 2.5) -> DataFrame:
    """Vehicles of an inspection station's scored rows that fail by hand or whose inspection score is ``cut`` under its mean."""
    mean = F.round(F.avg(f"z_{parameter}").over(Window.partitionBy("station")), 9)
    d = sc.withColumn("_m", mean)
    return d.where((F.col("manual_outcome") == "fail") | (F.col(f"z_{parameter}") <= F.col("_m") - cut)).select("vehicle").distinct()


def upstream(sc: DataFrame, station: int, exclude: tuple[str, ...], parameters: list[str] = PARAMETERS) -> DataFrame:
    """Wide z of the instrumented stations before ``station``, less their rolling medians, without the excluded parameters."""
    kept = [p for p in parameters if p not in exclude]
    d = sc.where((F.col("station") < station) & F.col("instrumented"))
    return d.withColumns({f"d_{p}": F.col(f"z_{p}") - S.rolling_median(f"z_{p}", ["station"], 61) for p in kept})


def latent_ranking(sc: DataFrame, station: int, parameter: str, exclude: tuple[str, ...] = ("quantity",), least: tuple[int, int] = (8, 30), parameters: list[str] = PARAMETERS) -> DataFrame:
    """Upstream signals with Welch's t between failing vehicles and time-matched passing ones.

    No rows where fewer than ``least[0]`` vehicles fail: nothing can be attributed then.
    """
    failed = inspection_failures(sc.where(F.col("station") == station), parameter)
    bounds = failed.agg(F.min("vehicle").alias("lo"), F.max("vehicle").alias("hi"), F.count(F.lit(1)).alias("n_failed")).where(F.col("n_failed") >= least[0])
    d = upstream(sc, station, exclude, parameters)
    # failures of one station: one row per vehicle of a line at most
    d = d.join(failed.withColumn("bad", F.lit(True)), "vehicle", "left").withColumn("bad", F.coalesce("bad", F.lit(False))).crossJoin(F.broadcast(bounds))
    span = F.col("hi") - F.col("lo")
    d = d.where(F.col("bad") | F.col("vehicle").between(F.col("lo") - span, F.col("hi") + span))
    kept = [p for p in parameters if p not in exclude]
    d = d.select("station", "bad", F.inline(F.array(*(F.struct(F.lit(p).alias("parameter"), F.col(f"d_{p}").alias("d")) for p in kept)))).where("d is not null")
    return _welch(d, ["station", "parameter"], least)


def _welch(d: DataFrame, keys: list[str], least: tuple[int, int]) -> DataFrame:
    """Welch's t and effect size between the ``d`` of bad and other rows, per key with enough of both."""
    bad, good = F.when(F.col("bad"), F.col("d")), F.when(~F.col("bad"), F.col("d"))
    w = d.groupBy(*keys).agg(
        F.avg(bad).alias("m1"), F.avg(good).alias("m2"), F.var_samp(bad).alias("s1"), F.var_samp(good).alias("s2"), F.count(bad).alias("n1"), F.count(good).alias("n2")
    )
    gap = F.col("m1") - F.col("m2")

    def over(x: Column) -> Column:
        return gap / F.coalesce(F.nullif(F.sqrt(x), F.lit(0.0)), F.lit(1e-9))

    return w.where((F.col("n1") >= least[0]) & (F.col("n2") >= least[1])).select(
        *keys, F.round(over(F.col("s1") / F.col("n1") + F.col("s2") / F.col("n2")), 2).alias("t_statistic"), F.round(over((F.col("s1") + F.col("s2")) / 2), 2).alias("effect_size_sigma"),
        F.round("m1", 3).alias("mean_z_failing"), F.round("m2", 3).alias("mean_z_passing"), F.col("n1").alias("n_failing"),
    )


def latent_trace(sc: DataFrame, station: int, parameter: str, exclude: tuple[str, ...] = ("quantity",), top: int = 8, parameters: list[str] = PARAMETERS) -> DataFrame:
    return latent_ranking(sc, station, parameter, exclude, parameters=parameters).orderBy(F.abs("t_statistic").desc(), "station", "parameter").limit(top)


def latent_exposure(sc: DataFrame, alarms: DataFrame, station: int, parameter: str, exclude: tuple[str, ...] = ("quantity",), least: int = 8, parameters: list[str] = PARAMETERS) -> DataFrame:
    """One row: whether a back-trace is available, its origin, how far it stands out, and what left the line before a local alarm."""
    failed = inspection_failures(sc.where(F.col("station") == station), parameter)
    count = failed.agg(F.count(F.lit(1)).alias("failures"), F.min("vehicle").alias("first_failure"), F.collect_list("vehicle").alias("_failed"))  # vehicles of one station
    by_t = F.array_sort(F.collect_list(F.struct((-F.abs("t_statistic")).alias("k"), "station", "parameter")))
    two = latent_ranking(sc, station, parameter, exclude, parameters=parameters).orderBy(F.abs("t_statistic").desc(), "station", "parameter").limit(2).agg(by_t.alias("r"))
    first, second = F.try_element_at("r", F.lit(1)), F.try_element_at("r", F.lit(2))
    d = count.crossJoin(F.broadcast(two)).withColumn("origin", first["station"]).withColumn("origin_parameter", first["parameter"]).withColumn("separation_margin_t", F.round(second["k"] - first["k"], 2))
    local = alarms.select(F.col("station").alias("_s"), F.col("vehicle").alias("_v"))
    d = d.join(local, (F.col("origin") == F.col("_s")) & (F.col("_v") >= F.col("first_failure")), "left")
    d = d.groupBy("failures", "first_failure", "_failed", "origin", "origin_parameter", "separation_margin_t").agg(F.min("_v").alias("first_local_alarm"))
    before = F.size(F.filter("_failed", lambda v: F.col("first_local_alarm").isNull() | (v < F.col("first_local_alarm"))))
    enough = F.col("failures") >= least
    return d.select(
        enough.alias("available"), F.when(~enough, F.format_string(f"Only %d inspection failures; need {least} to attribute.", "failures")).alias("reason"), "failures", "origin", "origin_parameter", "separation_margin_t",
        "first_failure", "first_local_alarm", F.when(F.col("origin").isNotNull(), before.cast("bigint")).alias("vehicles_before_local_alarm"), (F.col("first_local_alarm") - F.col("first_failure")).alias("local_alarm_lag"),
    )


def latest_operations(ops: DataFrame, at: int) -> DataFrame:
    """As-of join: each station's last operation up to vehicle ``at``."""
    last = ops.where(F.col("vehicle") <= at).groupBy("station").agg(F.max_by(F.struct("vehicle", "cycle_time", "manual_outcome"), "vehicle").alias("o"))
    return last.select("station", "o.*")


def line_throughput(ops: DataFrame, at: int, nominal: float = 40.0) -> DataFrame:
    """Line rate set by the slowest station up to ``at``."""
    m = ops.where(F.col("vehicle") <= at).groupBy("station").agg(F.max("cycle_time").alias("c"))
    return m.agg(F.max("c").alias("takt"), F.max_by("station", F.struct("c", -F.col("station"))).alias("constraint_station")).select(
        F.round(3600 / F.col("takt"), 1).alias("line_uph"), F.round("takt", 2).alias("takt_s"), "constraint_station", F.round(F.lit(3600 / nominal), 1).alias("nominal_uph"),
        F.round(F.greatest(F.lit(0.0), 3600 / nominal - 3600 / F.col("takt")), 2).alias("recoverable_uph"),
    )


def throughput_loss(ops: DataFrame, at: int, nominal: float = 40.0, top: int = 8) -> DataFrame:
    m = ops.where(F.col("vehicle") <= at).groupBy("station").agg(F.max("cycle_time").alias("c")).where(F.col("c") > nominal)
    return m.orderBy(F.desc("c"), "station").limit(top).select("station", F.round("c", 2).alias("cycle_s"), F.lit(nominal).alias("nominal_s"), F.round(F.col("c") - nominal, 2).alias("excess_s"))


def state_at(st: DataFrame, rows: DataFrame, bots: DataFrame, times: Sequence[int], recent: int = 20, near: int = 10, parameters: list[str] = PARAMETERS, weights: dict[str, float] | None = None) -> DataFrame:
    """Every station as known at each of ``times`` (vehicles): (t, station, area, ...), for any number of times in one pass.

    ``rows`` are all operations with z and ``flags`` (null where a station has
    no instruments), ``bots`` the constraints.  Each time is a row among a
    station's operations, in one window order; what it sees before it is its
    as-of join.  Manual stations without an outcome infer from their
    neighbours' alarms.  The health score weighs parameters by ``weights`` (1
    by default).  A station that had no vehicle by then has nulls.
    """
    z = [(F.abs(f"z_{p}"), (weights or {}).get(p, 1.0)) for p in parameters]
    facts = rows.select(
        "station", "vehicle", F.lit(False).alias("asked"), F.struct("vehicle", "cycle_time", "manual_outcome").alias("op"), "cycle_time", F.coalesce("flags", F.array().cast(rows.schema["flags"].dataType)).alias("flags"),
        sum((F.coalesce(v * w, F.lit(0.0)) for v, w in z), F.lit(0.0)).alias("zsum"), sum((v.isNotNull().cast("int") for v, _ in z), F.lit(0)).alias("zn"), F.lit(0).alias("bot"),
    )
    nulls = {f.name: F.lit(None).cast(f.dataType) for f in facts.schema.fields}
    found = bots.select(*(c.alias(n) for n, c in (nulls | {"station": F.col("station"), "vehicle": F.col("detected_at"), "asked": F.lit(False), "bot": F.lit(1)}).items()))
    asked = st.select("station", F.explode(F.array(*(F.lit(t).cast("bigint") for t in times))).alias("vehicle"))
    asked = asked.select(*(c.alias(n) for n, c in (nulls | {"station": F.col("station"), "vehicle": F.col("vehicle"), "asked": F.lit(True)}).items()))
    d = facts.unionByName(found).unionByName(asked).withColumn("_o", 2 * F.col("vehicle") + F.col("asked").cast("bigint"))
    order = Window.partitionBy("station").orderBy("_o")
    ever, lately, close = order.rangeBetween(Window.unboundedPreceding, -1), order.rangeBetween(-2 * recent - 1, -1), order.rangeBetween(-2 * near - 1, -1)
    # true if any alerts, false if there are other flags, null if none
    alerting = F.when(F.size("flags") > 0, F.exists("flags", lambda f: f["severity"] == "alert"))
    d = d.withColumn("alerting", alerting).withColumns(
        {
            "al": F.bool_or("alerting").over(lately), "nal": F.bool_or("alerting").over(close), "rb": F.max("bot").over(lately), "constraints": F.coalesce(F.sum("bot").over(ever), F.lit(0)), "n_flags": F.coalesce(F.sum(F.size("flags")).over(ever), F.lit(0)),
            "last": F.last("op", ignorenulls=True).over(ever), "worst_cycle": F.max("cycle_time").over(ever), "open_flags": F.flatten(F.collect_list(F.when(F.size("flags") > 0, F.transform("flags", lambda f: F.struct(F.col("vehicle"), f["type"].alias("type"), f["severity"].alias("severity"), f["parameter"].alias("parameter"))))).over(lately)),
            "h": F.sum("zsum").over(lately) / F.nullif(F.sum("zn").over(lately), F.lit(0)),
        }
    )
    d = d.where("asked").select(F.col("vehicle").alias("t"), "station", "al", "nal", "rb", "constraints", "n_flags", "last", "worst_cycle", "open_flags", F.when(F.col("h").isNotNull(), F.round(F.greatest(F.lit(0.0), 100 - 16 * F.col("h")) + 1e-9, 1)).alias("health_score"))
    sides = st.select("station", F.explode(F.array("upstream", "downstream")).alias("side")).where("side is not null")
    nb = d.select("t", F.col("station").alias("side"), "nal").where("nal is not null").join(sides, "side").groupBy("t", "station").agg(F.bool_or("nal").alias("beside"))
    d = d.drop("nal").join(st.select("station", "pos", "area", "instrumented"), "station").join(nb, ["t", "station"], "left")
    s = F.when((F.col("rb") == 1) | F.coalesce("al", F.lit(False)), "alert").when(F.col("al").isNotNull(), "warning").otherwise("healthy")
    d = d.withColumns({"s": s, "outcome": F.col("last.manual_outcome")})
    bad, fine = F.col("outcome").isin("fail", "rework"), (F.col("outcome") == "pass") & (F.col("s") == "healthy")
    return d.select(
        "t", "station", "pos", "area", "instrumented", "health_score",
        F.when(F.col("instrumented"), "instrumented").when(bad | fine, "manual outcome").otherwise("adjacent-signal inference").alias("gap_method"),
        F.when(F.col("instrumented"), F.col("s")).when(bad, "alert").when(fine, F.col("s")).when((F.col("s") == "healthy") & F.col("beside").isNotNull(), F.when(F.col("beside"), "alert").otherwise("warning")).otherwise(F.col("s")).alias("status"),
        F.col("last").alias("operation"), "worst_cycle", "open_flags", "n_flags", "constraints",
    )


def state_stations(st: DataFrame, rows: DataFrame, bots: DataFrame, at: int, **settings) -> DataFrame:
    """Status of every station as known at vehicle ``at``."""
    return state_at(st, rows, bots, [at], **settings).select("station", "area", "instrumented", "health_score", "gap_method", "status")


PAGE = 200


def state_pages(states: DataFrame, page: int = PAGE, first: int = 0) -> DataFrame:
    """One nested row per time and page of ``page`` positions of the line, counted from ``first`` (one before it is on page 0): counts by status
    and its stations with operation and open flags."""
    row = F.struct("pos", "station", "area", "status", "gap_method", "health_score", F.col("operation"), "open_flags")
    d = states.groupBy("t", F.expr(f"(pos - {first}) div {page}").alias("page")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "alert").alias("alerts"), F.count_if(F.col("status") == "warning").alias("warnings"), F.sum("n_flags").alias("flags_so_far"),
        F.array_sort(F.collect_list(row)).alias("stations"),  # a page's
    )
    return d.withColumn("stations", F.transform("stations", lambda x: x.dropFields("pos")))


def line_state_at(states: DataFrame, trace: DataFrame, nominal: float = 40.0, top: int = 8) -> DataFrame:
    """One nested row per time for the whole line: stations by status, alarms so far, line rate, largest losses and the back-trace of that time."""
    counts = states.groupBy("t").agg(
        F.count(F.lit(1)).alias("n_stations"), F.count_if("instrumented").alias("instrumented"), *(F.count_if(F.col("status") == s).alias(s) for s in ("alert", "warning", "healthy")),
        F.sum("n_flags").alias("flags"), F.sum("constraints").alias("constraints"), F.max("worst_cycle").alias("takt"), F.max_by("station", F.struct("worst_cycle", -F.col("station"))).alias("constraint_station"),
    )
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("worst_cycle"), "station"))  # cut to the first few before the shuffle
    loss = states.where(F.col("worst_cycle") > nominal).select("t", "worst_cycle", "station", rank.alias("k")).where(F.col("k") <= top)
    loss = loss.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("k", "station", F.round("worst_cycle", 2).alias("cycle_s"), F.round(F.col("worst_cycle") - nominal, 2).alias("excess_s")))).alias("loss"))
    found = trace.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("k", "station", "parameter", "t_statistic"))).alias("trace"))
    empty = lambda c, of: F.coalesce(F.transform(c, lambda x: x.dropFields("k")), F.transform(F.array().cast(of.schema[c].dataType), lambda x: x.dropFields("k")))
    d = counts.join(loss, "t", "left").join(found, "t", "left")
    rate = F.struct(
        F.round(3600 / F.col("takt"), 1).alias("line_uph"), F.round("takt", 2).alias("takt_s"), F.col("constraint_station"), F.lit(round(3600 / nominal, 1)).alias("nominal_uph"),
        F.round(F.greatest(F.lit(0.0), 3600 / nominal - 3600 / F.col("takt")), 2).alias("recoverable_uph"),
    )
    return d.select("t", "n_stations", "instrumented", "alert", "warning", "healthy", "flags", "constraints", rate.alias("throughput"), empty("loss", loss).alias("loss"), empty("trace", found).alias("trace"))


def latent_ranking_at(
    sc: DataFrame, station: int, parameter: str, times: Sequence[int], exclude: tuple[str, ...] = ("quantity",), least: tuple[int, int] = (8, 30), cut: float = 2.5, width: int = 61, parameters: list[str] = PARAMETERS
) -> DataFrame:
    """``latent_ranking`` as it could be made at each of ``times``, all in one job: (t, station, parameter, ...).

    Nothing looks ahead: signals lose the median of the last ``width`` rows
    instead of a centered one, and the failing vehicles, their mean and their
    span are those up to t.  Moments are summed by time before any shuffle.
    """
    kept = [p for p in parameters if p not in exclude]
    asked = F.array(*(F.lit(t).cast("bigint") for t in sorted(times)))
    # the inspection station: at each time its mean score so far, then who fails by then
    seen = sc.where(F.col("station") == station).select("vehicle", F.col(f"z_{parameter}").alias("z"), (F.col("manual_outcome") == "fail").alias("fails"), F.explode(F.filter(asked, lambda t: t >= F.col("vehicle"))).alias("t"))
    mean = F.round(F.avg("z").over(Window.partitionBy("t")), 9)
    failing = seen.withColumn("_m", mean).where(F.col("fails") | (F.col("z") <= F.col("_m") - cut)).select("t", "vehicle").distinct()
    bounds = failing.groupBy("t").agg(F.min("vehicle").alias("lo"), F.max("vehicle").alias("hi"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least[0])
    bounds = bounds.agg(F.map_from_entries(F.collect_list(F.struct("t", F.struct("lo", "hi")))).alias("spans"))  # one row, an entry per time
    bad = failing.groupBy("vehicle").agg(F.collect_set("t").alias("bad_at"))
    d = sc.where((F.col("station") < station) & F.col("instrumented"))
    back = S.by(["station"]).rowsBetween(1 - width, 0)
    d = d.withColumns({f"d_{p}": F.col(f"z_{p}") - F.percentile(f"z_{p}", F.lit(0.5)).over(back) for p in kept})
    d = d.join(bad, "vehicle", "left").crossJoin(F.broadcast(bounds))
    span = F.filter(F.map_entries("spans"), lambda e: e["key"] >= F.col("vehicle"))
    d = d.select("station", "vehicle", "bad_at", F.explode(span).alias("e"), *(f"d_{p}" for p in kept)).withColumn("bad", F.coalesce(F.array_contains("bad_at", F.col("e.key")), F.lit(False)))
    lo, hi = F.col("e.value.lo"), F.col("e.value.hi")
    d = d.where(F.col("bad") | F.col("vehicle").between(lo - (hi - lo), hi + (hi - lo)))
    d = d.select(F.col("e.key").alias("t"), "station", "bad", F.inline(F.array(*(F.struct(F.lit(p).alias("parameter"), F.col(f"d_{p}").alias("d")) for p in kept)))).where("d is not null")
    return _welch(d, ["t", "station", "parameter"], least)


def latent_trace_at(sc: DataFrame, station: int, parameter: str, times: Sequence[int], exclude: tuple[str, ...] = ("quantity",), top: int = 8, parameters: list[str] = PARAMETERS) -> DataFrame:
    """The ``top`` signals of ``latent_ranking_at`` at each time, numbered ``k``."""
    order = Window.partitionBy("t").orderBy(F.abs("t_statistic").desc(), "station", "parameter")
    return latent_ranking_at(sc, station, parameter, times, exclude, parameters=parameters).withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)


def alarms_of(flags: DataFrame, bots: DataFrame) -> DataFrame:
    """Flags and constraints as (station, at, is_bot)."""
    return flags.select("station", F.col("vehicle").alias("at"), F.lit(False).alias("is_bot")).union(bots.select("station", "detected_at", F.lit(True)))


def backtest_scenarios(inj: DataFrame, alarms: DataFrame, lead: int = 2, tail: int = 6) -> DataFrame:
    """First detection of every injected fault: flags in [first - lead, last + tail], constraints from first - lead on."""
    i = inj.where("kind <> 'latent_defect'").select("id", "kind", F.col("station").alias("fs"), "first", "last")
    bot = F.col("kind") == "bottleneck"
    hit = (F.col("station") == F.col("fs")) & (bot == F.col("is_bot")) & (F.col("at") >= F.col("first") - lead) & (bot | (F.col("at") <= F.col("last") + tail))
    # the faults are configuration: a handful of rows
    hits = alarms.join(F.broadcast(i), hit).groupBy("id").agg(F.min("at").alias("first_hit"))
    return i.join(hits, "id", "left").select("id", "kind", F.col("fs").alias("station"), "first_hit", (F.col("first_hit") - F.col("first")).alias("lag"))


def pct(n: Column, d: Column) -> Column:
    """Percentage to one decimal; null over nothing."""
    return F.round(100 * n / F.nullif(d.cast("double"), F.lit(0.0)), 1)


def backtest_summary(inj: DataFrame, alarms: DataFrame) -> DataFrame:
    """One row: precision by station, recall by fault, detection lags."""
    bot = F.col("kind") == "bottleneck"
    found = backtest_scenarios(inj, alarms).agg(
        *(F.count(F.when(b, F.col("first_hit"))).alias(f"{n}_hit") for n, b in (("a", ~bot), ("b", bot))), *(F.count_if(b).alias(f"{n}_all") for n, b in (("a", ~bot), ("b", bot))),
        F.round(F.avg("lag"), 1).alias("mean_detection_lag"), F.round(F.percentile("lag", F.lit(0.5)), 1).alias("median_detection_lag"), F.round(F.percentile("lag", F.lit(0.9)), 1).alias("p90_detection_lag"),
    )
    truth = inj.select(F.col("station").alias("ts"), bot.alias("tb")).distinct()
    named = alarms.select("station", "is_bot").distinct()
    right = named.join(F.broadcast(truth), (F.col("station") == F.col("ts")) & (F.col("is_bot") == F.col("tb")), "left_semi").groupBy("is_bot").agg(F.count(F.lit(1)).alias("n"))
    wrong = named.join(F.broadcast(truth), (F.col("station") == F.col("ts")) & (F.col("is_bot") == F.col("tb")), "left_anti").groupBy("is_bot").agg(F.count(F.lit(1)).alias("n"))
    both = right.withColumn("ok", F.lit(True)).union(wrong.withColumn("ok", F.lit(False)))
    n = lambda b, ok: F.coalesce(F.sum(F.when((F.col("is_bot") == b) & (F.col("ok") == ok), F.col("n"))), F.lit(0))
    counts = both.agg(n(False, True).alias("a_tp"), n(False, False).alias("a_fp"), n(True, True).alias("b_tp"), n(True, False).alias("b_fp"))
    return found.crossJoin(F.broadcast(counts)).select(  # one row each
        pct(F.col("a_tp"), F.col("a_tp") + F.col("a_fp")).alias("precision"), pct(F.col("a_hit"), F.col("a_all")).alias("recall"), F.col("a_fp").alias("false_positives"),
        pct(F.col("b_tp"), F.col("b_tp") + F.col("b_fp")).alias("bottleneck_precision"), pct(F.col("b_hit"), F.col("b_all")).alias("bottleneck_recall"), F.col("b_fp").alias("bottleneck_false_positives"),
        "mean_detection_lag", "median_detection_lag", "p90_detection_lag", (F.col("a_all") + F.col("b_all")).alias("evaluated_events"), (F.col("a_hit") + F.col("b_hit")).alias("detected_events"), F.col("b_hit").alias("bottleneck_events"),
    )


def validation(summary: DataFrame, inj: DataFrame, alarms: DataFrame, exposure: DataFrame) -> DataFrame:
    """``backtest_summary`` with latent defects, found by the back-trace, among the events, and the falsely alarming stations in order."""
    latent = inj.agg(F.count_if(F.col("kind") == "latent_defect").alias("latent_defect_scenarios"))
    truth = inj.where("kind <> 'bottleneck'").select("station").distinct()
    wrong = alarms.where("not is_bot").select("station").distinct().join(truth, "station", "left_anti").agg(F.array_sort(F.collect_list("station")).alias("false_positive_stations"))  # stations of a line
    found = exposure.select((F.col("available") & F.col("origin").isNotNull()).alias("_found"), F.col("origin").alias("latent_origin_station"))
    d = summary.crossJoin(F.broadcast(latent)).crossJoin(F.broadcast(wrong)).crossJoin(F.broadcast(found))  # one row each
    named = [c for c in summary.columns if c not in ("evaluated_events", "detected_events")]
    identified = (F.col("latent_defect_scenarios") > 0) & F.col("_found")
    return d.select(
        *named, "false_positive_stations", "latent_defect_scenarios", identified.alias("latent_origin_identified"), "latent_origin_station",
        (F.col("evaluated_events") + F.col("latent_defect_scenarios")).alias("evaluated_events"), (F.col("detected_events") + identified.cast("int")).alias("detected_events"),
    )


def report(valid: DataFrame, false_alarms: DataFrame, calibrated: DataFrame) -> DataFrame:
    """One row: the validation as one JSON document and as text."""
    whole = lambda d: d.select(F.struct(*d.columns))
    limits = calibrated.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "limit")))).alias("l"))  # a row per detector
    d = whole(valid).toDF("v").crossJoin(F.broadcast(whole(false_alarms).toDF("f"))).crossJoin(F.broadcast(limits))  # one row each
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("precision "), some("v.precision"), F.lit(" %, recall "), some("v.recall"), F.lit(" %")), F.concat(F.lit("constraints: precision "), some("v.bottleneck_precision"), F.lit(" %, recall "), some("v.bottleneck_recall"), F.lit(" %")),
        F.concat(F.lit("events found "), some("v.detected_events"), F.lit(" of "), some("v.evaluated_events")), F.concat(F.lit("false alarms per run "), some("f.total_false_alarms_per_run"), F.lit(", run length to one "), some("f.arl0_vehicles")),
    )
    return d.select(F.to_json(F.struct(F.col("v").alias("validation"), F.col("f").alias("false_alarms"), F.col("l").alias("limits")), {"ignoreNullFields": "false"}).alias("document"), text.alias("text"))


def line_false_alarms(lines: DataFrame, flags: DataFrame, bots: DataFrame, physics: DataFrame) -> DataFrame:
    """Per line without faults: its vehicles (of the longest station), distinct stations with alarms and with constraints, and oven alarms."""
    seen = flags.select("line", "station", F.lit("a").alias("k")).unionByName(bots.select("line", "station", F.lit("b").alias("k"))).distinct()
    seen = seen.unionByName(physics.select("line", F.col("oven").alias("station"), F.lit("p").alias("k")))
    counts = seen.groupBy("line").agg(*(F.count_if(F.col("k") == k).alias(n) for n, k in (("anomaly", "a"), ("bottleneck", "b"), ("physics", "p"))))
    return lines.groupBy("line").agg(F.max("vehicle").alias("vehicles")).join(counts, "line", "left").na.fill(0)


def false_alarm_profile(per_line: DataFrame) -> DataFrame:
    """Means of ``line_false_alarms`` over the lines; without any false alarm the run length to one is null."""
    m = per_line.agg(*(F.avg(c).alias(c) for c in ("anomaly", "bottleneck", "physics")), F.max("vehicles").alias("v"), F.count(F.lit(1)).alias("n"))
    total = F.col("anomaly") + F.col("bottleneck") + F.col("physics")
    return m.select(
        F.col("n").alias("runs"), F.col("v").alias("vehicles_per_run"), *(F.round(c, 2).alias(f"{c}_false_alarms_per_run") for c in ("anomaly", "bottleneck", "physics")), F.round(total, 2).alias("total_false_alarms_per_run"),
        F.round(total * 1000 / F.col("v"), 2).alias("false_alarms_per_1000_vehicles"), F.round(F.col("v") / F.nullif(total, F.lit(0.0)), 1).alias("arl0_vehicles"),
    )


def line_backtest(faults: DataFrame, flags: DataFrame, bots: DataFrame, lead: int = 2, tail: int = 6) -> DataFrame:
    """Per line how its faults were found: ``faults`` (line, station, kind, first, last), flags within [first - lead, last + tail], constraints from first - lead on.

    A line's alarming stations without a fault of that sort are its false
    positives.  Percentages over nothing are null.
    """
    bot = F.col("kind") == "bottleneck"
    alarms = flags.select("line", "station", F.col("vehicle").alias("at"), F.lit(False).alias("is_bot")).unionByName(bots.select("line", "station", F.col("detected_at").alias("at"), F.lit(True).alias("is_bot")))
    both = alarms.join(faults.withColumn("tb", bot), ["line", "station"], "left")
    same = F.coalesce(F.col("tb") == F.col("is_bot"), F.lit(False))
    hit = same & (F.col("at") >= F.col("first") - lead) & (bot | (F.col("at") <= F.col("last") + tail))
    per = both.groupBy("line", "station", "is_bot").agg(F.bool_or(same).alias("right"), F.min(F.when(hit, F.col("at") - F.col("first"))).alias("lag"))
    found = per.groupBy("line").agg(F.count_if("right").alias("tp"), F.count_if(~F.col("right")).alias("fp"), F.count("lag").alias("detected"), F.round(F.percentile("lag", F.lit(0.5)), 1).alias("median_lag"))
    out = faults.groupBy("line").agg(F.count(F.lit(1)).alias("faults")).join(found, "line", "full").na.fill(0, ["faults", "tp", "fp", "detected"])
    return out.select("line", "faults", "detected", pct(F.col("detected"), F.col("faults")).alias("recall"), pct(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.col("fp").alias("false_positives"), "median_lag")
