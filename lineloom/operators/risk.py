"""Features, labels, model and metrics for the risk of a confirmed fault within the next vehicles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions import series as S
from ..sources.adapters import PARAMETERS

#: Columns of the feature frame, in order. Fixed values.
FEATURES = [
    "max_abs_z_10", "mean_abs_z_10", "ewma_abs", "z_slope_10", "alerts_20", "warnings_20", "vehicles_since_alert", "cycle_z", "cycle_cusum", "queue_z", "utilization", "upstream_alerts_20",
    "thermal_residual_abs", "manual_rework_20", "operator_idx", "lot_mean_abs_z", "variant_idx",
]
HORIZON = 8
KEY = ["station"]


def others(keys: list[str]) -> list[str]:
    """The keys that tell lines apart."""
    return [k for k in keys if k != "station"]


def dense(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Every station with every vehicle from 1 to its line's count: rows that are missing come with nulls."""
    per = others(keys)
    count = F.broadcast(df.groupBy(*per).agg(F.max("vehicle").alias("_n")))  # one row, or one per line
    stations = df.select(*keys).distinct()
    grid = (stations.join(count, per) if per else stations.crossJoin(count)).select(*keys, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("vehicle"))
    return grid.join(df, [*keys, "vehicle"], "left")


def features(line: DataFrame, flagged: DataFrame, thermal: DataFrame | None = None, th: Thresholds = Thresholds(), parameters: list[str] = PARAMETERS, keys: list[str] = KEY, causal: bool = False) -> DataFrame:
    """The 17 columns per station and vehicle, from what is known at that vehicle.

    ``line`` is the wide operations with ``operator``, ``flagged`` the scored
    wide rows with their alarms, ``thermal`` optional (station, vehicle,
    residual) of the oven model.  Missing rows and readings count as 0.
    The mean of a lot counts all its vehicles; ``causal``, those up to this one.
    """
    z = [F.abs(f"z_{p}") for p in parameters]
    here = sum((v.isNotNull().cast("int") for v in z), F.lit(0))
    total = sum((F.coalesce(v, F.lit(0.0)) for v in z), F.lit(0.0))
    severe = lambda s: F.size(F.filter("flags", lambda f: f["severity"] == s))
    line_of = others(keys)
    per = flagged.select(*keys, "vehicle", F.coalesce(F.greatest(*z), F.lit(0.0)).alias("zmax"), F.coalesce(total / F.nullif(here, F.lit(0)), F.lit(0.0)).alias("zmean"), total.alias("_t"), here.alias("_h"), severe("alert").alias("alerts"), severe("warning").alias("warnings"))  # noqa: E501
    lots, lot_key = lot_means(flagged, total, here, line_of, causal)
    facts = line.select(*keys, "vehicle", "supplier_lot", "variant", "operator", "cycle_time", "queue", "utilization", F.col("manual_outcome").isin("fail", "rework").cast("double").alias("rework"))
    d = dense(facts, keys).join(per.drop("_t", "_h"), [*keys, "vehicle"], "left").join(lots, lot_key, "left")
    if thermal is None:
        d = d.withColumn("residual", F.lit(0.0))
    else:
        d = d.join(thermal.select(*keys, "vehicle", F.abs("residual").alias("residual")), [*keys, "vehicle"], "left")
    zeros = ["zmax", "zmean", "alerts", "warnings", "cycle_time", "queue", "utilization", "rework", "residual", "lot_mean_abs_z"]
    d = d.na.fill(0, zeros)
    d = d.join(upstream(per.where("alerts > 0").select(*keys, "vehicle", "alerts"), facts, keys), [*keys, "vehicle"], "left").na.fill(0, ["up"])
    whole = Window.partitionBy(*keys)
    warm = F.col("vehicle") <= F.least(F.lit(th.warmup), F.floor(F.max("vehicle").over(whole) / 2))
    d = d.withColumn("_warm", warm)
    stats = {}
    for n, c in (("c", "cycle_time"), ("q", "queue")):
        x = F.when(F.col("_warm"), F.col(c))
        stats |= {f"_m{n}": F.avg(x).over(whole), f"_s{n}": F.greatest(F.stddev_samp(x).over(whole), F.lit(1e-6))}
    d = d.withColumns(stats)
    d = S.cusum(d, F.col("cycle_time") - F.col("_mc") - 0.5 * F.col("_sc"), keys, out="_cusum")
    d = S.ewma(d, "zmean", keys, 0.2, out="_ewma")
    d = S.padded_slope(d, "zmean", keys, 10, out="z_slope_10")
    d = S.rows_since(d, F.col("alerts") > 0, keys, out="vehicles_since_alert")
    d = d.withColumns(
        {
            "max_abs_z_10": S.padded_max("zmax", keys, 10), "mean_abs_z_10": S.padded_mean("zmean", keys, 10), "alerts_20": S.padded_sum("alerts", keys, 20), "warnings_20": S.padded_sum("warnings", keys, 20),
            "upstream_alerts_20": S.padded_sum("up", keys, 20), "manual_rework_20": S.padded_sum("rework", keys, 20),
        }
    )
    index = F.coalesce(F.expr("try_cast(substr(operator, 1, 1) AS bigint)") - 1, F.lit(0))
    return d.withColumns(
        {
            "ewma_abs": F.abs("_ewma"), "cycle_z": (F.col("cycle_time") - F.col("_mc")) / F.col("_sc"), "queue_z": (F.col("queue") - F.col("_mq")) / F.col("_sq"), "cycle_cusum": F.col("_cusum") / F.col("_sc"),
            "thermal_residual_abs": F.col("residual"), "operator_idx": index.cast("double"), "variant_idx": F.when(F.col("variant") == "O", 1.0).otherwise(0.0),
        }
    ).select(*keys, "vehicle", *(F.col(c).cast("double").alias(c) for c in FEATURES))


def upstream(alerts: DataFrame, line: DataFrame, keys: list[str] = KEY, before: int = 3) -> DataFrame:
    """(station, vehicle, up): alerts at the ``before`` stations in front, vehicle by vehicle, where there are any.

    Only rows with alerts go on to the stations behind theirs; no task holds a vehicle's whole line.
    """
    per = others(keys)
    behind = Window.partitionBy(*per).orderBy("station")  # a row per station of a line
    after = line.select(*keys).distinct().select(*keys, F.array_compact(F.array(*(F.lead("station", k).over(behind) for k in range(1, before + 1)))).alias("_after"))
    sent = alerts.join(after, keys).select(*per, F.explode("_after").alias("station"), "vehicle", "alerts")
    return sent.groupBy(*keys, "vehicle").agg(F.sum("alerts").alias("up"))


def lot_means(flagged: DataFrame, total: Column, here: Column, per: list[str], causal: bool) -> tuple[DataFrame, list[str]]:
    """Mean |z| of each lot, and the columns it is joined by: the whole lot's, or with ``causal`` at each vehicle the lot's so far."""
    sums = [F.sum("_t").alias("_t"), F.sum("_h").alias("_h")]
    d = flagged.select(*per, "supplier_lot", "vehicle", total.alias("_t"), here.alias("_h"))
    mean = (F.col("_t") / F.col("_h")).alias("lot_mean_abs_z")
    if not causal:
        return d.groupBy(*per, "supplier_lot").agg(*sums).select(*per, "supplier_lot", mean), [*per, "supplier_lot"]
    so_far = Window.partitionBy(*per, "supplier_lot").orderBy("vehicle").rowsBetween(Window.unboundedPreceding, 0)
    d = d.groupBy(*per, "supplier_lot", "vehicle").agg(*sums).withColumns({c: F.sum(c).over(so_far) for c in ("_t", "_h")})
    return d.select(*per, "vehicle", mean), [*per, "vehicle"]


def labels(line: DataFrame, truth: DataFrame, horizon: int = HORIZON, keys: list[str] = KEY) -> DataFrame:
    """1 where a fault is confirmed at the station within the next ``horizon`` vehicles; ``truth`` holds (station, vehicle)."""
    d = dense(line.select(*keys, "vehicle"), keys).join(truth.distinct().withColumn("_g", F.lit(True)), [*keys, "vehicle"], "left")
    return d.withColumn("label", S.ahead(F.col("_g").isNotNull(), keys, horizon)).select(*keys, "vehicle", "label")


def truth_of(inj: DataFrame) -> DataFrame:
    """(station, vehicle) of every vehicle at which a fault is at work."""
    return inj.select("station", F.explode(F.coalesce("vehicles", F.sequence("first", "last"))).alias("vehicle"))


def _by_score(scored: DataFrame) -> DataFrame:
    """Counts per distinct score (rounded to 6 digits, so a million rows at most), with those above."""
    per = scored.groupBy(F.round("p", 6).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    w = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumns({"cn": F.sum("n").over(w), "cp": F.sum("pos").over(w)})


def metrics(scored: DataFrame, at: tuple[int, ...] = (40, 120)) -> DataFrame:
    """One row over (station, vehicle, p, y): Brier score, average precision and its no-skill value, ROC area, lift, precision among the first."""
    d = _by_score(scored)
    whole = scored.agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("positives"), F.round(F.avg(F.pow(F.round("p", 6) - F.col("y"), 2)), 4).alias("brier"))
    area = d.crossJoin(F.broadcast(whole)).agg(  # one row
        F.sum(F.col("pos") / F.col("positives") * F.col("cp") / F.col("cn")).alias("_ap"),
        F.sum((F.col("n") - F.col("pos")) * (F.col("cp") - F.col("pos") / 2)).alias("_u"),
    )
    tops = scored.select(F.round("p", 6).alias("p"), "station", "vehicle", "y").orderBy(F.desc("p"), "station", "vehicle").limit(max(at))
    ranked = tops.withColumn("_k", F.row_number().over(Window.orderBy(F.desc("p"), "station", "vehicle")))  # the first few only
    firsts = ranked.agg(*(F.round(F.avg(F.when(F.col("_k") <= k, F.col("y"))), 3).alias(f"precision_at_{k}") for k in at))
    out = whole.crossJoin(F.broadcast(area)).crossJoin(F.broadcast(firsts))  # one row each
    base = F.col("positives") / F.col("rows")
    ap = F.round("_ap", 3)
    return out.select(
        "rows", "positives", "brier", ap.alias("pr_auc"), F.round(base, 3).alias("pr_auc_baseline"), F.round(F.col("_u") / F.nullif(F.col("positives") * (F.col("rows") - F.col("positives")), F.lit(0)), 3).alias("roc_auc"),
        F.round(ap / F.greatest(F.round(base, 3), F.lit(1e-9)), 1).alias("lift"), *(f"precision_at_{k}" for k in at),
    )


def reliability(scored: DataFrame, least: int = 25) -> DataFrame:
    """Mean prediction and observed share per tenth with enough rows."""
    d = scored.withColumn("_p", F.round("p", 6))
    tenth = F.least(F.greatest(F.floor(F.col("_p") * 10), F.lit(0)), F.lit(9))
    d = d.groupBy(tenth.alias("bin")).agg(F.round(F.avg("_p") + 1e-9, 3).alias("predicted"), F.round(F.avg("y"), 3).alias("observed"), F.count(F.lit(1)).alias("n"))
    return d.where(F.col("n") >= least)


#: What a feature is about, and the family of causes it points at.
LABELS = {
    "max_abs_z_10": ("largest deviation of 10 vehicles", "process"), "mean_abs_z_10": ("mean deviation of 10 vehicles", "process"), "ewma_abs": ("lasting shift", "process"), "z_slope_10": ("rising deviation", "wear"),
    "alerts_20": ("alerts of 20 vehicles", "process"), "warnings_20": ("warnings of 20 vehicles", "process"), "vehicles_since_alert": ("vehicles since an alert", "wear"), "cycle_z": ("cycle time", "pacing"),
    "cycle_cusum": ("accumulated cycle time", "pacing"), "queue_z": ("queue", "pacing"), "utilization": ("utilization", "pacing"), "upstream_alerts_20": ("alerts upstream", "upstream"), "thermal_residual_abs": ("distance from the oven model", "thermal"),
    "manual_rework_20": ("failed or reworked by hand", "inspection"), "operator_idx": ("operator", "operator"), "lot_mean_abs_z": ("lot", "parts"), "variant_idx": ("variant", "mix"),
}


class RiskModel:
    """Boosted trees and their isotonic calibration."""

    def __init__(self, trees, calibrator):
        self.trees, self.calibrator = trees, calibrator

    def predict(self, frame: DataFrame) -> DataFrame:
        """``frame`` with the calibrated probability ``p``."""
        from pyspark.ml.functions import vector_to_array

        d = self.trees.transform(_vectors(frame)).withColumn("margin", vector_to_array("probability")[1]).drop("prediction")
        out = self.calibrator.transform(d)
        return out.withColumn("p", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))).drop("features", "rawPrediction", "probability", "prediction", "margin")

    def importances(self) -> dict[str, float]:
        """Shares of the trees' gain in percent."""
        gains = self.trees.featureImportances.toArray()
        return {f: round(float(g) / (float(gains.sum()) or 1.0) * 100, 1) for f, g in zip(FEATURES, gains, strict=True)}


def _vectors(frame: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(frame)


#: Of seven lines in a row four train, one calibrates, two validate. Fixed values.
ROLES = ("train", "train", "train", "train", "calibrate", "validate", "validate")


def role(line: Column) -> Column:
    """What a line is used for: lines are dealt whole, never row by row."""
    return F.element_at(F.array(*(F.lit(r) for r in ROLES)), (F.pmod(line, F.lit(len(ROLES))) + 1).cast("int"))


def fit(frame: DataFrame, rounds: int = 40, depth: int = 4, step: float = 0.06, seed: int = 42) -> RiskModel:
    """Boosted trees on the training lines of ``frame`` (features, label, line), calibrated by isotonic regression on others."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    d = _vectors(frame)
    used = role(F.col("line"))
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.85, featureSubsetStrategy="0.85", minInstancesPerNode=6, seed=seed)
    trees = gbt.fit(d.where(used == "train"))
    margin = trees.transform(d.where(used == "calibrate")).select(vector_to_array("probability")[1].alias("margin"), F.col("label").cast("double").alias("label"))
    return RiskModel(trees, IsotonicRegression(featuresCol="margin", labelCol="label").fit(margin))
