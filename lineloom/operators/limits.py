"""Calibrated limits as an append-only table that detectors read back."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Oven, Thresholds

SCHEMA = "version bigint, entry string, revoked boolean, note string, limits map<string,double>, rates map<string,double>"
#: Detector and the setting that its limit is.
SETTINGS = {"ewma": "ewma_l", "cusum": "cusum_h", "tau": "z_crit"}


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All entries ever written; none yet is an empty table."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def _append(spark: SparkSession, path: str, entry: DataFrame, version: int | None) -> int:
    version = version if version is not None else (versions(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    row = entry.select(F.lit(version).cast("bigint").alias("version"), F.lit(uuid.uuid4().hex).alias("entry"), "revoked", "note", "limits", "rates")
    row.write.mode("append").parquet(path)
    return version


def append(spark: SparkSession, path: str, calibrated: DataFrame, note: str = "") -> int:
    """Writes a calibration (kind, limit, validation_rate) as the next version and returns its number; nothing written before is touched."""
    by_kind = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", c))))  # noqa: E731  a row per detector
    one = calibrated.agg(by_kind("limit").alias("limits"), by_kind("validation_rate").alias("rates"))
    return _append(spark, path, one.select(F.lit(False).alias("revoked"), F.lit(note).alias("note"), "limits", "rates"), None)


def revoke(spark: SparkSession, path: str, version: int, note: str = "") -> None:
    """Takes a version back, by another entry of its number."""
    empty = F.create_map().cast("map<string,double>")
    _append(spark, path, spark.range(1).select(F.lit(True).alias("revoked"), F.lit(note).alias("note"), empty.alias("limits"), empty.alias("rates")), version)


def latest(spark: SparkSession, path: str) -> dict[str, float]:
    """Limits of the highest version that isn't revoked and has only positive ones; of two entries of a number the later name counts. None: empty."""
    d = versions(spark, path)
    taken_back = d.where("revoked").select("version").distinct()
    ok = F.forall(F.map_values("limits"), lambda x: x.isNotNull() & (x > 0)) & (F.size("limits") > 0)
    row = d.where(~F.col("revoked") & ok).join(taken_back, "version", "left_anti").agg(F.max_by("limits", F.struct("version", "entry")).alias("limits")).first()
    return row["limits"] or {}


def thresholds(limits: dict[str, float], th: Thresholds, o: Oven) -> tuple[Thresholds, Oven]:
    """Settings with the limits put in; detectors without one keep theirs."""
    given = {SETTINGS[k]: v for k, v in limits.items()}
    of = lambda kind: {k: v for k, v in given.items() if k in {f.name for f in dataclasses.fields(kind)}}
    return dataclasses.replace(th, **of(Thresholds)), dataclasses.replace(o, **of(Oven))
