"""Fitted models kept under a key of all that made them."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .risk import RiskModel

PREFIX = "risk-"


def fingerprint(rows: DataFrame) -> dict:
    """Number of rows and two order-free sums of their hashes: the same table gives the same, in one pass."""
    h = F.xxhash64(*rows.columns)
    got = rows.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return {"rows": got["n"], "sum": str(got["s"]), "xor": str(got["x"])}


def key(settings: dict, data: dict) -> str:
    """16 hex digits of the SHA-256 of the settings and the data's fingerprint."""
    return hashlib.sha256(json.dumps([settings, data], sort_keys=True, default=str).encode()).hexdigest()[:16]


class ModelStore:
    """A folder with one model: writing another removes it.

    A model is written beside its place and renamed into it, so readers find
    it whole or not at all; of two that write the same key the first stays.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def place(self, name: str) -> str:
        return f"{self.root}/{PREFIX}{name}"

    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(s.getPath().getName()[len(PREFIX) :] for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith(PREFIX))

    def load(self, name: str) -> RiskModel | None:
        """The model of that key; None if there is none, or one that can't be read."""
        if name not in self.names():
            return None
        try:
            return RiskModel(GBTClassificationModel.load(f"{self.place(name)}/trees"), IsotonicRegressionModel.load(f"{self.place(name)}/calibrator"))
        except (PySparkException, Py4JError):  # a damaged model is as good as none: it's fitted anew
            return None

    def save(self, name: str, model: RiskModel) -> str:
        beside = f"{self.root}/.{PREFIX}{name}-{uuid.uuid4().hex}"
        model.trees.write().save(f"{beside}/trees")
        model.calibrator.write().save(f"{beside}/calibrator")
        if name in self.names() and self.load(name) is None:
            self._fs.delete(self._path(self.place(name)), True)
        if name in self.names() or not self._fs.rename(self._path(beside), self._path(self.place(name))):
            self._fs.delete(self._path(beside), True)
        for other in self.names():
            if other != name:
                self._fs.delete(self._path(self.place(other)), True)
        return self.place(name)

    def get(self, name: str, fitted: Callable[[], RiskModel]) -> RiskModel:
        """The stored model of that key, else ``fitted()``, which is then stored."""
        model = self.load(name)
        if model is None:
            self.save(name, fitted())
            model = self.load(name)
        return model
