"""Alarms stored for look-ups by station and range of vehicles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import fresh_path


class AlarmIndex:
    """A table of alarms in buckets by station, each sorted by vehicle.

    A look-up of a station reads one bucket's file, of it only the row groups
    whose vehicles overlap the range; ranges alone skip row groups everywhere.
    """

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table

    @classmethod
    def write(cls, alarms: DataFrame, buckets: int = 16) -> AlarmIndex:
        """Stores alarms (station, vehicle, ...); one shuffle by station puts each bucket into one file."""
        spark = alarms.sparkSession
        name = f"alarms_{uuid.uuid4().hex}"
        alarms.repartition(buckets, "station").write.option("path", fresh_path(spark, "alarm-index")).bucketBy(buckets, "station").sortBy("vehicle").saveAsTable(name)
        return cls(spark, name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def window(self, station: int, lo: int, hi: int) -> DataFrame:
        """A station's alarms from ``lo`` to ``hi``, both included."""
        return self.rows().where((F.col("station") == station) & F.col("vehicle").between(lo, hi))

    def upto(self, hi: int) -> DataFrame:
        """All alarms up to ``hi``."""
        return self.rows().where(F.col("vehicle") <= hi)

    def windows(self, asked: DataFrame, back: int) -> DataFrame:
        """Alarms of many (station, t) at once, from ``back`` vehicles before on: (t, alarm); the index isn't shuffled."""
        a, q = self.rows().alias("a"), asked.alias("q")
        seen = (F.col("a.station") == F.col("q.station")) & F.col("a.vehicle").between(F.col("q.t") - back, F.col("q.t"))
        return a.join(q, seen).select("q.t", "a.*")
