"""The driver's star schema as a production line: suppliers are stations, their line items the vehicles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import GROUPS, INJECTIONS

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
PARAMETERS = ["quantity", "extendedprice", "discount", "tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instrumented(station: Column) -> Column:
    """Every third station is manual."""
    return station % 3 != 0


def covered(level: float):
    """Another rule: ``level`` of all stations are instrumented."""
    return lambda station: (station * 37) % 100 < round(100 * level)


def line(spark: SparkSession, sf_dir: str, rule=instrumented) -> DataFrame:
    """One wide row per (station, vehicle): cycle time, queue, utilisation, lot, outcome and the parameters.

    Parameters are null at stations without instruments (``rule``).  One scan,
    one shuffle by station: all that follows by station needs none.
    """
    vehicle = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*ORDER)).cast("bigint")
    return _wide(table(spark, sf_dir, "lineitem").withColumn("vehicle", vehicle), rule)


def _wide(items: DataFrame, rule, *keys: str) -> DataFrame:
    reads = lambda c: F.when(rule(F.col("l_suppkey")), F.col(f"l_{c}")).alias(c)
    return items.select(
        *keys,
        F.col("l_suppkey").alias("station"),
        "vehicle",
        F.col("l_linestatus").alias("variant"),
        F.col("l_quantity").alias("cycle_time"),
        F.col("l_linenumber").cast("bigint").alias("queue"),
        F.round(100 * (1 - F.col("l_discount")), 6).alias("utilization"),
        F.expr("(vehicle - 1) div 30").alias("supplier_lot"),
        F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "rework").otherwise("pass").alias("manual_outcome"),
        rule(F.col("l_suppkey")).alias("instrumented"),
        F.col("l_orderkey").alias("order_key"),
        *(reads(p) for p in PARAMETERS),
    )


def lines(spark: SparkSession, sf_dir: str, rule=instrumented) -> DataFrame:
    """Many lines in one table: each year of shipping is a run of the plant, ``line``, with vehicles counted anew at its stations.

    As in ``line`` one scan and one shuffle, by line and station.
    """
    items = table(spark, sf_dir, "lineitem").withColumn("line", F.year("l_shipdate").cast("bigint"))
    return _wide(items.withColumn("vehicle", F.row_number().over(Window.partitionBy("line", "l_suppkey").orderBy(*ORDER)).cast("bigint")), rule, "line")


#: A fault's onset, its length, and how far it goes (trend per vehicle, shift, cycle per vehicle), of the lines' faults. Fixed values.
ONSET, LENGTH, SLOPE, SHIFT, SLOWER = (50, 15), 20, 0.15, 2.5, 0.8


def line_faults(wide: DataFrame, parameters: list[str] = PARAMETERS) -> DataFrame:
    """Faults that differ from line to line, by rule: one station in ten of each line has one, of one of three kinds.

    Adds ``fault`` (trend of the first parameter, cross_parameter shift of the
    last two, bottleneck; null elsewhere and outside the fault's vehicles) and
    changes readings and cycle times.
    """
    here = (F.col("station") * 7 + F.col("line") * 13) % 10 == 0
    start = ONSET[0] + (F.col("station") * 31 + F.col("line") * 17) % ONSET[1]
    kind = F.element_at(F.array(F.lit("trend"), F.lit("cross_parameter"), F.lit("bottleneck")), ((F.col("station") + F.col("line")) % 3 + 1).cast("int"))
    df = wide.withColumn("fault", F.when(here & F.col("vehicle").between(start, start + LENGTH), kind)).withColumn("_into", F.col("vehicle") - start + 1)
    whole = Window.partitionBy("line", "station")
    size = {parameters[0]: ("trend", SLOPE * F.col("_into")), parameters[-2]: ("cross_parameter", F.lit(SHIFT)), parameters[-1]: ("cross_parameter", F.lit(SHIFT))}
    moved = {p: F.col(p) + F.when(F.col("fault") == k, by * F.stddev_samp(p).over(whole)).otherwise(0.0) for p, (k, by) in size.items()}
    moved["cycle_time"] = F.col("cycle_time") + F.when(F.col("fault") == "bottleneck", SLOWER * F.col("_into")).otherwise(0.0)
    return df.withColumns(moved).drop("_into")


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line`` with the operator, which stands in the order (every line item has one)."""
    return with_operator(line(spark, sf_dir), spark, sf_dir)


def with_operator(wide: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_orderpriority").alias("operator"))
    return wide.join(orders, "order_key")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations with area, position, neighbours and whether they are instrumented."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    pos = Window.orderBy("pos")  # stations only: a line's length
    return (
        s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"])  # nations and regions of the world: a few rows
        .join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
        .select(F.col("s_suppkey").alias("station"), F.col("s_suppkey").alias("pos"), F.col("r_name").alias("area"), instrumented(F.col("s_suppkey")).alias("instrumented"))
        .withColumn("upstream", F.lag("station").over(pos))
        .withColumn("downstream", F.lead("station").over(pos))
    )


FAULT = "id string, kind string, station bigint, parameters array<string>, start bigint, stop bigint, vehicles array<bigint>, size double"


def injections(spark: SparkSession) -> DataFrame:
    """The configured faults; ``first`` and ``last`` vehicle come from the range or the list."""
    i = spark.createDataFrame(INJECTIONS, FAULT)
    return i.withColumn("first", F.coalesce("start", F.array_min("vehicles"))).withColumn("last", F.coalesce("stop", F.array_max("vehicles")))


def by_station(spark: SparkSession, kinds) -> DataFrame:
    """Faults as one array per station, to be broadcast: the configuration holds a handful."""
    per: dict[int, list] = {}
    for row in INJECTIONS:
        if kinds(row[1]):
            per.setdefault(row[2], []).append(row)
    return spark.createDataFrame(list(per.items()), f"station bigint, faults array<struct<{FAULT.replace(' ', ':').replace(',:', ', ')}>>")


def active(f: Column, vehicle: Column) -> Column:
    """Whether a fault is at work: the vehicle is listed, or within the range; without either, never."""
    return F.coalesce(F.array_contains(f["vehicles"], vehicle), F.lit(False)) | F.coalesce(vehicle.between(f["start"], f["stop"]), F.lit(False))


def _at_work(parameter: str) -> Column:
    """Of a row's ``faults`` those that shift the parameter at this vehicle."""
    return F.filter("faults", lambda f: F.array_contains(f["parameters"], parameter) & active(f, F.col("vehicle")))


def with_faults(wide: DataFrame, faults: DataFrame, parameters: list[str] = PARAMETERS) -> DataFrame:
    """Adds the active faults' shifts, in standard deviations of the parameter at its station; ``fault_<p>`` names the fault."""
    everywhere = Window.partitionBy("station")
    df = wide.join(F.broadcast(faults), "station", "left")
    spread = {f"_sd_{p}": F.stddev_samp(p).over(everywhere) for p in parameters}
    df = df.withColumns(spread)
    out = {}
    for p in parameters:
        here = _at_work(p)
        shift = F.aggregate(here, F.lit(0.0), lambda a, f: a + f["size"] * F.when(f["kind"] == "trend", F.col("vehicle") - f["start"]).otherwise(1))
        out[p] = F.col(p) + F.when(F.col("faults").isNull(), F.lit(0.0)).otherwise(shift * F.col(f"_sd_{p}"))
        out[f"fault_{p}"] = F.when(F.col(p).isNotNull(), F.try_element_at(F.transform(here, lambda f: f["id"]), F.lit(1)))
    return df.withColumns(out).drop("faults", *spread)


def slowed(wide: DataFrame, faults: DataFrame) -> DataFrame:
    """Cycle times with the bottleneck faults: they grow from the start on, without an end."""
    df = wide.join(F.broadcast(faults), "station", "left")
    begun = F.filter("faults", lambda f: F.col("vehicle") >= f["start"])
    grown = F.aggregate(begun, F.lit(0.0), lambda a, f: a + f["size"] * (F.col("vehicle") - f["start"]))
    return df.withColumn("cycle_time", F.col("cycle_time") + F.when(F.col("faults").isNull(), F.lit(0.0)).otherwise(grown)).drop("faults")


def readings(wide: DataFrame, values: dict[str, str], parameters: list[str] = PARAMETERS) -> DataFrame:
    """Long form: a row per station, vehicle and parameter that was read; ``values`` maps new columns to prefixes of wide ones."""
    one = lambda p: F.struct(F.lit(p).alias("parameter"), *(F.col(f"{prefix}{p}").alias(c) for c, prefix in values.items()))
    keep = ["station", "vehicle", "variant", "supplier_lot"]
    return wide.select(*keep, F.explode(F.array(*map(one, parameters))).alias("r")).select(*keep, "r.*").where(F.col(next(iter(values))).isNotNull())


def topology(spark: SparkSession, groups=GROUPS) -> DataFrame:
    """Stations expanded from groups: the first round(count * (1 - share)) of each are manual; neighbours by position."""
    g = spark.createDataFrame([(i, *x) for i, x in enumerate(groups)], "g int, prefix string, area string, n int, share double, base_cycle double")
    s = g.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    w = Window.orderBy("g", "k")
    return (
        s.withColumn("id", F.format_string("%s-%02d", "prefix", "k"))
        .withColumn("instrumented", F.col("k") > F.bround(F.col("n") * (1 - F.col("share"))))
        .withColumn("pos", F.row_number().over(w).cast("bigint"))
        .withColumn("upstream", F.lag("id").over(w))
        .withColumn("downstream", F.lead("id").over(w))
        .select("pos", "id", "area", "instrumented", "base_cycle", "upstream", "downstream")
    )
