"""Sequential operators as framed windows: no loops, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512


def by(keys: list[str], order: str = "vehicle"):
    return Window.partitionBy(*keys).orderBy(order)


def seq(keys: list[str], order: str = "vehicle") -> Column:
    """1-based position in the series."""
    return F.row_number().over(by(keys, order)).cast("bigint")


def ewma(df: DataFrame, value: str | dict[str, str], keys: list[str], lam: float = 0.2, order: str = "vehicle", out: str = "ewma") -> DataFrame:
    """``e = lam * v + (1 - lam) * e`` from 0, in linear time for any length; ``value`` may map output to input columns.

    Within blocks of 512 rows it is a scaled running sum; the block before adds
    its remainder, blocks before that weigh less than 1e-49.
    """
    q = 1.0 - lam
    df = df.withColumn("_i", F.row_number().over(by(keys, order)) - 1).withColumn("_b", F.floor(F.col("_i") / BLOCK)).withColumn("_p", F.col("_i") % BLOCK)
    sums = {}
    for name, v in (value if isinstance(value, dict) else {out: value}).items():
        term = F.col(v) * F.pow(F.lit(q), -F.col("_p"))
        own = F.sum(term).over(Window.partitionBy(*keys, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
        past = F.coalesce(F.sum(term).over(Window.partitionBy(*keys).orderBy("_b").rangeBetween(-1, -1)), F.lit(0.0))
        sums[name] = lam * (F.pow(F.lit(q), F.col("_p")) * own + F.pow(F.lit(q), F.col("_p") + BLOCK) * past)
    return df.withColumns(sums).drop("_i", "_b", "_p")


def cusum(df: DataFrame, step: Column, keys: list[str], order: str = "vehicle", out: str = "cusum") -> DataFrame:
    """``s = max(0, s + step)`` from 0: the running sum less its lowest point so far."""
    w = by(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_c", F.sum(step).over(w)).withColumn(out, F.col("_c") - F.least(F.lit(0.0), F.min("_c").over(w))).drop("_c")


def latches(df: DataFrame, rules: dict[str, tuple[Column, Column]], keys: list[str], order: str = "vehicle") -> DataFrame:
    """Per rule (opens, closes) a column that is true where a flip-flop goes from closed to open; set wins over reset."""
    marks = {f"_mark_{name}": F.when(opens, 1).when(closes, 0) for name, (opens, closes) in rules.items()}
    before = by(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    fires = {name: F.coalesce((F.col(f"_mark_{name}") == 1) & (F.coalesce(F.last(f"_mark_{name}", ignorenulls=True).over(before), F.lit(0)) == 0), F.lit(False)) for name in rules}
    return df.withColumns(marks).withColumns(fires).drop(*marks)


def latch(df: DataFrame, opens: Column, closes: Column, keys: list[str], order: str = "vehicle", out: str = "fires") -> DataFrame:
    """One rule of ``latches``."""
    return latches(df, {out: (opens, closes)}, keys, order)


def rolling_t(df: DataFrame, value: str, keys: list[str], width: int, order: str = "vehicle") -> DataFrame:
    """slope and slope_t of ``value`` against position over the last ``width`` rows; null before there are that many."""
    df = df.withColumn("_x", F.row_number().over(by(keys, order)).cast("double"))
    w = by(keys, order).rowsBetween(1 - width, 0)
    y, x = F.col(value), F.col("_x")
    sxx, sxy, syy = F.regr_sxx(y, x).over(w), F.regr_sxy(y, x).over(w), F.regr_syy(y, x).over(w)
    df = df.withColumn("_sxx", sxx).withColumn("_sxy", sxy).withColumn("_syy", syy)
    full = F.col("_x") >= width
    se = F.greatest(F.sqrt(F.greatest(F.lit(0.0), F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx")) / (width - 2)) / F.sqrt("_sxx"), F.lit(1e-9))
    return (
        df.withColumn("slope", F.when(full, F.col("_sxy") / F.col("_sxx")))
        .withColumn("slope_t", F.when(full, F.col("_sxy") / F.col("_sxx") / se))
        .drop("_x", "_sxx", "_sxy", "_syy")
    )


def _padding(keys: list[str], width: int, order: str) -> tuple[Column, Column]:
    """Rows that a window of the last ``width`` lacks, and this row's place in its series."""
    rn = F.row_number().over(by(keys, order))
    return F.greatest(F.lit(0), width - rn), rn


def padded_sum(value: str, keys: list[str], width: int, order: str = "vehicle") -> Column:
    """Sum of the last ``width`` rows, the first row standing in for those before it."""
    w = by(keys, order)
    missing, _ = _padding(keys, width, order)
    return F.sum(value).over(w.rowsBetween(1 - width, 0)) + missing * F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))


def padded_mean(value: str, keys: list[str], width: int, order: str = "vehicle") -> Column:
    return padded_sum(value, keys, width, order) / width


def padded_max(value: str, keys: list[str], width: int, order: str = "vehicle") -> Column:
    """The first row, standing in for those before it, is in the window anyway."""
    return F.max(value).over(by(keys, order).rowsBetween(1 - width, 0))


def padded_slope(df: DataFrame, value: str, keys: list[str], width: int, order: str = "vehicle", out: str = "slope") -> DataFrame:
    """Least-squares slope over the last ``width`` rows, padded like ``padded_sum``."""
    w = by(keys, order)
    df = df.withColumn("_rn", F.row_number().over(w))
    missing, rn = _padding(keys, width, order)
    first, frame = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), w.rowsBetween(1 - width, 0)
    total, weighed = F.sum(value).over(frame), F.sum(F.col(value) * F.col("_rn")).over(frame)
    # positions run from 0 to width - 1, the padding at 0 to missing - 1
    sxy = (width - 1 - rn) * total + weighed + first * missing * (missing - 1) / 2
    return df.withColumn(out, (sxy - (width - 1) / 2 * (total + missing * first)) / (width * (width * width - 1) / 12)).drop("_rn")


def rows_since(df: DataFrame, event: Column, keys: list[str], cap: int = 200, order: str = "vehicle", out: str = "since") -> DataFrame:
    """Rows since the last event, at most ``cap``; ``cap`` when there was none."""
    w = by(keys, order)
    last = F.last(F.when(event, F.col("_rn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_rn", F.row_number().over(w)).withColumn(out, F.coalesce(F.least(F.col("_rn") - last, F.lit(cap)), F.lit(cap)).cast("bigint")).drop("_rn")


def ahead(event: Column, keys: list[str], horizon: int, order: str = "vehicle") -> Column:
    """1 where an event follows within the next ``horizon`` rows."""
    return F.coalesce(F.max(event.cast("int")).over(by(keys, order).rowsBetween(1, horizon)), F.lit(0))


def rolling_median(value: str, keys: list[str], width: int, order: str = "vehicle") -> Column:
    """Centered median, cut at the ends."""
    return F.percentile(F.col(value), F.lit(0.5)).over(by(keys, order).rowsBetween(-(width // 2), width // 2))


def rounded(value: str, digits: int) -> Column:
    """Rounded as a binary number, away from zero at its half, as in DuckDB; ``F.round`` takes the decimal text (4.0535 is under its half)."""
    scale = 10.0**digits
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def interp(x: Column, xs: tuple[float, ...], ys: tuple[float, ...]) -> Column:
    """Piecewise linear, flat beyond the ends."""
    out = F.when(x <= xs[0], F.lit(ys[0]))
    for a, b, c, d in zip(xs[:-1], xs[1:], ys[:-1], ys[1:], strict=True):
        out = out.when(x <= b, c + (x - a) * ((d - c) / (b - a)))
    return out.otherwise(F.lit(ys[-1]))
