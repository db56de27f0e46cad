"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import stage

__all__ = ["discard", "in_order", "match_spans", "read_table", "ship", "spans_text", "stage", "words_of"]

#: Word characters are everything but these six (space, tab, newline, vertical tab, form feed, return).
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def discard(*staged: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in staged:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once per application, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="lineloom-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Maximal runs of non-space characters; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


GROUP = 64  # matches whose offsets are summed one by one


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def match_spans(text: Column, pattern: str, kind: str, keep=None, context: int = 0) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as array<struct<start,end,kind,value,before>>.

    Offsets are code points, end exclusive.  The gaps between matches come from
    ``split`` and the matches from ``regexp_extract_all``; their running lengths
    are the offsets.  ``keep`` filters on the matched string; ``before`` holds up
    to ``context`` characters in front of it (back to the match before).
    """
    p = F.lit(pattern)
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    empty = F.expr(EMPTY_SPANS)
    pieces = F.arrays_zip(hits.alias("hit"), F.slice(F.transform(gaps, lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(context)).alias("tail"))), 1, F.size(hits)).alias("gap"))

    def span(at: Column, x: Column) -> Column:
        start = at + x["gap"]["n"]
        return F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("value"), x["gap"]["tail"].alias("before"))

    def fold(some: Column) -> Column:
        """Spans of a few pieces from 0 on, and their length."""
        return F.aggregate(
            some,
            F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda acc, x: F.struct((acc["at"] + x["gap"]["n"] + F.length(x["hit"])).alias("at"), F.concat(acc["out"], F.array(span(acc["at"], x))).alias("out")),
        )

    def moved(part: Column) -> Column:
        base = part["base"]
        return F.transform(part["part"]["out"], lambda s: F.struct((s["start"] + base).alias("start"), (s["end"] + base).alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), s["before"].alias("before")))

    # groups of pieces, so that no array grows match by match
    groups = lambda z: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(z) - 1) / GROUP).cast("int"))), lambda c: fold(F.slice(z, c * GROUP + 1, GROUP)))
    bases = lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - 1), lambda c: F.aggregate(F.slice(g, 1, c), F.lit(0), lambda a, x: a + x["at"]))
    folded = _let(pieces, lambda z: F.when(F.size(z) == 0, empty).otherwise(_let(groups(z), lambda g: F.flatten(F.transform(F.arrays_zip(g.alias("part"), bases(g).alias("base")), moved)))))
    if keep is not None:
        folded = F.filter(folded, lambda s: keep(s["value"]))
    return F.when(text.rlike(pattern), folded).otherwise(empty)


EMPTY_SPANS = "cast(array() as array<struct<start:int,end:int,kind:string,value:string,before:string>>)"


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def in_order(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then by the kinds' listed order."""
    rank = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.array_position(rank, s["kind"]).cast("int").alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")
        ),
    )
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
