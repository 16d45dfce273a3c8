"""As-of and interval joins by key and time, without a task that holds a key.

As of: time is cut into spans. Both sides meet by (key, span), so a key that holds a third of all rows is dealt over its spans; what a span's first rows
need from before it, one row, is carried in from a table of the last row of each (key, span), which is small. Rows within a span are merged by a window.

Overlap: an interval belongs to the level whose bins are at least as long as it is, where it touches two bins at most; it also stands in every coarser level, so a pair
meets at the coarser one's level and nowhere else, in the first bin they share, once. Only levels at which some interval of the other side is at home are stood in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, span: int, ties: list[str] | None = None, within: int | None = None) -> DataFrame:
    """``left`` with ``matched``: the last row of ``right`` of the same key at or before its time (whole numbers, such as seconds), as a struct; null if there is none, if it is more than
    ``within`` back, or if key or time is null. Of right rows of one time that with the largest ``ties`` counts. Repeated rows of ``left`` stay; ``span`` is the length of a span of time."""
    rows = right.where(F.col(by).isNotNull() & F.col(right_time).isNotNull())
    kind = rows.select(F.struct("*").alias("m")).schema["m"].dataType
    order = F.struct(F.col(right_time).cast("long").alias("t"), *[F.col(c) for c in ties or []])
    # Per time one row; equal ones are told apart by ``ties`` before anything is shuffled whole.
    last = rows.groupBy(F.col(by).alias("k"), F.col(right_time).cast("long").alias("t")).agg(F.max_by(F.struct(*right.columns), order).alias("m"))
    last = last.withColumn("b", F.floor(F.col("t") / span))
    whole = left.withColumn("row", F.struct(*left.columns)).select("row", F.col(by).alias("k"), F.col(left_time).cast("long").alias("t"))
    keyed = whole.where("k is not null and t is not null").withColumn("b", F.floor(F.col("t") / span))
    ends = last.groupBy("k", "b").agg(F.max_by("m", "t").alias("m"))
    spans = ends.unionByName(keyed.select("k", "b", F.lit(None).cast(kind).alias("m")).distinct()).groupBy("k", "b").agg(F.first("m", ignorenulls=True).alias("m"))
    before = F.last("m", ignorenulls=True).over(W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    carried = spans.select("k", "b", before.alias("m")).where("m is not null")
    no_row = F.lit(None).cast(left.select(F.struct("*").alias("r")).schema["r"].dataType)
    none = F.lit(None).cast(kind)
    # Within a span: what is carried, then right rows, then left ones of the same time.
    events = (
        carried.select("k", "b", F.lit(None).cast("long").alias("t"), F.lit(0).alias("side"), no_row.alias("row"), "m")
        .unionByName(last.select("k", "b", "t", F.lit(0).alias("side"), no_row.alias("row"), "m"))
        .unionByName(keyed.select("k", "b", "t", F.lit(1).alias("side"), "row", none.alias("m")))
    )
    seen = F.last("m", ignorenulls=True).over(W.partitionBy("k", "b").orderBy(F.asc_nulls_first("t"), "side").rowsBetween(W.unboundedPreceding, W.currentRow))
    met = events.withColumn("m", seen).where("side = 1")
    if within is not None:
        met = met.withColumn("m", F.when(F.col("t") - F.col("m")[right_time].cast("long") <= within, F.col("m")))
    out = met.select("row", "m").unionByName(whole.where("k is null or t is null").select("row", none.alias("m")))
    return out.select("row.*", F.col("m").alias("matched"))


LEVELS = 40


def _levelled(df: DataFrame, by: str, start: str, end: str, width: int, side: str) -> DataFrame:
    """(side, k, from, to, own): intervals with the level at which they are at home."""
    a, b = F.col(start).cast("long"), F.col(end).cast("long")
    rows = df.where(F.col(by).isNotNull() & (b > a)).select(F.struct(*df.columns).alias(side), F.col(by).alias("k"), a.alias("from"), b.alias("to"))
    own = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log2((F.col("to") - F.col("from")) / width)))).cast("int")
    return rows.withColumn("own", own)


def _placed(rows: DataFrame, width: int, side: str, levels: Column) -> DataFrame:
    """A row for each interval, level of an array and bin that it touches there."""
    size = F.lit(width).cast("double") * F.pow(F.lit(2.0), F.col("level"))
    first, last = F.floor(F.col("from") / size).cast("long"), F.floor((F.col("to") - 1) / size).cast("long")
    return rows.withColumn("level", F.explode(levels)).select(side, "k", "level", first.alias(f"first_{side}"), F.col("from").alias(f"from_{side}"), F.col("to").alias(f"to_{side}"), F.explode(F.sequence(first, last)).alias("bin"))


def overlaps(a: DataFrame, b: DataFrame, by: str, start: str, end: str, width: int) -> DataFrame:
    """(a, b, shared): each pair of half-open intervals of one key that share a point, once, and how long they share. ``width`` is the length of the finest bins. Null keys, null ends and intervals of no
    length meet nothing. Intervals at home on a level meet those of the other side that stand there, which are copied to such levels alone; so two intervals that are both finer than a level never meet on it."""
    x, y = _levelled(a, by, start, end, width, "a"), _levelled(b, by, start, end, width, "b")
    homes = {"a": [], "b": []}  # at most LEVELS + 1 each
    for side, level in x.select(F.lit("a"), "own").union(y.select(F.lit("b"), "own")).distinct().collect():
        homes[side].append(level)
    at_home = F.array("own")
    above = lambda side, least: F.filter(F.array(*[F.lit(v) for v in sorted(homes[side])]).cast("array<int>"), lambda v: v >= least)
    parts = [(at_home, above("a", F.col("own"))), (above("b", F.col("own") + 1), at_home)]
    # Copies are more than the planner sees in the files, so none is broadcast.
    met = [_placed(x, width, "a", p).join(_placed(y, width, "b", q).hint("merge"), ["k", "level", "bin"]) for p, q in parts]
    own = met[0].unionByName(met[1]).where((F.col("bin") == F.greatest("first_a", "first_b")) & (F.col("from_a") < F.col("to_b")) & (F.col("from_b") < F.col("to_a")))
    return own.select("a", "b", (F.least("to_a", "to_b") - F.greatest("from_a", "from_b")).alias("shared"))


def seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970 of the clock time shown, whatever the session's zone."""
    return F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)
