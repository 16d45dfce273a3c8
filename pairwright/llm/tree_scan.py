"""Up-sweep and down-sweep over numbered blocks with any associative summary, as Spark jobs.

The tree has ``2 ** FAN_BITS`` children a node; a node's number is that of its children without their last bits. Going up, the summaries of a node's
children are folded in order; going down, each child gets what lies before it: what lies before its parent, then its elder siblings. A task holds the
children of one node, at most 64 rows, whatever the input; only whether one node is left goes to the driver. Levels are tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, settled

FAN_BITS = 6


def tree_scan(blocks: DataFrame, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """(at, before) of every row of ``blocks`` (at long from 0, unique; own struct): the summary of all rows of smaller ``at``, null if there are none.

    ``combine(a, b)`` is associative, a before b, over structs of the type of ``own``; it never sees null.
    """
    spark = blocks.sparkSession
    levels = [settled(blocks.select("at", "own"))]
    kind = levels[0].schema["own"].dataType  # of a table read: all fields may be null
    none = F.lit(None).cast(kind)
    fold = lambda a, b: F.when(a.isNull(), b).otherwise(combine(a, b)).cast(kind)
    parent = F.shiftright("at", FAN_BITS)
    while levels[-1].limit(2).count() > 1:
        children = levels[-1].groupBy(parent.alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "own"))).alias("children"))
        levels.append(settled(children.select("at", F.aggregate("children", none, lambda a, x: fold(a, x["own"])).alias("own"))))
    before = levels.pop().select("at", none.alias("before"))
    pair = F.array().cast(f"array<struct<at:bigint,before:{kind.simpleString()}>>")
    while levels:
        level = levels.pop()
        # A parent's summary meets its children by number in one shuffle: no join, so nothing is broadcast.
        both = level.select(parent.alias("up"), F.struct("at", "own").alias("child"), none.alias("before")).unionByName(before.select(F.col("at").alias("up"), F.lit(None).cast(f"struct<at:bigint,own:{kind.simpleString()}>").alias("child"), "before"))
        met = both.groupBy("up").agg(F.array_sort(F.collect_list("child")).alias("children"), F.first("before", ignorenulls=True).alias("before"))
        swept = F.aggregate(
            "children", F.struct(F.col("before").alias("so_far"), pair.alias("out")),
            lambda s, x: F.struct(fold(s["so_far"], x["own"]).alias("so_far"), F.concat(s["out"], F.array(F.struct(x["at"].alias("at"), s["so_far"].alias("before")))).alias("out")),
        )
        last, before = before, settled(met.select(F.inline(swept["out"])))
        forget(spark, level)
        forget(spark, last)
    return before
