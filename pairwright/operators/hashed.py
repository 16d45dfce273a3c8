"""Bootstraps whose draws are hashes, so that they add up: no task holds a cell, SQL can repeat every draw, and neither the order nor the partition of rows matters.

In each draw a unit (a row, or a cluster such as a turn) counts a Poisson(1) number of times, told by 32 bits of md5("seed:word:unit"); each md5 serves four
draws. A row carries its hashed words as bytes into Arrow batches, where sums by cell and draw are taken without a row for each draw; what is left is of the
size of cells by draws.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from pairwright.functions.stats import kendall_tau_b

#: Places in 2^32 at which the Poisson(1) count goes up by one.
STEPS = [math.floor(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(12)]


def weights(units: DataFrame, unit: Column, n_boot: int, seed: int) -> DataFrame:
    """A row for each row of ``units`` and draw in which its unit counts, with ``draw`` and ``weight``."""
    words = -(-n_boot // 4)
    hashed = units.withColumn("_word", F.explode(F.sequence(F.lit(0), F.lit(words - 1)))).withColumn("_md5", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_word").cast("string"), unit.cast("string"))))
    bits = lambda j: F.conv(F.substring("_md5", 8 * j + 1, 8), 16, 10).cast("long")
    count = lambda u: sum(F.when(u >= t, 1).otherwise(0) for t in STEPS)
    each = F.array(*[F.struct((F.col("_word") * 4 + j).alias("draw"), count(bits(j)).alias("weight")) for j in range(4)])
    return hashed.withColumn("_d", F.explode(each)).where((F.col("_d.weight") > 0) & (F.col("_d.draw") < n_boot)).select(*units.columns, "_d.draw", "_d.weight")


def words(unit: Column, n_boot: int, seed: int) -> Column:
    """The hashed words of a unit, 16 bytes each, for all draws."""
    n, each = -(-n_boot // 4), lambda w: F.md5(F.concat_ws(":", F.lit(str(seed)), w.cast("string"), unit.cast("string")))
    # Written out while that is short: compiled code is faster than a lambda.
    return F.unhex(F.concat(*[each(F.lit(w)) for w in range(n)]) if n <= 64 else F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), each), ""))


def _counts(hashed: pa.Array, n_boot: int) -> np.ndarray:
    """(draws, rows): how often each row counts. Counts beyond three are rare and told apart on their own."""
    u = np.frombuffer(b"".join(hashed.to_pylist()), ">u4").reshape(len(hashed), -1)[:, :n_boot].T.astype(np.uint32, order="C")
    w = np.zeros(u.shape, np.uint8)
    for t in STEPS[:4]:
        w += u >= t
    far = u >= STEPS[4]
    w[far] = np.searchsorted(STEPS, u[far], side="right")
    return w


def totals(rows: DataFrame, by: list[str], hashed: str, measures: list[str], n_boot: int, squared: bool = False, most: int = 4_000_000) -> DataFrame:
    """(by, draw, weight, measures): sums by cell and draw of the weights and of weighted numbers, each row counting as its ``hashed`` words say (``squared``: the square of that). Draws in which
    nothing of a cell counts are left out. A task holds about ``most`` sums at a time."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "draw int, weight double", *(f"`{m}` double" for m in measures)])
    names, numbers = [*by, "draw", "weight", *measures], [F.col(m).cast("double").alias(m) for m in measures]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> Iterator[pd.DataFrame]:
            for key, sums in held.items():
                met = np.flatnonzero(sums[0])
                yield pd.DataFrame({**{c: pd.Series([k] * len(met), dtype=object) for c, k in zip(by, key, strict=True)}, "draw": met.astype(np.int32), **{n: s[met] for n, s in zip(["weight", *measures], sums, strict=True)}})
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
            place: dict[tuple, int] = {}
            code = np.array([place.setdefault(k, len(place)) for k in keys])
            w = _counts(batch.column("_words"), n_boot)
            parts = np.empty((len(place), 1 + len(measures), n_boot))
            values = [np.ones(len(code)), *(batch.column(m).to_numpy(zero_copy_only=False) for m in measures)]
            odd = [not np.isfinite(v).all() for v in values]
            for draw in range(n_boot):
                own = w[draw].astype(float)
                if squared:
                    own *= own
                for i, v in enumerate(values):
                    parts[:, i, draw] = np.bincount(code, np.where(own > 0, own * v, 0.0) if odd[i] else own * v if i else own, len(place))
            for key, i in place.items():
                held[key] = held[key] + parts[i] if key in held else parts[i]
            if len(held) * parts[0].size > most:
                yield from out()
        yield from out()

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame, arrow, preserve_index=False)

    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    parts = rows.select(*by, *numbers, F.col(hashed).alias("_words")).mapInArrow(batched, schema)
    return parts.groupBy(*by, "draw").agg(*[F.sum(c).alias(c) for c in names[len(by) + 1 :]])


def _bounds(drawn: DataFrame, by: list[str], value: str, alpha: float) -> DataFrame:
    return drawn.groupBy(*by).agg(F.percentile(value, F.lit(alpha / 2)).alias("ci_low"), F.percentile(value, F.lit(1 - alpha / 2)).alias("ci_high"))


def cluster_accuracy(turns: DataFrame, by: list[str], good: str, total: str, cluster: str, n_boot: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(by, turns, accuracy, ci_low, ci_high) from counts by cluster. A cluster that counts m times counts m squared times: its copies pair with each other."""
    own = turns.select(*by, F.col(good).alias("_g"), F.col(total).alias("_t"), words(F.col(cluster), n_boot, seed).alias("_words"))
    drawn = totals(own, by, "_words", ["_g", "_t"], n_boot, squared=True)
    values = drawn.where("_t > 0").withColumn("_v", F.col("_g") / F.col("_t"))
    whole = turns.groupBy(*by).agg(F.count("*").alias("turns"), F.try_divide(F.sum(good), F.sum(total)).alias("accuracy"))
    return whole.join(_bounds(values, by, "_v", alpha), by, "left")


def mean_test(rows: DataFrame, by: list[str], value: str, unit: Column, n_boot: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(by, n, mean, ci_low, ci_high, p): bounds of the mean and its two-sided bootstrap p, the draws on the rarer side of zero; units of ``unit`` (a column's expression, different for each row). Null values do not count."""
    own = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"), unit.alias("_u"))
    drawn = totals(own.withColumn("_words", words(F.col("_u"), n_boot, seed)), by, "_words", ["_x"], n_boot).withColumn("_m", F.col("_x") / F.col("weight"))
    rarer = F.least(F.count_if(F.col("_m") <= 0), F.count_if(F.col("_m") >= 0))
    tests = drawn.groupBy(*by).agg(F.percentile("_m", F.lit(alpha / 2)).alias("ci_low"), F.percentile("_m", F.lit(1 - alpha / 2)).alias("ci_high"), F.least(F.lit(1.0), 2 * (rarer + 1) / (F.count("*") + 1)).alias("p"))
    return own.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_x").alias("mean")).join(tests, by, "left")


def tau_change(scores: DataFrame, by: list[str], human: str, before: str, after: str, n_boot: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(by, turns, ci_low, ci_high, excludes_zero): bounds of the change of Kendall's tau with the human board, turns of two editors or more being the units. Means count to twelve digits."""
    turn = W.partitionBy(*by, "turn")
    names = [(human, "_h"), (before, "_b"), (after, "_a")]
    own = scores.dropna(subset=[human, before, after])
    own = own.withColumn("_n", F.count("*").over(turn)).select(*by, "turn", "editor", "_n", *[(F.col(c) - F.avg(c).over(turn)).alias(n) for c, n in names]).where("_n >= 2").drop("_n")
    # A turn is hashed once, whatever the number of its editors.
    turns = own.groupBy(*by, "turn").agg(F.collect_list(F.struct("editor", *[n for _, n in names])).alias("_e")).withColumn("_words", words(F.col("turn"), n_boot, seed))
    played = turns.select(*by, "_words", F.explode("_e").alias("_e")).select(*by, "_words", "_e.*")
    means = [F.round(F.col(n) / F.col("weight"), 12).alias(n) for _, n in names]
    boards = totals(played, [*by, "editor"], "_words", [n for _, n in names], n_boot).select(*by, "draw", "editor", *means)
    old, new = (kendall_tau_b(boards, [*by, "draw"], "editor", x, "_h").select(*by, "draw", F.col("tau").alias(f"_t{x}")) for x in ("_b", "_a"))
    drawn = old.join(new, [*by, "draw"]).withColumn("_v", F.col("_t_a") - F.col("_t_b")).where("_v is not null")
    whole = own.groupBy(*by).agg(F.count_distinct("turn").alias("turns"))
    return whole.join(_bounds(drawn, by, "_v", alpha), by, "left").withColumn("excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))
