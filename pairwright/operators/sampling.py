"""Seeded draws that do not depend on the order of rows or on other strata: order by md5(seed:stratum:tier:id), take a prefix. A larger draw
holds the smaller one. Each draw is one ranked aggregation that tasks limit before the shuffle (window group limit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairwright.functions.stats import cumulated
from pairwright.functions.text import seeded_key


def stratified_take(df: DataFrame, stratum: list[str], key: str, k: int | Column, seed: int = 42, tier: str | None = None) -> DataFrame:
    """The first k of each stratum, low tiers first, in seeded order; adds ``place``."""
    t = F.col(tier) if tier else F.lit(0)
    order = seeded_key(seed, *map(F.col, stratum), t, F.col(key))
    place = F.row_number().over(W.partitionBy(*stratum).orderBy(t, order, key))
    return df.withColumn("place", place).where(F.col("place") <= k)


def shortfall(df: DataFrame, stratum: list[str], k: int) -> DataFrame:
    """(stratum, available, missing) of strata with fewer rows than wanted."""
    return df.groupBy(*stratum).agg(F.count("*").alias("available")).where(F.col("available") < k).withColumn("missing", k - F.col("available"))


def whole_turns(df: DataFrame, stratum: str, turns: int, editors: int, seed: int = 42) -> DataFrame:
    """All of a turn or nothing: turns of two rated editors at least, the first ``turns`` a stratum in seeded order, at most ``editors`` of each."""
    rated = df.where("human is not null")
    sizes = rated.groupBy(stratum, "turn").agg(F.count("*").alias("_n")).where("_n >= 2")
    picked = stratified_take(sizes, [stratum], "turn", turns, seed).select(stratum, "turn")
    return stratified_take(rated.join(picked, [stratum, "turn"], "left_semi"), [stratum, "turn"], "editor", editors, seed)


def evenly_spaced(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """n rows of each group, evenly spread over its order: those at floor(i * size / n). The order begins with a
    number; rows that tie in all of it stand in any order."""
    ranked = cumulated(df.withColumns({"_v": F.struct(*order), "_one": F.lit(1)}), by, "_v", "_one", head=order[0]).withColumn("_i", F.col("_upto") - 1)
    # the i-th pick is at floor(i * size / n): a row is a pick if some i lands on it
    i = F.ceil(F.col("_i") * n / F.col("_size"))
    hit = (F.col("_size") <= n) | ((i < n) & (F.floor(i * F.col("_size") / n) == F.col("_i")))
    return ranked.where(hit).drop("_i", "_size", "_upto", "_v", "_one")


def value_at(df: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(by, a column a place): the values at places (from 0) of each group's sorted values, from counts by value. A place may use ``_size``, the
    group's rows; null values are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    at = lambda p: (F.col("_upto") > p) & (F.col("_upto") - F.col("_n") <= p)
    return cumulated(counts, by, value, "_n").groupBy(*by).agg(*[F.max(F.when(at(p), F.col(value))).alias(c) for c, p in places.items()])


def value_tertiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """Adds ``tertile`` (low, mid, high) by the cut values at places n/3 and 2n/3 of the sorted values of each group; equal values stay together, null
    has none."""
    cuts = value_at(df, [by], value, {"_c1": F.floor(F.col("_size") / 3), "_c2": F.floor(2 * F.col("_size") / 3)})
    v = F.col(value)
    tertile = F.when(v < F.col("_c1"), "low").when(v < F.col("_c2"), "mid").when(v.isNotNull(), "high")
    return df.join(cuts, by).withColumn("tertile", tertile).drop("_c1", "_c2")


def derangement(names: DataFrame, name: str, seed: int = 42) -> DataFrame:
    """(name, other): each name of a short list gets another one: seeded order, each takes the next, the last the first."""
    w = W.orderBy(seeded_key(seed, F.col(name)))
    own = names.select(name).distinct()
    ring = own.withColumn("other", F.lead(name).over(w)).withColumn("_first", F.first(name).over(w))
    return ring.select(name, F.coalesce("other", "_first").alias("other"))


def blind_sheet(df: DataFrame, stratum: list[str], key: str, k: int, seed: int = 42) -> DataFrame:
    """A stratified draw in one shuffled order, numbered from 1, with nothing that tells its stratum but the key sheet."""
    drawn = stratified_take(df, stratum, key, k, seed).drop("place")
    return drawn.withColumn("index", F.row_number().over(W.orderBy(seeded_key(seed, F.lit("sheet"), F.col(key)))))


def expand_targets(samples: DataFrame, cues: list[str | None], repeats: int = 1) -> DataFrame:
    """One job a sample, condition and ask, with its id."""
    cue = F.explode(F.array(*[F.lit(c) for c in cues])).alias("cue")
    jobs = samples.select("*", cue).withColumn("repeat_index", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return jobs.withColumn("result_id", F.concat_ws("__", "sample_id", F.coalesce("cue", F.lit("base")), F.concat(F.lit("r"), F.col("repeat_index"))))


def outstanding(samples: DataFrame, cues: list[str | None], repeats: int, done: DataFrame) -> DataFrame:
    """The jobs of ``expand_targets`` less those whose (sample_id, result_id) is in ``done``: a sample meets its finished jobs before it is expanded, so that a row a sample is shuffled, not one a job."""
    own = done.groupBy("sample_id").agg(F.collect_set("result_id").alias("_done"))
    jobs = expand_targets(samples.join(own, "sample_id", "left"), cues, repeats)
    return jobs.where(F.col("_done").isNull() | ~F.array_contains("_done", F.col("result_id"))).drop("_done")
