"""Set operators: overlap of two pools, first-wins unions, references that lead nowhere, audits of expected against found."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairwright.functions.stats import ratio
from pairwright.functions.text import normalize_instruction

# Shares at which a pool is refused, or needs its overlap excluded.
REJECT_AT, TEXT_MAX, PIXEL_MAX = 0.60, 0.10, 0.05


def pool_overlap(new: DataFrame, other: DataFrame, text: str, content: str) -> DataFrame:
    """One row: distinct normalised texts and content hashes of both pools, how many they share, the shares of the new one."""
    sides = []
    for name, value in (("text", normalize_instruction(F.col(text))), ("content", F.sha1(F.col(content)))):
        sides += [d.select(F.lit(name).alias("kind"), value.alias("v"), F.lit(i).alias("side")) for i, d in enumerate((new, other))]
    values = reduce(lambda a, b: a.unionByName(b), sides).where("v is not null").groupBy("kind", "v").agg(F.max((F.col("side") == 0).cast("int")).alias("a"), F.max("side").alias("b"))
    counts = []
    for kind in ("text", "content"):
        own = F.col("kind") == kind
        counts += [F.count(F.when(own & (F.col("a") == 1), 1)).alias(f"{kind}_new"), F.count(F.when(own & (F.col("b") == 1), 1)).alias(f"{kind}_other"), F.count(F.when(own & (F.col("a") == 1) & (F.col("b") == 1), 1)).alias(f"{kind}_shared")]
    return values.agg(*counts).select("*", ratio(F.col("text_shared"), F.col("text_new")).alias("text_share"), ratio(F.col("content_shared"), F.col("content_new")).alias("content_share"))


def overlap_examples(new: DataFrame, other: DataFrame, text: str, n: int = 5) -> DataFrame:
    """The first n normalised texts that both pools hold, in order."""
    a, b = (d.select(normalize_instruction(F.col(text)).alias("example")) for d in (new, other))
    return a.intersect(b).where("example is not null").orderBy("example").limit(n)


def verdict(text_share: Column, *pixel_shares: Column) -> Column:
    """The worst dimension decides: reject, needs_exclusion or independent."""
    worst = F.greatest(*[F.coalesce(s, F.lit(0.0)) for s in (text_share, *pixel_shares)])
    pixel = F.greatest(*[F.coalesce(s, F.lit(0.0)) for s in (*pixel_shares, F.lit(0.0))])
    return F.when(worst >= REJECT_AT, "reject").when((F.coalesce(text_share, F.lit(0.0)) >= TEXT_MAX) | (pixel >= PIXEL_MAX), "needs_exclusion").otherwise("independent")


def first_wins(tables: list[DataFrame], key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows with each key once, duplicates): the earlier table wins, then the earlier row."""
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("_t", F.lit(i)) for i, t in enumerate(tables)])
    ranked = united.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("_t", order)))
    return ranked.where("_n = 1").drop("_n", "_t"), ranked.where("_n > 1").groupBy(key).agg(F.count("*").alias("dropped"))


def dangling(references: DataFrame, columns: list[str], targets: DataFrame, key: str) -> DataFrame:
    """(column, id, n): ids in reference columns that the target table lacks."""
    long = references.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("id")) for c in columns])).alias("r")).select("r.*").where("id is not null")
    return long.join(targets.select(F.col(key).cast("string").alias("id")), "id", "left_anti").groupBy("column", "id").agg(F.count("*").alias("n"))


def audit(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """(status, n): keys that are missing, extra or there more than once."""
    have = found.groupBy(*key).agg(F.count("*").alias("n_found"))
    both = expected.select(*key).distinct().withColumn("_e", F.lit(1)).join(have, key, "full_outer")
    status = F.when(F.col("n_found").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("n_found") > 1, "duplicate").otherwise("ok")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def composite_key(*columns: Column) -> Column:
    return F.concat_ws("|", *columns)


def excluded(df: DataFrame, exclusions: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is on no exclusion list."""
    return df.join(exclusions.select(*key), key, "left_anti")


def near_duplicates(sample: DataFrame, against: DataFrame, key: str, vector: str, at_least: float, block: int = 2000) -> DataFrame:
    """(key, other, cosine): for each sampled row its most similar row of at least ``at_least`` cosine, the smallest key among equals. Exact: the sample's
    product with all rows, in blocks of at most ``block`` by ``block``; this detector stands in for image feature matching."""
    kind = sample.schema[key].dataType.simpleString()

    def packed(df: DataFrame, n: str) -> DataFrame:
        def pack(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                batch = batch.dropna()
                for lo in range(0, len(batch), block):
                    part = batch.iloc[lo : lo + block]
                    yield pd.DataFrame({f"k{n}": [part["k"].tolist()], f"v{n}": [np.stack(part["v"].to_list()).astype(float).tobytes()]})

        return df.select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v")).mapInPandas(pack, f"k{n} array<{kind}>, v{n} binary")

    def best(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for kx, vx, ky, vy in zip(batch["kx"], batch["vx"], batch["ky"], batch["vy"], strict=True):
                x, y = (np.frombuffer(v).reshape(len(k), -1) for k, v in ((kx, vx), (ky, vy)))
                with np.errstate(invalid="ignore", divide="ignore"):
                    x, y = (v / np.sqrt((v * v).sum(axis=1, keepdims=True)) for v in (x, y))
                by = np.argsort(np.asarray(ky), kind="stable")
                ky, cosine = np.asarray(ky)[by], np.round(np.nan_to_num(x @ y[by].T, nan=-2.0), 12)
                cosine[np.asarray(kx)[:, None] == ky] = -2.0
                at = cosine.argmax(axis=1)
                top = cosine[np.arange(len(at)), at]
                near = top >= at_least
                yield pd.DataFrame({"x": np.asarray(kx)[near], "y": ky[at][near], "cosine": top[near]})

    met = packed(sample, "x").crossJoin(packed(against, "y")).mapInPandas(best, f"x {kind}, y {kind}, cosine double")
    return met.groupBy(F.col("x").alias(key)).agg(F.max_by("y", F.struct("cosine", -F.col("y"))).alias("other"), F.max("cosine").alias("cosine"))
