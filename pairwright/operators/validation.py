"""Validators, raters and human labels: agreement coefficients, sensitivity on fixed and own denominators, matched floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairwright.functions.stats import count_if, kappa, mcnemar_exact, ratio, share, wilson


def rater_agreement(ratings: DataFrame, by: list[str], first: str, second: str, levels: list) -> DataFrame:
    """Two raters' confusion reduced to po, Cohen's kappa and its maximum, Scott's pi, Gwet's AC1 and PABAK."""
    n = F.count("*").cast("double")
    m1, m2 = ([count_if(F.col(c) == v) / n for v in levels] for c in (first, second))
    k = len(levels)
    po = share(F.col(first) == F.col(second))
    total = lambda cs: sum(cs[1:], cs[0])
    pe = total([a * b for a, b in zip(m1, m2, strict=True)])
    most = total([F.least(a, b) for a, b in zip(m1, m2, strict=True)])
    pi = [(a + b) / 2 for a, b in zip(m1, m2, strict=True)]
    pe_pi, pe_ac1 = total([p * p for p in pi]), total([p * (1 - p) for p in pi]) / (k - 1)
    own = ratings.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    return own.groupBy(*by).agg(F.count("*").alias("n"), po.alias("po"), kappa(po, pe).alias("kappa"), kappa(most, pe).alias("kappa_max"), kappa(po, pe_pi).alias("pi"), kappa(po, pe_ac1).alias("ac1"), ((k * po - 1) / (k - 1)).alias("pabak"))


def with_total(df: DataFrame, by: list[str], cell: str, aggs: list[Column]) -> DataFrame:
    """Aggregates by cell and an ``ALL`` row over all cells, in one pass."""
    grouped = df.rollup(*by, cell).agg(F.grouping_id().alias("_g"), *aggs)
    return grouped.where(F.col("_g").isin(0, 1)).withColumn(cell, F.when(F.col("_g") == 1, "ALL").otherwise(F.col(cell))).drop("_g")


def validator_agreement(df: DataFrame, by: list[str], cell: str) -> DataFrame:
    """Human and validator fails a cell and in all: both fail, what independence expects, agreement, kappa. Columns human_fail, validator_fail."""
    n = F.count("*").cast("double")
    h, v = F.sum(F.col("human_fail").cast("long")), F.sum(F.col("validator_fail").cast("long"))
    po = share(F.col("human_fail") == F.col("validator_fail"))
    pe = (h / n) * (v / n) + (1 - h / n) * (1 - v / n)
    return with_total(df, by, cell, [F.count("*").alias("n"), h.alias("human_fails"), v.alias("validator_fails"), count_if(F.col("human_fail") & F.col("validator_fail")).alias("both_fail"), (h * v / n).alias("expected_both"), po.alias("agreement"), kappa(po, pe).alias("kappa")])


def cue_rates(labels: DataFrame, cue: str, label: str, strict: tuple = ("Yes",), loose: tuple = ("Yes", "Slightly"), placebo: str = "sham") -> DataFrame:
    """(cue, threshold, n, hits, rate, ci, placebo_n, placebo_hits) at two thresholds of a label."""
    cases = labels.withColumn("_t", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(label).isin(*s).alias("hit")) for t, s in (("strict", strict), ("loose", loose))])))
    rates = cases.groupBy(F.col(cue).alias("cue"), "_t.threshold").agg(F.count("*").alias("n"), F.sum(F.col("_t.hit").cast("long")).alias("hits"))
    own = rates.where(F.col("cue") == placebo).select("threshold", F.col("n").alias("placebo_n"), F.col("hits").alias("placebo_hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return rates.join(own, "threshold", "left").withColumns({"rate": F.col("hits") / F.col("n"), "ci_low": low, "ci_high": high})


def matched_floor(arm: DataFrame, control: DataFrame, by: list[str], key: str) -> DataFrame:
    """Arm and control on the same base: both pass rates, discordant counts, McNemar's p. Both have (by, key, passed)."""
    both = arm.select(*by, key, F.col("passed").alias("_a")).join(control.select(*[c for c in by if c in control.columns], key, F.col("passed").alias("_c")), [*[c for c in by if c in control.columns], key])
    out = both.groupBy(*by).agg(F.count("*").alias("n"), share(F.col("_a")).alias("pass_rate"), share(F.col("_c")).alias("floor_rate"), count_if(F.col("_c") & ~F.col("_a")).alias("lost"), count_if(~F.col("_c") & F.col("_a")).alias("gained"))
    return out.withColumn("p_matched", mcnemar_exact(F.col("lost"), F.col("gained")))


def sensitivity(manifest: DataFrame, damaged: DataFrame, published: DataFrame, weak_below: float) -> DataFrame:
    """For each validator and condition: detection among all images that are not weakly damaged (fixed) and among those with a verdict (own), with
    Wilson bounds, false flags of the same images, discrimination, McNemar. manifest: condition, base, change; the others: validator, base, passed
    (damaged also condition)."""
    fixed = manifest.where(F.col("change") >= weak_below)
    sizes = fixed.groupBy("condition").agg(F.count_distinct("base").alias("n_fixed"))
    seen = damaged.join(fixed.select("condition", "base"), ["condition", "base"], "left_semi").join(published.select("validator", "base", F.col("passed").alias("clean_pass")), ["validator", "base"], "left")
    caught, flagged = ~F.col("passed"), ~F.col("clean_pass")
    out = seen.groupBy("validator", "condition").agg(F.count("*").alias("n_own"), count_if(caught).alias("caught"), count_if(flagged).alias("false_flags"), F.count("clean_pass").alias("n_clean"), count_if(caught & ~flagged).alias("only_damaged"), count_if(~caught & flagged).alias("only_clean")).join(sizes, "condition")
    low, high = wilson(F.col("caught"), F.col("n_fixed"))
    return out.withColumns({"sens_fixed": F.col("caught") / F.col("n_fixed"), "sens_own": F.col("caught") / F.col("n_own"), "ci_low": low, "ci_high": high, "false_flag_rate": ratio(F.col("false_flags"), F.col("n_clean"))}).withColumns(
        {"discrimination": F.col("sens_fixed") - F.col("false_flag_rate"), "p_mcnemar": mcnemar_exact(F.col("only_damaged"), F.col("only_clean"))}
    )


def pass_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Pass rate, mean and least similarity."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), share(F.col("passed")).alias("pass_rate"), F.avg("ssim").alias("mean_ssim"), F.min("ssim").alias("min_ssim"))


def duplicate_groups(df: DataFrame, digest: str, key: str) -> DataFrame:
    """(digest, size, first, dup_group): groups of two rows and more, numbered by the place of their hexadecimal digest among all digests
    from 0. Places come from counts by the first three digits, so no task ranks all digests."""
    groups = df.groupBy(digest).agg(F.count("*").alias("size"), F.min(key).alias("first")).withColumn("_head", F.substring(digest, 1, 3))
    heads = groups.groupBy("_head").agg(F.count("*").alias("_n"))  # 4096 rows at most
    before = heads.select("_head", (F.sum("_n").over(W.orderBy("_head")) - F.col("_n")).alias("_before"))
    placed = groups.join(before, "_head").withColumn("dup_group", (F.col("_before") + F.row_number().over(W.partitionBy("_head").orderBy(digest)) - 1).cast("long"))
    return placed.where("size > 1").select(digest, "size", "first", "dup_group")


def coverage_grid(df: DataFrame, rows: str, columns: str, most: int = 1000) -> DataFrame:
    """Counts of every combination of the two columns' values, zeros too. The columns' values are few (an error over ``most``)."""
    values = [r[0] for r in df.select(columns).distinct().where(F.col(columns).isNotNull()).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{columns} has more than {most} values")
    grid = df.select(rows).distinct().where(F.col(rows).isNotNull()).select(rows, F.explode(F.array(*map(F.lit, sorted(values)))).alias(columns))
    counts = df.groupBy(rows, columns).agg(F.count("*").alias("n"))
    return grid.join(counts, [rows, columns], "left").select(rows, columns, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
