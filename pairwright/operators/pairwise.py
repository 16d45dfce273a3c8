"""Pairwise operators: display order, repeated asks, cues on one side, reconciliation of two orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.stats import count_if, mcnemar_exact, ratio, share

LETTERS = ("A", "B", "Tie")


def inverted(winner: Column) -> Column:
    """The side a letter of the swapped display stands for."""
    return F.when(winner == "A", "B").when(winner == "B", "A").otherwise(winner)


def last_verdict(df: DataFrame, by: list[str], value: str = "winner") -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max_by(value, "ord").alias(value))


def position_flips(pairs: DataFrame, by: list[str]) -> DataFrame:
    """From winner (own order) and swapped (letter displayed when swapped): robustness rate, strict and soft flips, share of slot A
    before and after, McNemar's p over decided flips."""
    back = inverted(F.col("swapped"))
    decided = F.col("winner").isin("A", "B") & back.isin("A", "B")
    up, down = count_if((F.col("winner") == "A") & (back == "B")), count_if((F.col("winner") == "B") & (back == "A"))
    out = pairs.where("winner is not null and swapped is not null").groupBy(*by).agg(
        F.count("*").alias("n"), share(F.col("winner") == back).alias("rr"), share(decided & (F.col("winner") != back)).alias("strict_flip_rate"), share(F.col("winner") != back).alias("soft_flip_rate"),
        share(F.col("winner") == "A").alias("slot_a_before"), share(F.col("swapped") == "A").alias("slot_a_after"), up.alias("a_to_b"), down.alias("b_to_a"),
    )
    return out.withColumn("p_mcnemar", mcnemar_exact(F.col("a_to_b"), F.col("b_to_a")))


def position_joint(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The 3 by 3 table of displayed letters (before_after, zeros kept), the rate of the same slot and of sticking to slot A or B."""
    cells = [count_if((F.col("winner") == x) & (F.col("swapped") == y)).alias(f"{x}_{y}".lower()) for x in LETTERS for y in LETTERS]
    same = F.col("winner") == F.col("swapped")
    return pairs.where("winner is not null and swapped is not null").groupBy(*by).agg(F.count("*").alias("n"), *cells, share(same).alias("same_slot_rate"), share(same & (F.col("winner") != "Tie")).alias("sticky_rate"))


def consistency(asks: DataFrame, by: list[str], item: str) -> DataFrame:
    """Agreement of the first two asks (by ask, then winner) of an item: consistency, strict flips, ties won or lost."""
    order = F.struct("repeat_index", "winner")
    two = asks.where("winner is not null").groupBy(*by, item).agg(F.slice(F.array_sort(F.collect_list(order)), 1, 2).alias("two")).where(F.size("two") == 2)
    a, b = F.col("two")[0]["winner"], F.col("two")[1]["winner"]
    return two.groupBy(*by).agg(F.count("*").alias("n"), share(a == b).alias("cr"), share((a != b) & (a != "Tie") & (b != "Tie")).alias("strict_flip_rate"), share((a == "Tie") != (b == "Tie")).alias("tie_churn"))


def one_sided(pairs: DataFrame, by: list[str]) -> DataFrame:
    """From winner (baseline), cued, side (that wears the cue) and preference (null unless decisive): how the dressed side fares, flips to and from
    it, ties, and accuracy, pooled and split by whether the cue sits on the better side."""
    on = lambda c: F.col(c) == F.col("side")
    known = F.col("preference").isin("A", "B")
    right = lambda c: F.col(c) == F.col("preference")
    better = F.col("side") == F.col("preference")
    acc = lambda c, where: ratio(count_if(where & right(c)), count_if(where))
    out = pairs.where("winner is not null and cued is not null").groupBy(*by).agg(
        F.count("*").alias("n"), share(on("winner")).alias("dressed_before"), share(on("cued")).alias("dressed_after"), (F.sum(on("cued").cast("long") - on("winner").cast("long")) / F.count("*")).alias("advantage"),
        count_if(~on("winner") & on("cued")).alias("flips_toward"), count_if(on("winner") & ~on("cued")).alias("flips_away"), share(F.col("winner") == "Tie").alias("tie_before"), share(F.col("cued") == "Tie").alias("tie_after"),
        count_if(known).alias("n_decisive"), acc("winner", known).alias("acc_before"), acc("cued", known).alias("acc_after"), acc("cued", known & better).alias("acc_cue_on_winner"), acc("cued", known & ~better).alias("acc_cue_on_loser"),
    )
    return out.withColumn("p_advantage", mcnemar_exact(F.col("flips_toward"), F.col("flips_away")))


def reconciled(pairs: DataFrame) -> DataFrame:
    """The four ways to settle two display orders, a row each: own order, swapped order, only what both say, and what both say or else a tie."""
    back = inverted(F.col("swapped"))
    arms = {"single": F.col("winner"), "swapped": back, "agree_only": F.when(F.col("winner") == back, F.col("winner")), "agree_or_tie": F.when(F.col("winner") == back, F.col("winner")).otherwise("Tie")}
    return pairs.withColumn("_arm", F.explode(F.array(*[F.struct(F.lit(k).alias("arm"), v.alias("settled")) for k, v in arms.items()]))).select("*", "_arm.arm", "_arm.settled").drop("_arm")


def swap_average(pairs: DataFrame, by: list[str]) -> DataFrame:
    """For each arm: coverage (decided share), accuracy on decided and on all decisive pairs, against the single order."""
    arms = reconciled(pairs.where("preference in ('A', 'B') and winner is not null and swapped is not null"))
    decided = F.coalesce(F.col("settled").isin("A", "B"), F.lit(False))
    right, base = F.coalesce(F.col("settled") == F.col("preference"), F.lit(False)), F.col("winner") == F.col("preference")
    out = arms.groupBy(*by, "arm").agg(
        F.count("*").alias("n"), share(decided).alias("coverage"), ratio(count_if(decided & right), count_if(decided)).alias("acc_decided"), share(right).alias("acc_all"), ratio(count_if(decided & base), count_if(decided)).alias("single_on_retained"),
        count_if(right & ~base).alias("gained"), count_if(~right & base).alias("lost"),
    )
    return out.withColumn("p_all", mcnemar_exact(F.col("gained"), F.col("lost")))


def chance_levels(flips: DataFrame) -> DataFrame:
    """What RR and CR would be if letters were drawn by slot rates alone."""
    a, b = F.col("slot_a_before"), F.col("slot_a_after")
    return flips.withColumn("rr_chance", a * (1 - b) + (1 - a) * b).withColumn("cr_chance", a * a + (1 - a) * (1 - a))


def majority_vote(votes: DataFrame, by: list[str], vote: str = "vote") -> DataFrame:
    """(by, n_a, n_b, n_tie, preference, margin): a tie where neither side leads or ties outnumber both."""
    n = [count_if(F.col(vote) == v) for v in ("A", "B", "Tie")]
    out = votes.groupBy(*by).agg(n[0].alias("n_a"), n[1].alias("n_b"), n[2].alias("n_tie"))
    tie = (F.col("n_tie") > F.greatest("n_a", "n_b")) | (F.col("n_a") == F.col("n_b"))
    return out.withColumn("preference", F.when(tie, "tie").when(F.col("n_a") > F.col("n_b"), "a").otherwise("b")).withColumn("margin", ratio(F.col("n_a") - F.col("n_b"), F.col("n_a") + F.col("n_b") + F.col("n_tie")))
