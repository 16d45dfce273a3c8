"""Agreement with human rankings: items, within-turn pairs, accuracy, net discordance, leaderboards.

A turn is a cluster of a handful of editors, so the self-join by turn is bounded by editors a turn, not by the size of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairwright.functions.stats import board_rank, count_if, kendall_tau_b, share

MIN_EFFECT = 0.5


def human_sd(samples: DataFrame, by: str = "source", human: str = "human") -> DataFrame:
    """(by, sd): the sample standard deviation of each source with two scores at least."""
    return samples.where(F.col(human).isNotNull()).groupBy(by).agg(F.stddev_samp(human).alias("sd"), F.count("*").alias("_n")).where("_n >= 2").drop("_n")


def build_items(samples: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """samples (sample_id, human, ...) with a human score, joined to before (inner) and after (left)."""
    return samples.where("human is not null").join(before, "sample_id").join(after, "sample_id", "left")


def derived_pairs(items: DataFrame, sds: DataFrame, min_effect: float = MIN_EFFECT, keep: tuple[str, ...] = ("source", "turn")) -> DataFrame:
    """Within-turn comparisons that humans decide: their gap is no tie and reaches ``min_effect`` standard deviations of the source (no
    threshold where that is missing or zero). Items have editor, human, before, after."""
    side = lambda s: items.select(*keep, *[F.col(c).alias(f"{c}_{s}") for c in ("editor", "human", "before", "after")])
    both = side("a").join(side("b"), list(keep)).where("editor_a < editor_b").join(sds, "source", "left")
    gap = F.col("human_a") - F.col("human_b")
    decisive = (gap != 0) & (F.col("sd").isNull() | (F.col("sd") == 0) | (F.abs(gap) >= min_effect * F.col("sd")))
    agree = lambda c: F.signum(F.col(f"{c}_a") - F.col(f"{c}_b")) == F.signum(gap)
    graded = both.where(decisive)
    return graded.withColumns({"right_before": agree("before"), "right_after": agree("after"), "tie_before": F.col("before_a") == F.col("before_b"), "tie_after": F.col("after_a") == F.col("after_b")})


def accuracy(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Share of decisive pairs that the judge orders like the humans (a judge's tie is wrong), ties, and the discordant counts."""
    own = pairs.where("right_before is not null and right_after is not null")
    return own.groupBy(*by).agg(
        F.count("*").alias("n_pairs"), share(F.col("right_before")).alias("acc_before"), share(F.col("right_after")).alias("acc_after"), share(F.col("tie_before")).alias("tie_before"), share(F.col("tie_after")).alias("tie_after"),
        count_if(~F.col("right_before") & F.col("right_after")).alias("fixed"), count_if(F.col("right_before") & ~F.col("right_after")).alias("broken"),
    )


def net_discordance(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, turn, net): pairs put right less pairs put wrong in each turn, zero ones too."""
    step = F.col("right_after").cast("int") - F.col("right_before").cast("int")
    return pairs.where("right_before is not null and right_after is not null").groupBy(*by, "turn").agg(F.sum(step).alias("net"), F.count("*").alias("n"), F.sum(F.col("right_before").cast("long")).alias("good"))


def distinct_editor_pairs(samples: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """Pairs of different editors of a turn (their first sample each), at most ``cap`` a turn in a seeded order, numbered."""
    first = samples.groupBy("source", "turn", "editor").agg(F.min("sample_id").alias("sample_id"))
    a, b = (first.select("source", "turn", F.col("editor").alias(f"editor_{s}"), F.col("sample_id").alias(f"sample_id_{s}")) for s in "ab")
    both = a.join(b, ["source", "turn"]).where("editor_a < editor_b")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "sample_id_a", "sample_id_b"))
    ranked = both.withColumn("place", F.row_number().over(W.partitionBy("source", "turn").orderBy(order)))
    return ranked.where(F.col("place") <= cap).withColumn("pair_id", F.concat_ws("_", "source", F.col("turn").cast("string"), F.lpad(F.col("place").cast("string"), 2, "0")))


def decisive_tier(pairs: DataFrame, sds: DataFrame, min_effect: float = MIN_EFFECT) -> DataFrame:
    """Tier 0: the gap reaches ``min_effect`` deviations of its source; 1: it has a preference but is smaller, or its source has no deviation; 2: no
    preference. pairs have source, gap, preference."""
    reach = (F.col("sd") > 0) & (F.abs("gap") >= min_effect * F.col("sd"))
    has = F.col("preference").isin("A", "B", "a", "b")
    return pairs.join(sds, "source", "left").withColumn("tier", F.when(has & F.coalesce(reach, F.lit(False)), 0).when(has, 1).otherwise(2))


# ---- leaderboards ----


def turn_centred_means(scores: DataFrame, by: list[str], score: str) -> DataFrame:
    """(by, editor, mean): mean of score less the turn's mean, over turns with two editors at least; ``by`` names the board."""
    w = W.partitionBy(*by, "turn")
    own = scores.where(F.col(score).isNotNull()).withColumn("_c", F.col(score) - F.avg(score).over(w)).withColumn("_n", F.count("*").over(w))
    return own.where("_n >= 2").groupBy(*by, "editor").agg(F.avg("_c").alias("mean"), F.count("*").alias("turns"))


def leaderboard(scores: DataFrame, by: list[str], score: str) -> DataFrame:
    """Editors of a board with their turn-centred mean and rank (1 best, ties share the average rank)."""
    return board_rank(turn_centred_means(scores, by, score), by, "mean", "rank", descending=True)


def cued_sums(scores: DataFrame, by: list[str], clean: str, cued: str) -> DataFrame:
    """(by, target, editor and sums and counts of the editor's turn-centred scores: clean, with the target cued, all cued) over the turns that both play in. Rows carry their
    turn's targets, with what cueing each of them adds to the turn, so that they are not met and sorted again by target; what is summed by board, target and editor is small. A missing cued score is
    dropped, never replaced by the clean one."""
    turn, each = W.partitionBy(*by, "turn"), W.partitionBy(*by, "turn", "editor")
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    own = scores.select(*by, "turn", "editor", F.col(clean).cast("double").alias("_clean"), F.col(cued).cast("double").alias("_cued"))
    named = lambda c, none: F.when(F.col("editor").isNotNull(), c).otherwise(none)
    own = own.withColumn("_ds", named(total("_cued", each) - total("_clean", each), 0.0)).withColumn("_dn", named(F.count("_cued").over(each) - F.count("_clean").over(each), 0))
    own = own.withColumns({f"_s{c}": total(c, turn) for c in ("_clean", "_cued")} | {f"_n{c}": F.count(c).over(turn) for c in ("_clean", "_cued")} | {"_targets": F.collect_set(F.struct(F.col("editor").alias("target"), "_ds", "_dn")).over(turn)})
    met = own.drop("_ds", "_dn").select("*", F.inline("_targets"))
    played = F.when(F.col("editor") == F.col("target"), F.col("_cued")).otherwise(F.col("_clean"))
    centred = lambda x, s, n: F.when(n >= 2, x - F.try_divide(s, n))
    met = met.withColumn("_c0", centred(F.col("_clean"), F.col("_s_clean"), F.col("_n_clean"))).withColumn("_ca", centred(F.col("_cued"), F.col("_s_cued"), F.col("_n_cued")))
    met = met.withColumn("_c1", centred(played, F.col("_s_clean") + F.col("_ds"), F.col("_n_clean") + F.col("_dn")))
    return met.groupBy(*by, "target", "editor").agg(*[f(c).alias(n + c[2:]) for c in ("_c0", "_c1", "_ca") for n, f in (("_s", lambda c: F.coalesce(F.sum(c), F.lit(0.0))), ("_n", F.count))])


def _own_sums(sums: DataFrame, by: list[str]) -> DataFrame:
    """(by, editor, sums and counts of all turns): an editor plays in each of its turns beside itself."""
    return sums.where(F.col("editor").eqNullSafe(F.col("target"))).select(*by, "editor", "_s0", "_n0", "_sa", "_na")


def single_means(sums: DataFrame, by: list[str]) -> DataFrame:
    """(by, target, editor, mean) of ``cued_sums``: only turns that the target plays in differ from the clean board; sums and counts of all others come from there."""
    own = _own_sums(sums, by).select(*by, "editor", "_s0", "_n0")
    every = own.join(own.select(*by, F.col("editor").alias("target")), by)  # a board has few editors
    moved = sums.select(*by, "target", "editor", (F.col("_s1") - F.col("_s0")).alias("_ds"), (F.col("_n1") - F.col("_n0")).alias("_dn"))
    whole = every.join(moved, [*by, "target", "editor"], "left").fillna(0, ["_ds", "_dn"])
    return whole.where("_n0 + _dn > 0").select(*by, "target", "editor", ((F.col("_s0") + F.col("_ds")) / (F.col("_n0") + F.col("_dn"))).alias("mean"))


def single_boards(scores: DataFrame, by: list[str], clean: str, cued: str) -> DataFrame:
    """(by, target, editor, mean): boards on which one editor at a time, the target, is cued."""
    return single_means(cued_sums(scores, by, clean, cued), by)


def rank_moves(scores: DataFrame, by: list[str], clean: str = "clean", cued: str = "tint") -> DataFrame:
    """For each board and scenario: editors, largest and mean move, and whether the first place changes."""
    return moves_of(cued_sums(scores, by, clean, cued), by)


def moves_of(sums: DataFrame, by: list[str]) -> DataFrame:
    """``rank_moves`` from ``cued_sums``, which it reads several times."""
    own = _own_sums(sums, by)
    before = board_rank(own.where("_n0 > 0").withColumn("mean", F.col("_s0") / F.col("_n0")), by, "mean", "rank_clean", descending=True).select(*by, "editor", "rank_clean")
    every = own.where("_na > 0").select(*by, F.lit("all").alias("scenario"), F.lit(-1).alias("target"), "editor", (F.col("_sa") / F.col("_na")).alias("mean"))
    single = single_means(sums, by).select(*by, F.lit("single").alias("scenario"), "target", "editor", "mean")
    after = board_rank(every.unionByName(single), [*by, "scenario", "target"], "mean", "rank_cued", descending=True).drop("mean")
    moved = after.join(before, [*by, "editor"])
    own = F.col("scenario") == "single"
    shown = F.when(own & (F.col("editor") != F.col("target")), None).otherwise(F.col("rank_clean") - F.col("rank_cued"))
    top = lambda r: F.min_by("editor", F.struct(r, "editor"))
    return moved.groupBy(*by, "scenario", "target").agg(F.count("*").alias("editors"), F.max(F.abs(F.col("rank_clean") - F.col("rank_cued"))).alias("max_move"), F.avg(shown).alias("mean_gain"), (top("rank_clean") != top("rank_cued")).alias("top_changes"))


def board_tau(scores: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Kendall's tau-b of two scorings of a board's editors."""
    a, b = (turn_centred_means(scores, by, c).select(*by, "editor", F.col("mean").alias(n)) for c, n in ((x, "_a"), (y, "_b")))
    return kendall_tau_b(a.join(b, [*by, "editor"]), by, "editor", "_a", "_b")


def inversions(ranks: DataFrame, by: list[str], item: str, x: str, y: str) -> DataFrame:
    """(by, pairs, untied, inverted) between two rankings of few items."""
    a = ranks.select(*by, F.col(item).alias("_i"), F.col(x).alias("_x1"), F.col(y).alias("_y1"))
    b = ranks.select(*by, F.col(item).alias("_j"), F.col(x).alias("_x2"), F.col(y).alias("_y2"))
    sign = F.signum(F.col("_x1") - F.col("_x2")) * F.signum(F.col("_y1") - F.col("_y2"))
    return a.join(b, by).where("_i < _j").groupBy(*by).agg(F.count("*").alias("pairs"), count_if(sign != 0).alias("untied"), count_if(sign < 0).alias("inverted"))


