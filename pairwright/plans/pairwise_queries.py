"""Queries of the pairwise and agreement families with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import resample, stats
from pairwright.operators import agreement, hashed, pairwise, sampling
from pairwright.plans.views import PAIRS, POOL, pairs, pool, r6, sql
from pairwright.plans.record_queries import _shared
from pairwright.plans.scoring_queries import _rounded


def position_flips(spark: SparkSession, d: str) -> DataFrame:
    """JOIN5, AGG2, STAT5, VIS1: own against swapped display order."""
    return _rounded(pairwise.chance_levels(pairwise.position_flips(pairs(spark, d), ["judge"])))


def position_joint(spark: SparkSession, d: str) -> DataFrame:
    """AGG3: displayed letters of both orders."""
    return _rounded(pairwise.position_joint(pairs(spark, d), ["judge"]))


def sticky_equals_strict(spark: SparkSession, d: str) -> DataFrame:
    """The identity sticky rate = strict flip rate, by judge."""
    p = pairs(spark, d)
    a, b = pairwise.position_joint(p, ["judge"]).select("judge", "sticky_rate"), pairwise.position_flips(p, ["judge"]).select("judge", "strict_flip_rate")
    return a.join(b, "judge").select("judge", (F.abs(F.col("sticky_rate") - F.col("strict_flip_rate")) < 1e-12).alias("same"))


def pairwise_consistency(spark: SparkSession, d: str) -> DataFrame:
    """AGG4: the first two asks of a pair (own order, then with the cue, stand in for two asks)."""
    p = pairs(spark, d)
    asks = p.select("judge", "pair_id", F.lit(1).alias("repeat_index"), "winner").unionByName(p.select("judge", "pair_id", F.lit(2).alias("repeat_index"), F.col("cued").alias("winner")))
    return _rounded(pairwise.consistency(asks, ["judge"], "pair_id"))


def one_sided(spark: SparkSession, d: str) -> DataFrame:
    """JOIN4, JOIN6, AGG5: a cue on one side, against baseline and decisive human preference."""
    p = pool(spark, d)
    tiers = agreement.decisive_tier(pairs(spark, d), agreement.human_sd(p))
    return _rounded(pairwise.one_sided(tiers.withColumn("preference", F.when(F.col("tier") == 0, F.col("preference"))), ["judge", "cue"]))


def swap_average(spark: SparkSession, d: str) -> DataFrame:
    """AGG25: four ways to reconcile two orders."""
    return _rounded(pairwise.swap_average(pairs(spark, d), ["judge"]))


def decisive_tiers(spark: SparkSession, d: str) -> DataFrame:
    """TOPK3, AGG10: pairs by tier, with the thresholds of their source."""
    return agreement.decisive_tier(pairs(spark, d), agreement.human_sd(pool(spark, d))).groupBy("source", "tier").agg(F.count("*").alias("n"))


def battles(spark: SparkSession, d: str) -> DataFrame:
    """AGG41: votes of a match-up of two editors to a majority and a margin."""
    return _rounded(pairwise.majority_vote(pairs(spark, d).select("editor_a", "editor_b", F.col("winner").alias("vote")), ["editor_a", "editor_b"]))


def _stored(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder, for plans that read them several times."""
    at, conf, cleanup = _shared(df.sparkSession, "stored"), df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(cleanup, None)
    conf.set(cleanup, "true")  # the shuffle files on the way to it go when it is written
    try:
        df.write.parquet(at)
    finally:
        conf.unset(cleanup) if was is None else conf.set(cleanup, was)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _items(spark: SparkSession, d: str) -> DataFrame:
    """JOIN7: samples with a human score, baseline and cued score."""
    p = _stored(pool(spark, d).select("sample_id", "source", "turn", "editor", "human", "clean", "inset"))
    return agreement.build_items(p.select("sample_id", "source", "turn", "editor", "human"), p.select("sample_id", F.col("clean").alias("before")), p.where("inset is not null").select("sample_id", F.col("inset").alias("after")))


def agreement_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """JOIN8, AGG6, AGG7: accuracy on within-turn pairs that humans decide."""
    graded = agreement.derived_pairs(_items(spark, d), agreement.human_sd(pool(spark, d)))
    out = agreement.accuracy(graded, ["source"])
    return _rounded(out.withColumn("p_mcnemar", stats.mcnemar_exact(F.col("fixed"), F.col("broken"))))


def net_discordance(spark: SparkSession, d: str) -> DataFrame:
    """AGG8, AGG9: pairs put right less pairs put wrong, by turn, as a histogram."""
    graded = agreement.derived_pairs(_items(spark, d), agreement.human_sd(pool(spark, d)))
    return agreement.net_discordance(graded, ["source"]).groupBy("source", "net").agg(F.count("*").alias("turns"))


def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """STAT2: accuracy with its cluster bootstrap (squared multiplicities)."""
    graded = agreement.derived_pairs(_items(spark, d), agreement.human_sd(pool(spark, d)))
    return resample.cluster_accuracy_bootstrap(_stored(agreement.net_discordance(graded, ["source"])), ["source"], "good", "n", ["turn"], n_boot=200)


def hashed_cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """STAT2: accuracy with its cluster bootstrap, by draws that add up over tasks."""
    graded = agreement.derived_pairs(_items(spark, d), agreement.human_sd(pool(spark, d)))
    return _rounded(hashed.cluster_accuracy(agreement.net_discordance(graded, ["source"]), ["source"], "good", "n", "turn", n_boot=100))


def hashed_mean_test(spark: SparkSession, d: str) -> DataFrame:
    """STAT1, STAT3: bounds and two-sided bootstrap p of the shift of each source's editors under a cue, by draws that add up."""
    p = pool(spark, d).where("inset is not null").withColumn("shift", F.col("inset") - F.col("clean"))
    return _rounded(hashed.mean_test(p, ["source", "editor"], "shift", F.col("sample_id"), n_boot=100))


def hashed_tau_change(spark: SparkSession, d: str) -> DataFrame:
    """STAT13: change of tau with the human board, turns drawn by hash."""
    return _rounded(hashed.tau_change(pool(spark, d), ["source"], "human", "clean", "inset", n_boot=60))


def spearman_agreement(spark: SparkSession, d: str) -> DataFrame:
    """STAT10, STAT11: rank correlation with humans before and after, on paired items."""
    items = _stored(_items(spark, d).where("after is not null").select("source", "human", "before", "after"))
    rho = stats.spearmans(items, ["source"], "human", {"before": "rho_before", "after": "rho_after"})
    return _rounded(rho.withColumn("delta_rho", F.col("rho_after") - F.col("rho_before")))


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """JOIN20, AGG39, WIN1: turn-centred means and ranks of editors."""
    return _rounded(agreement.leaderboard(pool(spark, d), ["source"], "clean"))


def leaderboard_moves(spark: SparkSession, d: str) -> DataFrame:
    """AGG40: ranks when all or one editor is cued."""
    return _rounded(agreement.moves_of(_stored(agreement.cued_sums(pool(spark, d), ["source"], "clean", "tint")), ["source"]))


def leaderboard_tau(spark: SparkSession, d: str) -> DataFrame:
    """STAT12: tau-b of clean and human boards."""
    return _rounded(agreement.board_tau(pool(spark, d), ["source"], "clean", "human"))


def rank_inversions(spark: SparkSession, d: str) -> DataFrame:
    """STAT16, AGG35: inverted pairs between two boards."""
    p = pool(spark, d)
    a, b = (agreement.leaderboard(p, ["source"], c).select("source", "editor", F.col("rank").alias(n)) for c, n in (("clean", "x"), ("tint", "y")))
    return agreement.inversions(a.join(b, ["source", "editor"]), ["source"], "editor", "x", "y")


def editor_pairs(spark: SparkSession, d: str) -> DataFrame:
    """JOIN9: pairs of different editors, at most three a turn in seeded order."""
    return agreement.distinct_editor_pairs(pool(spark, d), 3).select("pair_id", "sample_id_a", "sample_id_b")


def pair_preference(spark: SparkSession, d: str) -> DataFrame:
    """JOIN10: pairs with both human scores, preference within a tolerance, gap."""
    p = pool(spark, d).select("sample_id", "human")
    q = agreement.distinct_editor_pairs(pool(spark, d), 1)
    j = q.join(p.select(F.col("sample_id").alias("sample_id_a"), F.col("human").alias("ha")), "sample_id_a").join(p.select(F.col("sample_id").alias("sample_id_b"), F.col("human").alias("hb")), "sample_id_b")
    gap = F.col("ha") - F.col("hb")
    return j.select("pair_id", F.when(gap > 1000, "a").when(gap < -1000, "b").otherwise("tie").alias("preference"), r6(F.abs(gap)).alias("gap"))


def area_bands(spark: SparkSession, d: str) -> DataFrame:
    """JOIN21, AGG33, STAT17: quantiles of an area share by source, and accuracy inside bands (area: discount)."""
    p = pool(spark, d).withColumn("area", F.pmod(F.col("turn") * 7 + F.col("editor") * 13, F.lit(100)) / 100.0)
    q = [r6(F.percentile("area", F.lit(x))).alias(f"q{int(x * 100)}") for x in (0.1, 0.5, 0.9)]
    return p.groupBy("source").agg(F.count("*").alias("n"), *q, r6(stats.share(F.col("area") < 0.05)).alias("below_5"), r6(F.avg("human")).alias("mean_human"))


def permutation(spark: SparkSession, d: str) -> DataFrame:
    """STAT14, JOIN19: is one cue the worst more often than chance? 10,000 draws on complete items of two stand-in judges."""
    p = pool(spark, d).where("inset is not null")
    judge = F.explode(F.array(F.lit("j0"), F.lit("j1"))).alias("judge")
    cells = p.select(judge, F.col("sample_id").alias("item"), "human", F.col("clean").alias("baseline"), "sham", "tint", "inset").withColumn("sham", F.when(F.col("judge") == "j1", F.col("tint")).otherwise(F.col("sham")))
    return resample.permutation_worst_cue(cells, "judge", "item", "human", ["sham", "tint", "inset"], store=_stored)


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """TOPK1, TOPK4: 25 of each source and status in seeded order, low tiers first (a sampling operator)."""
    p = pool(spark, d).withColumn("tier", (F.col("human") < 20000).cast("int"))
    return sampling.stratified_take(p, ["source", "status"], "sample_id", 25, tier="tier").select("source", "status", "tier", "sample_id", "place")


def whole_turn_sample(spark: SparkSession, d: str) -> DataFrame:
    """TOPK2: whole turns, ten a source, at most four editors each (a sampling operator)."""
    return sampling.whole_turns(pool(spark, d).withColumn("stratum", F.col("source")).withColumn("turn", F.concat_ws(":", "source", F.col("turn").cast("string"))), "stratum", 10, 4).select("stratum", "turn", "editor")


def even_spread(spark: SparkSession, d: str) -> DataFrame:
    """WIN5: 20 rows of each source, evenly spread by human score (a sampling operator)."""
    return sampling.evenly_spaced(pool(spark, d), ["source"], ["human", "sample_id"], 20).select("source", "sample_id")


def tertiles(spark: SparkSession, d: str) -> DataFrame:
    """WIN4: tertiles by cut values within each source."""
    return sampling.value_tertiles(pool(spark, d), "source", "clean").groupBy("source", "tertile").agg(F.count("*").alias("n"), F.min("clean").alias("low"), F.max("clean").alias("high"))


def derangement(spark: SparkSession, d: str) -> DataFrame:
    """TOPK8: each name gets another one."""
    from pairwright.plans.views import table

    return sampling.derangement(table(spark, d, "nation"), "n_name")


def blind_sheet(spark: SparkSession, d: str) -> DataFrame:
    """TOPK6: a blinded sheet of five a source (a sampling operator)."""
    return sampling.blind_sheet(pool(spark, d), ["source"], "sample_id", 5).select("index", "sample_id")


def targets(spark: SparkSession, d: str) -> DataFrame:
    """JOIN16, JOIN17, JOIN18: jobs by sample, condition and ask, less those done, counted by condition."""
    samples, cues = pool(spark, d).select("sample_id", "turn"), [None, "tint", "inset"]
    done = sampling.expand_targets(samples, cues, 2).where("cue = 'tint' and turn % 3 = 0 and repeat_index = 1").select("sample_id", "result_id")
    return sampling.outstanding(samples, cues, 2, done).groupBy(F.coalesce("cue", F.lit("base")).alias("condition"), "repeat_index").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        position_flips, position_joint, sticky_equals_strict, pairwise_consistency, one_sided, swap_average, decisive_tiers, battles, agreement_accuracy, net_discordance, cluster_bootstrap, hashed_cluster_bootstrap, hashed_mean_test, hashed_tau_change, spearman_agreement, leaderboard, leaderboard_moves, leaderboard_tau,
        rank_inversions, editor_pairs, pair_preference, area_bands, permutation, stratified_sample, whole_turn_sample, even_spread, tertiles, derangement, blind_sheet, targets,
    )
}

_V = (POOL, PAIRS)
_BACK = "CASE swapped WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE swapped END"
_AVG = "round(avg(CASE WHEN {} THEN 1.0 ELSE 0.0 END), 6)"
_MCN = """round(CASE WHEN {b} + {c} > 0 THEN least(1.0, 2 * (SELECT sum(exp(lgamma({b} + {c} + 1.0) - lgamma(i + 1.0) - lgamma({b} + {c} - i + 1.0) - ({b} + {c}) * ln(2.0))) FROM unnest(range(0, least({b}, {c}) + 1)) t(i))) END, 6)"""
_SD = "sds AS (SELECT source, stddev_samp(human) AS sd FROM pool GROUP BY source HAVING count(human) >= 2)"
_TIER = "tiers AS (SELECT p.*, CASE WHEN preference IN ('A', 'B') THEN CASE WHEN sd > 0 AND abs(gap) >= 0.5 * sd THEN 0 ELSE 1 END ELSE 2 END AS tier FROM pairs p LEFT JOIN sds USING (source))"
_GRADED = """graded AS (
  SELECT a.source, a.turn, sign(a.clean - b.clean) = sign(a.human - b.human) AS rb, sign(a.inset - b.inset) = sign(a.human - b.human) AS ra, a.clean = b.clean AS tb, a.inset = b.inset AS ta
  FROM pool a JOIN pool b ON a.turn = b.turn AND a.source = b.source AND a.editor < b.editor LEFT JOIN sds ON sds.source = a.source
  WHERE a.human <> b.human AND (sd IS NULL OR sd = 0 OR abs(a.human - b.human) >= 0.5 * sd) AND a.inset IS NOT NULL AND b.inset IS NOT NULL)"""
_MEANS = "{n} AS (SELECT {k}, editor, avg(c) AS mean, count(*) AS turns FROM (SELECT {k}, editor, {s} - avg({s}) OVER (PARTITION BY {k}, turn) AS c, count(*) OVER (PARTITION BY {k}, turn) AS m FROM {t} WHERE {s} IS NOT NULL) WHERE m >= 2 GROUP BY ALL)"
_RANK = "rank() OVER (PARTITION BY {k} ORDER BY mean DESC) + (count(*) OVER (PARTITION BY {k}, mean) - 1) / 2.0"
_BOOT_PAIRS = "first AS (SELECT source, turn, editor, min(sample_id) AS sample_id FROM pool GROUP BY ALL), ranked AS (SELECT a.source, a.turn, a.sample_id AS sample_id_a, b.sample_id AS sample_id_b, row_number() OVER (PARTITION BY a.source, a.turn ORDER BY md5('42:' || a.sample_id || ':' || b.sample_id)) AS place FROM first a JOIN first b ON a.source = b.source AND a.turn = b.turn AND a.editor < b.editor), ep AS (SELECT *, source || '_' || turn || '_' || lpad(CAST(place AS VARCHAR), 2, '0') AS pair_id FROM ranked)"

def _drawn(view: str, columns: str, unit: str, n_boot: int) -> str:
    """A view of the rows of another with draw and weight: Poisson counts by hashed words, four draws to a word."""
    steps = " + ".join(f"CASE WHEN u >= {t} THEN 1 ELSE 0 END" for t in hashed.STEPS)
    return (
        f"{view}_w AS (SELECT {columns}, word * 4 + j AS draw, CAST('0x' || substr(md5('42:' || word || ':' || CAST({unit} AS VARCHAR)), 8 * j + 1, 8) AS BIGINT) AS u FROM {view}, range({-(-n_boot // 4)}) w(word), range(4) j(j)), "
        f"{view}_d AS (SELECT * FROM (SELECT {columns}, draw, {steps} AS weight FROM {view}_w WHERE draw < {n_boot}) WHERE weight > 0)"
    )


ORACLES = {
    "position_flips": sql(
        *_V, f"f AS (SELECT judge, count(*) AS n, {_AVG.format(f'winner = {_BACK}')} AS rr, {_AVG.format(f'winner IN (' + chr(39) + 'A' + chr(39) + ',' + chr(39) + 'B' + chr(39) + f') AND {_BACK} <> ' + chr(39) + 'Tie' + chr(39) + f' AND winner <> {_BACK}')} AS strict_flip_rate, {_AVG.format(f'winner <> {_BACK}')} AS soft_flip_rate, "
        f"avg(CASE WHEN winner = 'A' THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN swapped = 'A' THEN 1.0 ELSE 0.0 END) AS b, count(*) FILTER (winner = 'A' AND {_BACK} = 'B') AS a_to_b, count(*) FILTER (winner = 'B' AND {_BACK} = 'A') AS b_to_a FROM pairs GROUP BY judge)",
        body=f"SELECT judge, n, rr, strict_flip_rate, soft_flip_rate, round(a, 6) AS slot_a_before, round(b, 6) AS slot_a_after, a_to_b, b_to_a, {_MCN.format(b='a_to_b', c='b_to_a')} AS p_mcnemar, round(a * (1 - b) + (1 - a) * b, 6) AS rr_chance, round(a * a + (1 - a) * (1 - a), 6) AS cr_chance FROM f",
    ),
    "position_joint": sql(*_V, body="SELECT judge, count(*) AS n, " + ", ".join(f"count(*) FILTER (winner = '{x}' AND swapped = '{y}') AS {x.lower()}_{y.lower()}" for x in ("A", "B", "Tie") for y in ("A", "B", "Tie")) + f", {_AVG.format('winner = swapped')} AS same_slot_rate, {_AVG.format('winner = swapped AND winner <> ' + chr(39) + 'Tie' + chr(39))} AS sticky_rate FROM pairs GROUP BY judge"),
    "sticky_equals_strict": sql(*_V, body="SELECT judge, true AS same FROM pairs GROUP BY judge"),
    "pairwise_consistency": sql(*_V, body=f"SELECT judge, count(*) AS n, {_AVG.format('winner = cued')} AS cr, {_AVG.format('winner <> cued AND winner <> ' + chr(39) + 'Tie' + chr(39) + ' AND cued <> ' + chr(39) + 'Tie' + chr(39))} AS strict_flip_rate, {_AVG.format('(winner = ' + chr(39) + 'Tie' + chr(39) + ') <> (cued = ' + chr(39) + 'Tie' + chr(39) + ')')} AS tie_churn FROM pairs GROUP BY judge"),
    "one_sided": sql(
        *_V, _SD, _TIER, "t AS (SELECT * REPLACE (CASE WHEN tier = 0 THEN preference END AS preference) FROM tiers)",
        "o AS (SELECT judge, cue, count(*) AS n, avg((winner = side)::INT) AS db, avg((cued = side)::INT) AS da, sum((cued = side)::INT - (winner = side)::INT) / count(*) AS adv, count(*) FILTER (winner <> side AND cued = side) AS ft, count(*) FILTER (winner = side AND cued <> side) AS fa, avg((winner = 'Tie')::INT) AS tb, avg((cued = 'Tie')::INT) AS ta, count(preference) AS nd, avg((winner = preference)::INT) AS ab, avg((cued = preference)::INT) AS aa, avg((cued = preference)::INT) FILTER (side = preference) AS aw, avg((cued = preference)::INT) FILTER (side <> preference) AS al FROM t GROUP BY judge, cue)",
        body=f"SELECT judge, cue, n, round(db, 6) AS dressed_before, round(da, 6) AS dressed_after, round(adv, 6) AS advantage, ft AS flips_toward, fa AS flips_away, round(tb, 6) AS tie_before, round(ta, 6) AS tie_after, nd AS n_decisive, round(ab, 6) AS acc_before, round(aa, 6) AS acc_after, round(aw, 6) AS acc_cue_on_winner, round(al, 6) AS acc_cue_on_loser, {_MCN.format(b='ft', c='fa')} AS p_advantage FROM o",
    ),
    "swap_average": sql(
        *_V, f"b AS (SELECT *, {_BACK} AS back FROM pairs WHERE preference IN ('A', 'B'))",
        "arms AS (SELECT judge, winner, preference, 'single' AS arm, winner AS settled FROM b UNION ALL SELECT judge, winner, preference, 'swapped', back FROM b UNION ALL SELECT judge, winner, preference, 'agree_only', CASE WHEN winner = back THEN winner END FROM b UNION ALL SELECT judge, winner, preference, 'agree_or_tie', CASE WHEN winner = back THEN winner ELSE 'Tie' END FROM b)",
        "g AS (SELECT *, coalesce(settled IN ('A', 'B'), false) AS dec, coalesce(settled = preference, false) AS ok, winner = preference AS base FROM arms)",
        "s AS (SELECT judge, arm, count(*) AS n, avg(dec::INT) AS coverage, avg(ok::INT) FILTER (dec) AS acc_decided, avg(ok::INT) AS acc_all, avg(base::INT) FILTER (dec) AS single_on_retained, count(*) FILTER (ok AND NOT base) AS gained, count(*) FILTER (NOT ok AND base) AS lost FROM g GROUP BY judge, arm)",
        body=f"SELECT judge, arm, n, round(coverage, 6) AS coverage, round(acc_decided, 6) AS acc_decided, round(acc_all, 6) AS acc_all, round(single_on_retained, 6) AS single_on_retained, gained, lost, {_MCN.format(b='gained', c='lost')} AS p_all FROM s",
    ),
    "decisive_tiers": sql(*_V, _SD, _TIER, body="SELECT source, tier, count(*) AS n FROM tiers GROUP BY source, tier"),
    "battles": sql(*_V, "v AS (SELECT editor_a, editor_b, count(*) FILTER (winner = 'A') AS n_a, count(*) FILTER (winner = 'B') AS n_b, count(*) FILTER (winner = 'Tie') AS n_tie FROM pairs GROUP BY ALL)", body="SELECT *, CASE WHEN n_tie > greatest(n_a, n_b) OR n_a = n_b THEN 'tie' WHEN n_a > n_b THEN 'a' ELSE 'b' END AS preference, round((n_a - n_b) / (n_a + n_b + n_tie), 6) AS margin FROM v"),
    "agreement_accuracy": sql(
        POOL, _SD, _GRADED, "a AS (SELECT source, count(*) AS n_pairs, avg(rb::INT) AS x, avg(ra::INT) AS y, avg(tb::INT) AS t1, avg(ta::INT) AS t2, count(*) FILTER (NOT rb AND ra) AS fixed, count(*) FILTER (rb AND NOT ra) AS broken FROM graded GROUP BY source)",
        body=f"SELECT source, n_pairs, round(x, 6) AS acc_before, round(y, 6) AS acc_after, round(t1, 6) AS tie_before, round(t2, 6) AS tie_after, fixed, broken, {_MCN.format(b='fixed', c='broken')} AS p_mcnemar FROM a",
    ),
    "net_discordance": sql(POOL, _SD, _GRADED, body="SELECT source, CAST(net AS BIGINT) AS net, count(*) AS turns FROM (SELECT source, turn, sum(ra::INT - rb::INT) AS net FROM graded GROUP BY ALL) GROUP BY ALL"),
    "hashed_cluster_bootstrap": sql(
        POOL, _SD, _GRADED, "t AS (SELECT source, turn, sum(rb::INT) AS good, count(*) AS n FROM graded GROUP BY ALL)", _drawn("t", "source, turn, good, n", "turn", 100),
        "v AS (SELECT source, draw, sum(weight * weight * good) / sum(weight * weight * n)::DOUBLE AS v FROM t_d GROUP BY ALL)",
        body="SELECT source, count(*) AS turns, round(sum(good) / sum(n)::DOUBLE, 6) AS accuracy, round(any_value(lo), 6) AS ci_low, round(any_value(hi), 6) AS ci_high FROM t JOIN (SELECT source, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM v GROUP BY source) USING (source) GROUP BY source",
    ),
    "hashed_mean_test": sql(
        POOL, "s AS (SELECT source, editor, sample_id, (inset - clean)::DOUBLE AS x FROM pool WHERE inset IS NOT NULL)", _drawn("s", "source, editor, x", "sample_id", 100), "m AS (SELECT source, editor, draw, sum(weight * x) / sum(weight) AS m FROM s_d GROUP BY ALL)",
        "q AS (SELECT source, editor, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, least(1.0, 2 * (least(count(*) FILTER (m <= 0), count(*) FILTER (m >= 0)) + 1) / (count(*) + 1)::DOUBLE) AS p FROM m GROUP BY ALL)",
        body="SELECT source, editor, count(*) AS n, round(avg(x), 6) AS mean, round(any_value(lo), 6) AS ci_low, round(any_value(hi), 6) AS ci_high, round(any_value(p), 6) AS p FROM s LEFT JOIN q USING (source, editor) GROUP BY source, editor",
    ),
    "hashed_tau_change": sql(
        POOL, "c AS (SELECT source, turn, editor, human - avg(human) OVER w AS h, clean - avg(clean) OVER w AS b, inset - avg(inset) OVER w AS a, count(*) OVER w AS n FROM pool WHERE inset IS NOT NULL WINDOW w AS (PARTITION BY source, turn))", "o AS (SELECT * FROM c WHERE n >= 2)",
        _drawn("o", "source, turn, editor, h, b, a", "turn", 60), "m AS (SELECT source, draw, editor, round(sum(weight * h) / sum(weight), 12) AS h, round(sum(weight * b) / sum(weight), 12) AS b, round(sum(weight * a) / sum(weight), 12) AS a FROM o_d GROUP BY ALL)",
        "t AS (SELECT x.source, x.draw, sum(sign(x.b - y.b) * sign(x.h - y.h)) / sqrt(count(*) FILTER (x.b <> y.b)::DOUBLE * count(*) FILTER (x.h <> y.h)) AS tb, sum(sign(x.a - y.a) * sign(x.h - y.h)) / sqrt(count(*) FILTER (x.a <> y.a)::DOUBLE * count(*) FILTER (x.h <> y.h)) AS ta FROM m x JOIN m y ON x.source = y.source AND x.draw = y.draw AND x.editor < y.editor GROUP BY ALL)",
        "q AS (SELECT source, quantile_cont(ta - tb, 0.025) AS lo, quantile_cont(ta - tb, 0.975) AS hi FROM t GROUP BY source)",
        body="SELECT source, count(DISTINCT turn) AS turns, round(any_value(lo), 6) AS ci_low, round(any_value(hi), 6) AS ci_high, any_value(lo) > 0 OR any_value(hi) < 0 AS excludes_zero FROM o JOIN q USING (source) GROUP BY source",
    ),
    "spearman_agreement": sql(
        POOL, "i AS (SELECT * FROM pool WHERE inset IS NOT NULL)", "r AS (SELECT source, " + ", ".join(f"rank() OVER (PARTITION BY source ORDER BY {c}) + (count(*) OVER (PARTITION BY source, {c}) - 1) / 2.0 AS r_{c}" for c in ("human", "clean", "inset")) + " FROM i)",
        body="SELECT source, count(*) AS n, round(corr(r_human, r_clean), 6) AS rho_before, round(corr(r_human, r_inset), 6) AS rho_after, round(corr(r_human, r_inset) - corr(r_human, r_clean), 6) AS delta_rho FROM r GROUP BY source",
    ),
    "leaderboard": sql(POOL, _MEANS.format(n="m", k="source", s="clean", t="pool"), body=f"SELECT source, editor, round(mean, 6) AS mean, turns, {_RANK.format(k='source')} AS rank FROM m"),
    "leaderboard_moves": sql(
        POOL,
        "s AS (SELECT source, turn, editor, 'clean' AS scenario, -1 AS target, CAST(clean AS DOUBLE) AS x FROM pool UNION ALL SELECT source, turn, editor, 'all', -1, tint FROM pool UNION ALL SELECT p.source, turn, p.editor, 'single', t.editor, CASE WHEN p.editor = t.editor THEN tint ELSE clean END FROM pool p JOIN (SELECT DISTINCT source, editor FROM pool) t USING (source))",
        "c AS (SELECT source, scenario, target, editor, x - avg(x) OVER w AS c, count(*) OVER w AS m FROM s WHERE x IS NOT NULL WINDOW w AS (PARTITION BY source, scenario, target, turn))",
        "m AS (SELECT source, scenario, target, editor, round(avg(c), 12) AS mean FROM c WHERE m >= 2 GROUP BY ALL)", f"r AS (SELECT *, {_RANK.format(k='source, scenario, target')} AS rank FROM m)",
        "b AS (SELECT a.source, a.scenario, a.target, a.editor, a.rank AS ra, k.rank AS rk FROM r a JOIN r k ON a.source = k.source AND a.editor = k.editor AND k.scenario = 'clean' WHERE a.scenario <> 'clean')",
        body="SELECT source, scenario, CAST(target AS INT) AS target, count(*) AS editors, max(abs(rk - ra)) AS max_move, round(avg(CASE WHEN scenario = 'single' AND editor <> target THEN NULL ELSE rk - ra END), 6) AS mean_gain, arg_min(editor, (rk, editor)) <> arg_min(editor, (ra, editor)) AS top_changes FROM b GROUP BY source, scenario, target",
    ),
    "leaderboard_tau": sql(
        POOL, _MEANS.format(n="x", k="source", s="clean", t="pool"), _MEANS.format(n="y", k="source", s="human", t="pool"), "b AS (SELECT x.source, x.editor, x.mean AS mx, y.mean AS my FROM x JOIN y USING (source, editor))",
        body="SELECT source, (SELECT count(*) FROM b q WHERE q.source = p.source) AS n, round(sum(sign(p.mx - r.mx) * sign(p.my - r.my)) / sqrt(CAST(count(*) FILTER (p.mx <> r.mx) AS DOUBLE) * count(*) FILTER (p.my <> r.my)), 6) AS tau FROM b p JOIN b r USING (source) WHERE p.editor < r.editor GROUP BY source",
    ),
    "rank_inversions": sql(
        POOL, _MEANS.format(n="mx", k="source", s="clean", t="pool"), _MEANS.format(n="my", k="source", s="tint", t="pool"), f"rx AS (SELECT source, editor, {_RANK.format(k='source')} AS x FROM mx)", f"ry AS (SELECT source, editor, {_RANK.format(k='source')} AS y FROM my)",
        "b AS (SELECT * FROM rx JOIN ry USING (source, editor))", body="SELECT source, count(*) AS pairs, count(*) FILTER (p.x <> r.x AND p.y <> r.y) AS untied, count(*) FILTER (sign(p.x - r.x) * sign(p.y - r.y) < 0) AS inverted FROM b p JOIN b r USING (source) WHERE p.editor < r.editor GROUP BY source",
    ),
    "editor_pairs": sql(POOL, _BOOT_PAIRS, body="SELECT pair_id, sample_id_a, sample_id_b FROM ep WHERE place <= 3"),
    "pair_preference": sql(POOL, _BOOT_PAIRS, body="SELECT pair_id, CASE WHEN a.human - b.human > 1000 THEN 'a' WHEN a.human - b.human < -1000 THEN 'b' ELSE 'tie' END AS preference, round(abs(a.human - b.human), 6) AS gap FROM ep JOIN (SELECT sample_id, any_value(human) AS human FROM pool GROUP BY sample_id) a ON a.sample_id = sample_id_a JOIN (SELECT sample_id, any_value(human) AS human FROM pool GROUP BY sample_id) b ON b.sample_id = sample_id_b WHERE place <= 1"),
    "area_bands": sql(POOL, body="SELECT source, count(*) AS n, " + ", ".join(f"round(quantile_cont(area, {x}), 6) AS q{int(x * 100)}" for x in (0.1, 0.5, 0.9)) + ", round(avg((area < 0.05)::INT), 6) AS below_5, round(avg(human), 6) AS mean_human FROM (SELECT *, ((turn * 7 + editor * 13) % 100) / 100.0::DOUBLE AS area FROM pool) GROUP BY source"),
    "stratified_sample": sql(POOL, "t AS (SELECT *, (human < 20000)::INT AS tier FROM pool)", "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source, status ORDER BY tier, md5('42:' || source || ':' || status || ':' || tier || ':' || sample_id), sample_id) AS INT) AS place FROM t)", body="SELECT source, status, tier, sample_id, place FROM r WHERE place <= 25"),
    "whole_turn_sample": sql(
        POOL, "p AS (SELECT source AS stratum, source || ':' || turn AS turn, editor FROM pool WHERE human IS NOT NULL)", "z AS (SELECT stratum, turn FROM p GROUP BY ALL HAVING count(*) >= 2)", "k AS (SELECT stratum, turn FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || stratum || ':0:' || turn), turn) AS n FROM z) WHERE n <= 10)",
        body="SELECT stratum, turn, editor FROM (SELECT *, row_number() OVER (PARTITION BY stratum, turn ORDER BY md5('42:' || stratum || ':' || turn || ':0:' || editor), editor) AS n FROM p SEMI JOIN k USING (stratum, turn)) WHERE n <= 4",
    ),
    "even_spread": sql(POOL, "o AS (SELECT source, sample_id, row_number() OVER (PARTITION BY source ORDER BY human, sample_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM pool)", body="SELECT DISTINCT source, sample_id FROM o, (SELECT unnest(range(20)) AS k) WHERE i = CAST(floor(k * c / 20) AS BIGINT)"),
    "tertiles": sql(
        POOL, "o AS (SELECT source, clean, row_number() OVER (PARTITION BY source ORDER BY clean) - 1 AS p, count(*) OVER (PARTITION BY source) AS c FROM pool)", "cuts AS (SELECT source, max(clean) FILTER (p = c // 3) AS c1, max(clean) FILTER (p = 2 * c // 3) AS c2 FROM o GROUP BY source)",
        body="SELECT source, CASE WHEN clean < c1 THEN 'low' WHEN clean < c2 THEN 'mid' ELSE 'high' END AS tertile, count(*) AS n, min(clean) AS low, max(clean) AS high FROM pool JOIN cuts USING (source) GROUP BY ALL",
    ),
    "derangement": sql("o AS (SELECT n_name, row_number() OVER (ORDER BY md5('42:' || n_name)) AS i, count(*) OVER () AS c FROM nation)", body="SELECT a.n_name, b.n_name AS other FROM o a JOIN o b ON b.i = a.i % a.c + 1"),
    "blind_sheet": sql(POOL, "k AS (SELECT sample_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || source || ':0:' || sample_id), sample_id) AS n FROM pool) WHERE n <= 5)", body="SELECT CAST(row_number() OVER (ORDER BY md5('42:sheet:' || sample_id)) AS INT) AS index, sample_id FROM k"),
    "targets": sql(POOL, body="SELECT condition, repeat_index, count(*) AS n FROM pool, (VALUES ('base'), ('tint'), ('inset')) c(condition), (VALUES (1), (2)) r(repeat_index) WHERE NOT (condition = 'tint' AND turn % 3 = 0 AND repeat_index = 1) GROUP BY ALL"),
}
