"""Queries of the score family with their oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import resample, stats
from pairwright.operators import scoring
from pairwright.plans.views import RATERS, VERDICTS, pool, r6, sql, verdicts  # noqa: F401

STATS = "count(*) AS n, round(avg(before), 6) AS mean_before, round(avg(after), 6) AS mean_after, round(avg(shift), 6) AS mean_shift, round(avg(CASE WHEN shift > 0 THEN 1.0 ELSE 0.0 END), 6) AS sir, round(avg(abs(shift)), 6) AS \"asc\""
BASE = """
base AS (SELECT judge, sample, arg_max({s}, ord) AS before FROM verdicts WHERE cue IS NULL AND parsed AND repeat_index = 1 GROUP BY judge, sample)"""
CUED = """
cued AS (SELECT judge, sample, cue, {s} AS after, biased_id, ord FROM (
           SELECT *, row_number() OVER (PARTITION BY judge, biased_id ORDER BY ord) AS n FROM verdicts WHERE cue IS NOT NULL AND parsed AND biased_id IS NOT NULL) WHERE n = 1
         UNION ALL SELECT judge, sample, cue, {s}, biased_id, ord FROM verdicts WHERE cue IS NOT NULL AND parsed AND biased_id IS NULL)"""
SHIFTS = """
shifts AS (SELECT cued.*, before, after - before AS shift FROM cued JOIN base USING (judge, sample))"""


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[c if c in keys or kinds[c] != "double" else r6(F.col(c)).alias(c) for c in df.columns])


def score_shift(spark: SparkSession, d: str) -> DataFrame:
    """JOIN1, AGG1: cued against baseline of the same judge and sample."""
    v = verdicts(spark, d)
    return _rounded(scoring.score_shift(v, scoring.resolve_score(v)))


def score_shift_qc(spark: SparkSession, d: str) -> DataFrame:
    """AGG16, JOIN14: the same on cued items that both stand-in validators pass."""
    v = verdicts(spark, d)
    checks = v.where("biased_id is not null").groupBy("biased_id").agg(F.max("d2").alias("a"), F.max("d3").alias("b"))
    validations = checks.select("biased_id", F.lit("v1").alias("validator"), (F.col("a") < 10).alias("passed")).union(checks.select("biased_id", F.lit("v2"), F.col("b") < 10))
    return _rounded(scoring.score_shift(v, "fine", scoring.passed_by_all(validations)))


def shift_of_passed(spark: SparkSession, d: str) -> DataFrame:
    """AGG16, JOIN14: the shift on cued items that every one of three validators passed; each fails some, and one has not seen all."""
    v = verdicts(spark, d)
    seen = v.where("biased_id is not null").select("biased_id", F.substring("sample", 2, 9).cast("int").alias("n")).distinct()
    told = [("v1", F.col("n") % 4 != 0, F.lit(True)), ("v2", F.col("n") % 5 != 0, F.lit(True)), ("v3", F.lit(True), F.col("n") % 11 != 0)]
    validations = reduce(DataFrame.unionByName, [seen.where(has).select("biased_id", F.lit(k).alias("validator"), passed.alias("passed")) for k, passed, has in told])
    return _rounded(scoring.score_shift(v, "fine", scoring.passed_by_all(validations)))


def score_fields(spark: SparkSession, d: str) -> DataFrame:
    """FLT7: the score that each judge's rows are analysed by, one judge having but the overall one; a table of all judges is refused, one of the others is not."""
    v = verdicts(spark, d).withColumn("fine", F.when((F.col("judge") == "j4") & (F.col("ord") % 3 != 0), None).otherwise(F.col("fine")))
    fields = scoring.score_fields(v)

    def refused(rows: DataFrame) -> bool:
        try:
            scoring.check_single_score(rows)
        except scoring.MixedRows:
            return True
        return False

    return fields.withColumns({"refused_whole": F.lit(refused(fields)), "refused_rest": F.lit(refused(fields.where("judge <> 'j4'")))})


def placebo_contrast(spark: SparkSession, d: str) -> DataFrame:
    """JOIN2: each cue against the control cue."""
    return _rounded(scoring.placebo_contrast(verdicts(spark, d)))


def retest(spark: SparkSession, d: str) -> DataFrame:
    """JOIN3: consecutive asks of one baseline item."""
    return _rounded(scoring.retest(verdicts(spark, d)))


def shift_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    """AGG28: the flagship for each rating dimension."""
    return _rounded(scoring.by_dimension(verdicts(spark, d), ["d1", "d2", "d3"]))


def shift_by_group(spark: SparkSession, d: str) -> DataFrame:
    """AGG13: the shift by a group of samples as well."""
    pairs = scoring.shift_pairs(verdicts(spark, d), "fine").withColumn("grp", F.when(F.substring("sample", 2, 9).cast("int") % 3 == 0, "x").otherwise("y"))
    return _rounded(scoring.shift_stats(pairs, ["judge", "cue", "grp"]))


def positive_control(spark: SparkSession, d: str) -> DataFrame:
    """AGG14: the shift on overlapping subsets."""
    n = F.substring("sample", 2, 9).cast("int")
    subsets = F.array_compact(F.array(F.lit("pooled"), F.when(n % 4 == 0, "collision").otherwise("clean")))
    pairs = scoring.shift_pairs(verdicts(spark, d), "fine").withColumn("subset", F.explode(subsets))
    return _rounded(scoring.shift_stats(pairs, ["judge", "cue", "subset"]))


def claim_a(spark: SparkSession, d: str) -> DataFrame:
    """AGG27, STAT4, STAT7: shift, contrast with the control, the signed-rank statistic with its p, and its q within the family (control left out)."""
    v = verdicts(spark, d)
    pairs = scoring.shift_pairs(v, "fine")
    z = stats.signed_rank(pairs, ["judge", "cue"], "shift")
    table = scoring.shift_stats(pairs, ["judge", "cue"]).join(scoring.placebo_contrast(v).select("judge", "cue", F.col("mean_shift").alias("contrast")), ["judge", "cue"], "left").join(z, ["judge", "cue"], "left")
    table = table.withColumn("p", F.round(stats.two_sided(F.col("z")), 6)).withColumn("family", F.when(F.col("cue") != "sham", "claim_A").otherwise("control"))
    return _rounded(stats.with_bh(table, "p", ["family"]).select("judge", "cue", "n", "mean_shift", "contrast", "n_nonzero", "w_plus", "tie_term", "z", "p", "q", "significant", "family"))


def claim_a_q(spark: SparkSession, d: str) -> DataFrame:
    """STAT4 with STAT7 and the normal tail; no SQL (no error function)."""
    v = verdicts(spark, d)
    p = resample.wilcoxon(scoring.shift_pairs(v, "fine"), ["judge", "cue"], "shift").withColumn("p", F.round("p", 6)).withColumn("family", F.lit("claim_A"))
    return stats.with_bh(p, "p", ["family"])


def zero_policy(spark: SparkSession, d: str) -> DataFrame:
    """AGG38: signed-rank p under two treatments of zero shifts."""
    pairs = scoring.shift_pairs(verdicts(spark, d), "d1")
    a, b = (resample.wilcoxon(pairs, ["judge", "cue"], "shift", z, f"p_{z}") for z in ("wilcox", "pratt"))
    both = a.join(b, ["judge", "cue"]).withColumn("family", F.lit("all"))
    both = stats.with_bh(stats.with_bh(both, "p_wilcox", ["family"], "q_wilcox", significant="sig_wilcox"), "p_pratt", ["family"], "q_pratt", significant="sig_pratt")
    return _rounded(both.withColumn("changes", F.col("sig_wilcox") != F.col("sig_pratt")).drop("family"))


def shift_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """STAT1: percentile bootstrap of the mean shift, numpy draws."""
    pairs = scoring.shift_pairs(verdicts(spark, d), "fine")
    return resample.bootstrap_mean(pairs, ["judge", "cue"], "shift", ["sample", "after"], n_boot=2000)


def hash_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """STAT1 with draws that SQL can repeat: 20 draws of each judge's retest deltas."""
    deltas = scoring.retest_deltas(verdicts(spark, d), "d1")
    return _rounded(resample.bootstrap_mean(deltas, ["judge"], "delta", ["sample", "delta"], n_boot=20, rng="hash"))


def noise_floor(spark: SparkSession, d: str) -> DataFrame:
    """AGG26: ten times the mean absolute change of each cue, its 2.5 % bootstrap bound, and the floors (20 % bounds of control and of repeated asks)
    that it clears."""
    v = verdicts(spark, d)
    pairs = scoring.shift_pairs(v, "fine").select("judge", "cue", "sample", (F.abs("shift") * 10).alias("size"))
    again = scoring.retest_deltas(v, "fine").select("judge", F.lit("retest").alias("cue"), "sample", (F.abs("delta") * 10).alias("size"))
    low = resample.bootstrap_mean(pairs, ["judge", "cue"], "size", ["sample", "size"], alpha=0.05)
    floor = resample.bootstrap_mean(pairs.where("cue = 'sham'").unionByName(again), ["judge", "cue"], "size", ["sample", "size"], alpha=0.40)
    floors = floor.groupBy("judge").agg(F.max(F.when(F.col("cue") == "sham", F.col("ci_low"))).alias("sham_floor"), F.max(F.when(F.col("cue") == "retest", F.col("ci_low"))).alias("retest_floor"))
    out = low.where("cue <> 'sham'").join(floors, "judge", "left")
    cleared = F.coalesce((F.col("ci_low") > F.col("sham_floor")).cast("int"), F.lit(0)) + F.coalesce((F.col("ci_low") > F.col("retest_floor")).cast("int"), F.lit(0))
    marker = F.element_at(F.array(F.lit("gray"), F.lit("plain"), F.lit("bold")), F.col("cleared") + 1)
    return out.withColumn("cleared", cleared).withColumn("marker", marker).withColumn("shown", F.round(F.col("mean").cast("decimal(38,18)"), 1).cast("double"))


def ensemble_median(spark: SparkSession, d: str) -> DataFrame:
    """AGG22, AGG24: the median over judges of each item (truncated), its shift, and how far it lies below the mean member."""
    v = verdicts(spark, d)
    per = lambda df, by: df.groupBy(*by, "sample").agg(F.count_distinct("judge").alias("j"), F.percentile("s", F.lit(0.5)).cast("int").alias("m"))
    base = scoring.baseline_scores(v, "fine").withColumnRenamed("before", "s")
    cued = scoring.cued_scores(v, "fine").groupBy("judge", "sample", "cue").agg(F.min_by("after", "ord").alias("s"))
    ens = per(cued, ["cue"]).withColumnRenamed("m", "after").drop("j").join(per(base, []).withColumnRenamed("m", "before").drop("j"), "sample")
    whole = scoring.shift_stats(ens.withColumn("shift", F.col("after") - F.col("before")), ["cue"])
    members = cued.join(base.withColumnRenamed("s", "b"), ["judge", "sample"]).groupBy("cue", "judge").agg(F.avg(F.col("s") - F.col("b")).alias("m")).groupBy("cue").agg(F.avg("m").alias("mean_member"), F.max_by("judge", F.struct(F.round(F.abs("m"), 9), "judge")).alias("worst_member"))
    out = whole.join(members, "cue")
    return _rounded(out.withColumn("pct_reduction", stats.ratio(F.abs("mean_member") - F.abs("mean_shift"), F.abs("mean_member"))))


def z_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """AGG23: scores scaled by each judge's baseline, median over judges, shift."""
    v = verdicts(spark, d)
    base = scoring.baseline_scores(v, "fine")
    scale = base.groupBy("judge").agg(F.avg("before").alias("mu"), F.stddev_samp("before").alias("sd"))
    z = lambda df, c: df.join(scale, "judge").withColumn("z", F.when(F.col("sd") > 0, (F.col(c) - F.col("mu")) / F.col("sd")))
    b = z(base, "before").groupBy("sample").agg(F.percentile("z", F.lit(0.5)).alias("before"))
    cued = scoring.cued_scores(v, "fine").groupBy("judge", "sample", "cue").agg(F.min_by("after", "ord").alias("after"))
    a = z(cued, "after").groupBy("cue", "sample").agg(F.percentile("z", F.lit(0.5)).alias("after"))
    return _rounded(scoring.shift_stats(a.join(b, "sample").withColumn("shift", F.col("after") - F.col("before")), ["cue"]).select("cue", "n", "mean_shift"))


def judges_admitted(spark: SparkSession, d: str) -> DataFrame:
    """FLT9, FLT12: judges with at least half the rows of the leading one, on the roster."""
    return scoring.admitted_judges(verdicts(spark, d), ["j0", "j1", "j2"])


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """FLT16: every expected condition's rows, absent ones too."""
    expected = spark.createDataFrame([("sham", 10), ("click", 10**9), ("signup", 1), ("none", 5)], "cue string, expected long")
    return scoring.check_coverage(verdicts(spark, d).where("cue is not null"), "cue", expected)


def filters(spark: SparkSession, d: str) -> DataFrame:
    """FLT1, FLT3, FLT4: null-safe conjunctive filters."""
    v = verdicts(spark, d)
    keep = scoring.matches(v, {"judge": ["j0", "j3"], "cue": [None, "sham"], "scale": 10}) & ~scoring.is_repeat()
    return scoring.complete_case(v.where(keep), ["d1", "d2", "d3"]).select("ord", "judge", "sample", "fine")


def mos_strata(spark: SparkSession, d: str) -> DataFrame:
    """AGG37, WIN4, STAT9: shift inside tertiles of a score within each judge, with its deviation and detectable effect."""
    from pairwright.operators.sampling import value_tertiles

    pairs = scoring.shift_pairs(verdicts(spark, d), "fine")
    cut = value_tertiles(pairs, "judge", "before")
    out = cut.groupBy("judge", "tertile").agg(F.count("*").alias("n"), F.avg("shift").alias("mean_shift"), F.stddev_samp("shift").alias("sd_shift"))
    out = out.withColumn("mde", stats.minimum_detectable_effect(F.col("n")))
    return _rounded(out.withColumn("detectable", F.abs("mean_shift") >= F.col("mde") * F.col("sd_shift")))


def exclusion_levels(spark: SparkSession, d: str) -> DataFrame:
    """AGG36: the shift at three exclusion levels against the published one."""
    pairs = scoring.shift_pairs(verdicts(spark, d), "fine").withColumn("v", F.substring("sample", 2, 9).cast("int") % 10)
    levels = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.lit(t).alias("most")) for n, t in (("published", 99), ("lenient", 8), ("strict", 5))]))
    rows = pairs.withColumn("_l", levels).where("v <= _l.most").withColumn("level", F.col("_l.level"))
    own = rows.groupBy("level", "judge", "cue").agg(F.count("*").alias("n"), F.avg("shift").alias("mean_shift"))
    pub = own.where("level = 'published'").select("judge", "cue", F.col("mean_shift").alias("_p"))
    return _rounded(own.join(pub, ["judge", "cue"]).withColumn("delta", F.col("mean_shift") - F.col("_p")).withColumn("sign_kept", F.signum("mean_shift") == F.signum("_p")).drop("_p"))


def layer_scalars(spark: SparkSession, d: str) -> DataFrame:
    """VIS6, WIN1-3: each judge's mean absolute change over cues but the control, with average and competition ranks."""
    own = scoring.score_shift(verdicts(spark, d), "fine").where("cue <> 'sham'").groupBy("judge").agg(F.round(F.avg("asc"), 6).alias("layer")).withColumn("all_", F.lit(1))
    ranked = stats.with_average_rank(stats.with_average_rank(own, ["all_"], "layer", "rank_up"), ["all_"], "layer", "rank_down", descending=True)
    from pyspark.sql import Window as W

    return ranked.withColumn("place", F.rank().over(W.partitionBy("all_").orderBy("layer"))).drop("all_")


def cue_order(spark: SparkSession, d: str) -> DataFrame:
    """VIS2: cues by mean absolute effect over judges, the control last."""
    from pyspark.sql import Window as W

    own = scoring.score_shift(verdicts(spark, d), "fine").groupBy("cue").agg(F.round(F.avg(F.abs("mean_shift")), 6).alias("effect"))
    return own.withColumn("place", F.row_number().over(W.orderBy(F.col("cue") == "sham", F.desc("effect"), "cue")))


def judge_cue_matrix(spark: SparkSession, d: str) -> DataFrame:
    """VIS5: judge by cue, one column a cue."""
    m = scoring.score_shift(verdicts(spark, d), "fine").groupBy("judge").pivot("cue", ["click", "purchase", "sham", "signup"]).agg(F.max("mean_shift"))
    return _rounded(m)


def cue_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG34, WIN6: one row a cue: judges that move up or down, the direction, the median."""
    s = scoring.score_shift(verdicts(spark, d), "fine")
    up, down = stats.count_if(F.col("mean_shift") > 0), stats.count_if(F.col("mean_shift") < 0)
    out = s.groupBy("cue").agg(F.count("*").alias("cells"), up.alias("up"), down.alias("down"), F.percentile("mean_shift", F.lit(0.5)).alias("median_shift"))
    return _rounded(out.withColumn("direction", F.when((F.col("up") > 0) & (F.col("down") > 0), "mixed").when(F.col("up") > 0, "up").otherwise("down")))


def collection_drift(spark: SparkSession, d: str) -> DataFrame:
    """AGG32: a second collection (later half of the events): its control against the first one's baseline."""
    v = verdicts(spark, d)
    half = v.agg(F.percentile("ord", F.lit(0.5))).first()[0]
    tagged = v.withColumn("second", F.col("ord") > half)
    first = scoring.baseline_scores(tagged.where("not second"), "fine")
    control = scoring.cued_scores(tagged.where("second and cue = 'sham'"), "fine").groupBy("judge", "sample").agg(F.max_by("after", "ord").alias("after"))
    return _rounded(control.join(first, ["judge", "sample"]).withColumn("shift", F.col("after") - F.col("before")).groupBy("judge").agg(F.count("*").alias("n"), F.avg("shift").alias("drift")))


QUERIES = {
    f.__name__: f
    for f in (
        score_shift, score_shift_qc, shift_of_passed, score_fields, placebo_contrast, retest, shift_by_dimension, shift_by_group, positive_control, claim_a, claim_a_q, zero_policy, shift_bootstrap, hash_bootstrap, noise_floor, ensemble_median, z_ensemble, judges_admitted, coverage,
        filters, mos_strata, exclusion_levels, layer_scalars, cue_order, judge_cue_matrix, cue_summary, collection_drift,
    )
}

_S = (VERDICTS, BASE.format(s="fine"), CUED.format(s="fine"), SHIFTS)
_LAST = "last AS (SELECT judge, sample, cue, arg_max(after, ord) AS after FROM cued GROUP BY ALL)"
_RETEST = """deltas AS (SELECT judge, sample, {s} - before AS delta FROM (SELECT judge, sample, {s}, lag({s}) OVER (PARTITION BY judge, sample ORDER BY repeat_index, {s}) AS before
  FROM verdicts WHERE cue IS NULL AND parsed) WHERE before IS NOT NULL)"""
_PER = f"per AS (SELECT judge, cue, {STATS} FROM shifts GROUP BY judge, cue)"
_DIM = "SELECT judge, cue, {st}, '{s}' AS dimension FROM (SELECT cued.*, before, after - before AS shift FROM (SELECT judge, sample, cue, {s} AS after FROM cued) cued JOIN (SELECT judge, sample, arg_max({s}, ord) AS before FROM verdicts WHERE cue IS NULL AND parsed AND repeat_index = 1 GROUP BY judge, sample) USING (judge, sample)) GROUP BY judge, cue"
_CUED_ALL = CUED.replace("{s} AS after", "d1, d2, d3").replace("{s},", "d1, d2, d3,")

#: Twice the normal tail at sqrt(2) x: the error function's series for small x, its continued fraction for large ones.
_TAIL = """CASE WHEN {x} < 2.5 THEN 1 - 2 / sqrt(pi()) * {x} * list_sum(list_transform(range(0, 61), lambda i: pow(-1, i) * pow({x}, 2 * i) / gamma(i + 1) / (2 * i + 1)))
  WHEN {x} >= 2.5 THEN exp(-{x} * {x}) / sqrt(pi()) / ({x} + list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(60, 0, -1), lambda i: i::DOUBLE)), lambda a, i: i / 2 / ({x} + a))) END"""
_BH = "least(1.0, min({p} * {k} / {up}) OVER (ORDER BY {up} DESC ROWS UNBOUNDED PRECEDING))"


def _signed(zeros: bool, name: str) -> list[str]:
    """Views that end in ``name`` (judge, cue, x): |z| / sqrt(2) of the signed-rank statistic of shifts, zeros ranked and their ranks dropped, or left out."""
    keep = "" if zeros else " WHERE shift <> 0"
    return [
        f"{name}_r AS (SELECT judge, cue, shift, rank() OVER (PARTITION BY judge, cue ORDER BY abs(shift)) + (count(*) OVER (PARTITION BY judge, cue, abs(shift)) - 1) / 2.0 AS r FROM shifts{keep})",
        f"{name}_t AS (SELECT judge, cue, sum(t * t * t - t) AS ties FROM (SELECT judge, cue, abs(shift), count(*) AS t FROM {name}_r WHERE shift <> 0 GROUP BY ALL) GROUP BY ALL)",
        f"{name}_w AS (SELECT judge, cue, count(*)::DOUBLE AS n, count(*) FILTER (shift = 0)::DOUBLE AS z, least(sum(r) FILTER (shift > 0), sum(r) FILTER (shift < 0)) AS t FROM {name}_r GROUP BY ALL)",
        f"{name} AS (SELECT judge, cue, abs(t - n * (n + 1) / 4 + z * (z + 1) / 4) / sqrt(2 * (n * (n + 1) * (2 * n + 1) / 24 - z * (z + 1) * (2 * z + 1) / 24 - coalesce(ties, 0) / 48.0)) AS x FROM {name}_w LEFT JOIN {name}_t USING (judge, cue))",
    ]


ORACLES = {
    "claim_a_q": sql(
        *_S, *_signed(False, "x"), f"p AS (SELECT judge, cue, round({_TAIL.format(x='x')}, 6) AS p FROM x)", "r AS (SELECT *, row_number() OVER (ORDER BY p) AS up, count(*) OVER () AS k FROM p)", f"q AS (SELECT *, {_BH.format(p='p', k='k', up='up')} AS q FROM r)",
        body="SELECT judge, cue, p, 'claim_A' AS family, q, q < 0.05 AS significant FROM q",
    ),
    "zero_policy": sql(
        VERDICTS, BASE.format(s="d1"), CUED.format(s="d1"), SHIFTS, *_signed(False, "a"), *_signed(True, "b"), f"p AS (SELECT judge, cue, {_TAIL.format(x='a.x')} AS pw, {_TAIL.format(x='b.x')} AS pp FROM a JOIN b USING (judge, cue))",
        "r AS (SELECT *, row_number() OVER (ORDER BY pw) AS uw, row_number() OVER (ORDER BY pp) AS up, count(*) OVER () AS k FROM p)", f"q AS (SELECT *, {_BH.format(p='pw', k='k', up='uw')} AS qw, {_BH.format(p='pp', k='k', up='up')} AS qp FROM r)",
        body="SELECT judge, cue, round(pw, 6) AS p_wilcox, round(pp, 6) AS p_pratt, round(qw, 6) AS q_wilcox, round(qp, 6) AS q_pratt, qw < 0.05 AS sig_wilcox, qp < 0.05 AS sig_pratt, (qw < 0.05) <> (qp < 0.05) AS changes FROM q",
    ),
    "score_shift": sql(*_S, body=f"SELECT judge, cue, {STATS} FROM shifts GROUP BY judge, cue"),
    "shift_of_passed": sql(
        *_S, "kept AS (SELECT * FROM shifts WHERE biased_id IS NOT NULL AND CAST(substr(sample, 2) AS INT) % 4 <> 0 AND CAST(substr(sample, 2) AS INT) % 5 <> 0 AND CAST(substr(sample, 2) AS INT) % 11 <> 0)",
        body=f"SELECT judge, cue, {STATS} FROM kept GROUP BY judge, cue",
    ),
    "score_fields": sql(
        VERDICTS, "f AS (SELECT judge, parsed, CASE WHEN judge = 'j4' AND ord % 3 <> 0 THEN NULL ELSE fine END AS fine, overall FROM verdicts WHERE parsed)",
        body="SELECT judge, CASE WHEN count(fine) >= 0.95 * count(*) THEN 'fine' ELSE 'overall' END AS score_field, count(*) AS parsed, CASE WHEN count(fine) >= 0.95 * count(*) THEN count(fine) ELSE count(overall) END AS scored, true AS refused_whole, false AS refused_rest FROM f GROUP BY judge",
    ),
    "score_shift_qc": sql(
        *_S, "good AS (SELECT biased_id FROM verdicts WHERE biased_id IS NOT NULL GROUP BY biased_id HAVING max(d2) < 10 AND max(d3) < 10)", body=f"SELECT judge, cue, {STATS} FROM shifts WHERE biased_id IN (SELECT biased_id FROM good) GROUP BY judge, cue"
    ),
    "placebo_contrast": sql(*_S, _LAST, body=f"SELECT judge, cue, {STATS} FROM (SELECT a.judge, a.cue, a.after, b.after AS before, a.after - b.after AS shift FROM last a JOIN last b ON a.judge = b.judge AND a.sample = b.sample AND b.cue = 'sham' AND a.cue <> 'sham') GROUP BY judge, cue"),
    "retest": sql(VERDICTS, _RETEST.format(s="fine"), body="SELECT judge, count(*) AS n, round(avg(abs(delta)), 6) AS mean_abs_delta, round(avg(CASE WHEN delta = 0 THEN 1.0 ELSE 0.0 END), 6) AS identical_rate, round(avg(delta), 6) AS drift FROM deltas GROUP BY judge"),
    "shift_by_dimension": sql(VERDICTS, _CUED_ALL, body=" UNION ALL ".join(_DIM.format(s=s, st=STATS) for s in ("d1", "d2", "d3"))),
    "shift_by_group": sql(*_S, body=f"SELECT judge, cue, CASE WHEN CAST(substr(sample, 2) AS INT) % 3 = 0 THEN 'x' ELSE 'y' END AS grp, {STATS} FROM shifts GROUP BY ALL"),
    "positive_control": sql(*_S, body=f"SELECT judge, cue, subset, {STATS} FROM (SELECT *, unnest(['pooled', CASE WHEN CAST(substr(sample, 2) AS INT) % 4 = 0 THEN 'collision' ELSE 'clean' END]) AS subset FROM shifts) GROUP BY judge, cue, subset"),
    "claim_a": sql(
        *_S, _LAST, _PER, "contrast AS (SELECT a.judge, a.cue, round(avg(a.after - b.after), 6) AS contrast FROM last a JOIN last b ON a.judge = b.judge AND a.sample = b.sample AND b.cue = 'sham' AND a.cue <> 'sham' GROUP BY a.judge, a.cue)",
        "ranked AS (SELECT judge, cue, shift, rank() OVER (PARTITION BY judge, cue ORDER BY abs(shift)) + (count(*) OVER (PARTITION BY judge, cue, abs(shift)) - 1) / 2.0 AS r FROM shifts WHERE shift <> 0)",
        "ties AS (SELECT judge, cue, sum(t * t * t - t) AS tie_term FROM (SELECT judge, cue, abs(shift), count(*) AS t FROM ranked GROUP BY ALL) GROUP BY judge, cue)",
        "w AS (SELECT judge, cue, count(*) AS n_nonzero, sum(CASE WHEN shift > 0 THEN r ELSE 0.0 END) AS w_plus FROM ranked GROUP BY judge, cue)",
        """z AS (SELECT per.judge, per.cue, per.n, per.mean_shift, contrast, n_nonzero, round(w_plus, 6) AS w_plus, CAST(tie_term AS BIGINT) AS tie_term,
  (least(w_plus, n_nonzero * (n_nonzero + 1) / 2.0 - w_plus) - n_nonzero * (n_nonzero + 1) / 4.0) / sqrt((CAST(n_nonzero AS DOUBLE) * (n_nonzero + 1) * (2 * n_nonzero + 1) - tie_term / 2.0) / 24) AS z,
  CASE WHEN per.cue <> 'sham' THEN 'claim_A' ELSE 'control' END AS family
FROM per LEFT JOIN contrast USING (judge, cue) LEFT JOIN w USING (judge, cue) LEFT JOIN ties USING (judge, cue))""",
        # The normal tail: the error function's series for small x, its continued fraction for large ones.
        "x AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x FROM z)",
        f"p AS (SELECT *, round({_TAIL.format(x='x')}, 6) AS p FROM x)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST) AS up, count(p) OVER (PARTITION BY family) AS k FROM p)",
        "q AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * k / up) OVER (PARTITION BY family ORDER BY up DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM r)",
        body="SELECT judge, cue, n, mean_shift, contrast, n_nonzero, w_plus, tie_term, round(z, 6) AS z, p, round(q, 6) AS q, coalesce(q < 0.05, false) AS significant, family FROM q",
    ),
    "hash_bootstrap": sql(
        VERDICTS, _RETEST.format(s="d1"), "v AS (SELECT judge, delta, row_number() OVER (PARTITION BY judge ORDER BY sample, delta) - 1 AS i, count(*) OVER (PARTITION BY judge) AS n FROM deltas)",
        "means AS (SELECT p.judge, b, avg(q.delta) AS m FROM (SELECT judge, n, i, unnest(range(20)) AS b FROM v) p JOIN v q ON q.judge = p.judge AND q.i = CAST('0x' || substr(md5('42:' || b || ':' || p.i), 1, 8) AS BIGINT) % p.n GROUP BY p.judge, b)",
        body="SELECT judge, n, mean, ci_low, ci_high FROM (SELECT judge, count(*) AS n, round(avg(delta), 6) AS mean FROM v GROUP BY judge) JOIN (SELECT judge, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM means GROUP BY judge) USING (judge)",
    ),
    "ensemble_median": sql(
        *_S, "c1 AS (SELECT judge, sample, cue, arg_min(after, ord) AS s FROM cued GROUP BY ALL)", "ea AS (SELECT cue, sample, CAST(trunc(quantile_cont(s, 0.5)) AS INT) AS after FROM c1 GROUP BY ALL)", "eb AS (SELECT sample, CAST(trunc(quantile_cont(before, 0.5)) AS INT) AS before FROM base GROUP BY ALL)",
        f"whole AS (SELECT cue, {STATS}, avg(shift) AS ms FROM (SELECT *, after - before AS shift FROM ea JOIN eb USING (sample)) GROUP BY cue)",
        "mem AS (SELECT cue, judge, avg(s - before) AS m FROM c1 JOIN base USING (judge, sample) GROUP BY ALL)", "m2 AS (SELECT cue, avg(m) AS mean_member, arg_max(judge, (round(abs(m), 9), judge)) AS worst_member FROM mem GROUP BY cue)",
        body="SELECT whole.* EXCLUDE (ms), round(mean_member, 6) AS mean_member, worst_member, round(CASE WHEN mean_member <> 0 THEN (abs(mean_member) - abs(ms)) / abs(mean_member) END, 6) AS pct_reduction FROM whole JOIN m2 USING (cue)",
    ),
    "z_ensemble": sql(
        *_S, "c1 AS (SELECT judge, sample, cue, arg_min(after, ord) AS s FROM cued GROUP BY ALL)", "sc AS (SELECT judge, avg(before) AS mu, stddev_samp(before) AS sd FROM base GROUP BY judge)",
        "zb AS (SELECT sample, quantile_cont((before - mu) / sd, 0.5) AS before FROM base JOIN sc USING (judge) GROUP BY sample)", "za AS (SELECT cue, sample, quantile_cont((s - mu) / sd, 0.5) AS after FROM c1 JOIN sc USING (judge) GROUP BY ALL)",
        body="SELECT cue, count(*) AS n, round(avg(after - before), 6) AS mean_shift FROM za JOIN zb USING (sample) GROUP BY cue",
    ),
    "judges_admitted": sql(VERDICTS, body="SELECT judge, count(*) AS rows, count(*) >= 0.5 * max(count(*)) OVER () AND judge IN ('j0', 'j1', 'j2') AS admitted FROM verdicts GROUP BY judge"),
    "coverage": sql(VERDICTS, "e AS (SELECT * FROM (VALUES ('sham', 10::BIGINT), ('click', 1000000000), ('signup', 1), ('none', 5)) t(cue, expected))", body="SELECT e.cue, expected, count(v.cue) AS rows, count(v.cue) >= 0.95 * expected AS covered FROM e LEFT JOIN verdicts v ON v.cue = e.cue GROUP BY e.cue, expected"),
    "filters": sql(VERDICTS, body="SELECT ord, judge, sample, fine FROM verdicts WHERE judge IN ('j0', 'j3') AND (cue IS NULL OR cue = 'sham') AND repeat_index = 1"),
    "mos_strata": sql(
        *_S, "o AS (SELECT *, row_number() OVER (PARTITION BY judge ORDER BY before) - 1 AS p, count(*) OVER (PARTITION BY judge) AS c FROM shifts)", "cuts AS (SELECT judge, max(before) FILTER (p = c // 3) AS c1, max(before) FILTER (p = 2 * c // 3) AS c2 FROM o GROUP BY judge)",
        "t AS (SELECT judge, CASE WHEN before < c1 THEN 'low' WHEN before < c2 THEN 'mid' ELSE 'high' END AS tertile, shift FROM shifts JOIN cuts USING (judge))",
        body="SELECT judge, tertile, count(*) AS n, round(avg(shift), 6) AS mean_shift, round(stddev_samp(shift), 6) AS sd_shift, round(0.113 * sqrt(611.0 / count(*)), 6) AS mde, abs(avg(shift)) >= 0.113 * sqrt(611.0 / count(*)) * stddev_samp(shift) AS detectable FROM t GROUP BY judge, tertile",
    ),
    "exclusion_levels": sql(
        *_S, "o AS (SELECT level, judge, cue, count(*) AS n, avg(shift) AS m FROM shifts, (VALUES ('published', 99), ('lenient', 8), ('strict', 5)) l(level, most) WHERE CAST(substr(sample, 2) AS INT) % 10 <= most GROUP BY ALL)",
        body="SELECT o.judge, o.cue, o.level, o.n, round(o.m, 6) AS mean_shift, round(o.m - p.m, 6) AS delta, sign(o.m) = sign(p.m) AS sign_kept FROM o JOIN o p ON p.level = 'published' AND o.judge = p.judge AND o.cue = p.cue",
    ),
    "layer_scalars": sql(
        *_S, "a AS (SELECT judge, cue, avg(abs(shift)) AS a FROM shifts WHERE cue <> 'sham' GROUP BY ALL)", "l AS (SELECT judge, round(avg(a), 6) AS layer FROM a GROUP BY judge)",
        body="SELECT judge, layer, rank() OVER (ORDER BY layer) + (count(*) OVER (PARTITION BY layer) - 1) / 2.0 AS rank_up, rank() OVER (ORDER BY layer DESC) + (count(*) OVER (PARTITION BY layer) - 1) / 2.0 AS rank_down, CAST(rank() OVER (ORDER BY layer) AS INT) AS place FROM l",
    ),
    "cue_order": sql(*_S, "e AS (SELECT cue, round(avg(abs(m)), 6) AS effect FROM (SELECT judge, cue, avg(shift) AS m FROM shifts GROUP BY ALL) GROUP BY cue)", body="SELECT cue, effect, CAST(row_number() OVER (ORDER BY cue = 'sham', effect DESC, cue) AS INT) AS place FROM e"),
    "judge_cue_matrix": sql(*_S, body="SELECT judge, " + ", ".join(f"round(avg(shift) FILTER (cue = '{c}'), 6) AS {c}" for c in ("click", "purchase", "sham", "signup")) + " FROM shifts GROUP BY judge"),
    "cue_summary": sql(*_S, "m AS (SELECT judge, cue, avg(shift) AS m FROM shifts GROUP BY ALL)", body="SELECT cue, count(*) AS cells, count(*) FILTER (m > 0) AS up, count(*) FILTER (m < 0) AS down, round(quantile_cont(m, 0.5), 6) AS median_shift, CASE WHEN count(*) FILTER (m > 0) > 0 AND count(*) FILTER (m < 0) > 0 THEN 'mixed' WHEN count(*) FILTER (m > 0) > 0 THEN 'up' ELSE 'down' END AS direction FROM m GROUP BY cue"),
    "collection_drift": sql(
        VERDICTS, "t AS (SELECT *, ord > (SELECT quantile_cont(ord, 0.5) FROM verdicts) AS second FROM verdicts)", "base AS (SELECT judge, sample, arg_max(fine, ord) AS before FROM t WHERE NOT second AND cue IS NULL AND parsed AND repeat_index = 1 GROUP BY ALL)",
        "c AS (SELECT judge, sample, arg_max(fine, ord) AS after FROM (SELECT *, row_number() OVER (PARTITION BY judge, biased_id ORDER BY ord) AS n FROM t WHERE second AND cue = 'sham' AND parsed) WHERE n = 1 GROUP BY ALL)",
        body="SELECT judge, count(*) AS n, round(avg(after - before), 6) AS drift FROM c JOIN base USING (judge, sample) GROUP BY judge",
    ),
}
