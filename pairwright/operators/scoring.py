"""Paired score operators: which duplicate counts, shifts against a baseline and against a control, repeated asks.

Verdict tables have ord, judge, sample, cue (null: baseline), biased_id, parsed, repeat_index, scale and score columns. One aggregation by key picks a
duplicate (``max_by``/``min_by`` combine map-side), so no row is sorted; joins are on (judge, sample) and left to the optimizer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairwright.functions.stats import share
from pairwright.schemas import CONTROL


class MixedRows(ValueError):
    """Rows that must not meet in one column."""


def is_repeat() -> Column:
    """Whether a row is a later ask of the same question."""
    return F.coalesce(F.col("repeat_index"), F.lit(1)) > 1


def cue_is(value: str | None) -> Column:
    """A null-safe condition on the cue: the baseline is a condition of its own."""
    return F.col("cue").eqNullSafe(F.lit(value))


def complete_case(df: DataFrame, dimensions: list[str]) -> DataFrame:
    return df.dropna(subset=dimensions)


def check_single_scale(df: DataFrame, scale: str = "scale") -> DataFrame:
    """The table, if its rows are on one scale; no scale is a scale of its own."""
    found = df.select(F.col(scale).alias("s")).distinct().limit(2).collect()
    if len(found) > 1:
        raise MixedRows(f"more than one scale: {sorted(str(r.s) for r in found)}")
    return df


def check_single_score(df: DataFrame, field: str = "score_field") -> DataFrame:
    """The table, if the rows that name the score they were computed from name the same one."""
    found = df.where(F.col(field) != "").select(field).distinct().limit(2).collect()
    if len(found) > 1:
        raise MixedRows(f"more than one score: {sorted(r[0] for r in found)}")
    return df


def score_fields(df: DataFrame, fine: str = "fine", overall: str = "overall", tolerance: float = 0.05) -> DataFrame:
    """(judge, score_field, parsed, scored): the score that each judge's parsed rows are to be analysed by: the fine one if all but ``tolerance`` of them have it, else the overall one."""
    own = df.where("parsed").groupBy("judge").agg(F.count("*").alias("parsed"), F.count(fine).alias("_fine"), F.count(overall).alias("_overall"))
    has = F.col("parsed") - F.col("_fine") <= tolerance * F.col("parsed")
    return own.select("judge", F.when(has, fine).otherwise(overall).alias("score_field"), "parsed", F.when(has, F.col("_fine")).otherwise(F.col("_overall")).alias("scored"))


def only_values(df: DataFrame, column: str, asked: list[str]) -> DataFrame:
    """The rows with one of the values asked for; an error if the table lacks one of them. Nothing asked for: all rows."""
    if not asked:
        return df
    kept = df.where(F.col(column).isin(asked))
    lacking = set(asked) - {r[0] for r in kept.select(column).distinct().collect()}  # at most as many as asked for
    if lacking:
        raise MixedRows(f"{column} lacks {sorted(lacking)}")
    return kept


def with_endorsed_side(df: DataFrame, keys: dict[str, str], cue: str = "cue", params: str = "params", side: str = "side") -> DataFrame:
    """The side that a cue's JSON parameters endorse (``keys``: parameter by cue) as a or b; rows of other cues stay. A parameter that is neither A nor B,
    or a side that contradicts it, fails the job when the row is computed."""
    at = reduce(lambda c, k: c.when(F.col(cue) == k, F.upper(F.trim(F.get_json_object(params, f"$.{keys[k]}")))), keys, F.when(F.lit(False), F.lit(None).cast("string")))
    told, own = F.lower(F.coalesce(at, F.lit(""))), F.col(side)
    wrong = F.raise_error(F.concat_ws(" ", F.lit("no side, or another one:"), F.col(cue), told, own)).cast("string")
    return df.withColumn(side, F.when(~F.coalesce(F.col(cue).isin(list(keys)), F.lit(False)), own).when(told.isin("a", "b") & F.coalesce(own == told, F.lit(True)), told).otherwise(wrong))


def with_provenance(df: DataFrame, reference: str, collection: str, before: str = "family") -> DataFrame:
    """Adds (or replaces) reference and collection, in front of the column ``before`` if there."""
    others = [c for c in df.columns if c not in ("reference", "collection")]
    at = others.index(before) if before in others else len(others)
    return df.select(*others[:at], F.lit(reference).alias("reference"), F.lit(collection).alias("collection"), *others[at:])


def main_grid(df: DataFrame, main: str = "main") -> DataFrame:
    """The rows of the main collection; rows that name none are of it."""
    if "collection" not in df.columns:
        return df
    return df.where(F.coalesce(F.nullif(F.col("collection"), F.lit("")), F.lit(main)) == main)


def resolve_score(df: DataFrame, fine: str = "fine", overall: str = "overall", tolerance: float = 0.05) -> str:
    """The fine score if any parsed row has it, else the overall one; an error if over ``tolerance`` of the parsed rows lack the fine one."""
    n, have = df.where("parsed").agg(F.count("*"), F.count(fine)).first()
    if not have:
        return overall
    if (n - have) / n > tolerance:
        raise MixedRows(f"{n - have} of {n} parsed rows lack {fine}")
    return fine


def baseline_scores(df: DataFrame, score: str) -> DataFrame:
    """(judge, sample, before): the last parsed baseline row that is no repeat."""
    own = df.where(cue_is(None) & F.col("parsed") & ~is_repeat() & F.col(score).isNotNull())
    return own.groupBy("judge", "sample").agg(F.max_by(score, "ord").alias("before"))


def cued_scores(df: DataFrame, score: str) -> DataFrame:
    """(judge, sample, cue, after, biased_id, ord): of rows of one biased_id the first counts; rows without one all do."""
    own = df.where(F.col("cue").isNotNull() & F.col("parsed") & F.col(score).isNotNull())
    named = own.where(F.col("biased_id").isNotNull()).groupBy("judge", "biased_id").agg(F.min_by(F.struct("sample", "cue", F.col(score).alias("after"), "ord"), "ord").alias("r"))
    bare = own.where(F.col("biased_id").isNull()).select("judge", "sample", "cue", F.col(score).alias("after"), "biased_id", "ord")
    out = named.select("judge", "r.sample", "r.cue", "r.after", "biased_id", "r.ord").unionByName(bare)
    return out.withColumn("cue", F.coalesce(F.nullif(F.col("cue"), F.lit("")), F.lit("unknown")))


def shift_pairs(df: DataFrame, score: str, keep_ids: DataFrame | None = None) -> DataFrame:
    """(judge, sample, cue, before, after, shift): cued rows with their baseline. ``keep_ids``: (biased_id) that may count, asked
    after duplicates are settled."""
    cued = cued_scores(df, score)
    if keep_ids is not None:
        cued = cued.join(keep_ids.select("biased_id"), "biased_id", "left_semi")
    return cued.join(baseline_scores(df, score), ["judge", "sample"]).withColumn("shift", F.col("after") - F.col("before"))


def shift_stats(pairs: DataFrame, by: list[str]) -> DataFrame:
    """n, means before and after, mean shift, share of positive shifts (sir), mean absolute shift (asc)."""
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"), F.avg("shift").alias("mean_shift"), share(F.col("shift") > 0).alias("sir"), F.avg(F.abs("shift")).alias("asc")
    )


def score_shift(df: DataFrame, score: str = "fine", keep_ids: DataFrame | None = None) -> DataFrame:
    return shift_stats(shift_pairs(df, score, keep_ids), ["judge", "cue"])


def placebo_pairs(df: DataFrame, score: str = "fine", control: str = CONTROL) -> DataFrame:
    """(judge, sample, cue, before, after, shift): cued rows against the control of the same judge and sample; of several the last counts."""
    last = cued_scores(df, score).groupBy("judge", "sample", "cue").agg(F.max_by("after", "ord").alias("after"))
    own = last.where(F.col("cue") == control).select("judge", "sample", F.col("after").alias("before"))
    return last.where(F.col("cue") != control).join(own, ["judge", "sample"]).withColumn("shift", F.col("after") - F.col("before"))


def placebo_contrast(df: DataFrame, score: str = "fine", control: str = CONTROL) -> DataFrame:
    return shift_stats(placebo_pairs(df, score, control), ["judge", "cue"])


def retest_deltas(df: DataFrame, score: str = "fine") -> DataFrame:
    """(judge, sample, delta) of consecutive asks of one baseline item, in order of ask, then score."""
    asks = df.where(cue_is(None) & F.col("parsed") & F.col(score).isNotNull())
    before = F.lag(score).over(W.partitionBy("judge", "sample").orderBy("repeat_index", score))
    return asks.withColumn("_before", before).where("_before is not null").select("judge", "sample", (F.col(score) - F.col("_before")).alias("delta"))


def retest(df: DataFrame, score: str = "fine") -> DataFrame:
    d = retest_deltas(df, score)
    return d.groupBy("judge").agg(F.count("*").alias("n"), F.avg(F.abs("delta")).alias("mean_abs_delta"), share(F.col("delta") == 0).alias("identical_rate"), F.avg("delta").alias("drift"))


def by_dimension(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """The flagship for each rating dimension, on rows that have them all."""
    whole = complete_case(df, dimensions)
    parts = [score_shift(whole, d).withColumn("dimension", F.lit(d)) for d in dimensions]
    return reduce(DataFrame.unionByName, parts)


def admitted_judges(df: DataFrame, roster: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """(judge, rows, admitted): at least half the rows of the leading judge, and on the roster if there is one."""
    counts = df.groupBy("judge").agg(F.count("*").alias("rows"))
    top = counts.agg(F.max("rows")).first()[0] or 0
    listed = F.col("judge").isin(roster) if roster else F.lit(True)
    return counts.select("judge", "rows", ((F.col("rows") >= least * top) & listed).alias("admitted"))


def check_coverage(df: DataFrame, by: str, expected: DataFrame, least: float = 0.95) -> DataFrame:
    """(by, expected, rows, covered) for each expected condition, those without rows too."""
    counts = df.groupBy(by).agg(F.count("*").alias("rows"))
    return expected.join(counts, by, "left").select(by, "expected", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), (F.coalesce("rows", F.lit(0)) >= least * F.col("expected")).alias("covered"))


def matches(df: DataFrame, conditions: dict) -> Column:
    """Equality for a value, membership for a list, null-safe; fields may stand in the JSON column ``metadata``."""
    out = F.lit(True)
    for name, wanted in conditions.items():
        c = F.col(name) if name in df.columns else F.get_json_object("metadata", f"$.{name}")
        values = wanted if isinstance(wanted, (list, tuple, set)) else [wanted]
        known = [v for v in values if v is not None]
        one = (c.isin(known) if known else F.lit(False)) | (c.isNull() if None in values else F.lit(False))
        out = out & F.coalesce(one, F.lit(False))
    return out


def passed_by_all(validations: DataFrame) -> DataFrame:
    """(biased_id) that every validator passed."""
    n = validations.select("validator").distinct().count()
    good = validations.where("passed").groupBy("biased_id").agg(F.count_distinct("validator").alias("passes"))
    return good.where(F.col("passes") == n).select("biased_id")
