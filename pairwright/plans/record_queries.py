"""Queries of texts, answers, labels, sets, geometry and sources with their oracles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import geometry, judge, parse, raster, resample, rules, stats, text
from pairwright.operators import sets, validation
from pairwright.plans.views import POOL, RATERS, VERDICTS, pool, r6, raters, sql, table, verdicts
from pairwright.plans.scoring_queries import _rounded
from pairwright.sources import files
from pairwright.streaming import log


def _shared(spark: SparkSession, what: str) -> str:
    """A fresh place in the folder that driver and executors share."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir")
    if not top:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that the driver and all executors share")
        top = "/tmp/checkpoints"  # all tasks run on this machine
    return f"{top}/{what}-{uuid.uuid4().hex}"


def normalized_texts(spark: SparkSession, d: str) -> DataFrame:
    """STR7: normalised text of every document, as a digest."""
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_instruction(F.col("text"))).alias("digest"))


def content_categories(spark: SparkSession, d: str) -> DataFrame:
    """STR6: content class of every document's normalised text, counted."""
    return table(spark, d, "documents").select(rules.content_category(text.normalize_instruction(F.col("text"))).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def edit_types(spark: SparkSession, d: str) -> DataFrame:
    """STR5: edit type of every document's text, counted."""
    return table(spark, d, "documents").select(rules.edit_type(F.col("text")).alias("edit_type")).groupBy("edit_type").agg(F.count("*").alias("n"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    """SRC22, STR8: file-safe names and editor families."""
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"), text.editor_family(F.col("p_brand")).alias("family"))


def keywords(spark: SparkSession, d: str) -> DataFrame:
    """STR9: the keyword and the first words of every document."""
    return table(spark, d, "documents").select("doc_id", text.keyword(F.col("text")).alias("keyword"), F.size(text.word_wrap(text.first_words(F.col("text"), 12), 20)).cast("long").alias("lines"))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """STR16, STR17: digests of the prompts of every benchmark item in each style."""
    b = table(spark, d, "benchmark")
    side = text.seeded_side(42, F.col("item_id"))
    return b.select(
        "item_id", *[F.md5(text.scoring_prompt(F.col("text"), s)).alias(f"scoring_{s}") for s in ("vanilla", "bias_aware", "rubric_first", "viescore")], F.md5(text.scoring_prompt(F.col("text"), bandwagon=True, model=F.lit("m1"), scale=5)).alias("scoring_cued"),
        F.md5(text.pairwise_prompt(F.col("text"), side=side, model_a=F.lit("m1"))).alias("pairwise_cued"), side.alias("side"),
    )


def mock_scores(spark: SparkSession, d: str) -> DataFrame:
    """JUDGE2, STR1, STR2: the mock judge's fenced answer to every turn of a conversation, parsed back."""
    asked = table(spark, d, "conversations").select("conv_id", "turn", judge.mock_answer(F.lit("scoring"), F.col("text"), style="fenced").alias("raw"))
    return parse.parse_scoring(asked, "raw").select("conv_id", "turn", "parse_success", "instruction_adherence", "editing_quality", "detail_preservation", "overall_score", "fine_score")


def mock_winners(spark: SparkSession, d: str) -> DataFrame:
    """JUDGE2, STR3, STR4: pairwise and validation answers within prose, counted."""
    c = table(spark, d, "conversations")
    w = parse.parse_pairwise(c.select(judge.mock_answer(F.lit("pairwise"), F.col("text"), style="prose").alias("raw")), "raw").select(F.col("winner").alias("verdict"))
    v = parse.parse_validation(c.select(judge.mock_answer(F.lit("validation"), F.col("text")).alias("raw")), "raw").select(F.col("passed").cast("string").alias("verdict"))
    return w.union(v).groupBy("verdict").agg(F.count("*").alias("n"))


def answer_repair(spark: SparkSession, d: str) -> DataFrame:
    """STR1, STR2: answers bare, fenced, in prose, with trailing commas, broken; ratings out of range and as text."""
    e = table(spark, d, "events").select("event_id", F.floor(F.col("value")).cast("int").alias("v"))
    n = F.col("event_id") % 5
    body = F.format_string('{"overall_score": %d, "reason": "a {brace} in text"}', "v")
    raw = F.when(n == 0, body).when(n == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n == 2, F.concat(F.lit("So: "), body, F.lit(" done {"))).when(n == 3, F.format_string('{"overall_score": "%d out of 10",}', "v")).otherwise(F.lit("no answer {"))
    return parse.parse_scoring(e.withColumn("raw", raw), "raw").select("event_id", "parse_success", "overall_score")


def page_attributes(spark: SparkSession, d: str) -> DataFrame:
    """STR11, STR13: attributes taken from markup by pattern."""
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_count("html", F.lit(r'<a href="')).cast("long").alias("links"), F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("host"))


def uids(spark: SparkSession, d: str) -> DataFrame:
    """STR12, SRC27, SRC14: ids and stems parsed from paths."""
    li = table(spark, d, "orders").withColumn("path", F.concat(F.lit("C:\\data\\img\\sample_"), F.col("o_orderkey"), F.lit("_"), F.col("o_custkey") % 3, F.lit(".png")))
    rel = text.relative_path(F.col("path"), "C:\\data")
    uid = text.parse_uid(F.concat(text.stem(rel), F.lit(".png")))
    return li.select("o_orderkey", rel.alias("rel"), uid["img_id"].alias("img_id"), uid["turn"].alias("turn"))


def document_overlap(spark: SparkSession, d: str) -> DataFrame:
    """SET1, SET2: documents of one half of the sources against the other half."""
    docs = table(spark, d, "documents")
    half = F.substring("source", 4, 9).cast("int") % 2 == 0
    out = sets.pool_overlap(docs.where(half), docs.where(~half), "text", "text")
    return _rounded(out.withColumn("verdict", sets.verdict(F.col("text_share"), F.col("content_share"))))


def overlap_examples(spark: SparkSession, d: str) -> DataFrame:
    """SET1: the first shared texts of both halves (a report of five)."""
    docs = table(spark, d, "documents")
    half = F.substring("source", 4, 9).cast("int") % 2 == 0
    return sets.overlap_examples(docs.where(half), docs.where(~half), "text").select(F.md5("example").alias("example"))


def union_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """SET3: two sources united, the first wins an id."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    kept, dropped = sets.first_wins([o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'")], "o_custkey", "o_orderkey")
    return kept.join(dropped, "o_custkey", "left").select("o_custkey", "o_orderkey", F.coalesce("dropped", F.lit(0)).cast("long").alias("dropped"))


def dangling_references(spark: SparkSession, d: str) -> DataFrame:
    """JOIN22, JOIN23, FLT20: references of two columns that no target has."""
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") + F.col("l_partkey")).alias("a"), F.col("l_orderkey").alias("b"))
    return sets.dangling(li, ["a", "b"], table(spark, d, "orders"), "o_orderkey").groupBy("column").agg(F.count("*").alias("ids"), F.sum("n").alias("rows"))


def audit_ids(spark: SparkSession, d: str) -> DataFrame:
    """SET4, SET5, SET6, SRC25: expected keys against found ones."""
    return sets.audit(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).where("k % 3 <> 0"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


def exclusions(spark: SparkSession, d: str) -> DataFrame:
    """FLT21, FLT2: rows whose composite key is not excluded, by status."""
    o = table(spark, d, "orders").withColumn("key", sets.composite_key(F.col("o_custkey").cast("string"), "o_orderstatus"))
    out = table(spark, d, "customer").where("c_acctbal < 0").select(sets.composite_key(F.col("c_custkey").cast("string"), F.lit("F")).alias("key"))
    return sets.excluded(o, out, ["key"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def near_duplicate_vectors(spark: SparkSession, d: str) -> DataFrame:
    """JOIN25, TOPK7: each 100th vector's most similar one of at least 0.3 cosine (exact; another detector than image features)."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return _rounded(sets.near_duplicates(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 0.3))


def neighbour_cosine(spark: SparkSession, d: str) -> DataFrame:
    """STAT20: cosine of each vector and the next."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    return both.select("vec_id", r6(dot("v", "w") / F.sqrt(dot("v", "v") * dot("w", "w"))).alias("cosine"))


def duplicate_documents(spark: SparkSession, d: str) -> DataFrame:
    """AGG43, STR15: documents of equal bytes, grouped and numbered."""
    docs = table(spark, d, "documents").select("doc_id", F.sha1("text").alias("digest"))
    return validation.duplicate_groups(docs, "digest", "doc_id").withColumn("name", F.substring("digest", 1, 12)).drop("digest")


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """AGG46, AGG47: order-free fingerprints of the pool by source, against a copy with one source changed and one missing."""
    p = pool(spark, d).withColumn("line", F.concat_ws(",", "sample_id", F.col("clean").cast("string")))
    f = files.fingerprint(p, ["source"], "line")
    other = f.where("source <> 'A'").withColumn("digest", F.when(F.col("source") == "N", F.lit("x")).otherwise(F.col("digest")))
    return f.join(files.compare_fingerprints(f, other, ["source"]), "source")


def cell_grid(spark: SparkSession, d: str) -> DataFrame:
    """AGG12, AGG44: a dense grid of counts."""
    return validation.coverage_grid(table(spark, d, "documents"), "source", "lang")


def rater_kappas(spark: SparkSession, d: str) -> DataFrame:
    """AGG19: agreement coefficients of two raters by language."""
    return _rounded(validation.rater_agreement(raters(spark, d), ["lang"], "first", "second", [0, 1]))


def validator_kappas(spark: SparkSession, d: str) -> DataFrame:
    """AGG18: human and validator fails by language and source, with an ALL row."""
    r = raters(spark, d).select("lang", "source", (F.col("first") == 0).alias("human_fail"), (F.col("second") == 1).alias("validator_fail"))
    return _rounded(validation.validator_agreement(r, ["lang"], "source"))


def cue_label_rates(spark: SparkSession, d: str) -> DataFrame:
    """AGG17, STAT8, SRC5, SRC18: label rates at two thresholds against the placebo, with Wilson bounds."""
    label = F.when(F.col("first") == 0, "Yes").when(F.col("second") == 1, "Slightly").otherwise("No")
    r = raters(spark, d).select(F.when(F.col("lang") == "en", "sham").otherwise(F.col("lang")).alias("cue"), label.alias("label"))
    return _rounded(validation.cue_rates(r, "cue", "label"))


def cue_label_tests(spark: SparkSession, d: str) -> DataFrame:
    """AGG17, STAT6, STAT7: Fisher's p of each rate against the placebo, q by threshold."""
    c = cue_label_rates(spark, d).where("cue <> 'sham'")
    counted = c.withColumn("miss", F.col("n") - F.col("hits")).withColumn("placebo_miss", F.col("placebo_n") - F.col("placebo_hits"))
    tested = resample.with_fisher(counted, "hits", "miss", "placebo_hits", "placebo_miss")
    return _rounded(stats.with_bh(tested, "p", ["threshold"]).select("cue", "threshold", "hits", "placebo_hits", "p", "q", "significant"))


def _validations(spark: SparkSession, d: str) -> DataFrame:
    v = verdicts(spark, d).where("cue is not null")
    return v.select(F.concat(F.lit("v"), F.col("d2") % 2).alias("validator"), "cue", F.col("sample").alias("base"), (F.col("d3") > 3).alias("passed"), (F.col("d1") / 10.0).alias("ssim"), "ord").groupBy("validator", "cue", "base").agg(F.max_by("passed", "ord").alias("passed"), F.max_by("ssim", "ord").alias("ssim"))


def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG11, AGG15, JOIN14, JOIN15: pass rates and similarity by validator and cue, with the matched floor of the control and q."""
    v = _validations(spark, d)
    floor = validation.matched_floor(v.where("cue <> 'sham'"), v.where("cue = 'sham'").drop("cue"), ["validator", "cue"], "base").select("validator", "cue", "floor_rate", "lost", "gained", "p_matched")
    out = validation.pass_summary(v, ["validator", "cue"]).join(floor, ["validator", "cue"], "left")
    return _rounded(stats.with_bh(out, "p_matched", ["validator"], "q_matched"))


def validator_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """AGG20, SRC17, STAT18: sensitivity on fixed and own denominators."""
    v = verdicts(spark, d)
    manifest = v.where("cue in ('click', 'purchase')").groupBy(F.col("cue").alias("condition"), F.col("sample").alias("base")).agg(F.max("d2").cast("double").alias("change"))
    own = _validations(spark, d)
    damaged = own.where("cue in ('click', 'purchase')").select("validator", F.col("cue").alias("condition"), "base", "passed")
    published = own.where("cue = 'sham'").select("validator", "base", "passed")
    return _rounded(validation.sensitivity(manifest, damaged, published, 10))


def prompt_ablation(spark: SparkSession, d: str) -> DataFrame:
    """AGG21: pass rates under two templates (two validators stand in), paired by cue and base."""
    v = _validations(spark, d)
    out = validation.matched_floor(v.where("validator = 'v1'").drop("validator"), v.where("validator = 'v0'").drop("validator"), ["cue"], "base")
    low, high = stats.wilson(F.round(F.col("pass_rate") * F.col("n")), F.col("n"))
    return _rounded(stats.with_bh(out.withColumns({"ci_low": low, "ci_high": high, "headroom": 1 - F.col("floor_rate")}), "p_matched", [], "q"))


def sticker_slots(spark: SparkSession, d: str) -> DataFrame:
    """IMG9, IMG14, IMG15: rectangles of each line: clamp, area share, the sticker slot that meets the region least, overlap ratio with the centre."""
    li = table(spark, d, "lineitem").withColumns({"w": (200 + F.col("l_partkey") % 300).cast("int"), "h": (150 + F.col("l_suppkey") * 3).cast("int")})
    left, top = (F.col("l_orderkey") % F.col("w")).cast("int"), (F.col("l_partkey") % F.col("h")).cast("int")
    region = geometry.clamp(geometry.rect(left, top, left + (F.col("l_quantity") * 5).cast("int"), top + 60), F.col("w"), F.col("h"))
    li = li.withColumn("region", region).withColumn("side", geometry.sticker_side(F.col("w"), F.col("h")))
    li = li.withColumn("best", geometry.least_overlap(geometry.sticker_slots(F.col("w"), F.col("h"), F.col("side")), F.col("region"), 8))
    best = F.col("best")
    share, iou = geometry.area_share(F.col("region"), F.col("w"), F.col("h")), geometry.iou(F.col("region"), geometry.centred(F.col("w"), F.col("h")))
    return li.groupBy(best["name"].alias("slot")).agg(F.count("*").alias("n"), F.sum(best["overlap"]).alias("overlap"), r6(F.avg(share)).alias("area_share"), r6(F.avg(iou)).alias("iou"))


def _rasters(spark: SparkSession, d: str) -> DataFrame:
    """Rasters made of the vectors' bytes (4 by 16 pixels)."""

    def pixels(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            yield vectors.map(lambda v: None if v is None else np.resize((np.asarray(v, float) * 97).astype(np.int64) % 256, 192).astype(np.uint8).tobytes())

    made = F.pandas_udf(pixels, "binary")
    return table(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("sample_id"), F.lit(16).alias("width"), F.lit(4).alias("height"), made("embedding").alias("pixels"))


def raster_cues(spark: SparkSession, d: str) -> DataFrame:
    """IMG1-4, IMG16: cues on rasters."""
    return raster.inject(_rasters(spark, d), ["brightness", "saturation", "padding", "aesthetic_filter"]).select("biased_id", "bias_type", "width", "height", "sha1")


def raster_regions(spark: SparkSession, d: str) -> DataFrame:
    """IMG10 (box form), IMG12, IMG13: the region in which a raster differs from the one before it, outlined and taken back."""
    r = _rasters(spark, d)
    before = r.select((F.col("vec_id") + 1).alias("vec_id"), F.col("pixels").alias("original"))
    return raster.region_cues(r.join(before, "vec_id", "left"))


def rating_table(spark: SparkSession, d: str) -> DataFrame:
    """SRC6, AGG42: wide rating cells unpivoted, bad ones dropped, averaged."""
    s = table(spark, d, "supplier")
    cell = lambda k: F.when(F.col("s_suppkey") % k == 0, "n/a").otherwise(F.format_string("[%s, %s]", (F.col("s_suppkey") % 2 + 0.0).cast("string"), ((F.col("s_nationkey") % 4) / 2.0).cast("string")))
    long = files.unpivot_ratings(s.select("s_suppkey", cell(5).alias("m1"), cell(7).alias("m2")), "s_suppkey")
    return _rounded(files.mean_ratings(long, ["model"]))


def dimension_labels(spark: SparkSession, d: str) -> DataFrame:
    """SRC8, JOIN11, JOIN12: labels of several kinds joined by key, the last value wins, incomplete keys told."""
    e = table(spark, d, "events").select(F.col("event_id").alias("ord"), "user_id", "event_type", "value").where("event_type in ('view', 'click', 'error')")
    return _rounded(files.join_labels(e, ["user_id"], "event_type", "value", ["view", "click", "error"]))


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """SRC1, SRC2, SRC3, SRC20, SRC21, SRC4: nations written as JSON lines and as CSV, read back with declared schemas, counted."""
    n = table(spark, d, "nation")
    at = _shared(spark, "trip")
    files.write_jsonl(n, f"{at}/json")
    files.write_csv(n, f"{at}/csv")
    a = files.read_required(spark, f"{at}/json", n.schema)
    b = files.read_csv(spark, f"{at}/csv", ["n_nationkey", "n_name"], {"n_nationkey": "int", "n_regionkey": "int"})
    gone = files.read_or_empty(spark, f"{at}/none", n.schema)
    return a.unionByName(b).unionByName(gone).groupBy("n_regionkey").agg(F.count("*").alias("rows"), F.count_distinct("n_name").alias("names"))


def stream_append(spark: SparkSession, d: str) -> DataFrame:
    """SRC24: the events drained into a log twice; each id is there once."""
    at = _shared(spark, "log")
    stream = lambda: log.stream_of(spark, d, "events").withColumnRenamed("event_id", "result_id").select("result_id", "ts", "event_type")
    log.append_log(stream(), f"{at}/log", f"{at}/checkpoint1")
    log.append_log(stream(), f"{at}/log", f"{at}/checkpoint2")
    return spark.read.parquet(f"{at}/log").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("result_id").alias("ids"))


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Windowed counts of the event stream (extension)."""
    at = _shared(spark, "counts")
    log.windowed_counts(log.stream_of(spark, d, "events"), f"{at}/counts", f"{at}/checkpoint", "event_type", width="1 day")
    return spark.read.parquet(f"{at}/counts").groupBy("event_type").agg(F.count("*").alias("windows"), F.sum("n").alias("n"), F.max("n").alias("most"))


QUERIES = {
    f.__name__: f
    for f in (
        normalized_texts, content_categories, edit_types, slugs, keywords, prompts, mock_scores, mock_winners, answer_repair, page_attributes, uids, document_overlap, overlap_examples, union_first_wins, dangling_references, audit_ids, exclusions,
        near_duplicate_vectors, neighbour_cosine, duplicate_documents, fingerprints, cell_grid, rater_kappas, validator_kappas, cue_label_rates, cue_label_tests, quality_summary, validator_sensitivity, prompt_ablation, sticker_slots, raster_cues, raster_regions,
        rating_table, dimension_labels, json_round_trip, stream_append, stream_counts,
    )
}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _scoring_sql(style: str, extra: str = "", scale: int = 10) -> str:
    a, b = text.SCORING_HEAD.format(scale=scale, anchors=text.ANCHORS[scale]).split("%s")
    lines = [text.STYLE_LINES["scoring", style].replace("{scale}", str(scale))] if style != "vanilla" else []
    tail = "\n\n".join([*([extra] if extra else []), *lines, text.SCORING_TAIL.format(scale=scale)])
    return f"md5({_quoted(a)} || text || {_quoted(b + chr(10) * 2 + tail)})"


_SIDE = "CASE WHEN CAST('0x' || substr(md5('42:bandwagon:' || item_id), 1, 8) AS BIGINT) % 2 = 0 THEN 'A' ELSE 'B' END"
_PA, _PB = text.PAIRWISE_HEAD.split("%s")
_NORM = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_HASH = "CAST('0x' || substr(sha256('0|{t}|' || text), 1, 16) AS UBIGINT)"
_Z2 = str(stats.Z95 * stats.Z95)
_MCN = """CASE WHEN {b} + {c} > 0 THEN least(1.0, 2 * (SELECT sum(exp(lgamma({b} + {c} + 1.0) - lgamma(i + 1.0) - lgamma({b} + {c} - i + 1.0) - ({b} + {c}) * ln(2.0))) FROM unnest(range(0, least({b}, {c}) + 1)) t(i))) END"""
_VAL = "val AS (SELECT validator, cue, base, arg_max(passed, ord) AS passed, arg_max(ssim, ord) AS ssim FROM (SELECT 'v' || (d2 % 2) AS validator, cue, sample AS base, d3 > 3 AS passed, d1 / 10.0::DOUBLE AS ssim, ord FROM verdicts WHERE cue IS NOT NULL) GROUP BY ALL)"


def _wilson(k: str, n: str) -> tuple[str, str]:
    half = f"1.959963985 * sqrt(({k}) / ({n}) * (1 - ({k}) / ({n})) / ({n}) + {_Z2} / (4.0 * ({n}) * ({n})))"
    mid = f"({k}) / ({n}) + {_Z2} / (2.0 * ({n}))"
    return f"round(greatest(0.0, ({mid} - {half}) / (1 + {_Z2} / ({n}))), 6)", f"round(least(1.0, ({mid} + {half}) / (1 + {_Z2} / ({n}))), 6)"


def _kappas(pe: str, po: str = "po") -> str:
    return f"round(CASE WHEN {pe} <> 1 THEN ({po} - {pe}) / (1 - {pe}) END, 6) + 0.0"


_CASES = "CASE " + " ".join(f"WHEN regexp_matches(t, '(?i){p}') THEN '{n}'" for n, p in rules.rules(rules.CONTENT_PATTERNS)) + " ELSE 'global' END"
_HALF = "CAST(substr(source, 4) AS INT) % 2 = 0"

def _edit_type_sql(t: str) -> str:
    """The first rule found, in RE2, which looks nowhere ahead: what must not follow is taken out with the match and compared. Equal to the rules where their places do not overlap."""
    color = rf"^(?i)(?:{rules.COLOR})\b"
    has = lambda pattern: f"regexp_matches({t}, {_quoted('(?i)' + pattern)})"
    not_before = lambda pattern, rest, taken: f"len(list_filter(regexp_extract_all({t}, {_quoted('(?i)' + pattern + rest)}, 1), lambda x: NOT regexp_matches(x, {_quoted(taken)}))) > 0"
    runs: list[tuple[str, list[str], list[str]]] = []
    for line in rules.EDIT_TYPE_PATTERNS.strip().splitlines():
        name, _, pattern = line.partition(" ")
        pattern = pattern.strip().replace("<COLOR>", rules.COLOR).replace("<SCENE>", rules.SCENE).replace("<MATERIAL>", rules.MATERIAL)
        if not runs or runs[-1][0] != name:
            runs.append((name, [], []))
        if "(?=" in pattern:
            pattern = pattern.replace("(?=", "(?:")
        if pattern.endswith("(?!ing)"):
            pattern = pattern.removesuffix("(?!ing)")
        if "(?!" not in pattern:
            runs[-1][1].append(pattern)
            continue
        head, _, ahead = pattern.partition("(?!")
        if head.endswith(r"\s+"):  # white space may be given back, so two signs of it are enough
            head = head.removesuffix(r"\s+")
            runs[-1][1].append(head + r"\s\s")
            runs[-1][2].append(not_before(head, r"\s([^\s]{0,20})", color))
        else:
            runs[-1][2].append(not_before(head, r"(\s*[a-z]*)", "^(?i)" + ahead.removesuffix(")")))
    tests = [(name, " OR ".join([has("(?:" + "|".join(plain) + ")"), *odd])) for name, plain, odd in runs]
    return "CASE " + " ".join(f"WHEN {c} THEN '{name}'" for name, c in tests) + " END"


def _listed(words: list[str]) -> str:
    return "(" + ", ".join(map(_quoted, words)) + ")"


_CLAMPED = "g AS (SELECT *, greatest(0, least(l, w - 1)) AS x0, greatest(0, least(t, h - 1)) AS y0 FROM f), c AS (SELECT *, greatest(x0 + 1, least(r, w)) AS x1, greatest(y0 + 1, least(b, h)) AS y1 FROM g)"

ORACLES = {
    "normalized_texts": f"SELECT doc_id, md5({_NORM}) AS digest FROM documents",
    "content_categories": f"SELECT {_CASES} AS category, count(*) AS n FROM (SELECT {_NORM} AS t FROM documents) GROUP BY 1",
    "slugs": "SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' / ' || p_type, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(lower(p_brand), '[^\\p{L}\\p{N}]', '', 'g') AS family FROM part",
    "prompts": "SELECT item_id, " + ", ".join(f"{_scoring_sql(s)} AS scoring_{s}" for s in ("vanilla", "bias_aware", "rubric_first", "viescore")) + f", {_scoring_sql('vanilla', text.BANDWAGON_SCORING + chr(10) * 2 + text.NAMED_SCORING.format(model='m1'), 5)} AS scoring_cued, md5({_quoted(_PA)} || text || {_quoted(_PB + chr(10) * 2 + 'Note: 90% of human evaluators preferred Image ')} || {_SIDE} || {_quoted('.' + chr(10) * 2 + text.NAMED_PAIRWISE.format(a='m1', b=text.UNNAMED) + chr(10) * 2 + text.PAIRWISE_TAIL)}) AS pairwise_cued, {_SIDE} AS side FROM benchmark",
    "mock_scores": f"SELECT conv_id, turn, true AS parse_success, a AS instruction_adherence, b AS editing_quality, c AS detail_preservation, CAST(round_even((a + b + c) / 3.0, 0) AS INT) AS overall_score, a + b + c AS fine_score FROM (SELECT conv_id, turn, CAST(1 + h % 10 AS INT) AS a, CAST(1 + (h // 8) % 10 AS INT) AS b, CAST(1 + (h // 64) % 10 AS INT) AS c FROM (SELECT conv_id, turn, {_HASH.format(t='scoring')} AS h FROM conversations))",
    "mock_winners": f"SELECT verdict, count(*) AS n FROM (SELECT ['A', 'B', 'Tie'][CAST({_HASH.format(t='pairwise')} % 3 AS INT) + 1] AS verdict FROM conversations UNION ALL SELECT CASE WHEN {_HASH.format(t='validation')} % 5 = 0 THEN 'false' ELSE 'true' END FROM conversations) GROUP BY verdict",
    "answer_repair": "SELECT event_id, event_id % 5 <> 4 AS parse_success, CASE WHEN event_id % 5 <> 4 THEN CAST(greatest(1, least(10, floor(value))) AS INT) END AS overall_score FROM events",
    "page_attributes": "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<a href=\"')) AS links, regexp_extract(url, '^https?://([^/]+)/', 1) AS host FROM pages",
    "uids": "SELECT o_orderkey, 'img/sample_' || o_orderkey || '_' || (o_custkey % 3) || '.png' AS rel, CAST(o_orderkey AS VARCHAR) AS img_id, CAST(o_custkey % 3 AS INT) AS turn FROM orders",
    "document_overlap": f"WITH x AS (SELECT DISTINCT {_HALF} AS own, {_NORM} AS t FROM documents), y AS (SELECT DISTINCT {_HALF} AS own, sha1(text) AS h FROM documents), c AS (SELECT (SELECT count(*) FROM x WHERE own) AS text_new, (SELECT count(*) FROM x WHERE NOT own) AS text_other, (SELECT count(*) FROM (SELECT t FROM x WHERE own INTERSECT SELECT t FROM x WHERE NOT own)) AS text_shared, (SELECT count(*) FROM y WHERE own) AS content_new, (SELECT count(*) FROM y WHERE NOT own) AS content_other, (SELECT count(*) FROM (SELECT h FROM y WHERE own INTERSECT SELECT h FROM y WHERE NOT own)) AS content_shared) SELECT *, round(text_shared / text_new, 6) AS text_share, round(content_shared / content_new, 6) AS content_share, CASE WHEN greatest(text_shared / text_new, content_shared / content_new) >= 0.6 THEN 'reject' WHEN text_shared / text_new >= 0.1 OR content_shared / content_new >= 0.05 THEN 'needs_exclusion' ELSE 'independent' END AS verdict FROM c",
    "overlap_examples": f"SELECT md5(t) AS example FROM (SELECT {_NORM} AS t FROM documents WHERE {_HALF} INTERSECT SELECT {_NORM} FROM documents WHERE NOT {_HALF}) ORDER BY t LIMIT 5",
    "union_first_wins": "SELECT o_custkey, o_orderkey, c - 1 AS dropped FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders) WHERE n = 1",
    "dangling_references": 'SELECT "column", count(*) AS ids, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT "column", id, count(*) AS n FROM (SELECT \'a\' AS "column", l_orderkey + l_partkey AS id FROM lineitem UNION ALL SELECT \'b\', l_orderkey FROM lineitem) WHERE id NOT IN (SELECT o_orderkey FROM orders) GROUP BY ALL) GROUP BY "column"',
    "audit_ids": "WITH e AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0), f AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN f.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'extra' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS status, count(*) AS n FROM e FULL JOIN f ON e.k = f.k GROUP BY 1",
    "exclusions": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) GROUP BY 1",
    "neighbour_cosine": "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "duplicate_documents": "SELECT size, first, dup_group, substr(h, 1, 12) AS name FROM (SELECT sha1(text) AS h, count(*) AS size, min(doc_id) AS first, row_number() OVER (ORDER BY sha1(text)) - 1 AS dup_group FROM documents GROUP BY 1) WHERE size > 1",
    "fingerprints": sql(POOL, body="SELECT source, count(*) AS n, sha256(count(*) || ':' || sum(('0x' || substr(h, 1, 15))::BIGINT) || ':' || sum(('0x' || substr(h, 16, 15))::BIGINT) || ':' || sum(('0x' || substr(h, 31, 15))::BIGINT) || ':' || sum(('0x' || substr(h, 46, 15))::BIGINT)) AS digest, CASE source WHEN 'A' THEN 'EXTRA' WHEN 'N' THEN 'DIFFERS' ELSE 'OK' END AS status FROM (SELECT source, sha256(sample_id || ',' || clean) AS h FROM pool) GROUP BY source"),
    "cell_grid": "WITH d AS (SELECT source, lang FROM documents), s AS (SELECT DISTINCT source FROM d), l AS (SELECT DISTINCT lang FROM d) SELECT s.source, l.lang, count(d.source) AS n FROM s, l LEFT JOIN d ON d.source = s.source AND d.lang = l.lang GROUP BY ALL",
    "rater_kappas": sql(
        RATERS, "m AS (SELECT lang, count(*) AS n, avg((first = second)::INT) AS po, avg((first = 0)::INT) AS a0, avg((first = 1)::INT) AS a1, avg((second = 0)::INT) AS b0, avg((second = 1)::INT) AS b1 FROM raters WHERE first IS NOT NULL AND second IS NOT NULL GROUP BY lang)",
        "k AS (SELECT *, a0 * b0 + a1 * b1 AS pe, least(a0, b0) + least(a1, b1) AS pm, ((a0 + b0) / 2) ** 2 + ((a1 + b1) / 2) ** 2 AS pp, (a0 + b0) / 2 * (1 - (a0 + b0) / 2) + (a1 + b1) / 2 * (1 - (a1 + b1) / 2) AS pg FROM m)",
        body=f"SELECT lang, n, round(po, 6) AS po, {_kappas('pe')} AS kappa, {_kappas('pe', 'pm')} AS kappa_max, {_kappas('pp')} AS pi, {_kappas('pg')} AS ac1, round(2 * po - 1, 6) AS pabak FROM k",
    ),
    "validator_kappas": sql(
        RATERS, "r AS (SELECT lang, source, (first = 0)::INT AS h, (second = 1)::INT AS v FROM raters)", "g AS (SELECT lang, coalesce(source, 'ALL') AS source, count(*) AS n, sum(h) AS h, sum(v) AS v, sum(h * v) AS b, avg((h = v)::INT) AS po FROM r GROUP BY GROUPING SETS ((lang, source), (lang)))", "k AS (SELECT *, (h / n) * (v / n) + (1 - h / n) * (1 - v / n) AS pe FROM g)",
        body=f"SELECT lang, source, n, CAST(h AS BIGINT) AS human_fails, CAST(v AS BIGINT) AS validator_fails, CAST(b AS BIGINT) AS both_fail, round(h * v / n, 6) AS expected_both, round(po, 6) AS agreement, {_kappas('pe')} AS kappa FROM k",
    ),
    "edit_types": f"SELECT CASE WHEN t <> '' THEN {_edit_type_sql('t')} END AS edit_type, count(*) AS n FROM (SELECT trim(coalesce(text, '')) AS t FROM documents) GROUP BY 1",
    "keywords": f"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '([A-Za-z][A-Za-z''-]*)', 1) AS w, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')[1:12] AS f FROM documents),
        c AS (SELECT *, list_filter(w, lambda x: lower(x) NOT IN {_listed(text.STOPWORDS + text.EDIT_VERBS)}) AS k,
              list_reduce(list_transform(f, lambda x: {{'done': 1::BIGINT, 'n': length(x)::BIGINT}}), lambda a, b: CASE WHEN a.n + 1 + b.n <= 20 THEN {{'done': a.done, 'n': a.n + 1 + b.n}} ELSE {{'done': a.done + 1, 'n': b.n}} END) AS l FROM t WHERE len(f) > 0
              UNION ALL SELECT *, list_filter(w, lambda x: lower(x) NOT IN {_listed(text.STOPWORDS + text.EDIT_VERBS)}), NULL FROM t WHERE len(f) = 0)
        SELECT doc_id, coalesce(k[-1], w[-1], '') AS keyword, coalesce(l.done, 0) AS lines FROM c""",
    "sticker_slots": f"""
        WITH p AS (SELECT CAST(200 + l_partkey % 300 AS INT) AS w, CAST(150 + l_suppkey * 3 AS INT) AS h, l_orderkey AS o, l_partkey AS k, l_quantity AS q FROM lineitem),
        f AS (SELECT *, CAST(o % w AS INT) AS l, CAST(k % h AS INT) AS t, CAST(o % w AS INT) + CAST(floor(q * 5) AS INT) AS r, CAST(k % h AS INT) + 60 AS b FROM p), {_CLAMPED},
        s AS (SELECT *, least(greatest(8, CAST(floor(sqrt(w * h * 0.04::DOUBLE)) AS INT)), w // 2, h // 2) AS s, greatest(1, CAST(floor(least(w, h) * 0.02::DOUBLE) AS INT)) AS m, CAST(round_even(w * 0.6::DOUBLE, 0) AS INT) AS cw, CAST(round_even(h * 0.6::DOUBLE, 0) AS INT) AS ch FROM c),
        n AS (SELECT *, row_number() OVER () AS i, w - s - m AS sr, h - s - m AS sb, (w - s) // 2 AS mx, (h - s) // 2 AS my, (w - cw) // 2 AS cl, (h - ch) // 2 AS ct FROM s),
        u AS (SELECT i, unnest([{{'n': 'top-left', 'x': m, 'y': m}}, {{'n': 'top-right', 'x': sr, 'y': m}}, {{'n': 'bottom-left', 'x': m, 'y': sb}}, {{'n': 'bottom-right', 'x': sr, 'y': sb}}, {{'n': 'top-mid', 'x': mx, 'y': m}}, {{'n': 'bottom-mid', 'x': mx, 'y': sb}}, {{'n': 'left-mid', 'x': m, 'y': my}}, {{'n': 'right-mid', 'x': sr, 'y': my}}]) AS a FROM n),
        v AS (SELECT i, min({{'o': greatest(0, least(a.x + s, x1) - greatest(a.x, x0)) * greatest(0, least(a.y + s, y1) - greatest(a.y, y0)), 'n': a.n}}) AS best FROM u JOIN n USING (i) GROUP BY i),
        e AS (SELECT n.*, best, (x1 - x0) * (y1 - y0) AS area, greatest(0, least(x1, cl + cw) - greatest(x0, cl)) * greatest(0, least(y1, ct + ch) - greatest(y0, ct)) AS shared FROM n JOIN v USING (i))
        SELECT best.n AS slot, count(*) AS n, CAST(sum(best.o) AS BIGINT) AS overlap, round(avg(area / (w * h)::DOUBLE), 6) AS area_share, round(avg(CASE WHEN shared = 0 THEN 0.0::DOUBLE ELSE shared / (area + cw * ch - shared)::DOUBLE END), 6) AS iou FROM e GROUP BY 1""",
    "near_duplicate_vectors": """
        WITH p AS (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, other) AS n FROM p WHERE cosine >= 0.3) SELECT vec_id, other, round(cosine, 6) AS cosine FROM r WHERE n = 1""",
    "cue_label_rates": sql(
        RATERS, "l AS (SELECT CASE WHEN lang = 'en' THEN 'sham' ELSE lang END AS cue, CASE WHEN first = 0 THEN 'Yes' WHEN second = 1 THEN 'Slightly' ELSE 'No' END AS label FROM raters)", "c AS (SELECT cue, 'strict' AS threshold, count(*) AS n, count(*) FILTER (label = 'Yes') AS hits FROM l GROUP BY cue UNION ALL SELECT cue, 'loose', count(*), count(*) FILTER (label IN ('Yes', 'Slightly')) FROM l GROUP BY cue)",
        body=f"SELECT c.cue, c.threshold, c.n, c.hits, p.n AS placebo_n, p.hits AS placebo_hits, round(c.hits / c.n, 6) AS rate, {_wilson('c.hits', 'c.n')[0]} AS ci_low, {_wilson('c.hits', 'c.n')[1]} AS ci_high FROM c LEFT JOIN c p ON p.cue = 'sham' AND p.threshold = c.threshold",
    ),
    "cue_label_tests": sql(
        RATERS, "l AS (SELECT CASE WHEN lang = 'en' THEN 'sham' ELSE lang END AS cue, CASE WHEN first = 0 THEN 'Yes' WHEN second = 1 THEN 'Slightly' ELSE 'No' END AS label FROM raters)", "c AS (SELECT cue, 'strict' AS threshold, count(*) AS n, count(*) FILTER (label = 'Yes') AS hits FROM l GROUP BY cue UNION ALL SELECT cue, 'loose', count(*), count(*) FILTER (label IN ('Yes', 'Slightly')) FROM l GROUP BY cue)",
        "t AS (SELECT c.cue, c.threshold, c.hits AS a, c.n AS n1, p.hits AS pa, p.n AS n2, c.hits + p.hits AS k FROM c JOIN c p ON p.cue = 'sham' AND p.threshold = c.threshold WHERE c.cue <> 'sham')",
        # The hypergeometric chance of each table of the same margins; those no likelier than the one found are summed.
        "h AS (SELECT *, list_transform(range(greatest(0, k - n2), least(k, n1) + 1), lambda i: exp(lgamma(n1 + 1) - lgamma(i + 1) - lgamma(n1 - i + 1) + lgamma(n2 + 1) - lgamma(k - i + 1) - lgamma(n2 - k + i + 1) - lgamma(n1 + n2 + 1) + lgamma(k + 1) + lgamma(n1 + n2 - k + 1))) AS chances FROM t)",
        "p AS (SELECT *, least(1.0, list_sum(list_filter(chances, lambda v: v <= chances[a - greatest(0, k - n2) + 1] * (1 + 1e-7)))) AS p FROM h)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY p) AS up, count(*) OVER (PARTITION BY threshold) AS m FROM p)", "q AS (SELECT *, least(1.0, min(p * m / up) OVER (PARTITION BY threshold ORDER BY up DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)",
        body="SELECT cue, threshold, a AS hits, pa AS placebo_hits, round(p, 6) AS p, round(q, 6) AS q, q < 0.05 AS significant FROM q",
    ),
    "quality_summary": sql(
        VERDICTS, _VAL, "s AS (SELECT validator, cue, count(*) AS n, round(avg(passed::INT), 6) AS pass_rate, round(avg(ssim), 6) AS mean_ssim, round(min(ssim), 6) AS min_ssim FROM val GROUP BY ALL)",
        "m AS (SELECT a.validator, a.cue, round(avg(c.passed::INT), 6) AS floor_rate, count(*) FILTER (c.passed AND NOT a.passed) AS lost, count(*) FILTER (NOT c.passed AND a.passed) AS gained FROM val a JOIN val c ON c.cue = 'sham' AND a.cue <> 'sham' AND a.validator = c.validator AND a.base = c.base GROUP BY ALL)",
        f"p AS (SELECT *, {_MCN.format(b='lost', c='gained')} AS p FROM m)", "r AS (SELECT *, row_number() OVER (PARTITION BY validator ORDER BY p NULLS LAST) AS up, count(p) OVER (PARTITION BY validator) AS k FROM s LEFT JOIN p USING (validator, cue))",
        "q AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * k / up) OVER (PARTITION BY validator ORDER BY up DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM r)",
        body="SELECT validator, cue, n, pass_rate, mean_ssim, min_ssim, floor_rate, lost, gained, round(p, 6) AS p_matched, round(q, 6) AS q_matched, coalesce(q < 0.05, false) AS significant FROM q",
    ),
    "validator_sensitivity": sql(
        VERDICTS, _VAL, "fixed AS (SELECT cue AS condition, sample AS base FROM verdicts WHERE cue IN ('click', 'purchase') GROUP BY ALL HAVING max(d2) >= 10)", "sz AS (SELECT condition, count(*) AS n_fixed FROM fixed GROUP BY ALL)",
        "x AS (SELECT d.validator, d.cue AS condition, d.passed, c.passed AS clean FROM val d JOIN fixed f ON f.condition = d.cue AND f.base = d.base LEFT JOIN val c ON c.cue = 'sham' AND c.validator = d.validator AND c.base = d.base)",
        "a AS (SELECT validator, condition, count(*) AS n_own, count(*) FILTER (NOT passed) AS caught, count(*) FILTER (NOT clean) AS false_flags, count(clean) AS n_clean, count(*) FILTER (NOT passed AND clean) AS only_damaged, count(*) FILTER (passed AND NOT clean) AS only_clean FROM x GROUP BY ALL)",
        body=f"SELECT condition, validator, n_own, caught, false_flags, n_clean, only_damaged, only_clean, n_fixed, round(caught / n_fixed, 6) AS sens_fixed, round(caught / n_own, 6) AS sens_own, {_wilson('caught', 'n_fixed')[0]} AS ci_low, {_wilson('caught', 'n_fixed')[1]} AS ci_high, round(CASE WHEN n_clean <> 0 THEN false_flags / n_clean END, 6) AS false_flag_rate, round(caught / n_fixed - CASE WHEN n_clean <> 0 THEN false_flags / n_clean END, 6) AS discrimination, round({_MCN.format(b='only_damaged', c='only_clean')}, 6) AS p_mcnemar FROM a JOIN sz USING (condition)",
    ),
    "prompt_ablation": sql(
        VERDICTS, _VAL, "m AS (SELECT a.cue, count(*) AS n, avg(a.passed::INT) AS pass_rate, avg(c.passed::INT) AS floor_rate, count(*) FILTER (c.passed AND NOT a.passed) AS lost, count(*) FILTER (NOT c.passed AND a.passed) AS gained, count(*) FILTER (a.passed) AS k FROM val a JOIN val c ON a.validator = 'v1' AND c.validator = 'v0' AND a.cue = c.cue AND a.base = c.base GROUP BY ALL)",
        f"p AS (SELECT *, {_MCN.format(b='lost', c='gained')} AS p FROM m)", "r AS (SELECT *, row_number() OVER (ORDER BY p NULLS LAST) AS up, count(p) OVER () AS c FROM p)", "q AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * c / up) OVER (ORDER BY up DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM r)",
        body=f"SELECT cue, n, round(pass_rate, 6) AS pass_rate, round(floor_rate, 6) AS floor_rate, lost, gained, round(p, 6) AS p_matched, {_wilson('k', 'n')[0]} AS ci_low, {_wilson('k', 'n')[1]} AS ci_high, round(1 - floor_rate, 6) AS headroom, round(q, 6) AS q, coalesce(q < 0.05, false) AS significant FROM q",
    ),
    "rating_table": "WITH c AS (SELECT 'm1' AS model, s_suppkey % 5 = 0 AS gone, s_suppkey % 2 AS sc, (s_nationkey % 4) / 2.0::DOUBLE AS pq FROM supplier UNION ALL SELECT 'm2', s_suppkey % 7 = 0, s_suppkey % 2, (s_nationkey % 4) / 2.0::DOUBLE FROM supplier) SELECT model, round(avg(sc), 6) AS sc, round(avg(pq), 6) AS pq, count(*) AS raters, round(sqrt(avg(sc) * avg(pq)), 6) AS overall FROM c WHERE NOT gone AND pq <= 1 GROUP BY model",
    "dimension_labels": "SELECT user_id, round(arg_max(value, event_id) FILTER (event_type = 'view'), 6) AS view, round(arg_max(value, event_id) FILTER (event_type = 'click'), 6) AS click, round(arg_max(value, event_id) FILTER (event_type = 'error'), 6) AS error, bool_or(event_type = 'view') AND bool_or(event_type = 'click') AND bool_or(event_type = 'error') AS complete FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY user_id",
    "json_round_trip": "SELECT n_regionkey, 2 * count(*) AS rows, count(DISTINCT n_name) AS names FROM nation GROUP BY 1",
    "stream_append": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1",
    "stream_counts": "SELECT event_type, count(*) AS windows, CAST(sum(n) AS BIGINT) AS n, max(n) AS most FROM (SELECT event_type, date_trunc('day', ts) AS w, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type",
}
