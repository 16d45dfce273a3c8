"""Files of an audit as tables: label sheets and their keys, region audits, validator verdicts, control manifests, raw answers, judges by their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.text import slug
from pairwright.sources import files, tree

# The label column of a sheet, its categories.
LABEL, CATEGORIES = "quality_changed (No/Slightly/Yes)", ("No", "Slightly", "Yes")


def _cell(df: DataFrame, name: str) -> Column:
    """A trimmed cell, null if it is blank or the sheet has no such column."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def read_sheets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(package, biased_id, bias_type, label) of label sheets; rows without cue or label are left out, a missing sheet has none. ``biased_id`` may be null. The package is the file's folder or, where a sheet
    is one file, its name."""
    parts = []
    for p in paths:
        if files._exists(spark, p):
            sheet = files.read_csv(spark, p, [])
            name = F.lit(p.rstrip("/").rsplit("/", 1)[-1].removesuffix(".csv"))
            parts.append(sheet.select(name.alias("package"), _cell(sheet, "biased_id").alias("biased_id"), _cell(sheet, "bias_type").alias("bias_type"), _cell(sheet, LABEL).alias("label")))
    if not parts:
        return spark.createDataFrame([], "package string, biased_id string, bias_type string, label string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("bias_type is not null and label is not null")


def fold_sheets(rows: DataFrame, validated: DataFrame) -> DataFrame:
    """(bias_type, n_human, n_ids, n_human_matched, packages) of sheet rows: labels, different ids, those of them that ``validated`` (bias_type, biased_id) has too, and the sheets they come from."""
    counts = rows.groupBy("bias_type").agg(F.count("*").alias("n_human"), F.array_join(F.array_sort(F.collect_set("package")), ",").alias("packages"))
    ids = rows.where("biased_id is not null").select("bias_type", "biased_id").distinct()
    met = ids.join(validated.select("bias_type", "biased_id", F.lit(True).alias("seen")).distinct(), ["bias_type", "biased_id"], "left")
    return counts.join(met.groupBy("bias_type").agg(F.count("*").alias("n_ids"), F.count("seen").alias("n_human_matched")), "bias_type", "left").fillna(0, ["n_ids", "n_human_matched"])


def read_resolved(spark: SparkSession, path: str) -> DataFrame:
    """(biased_id, bias_type, label) of an unblinded sheet: rows of one of the three categories; of rows of one id the last."""
    sheet = files.read_csv(spark, path, ["biased_id", "bias_type", LABEL]).withColumn("ord", F.monotonically_increasing_id())
    kept = sheet.where(F.col(f"`{LABEL}`").isin(*CATEGORIES)).select("biased_id", "bias_type", F.col(f"`{LABEL}`").alias("label"), "ord")
    return kept.groupBy("biased_id").agg(F.max_by(F.struct("bias_type", "label"), "ord").alias("r")).select("biased_id", "r.*")


def read_second_sheet(spark: SparkSession, sheet: str, key: str) -> DataFrame:
    """(biased_id, label) of a second rater's sheet, whose numbers are told apart by its own key file; a number that the key lacks is an error."""
    labels = files.read_csv(spark, sheet, ["index", LABEL], {"index": "int"}).where(F.col(f"`{LABEL}`").isin(*CATEGORIES)).select("index", F.col(f"`{LABEL}`").alias("label"))
    of = files.read_csv(spark, key, ["index", "biased_id"], {"index": "int"}).groupBy("index").agg(F.max("biased_id").alias("biased_id"))
    if lost := labels.join(of, "index", "left_anti").head(1):
        raise files.BadRows(f"{key} lacks index {lost[0]['index']}")
    return labels.join(of, "index").select("biased_id", "label")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, box array<int>) of region audits: JSON files with a list ``per_sample`` of sample_id and bbox_fixed."""
    raw = spark.read.option("multiLine", True).schema("per_sample array<struct<sample_id:string,bbox_fixed:array<int>>>").json(path)
    return raw.select(F.inline("per_sample")).select("sample_id", F.col("bbox_fixed").alias("box"))


def _in_order() -> Column:
    """The order of lines: by file, by place in it."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def read_verdicts(spark: SparkSession, folder: str, task: str = "validation") -> DataFrame:
    """(judge, base, cue, passed) of the raw verdict files ``task``__judge.jsonl of a folder (each a file, or a folder of parts). Rows that did not parse have no verdict (no word on it counts as parsed), ``passed`` stands in for
    an absent ``pass``; ids are split at their last ``__``; of rows of one judge, base and cue the last of its file counts."""
    judge = F.regexp_extract("_metadata.file_path", rf"/{task}__([^/]+)\.jsonl(?:/[^/]*)?$", 1)
    lines = spark.read.text(f"{folder}/{task}__*.jsonl").select("value", F.url_decode(judge).alias("judge"), _in_order().alias("ord")).where(F.trim("value") != "")
    v = F.parse_json("value")
    rows = lines.select(
        "judge", "ord", F.coalesce(F.try_variant_get(v, "$.biased_id", "string"), F.lit("")).alias("id"), F.coalesce(F.try_variant_get(v, "$.parse_success", "boolean"), F.lit(True)).alias("parsed"),
        F.coalesce(F.try_variant_get(v, "$.pass", "boolean"), F.try_variant_get(v, "$.passed", "boolean")).alias("passed"),
    )
    told = rows.where("parsed and passed is not null").select("judge", F.regexp_extract("id", r"(?s)^(.*)__", 1).alias("base"), F.regexp_extract("id", r"(?s)^(?:.*__)?(.*)$", 1).alias("cue"), "passed", "ord")
    return told.groupBy("judge", "base", "cue").agg(F.max_by("passed", "ord").alias("passed"))


def read_control(spark: SparkSession, path: str) -> DataFrame:
    """(condition, base, params variant) of a control manifest; of rows of one condition and base the last counts."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("v"), _in_order().alias("ord"))
    keyed = lines.select(F.variant_get("v", "$.bias_type", "string").alias("condition"), F.variant_get("v", "$.base_sample_id", "string").alias("base"), F.to_json(F.try_variant_get("v", "$.bias_params", "variant")).alias("params"), "ord")
    return keyed.groupBy("condition", "base").agg(F.max_by(F.struct("params"), "ord").alias("r")).select("condition", "base", F.parse_json(F.coalesce("r.params", F.lit("{}"))).alias("params"))


def discover_judges(spark: SparkSession, folder: str, task: str, roster: list[str] | None = None) -> DataFrame:
    """(judge) of the raw verdict files of a task, from their names alone; of a roster those on it."""
    names = tree.read_tree(spark, folder, depth=1).where("top = 'raw_judgments'")
    found = names.select(F.regexp_extract("path", rf"^raw_judgments/{task}__([^/]+)\.jsonl(?:/|$)", 1).alias("judge")).where("judge <> ''").distinct()
    return found.where(F.col("judge").isin(roster)) if roster is not None else found


def write_verdict_files(lines: DataFrame, folder: str, task: str, judge: str = "judge") -> None:
    """Lines (judge, value) written as ``task``__judge.jsonl, a folder of parts for each judge, in the order of the partitions and of the lines in them."""
    lines.select("value", judge).write.partitionBy(judge).mode("overwrite").text(folder)
    spark = lines.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in system.listStatus(path(folder)):
        name = f.getPath().getName()
        if name.startswith(f"{judge}="):
            system.rename(f.getPath(), path(f"{folder}/{task}__{name.partition('=')[2]}.jsonl"))


def save_raw_answers(answers: DataFrame, root: str, folder: str = "raw") -> DataFrame:
    """(path, size, written) of raw answers (judge_model, result_id, raw_text), a text file each: folder/judge/result.txt, names made safe for files. Written before anything is parsed; null answers are passed over."""
    path = F.concat_ws("/", F.lit(folder), slug(F.col("judge_model")), F.concat(slug(F.replace(F.col("result_id"), F.lit("::"), F.lit("__"))), F.lit(".txt")))
    return tree.write_contents(answers.select(path.alias("path"), F.col("raw_text").cast("binary").alias("content")), root)
