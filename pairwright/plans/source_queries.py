"""Queries over files of an audit, torn lines and open metadata that Spark derives from the test tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import metadata, unfold
from pairwright.plans.record_queries import _shared
from pairwright.plans.views import table
from pairwright.sources import files, reports, tree


def _k():  # noqa: ANN202
    return F.get_json_object("props", "$.k").cast("int")


def label_sheets(spark: SparkSession, d: str) -> DataFrame:
    """SRC5: two label sheets written as CSV and read back: rows without cue or label left out, labels, ids and ids that a validator has seen too, by cue."""
    at = _shared(spark, "sheets")
    i = F.col("doc_id")
    label = F.when(i % 11 == 0, F.lit(" ")).when(F.col("quality") == 1, "No").when(F.col("toxic") == 1, "Yes").otherwise(" Slightly ")
    rows = table(spark, d, "labels").select(i, F.when(i % 4 != 0, F.concat(F.lit("d"), i)).alias("biased_id"), F.when(i % 13 != 0, F.concat(F.lit("c"), i % 5)).alias("bias_type"), label.alias(reports.LABEL))
    for name, part in (("pilot.csv", rows.where(i % 2 == 0)), ("second.csv", rows.where(i % 2 == 1))):
        part.drop("doc_id").write.option("header", True).csv(f"{at}/{name}")
    read = reports.read_sheets(spark, [f"{at}/pilot.csv", f"{at}/second.csv", f"{at}/absent.csv"])
    seen = rows.where(i % 3 == 0).select("bias_type", "biased_id")
    return reports.fold_sheets(read, seen)


def record_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC1, SRC2, SRC3, SRC4, SRC20: all sales written as JSON lines and as CSV, in parts, read back by declared schemas; an absent file is an empty table; rows, ids and totals by status."""
    at = _shared(spark, "records")
    sales = table(spark, d, "sales").select("sale_id", "client_id", "status", "total", "priority")
    files.write_jsonl(sales, f"{at}/json")
    sales.write.option("header", True).csv(f"{at}/csv")
    back = files.read_required(spark, f"{at}/json", sales.schema)
    typed = files.read_csv(spark, f"{at}/csv", ["sale_id", "status", "total"], {"sale_id": "long", "client_id": "long", "total": "double", "priority": "int"})
    none = files.read_or_empty(spark, f"{at}/none", sales.schema)
    rows = back.withColumn("kind", F.lit("json")).unionByName(typed.withColumn("kind", F.lit("csv"))).unionByName(none.withColumn("kind", F.lit("none")))
    own = [F.count("*").alias("n"), F.count_distinct("sale_id").alias("ids"), F.count("client_id").alias("named"), F.round(F.sum("total"), 2).alias("total"), F.sum("priority").alias("priorities")]
    return rows.groupBy("kind", "status").agg(*own)


def second_rater(spark: SparkSession, d: str) -> DataFrame:
    """SRC18: an unblinded sheet and a renumbered second one with its key, joined by what they label; how often the raters agree by cue."""
    at = _shared(spark, "raters")
    own = table(spark, d, "labels").select("doc_id", F.concat(F.lit("d"), F.col("doc_id")).alias("biased_id"), F.concat(F.lit("c"), F.col("doc_id") % 5).alias("bias_type"), (F.col("doc_id") * 7 + 3).alias("index"), "quality", "toxic")
    word = lambda c: F.when(F.col("doc_id") % 17 == 0, "?").when(F.col(c) == 1, "Yes").otherwise("No").alias(reports.LABEL)
    own.select("biased_id", "bias_type", word("quality")).write.option("header", True).csv(f"{at}/resolved")
    own.select("index", word("toxic")).write.option("header", True).csv(f"{at}/labels")
    own.select("index", "biased_id").write.option("header", True).csv(f"{at}/key")
    first, second = reports.read_resolved(spark, f"{at}/resolved"), reports.read_second_sheet(spark, f"{at}/labels", f"{at}/key").withColumnRenamed("label", "other")
    return first.join(second, "biased_id").groupBy("bias_type").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("other")).alias("agreed"))


def audit_boxes(spark: SparkSession, d: str) -> DataFrame:
    """SRC16, FLT11: an audit's JSON read into boxes, the manifest's lines of one cue and the audited ids met with them; rows and areas by cue."""
    at = _shared(spark, "audit")
    e = table(spark, d, "events").where("event_id % 3 = 0")
    box = F.array(_k() % 50, F.col("event_id") % 40, _k() % 50 + 10 + _k() % 7, F.col("event_id") % 40 + 8)
    # Audits of a hundred samples each: one JSON file is one report.
    audits = e.groupBy(F.floor(F.col("event_id") / 300).alias("part")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.concat(F.lit("s"), "event_id").alias("sample_id"), box.alias("bbox_fixed"))).alias("per_sample"))).alias("value"))
    tree.write_contents(audits.select(F.format_string("audit/%d.json", "part").alias("path"), F.col("value").cast("binary").alias("content")), at).count()
    table(spark, d, "events").select(F.concat(F.lit("s"), "event_id").alias("base_sample_id"), F.col("event_type").alias("bias_type")).write.json(f"{at}/manifest")
    found = reports.read_audit(spark, f"{at}/audit")
    rows = spark.read.schema("base_sample_id string, bias_type string").json(f"{at}/manifest").where("bias_type in ('click', 'error')")
    area = (F.col("box")[2] - F.col("box")[0]) * (F.col("box")[3] - F.col("box")[1])
    return rows.join(found, F.col("base_sample_id") == F.col("sample_id")).groupBy("bias_type").agg(F.count("*").alias("n"), F.sum(area).alias("area"))


def verdict_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC17, FLT10: raw verdict files, one a judge: unparsed rows dropped, ``pass`` or ``passed``, ids split at their last ``__``, the last row of an id wins; judges are found by their files' names, and of a roster three."""
    at = _shared(spark, "verdicts")
    e = table(spark, d, "events").withColumn("i", F.col("event_id")).withColumn("judge", F.concat(F.lit("v"), _k() % 5))
    said = F.when(F.col("i") % 9 == 0, F.lit(None)).otherwise(F.floor("value") % 3 != 0)
    row = F.to_json(F.struct(
        F.when(F.col("i") % 37 != 0, F.concat(F.lit("s_"), F.col("i") % 900, F.lit("__x__"), "event_type")).alias("biased_id"), F.when(F.col("i") % 4 != 0, F.col("i") % 8 != 1).alias("parse_success"),
        F.when(F.col("i") % 2 == 0, said).alias("pass"), F.when(F.col("i") % 2 == 1, said).alias("passed"),
    ))
    lines = e.repartitionByRange("i").sortWithinPartitions("i").select("judge", F.when(F.col("i") % 50 == 0, F.lit(" ")).otherwise(row).alias("value"))
    reports.write_verdict_files(lines, f"{at}/raw_judgments", "validation")
    read = reports.read_verdicts(spark, f"{at}/raw_judgments")
    judges = reports.discover_judges(spark, at, "validation", roster=["v0", "v1", "v3", "nobody"])
    return read.join(judges, "judge").groupBy("judge", "cue").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.max("base").alias("last_base"))


def raw_answers(spark: SparkSession, d: str) -> DataFrame:
    """SRC22: raw answers written as text files named by judge and result, before they are parsed; a second run writes none, and what is read back is what was said."""
    at = _shared(spark, "raw")
    c = table(spark, d, "conversations").where("text is not null").select(F.concat(F.lit("lab/"), "role").alias("judge_model"), F.concat_ws("::", F.concat(F.lit("c"), "conv_id"), F.col("turn").cast("string")).alias("result_id"), F.col("text").alias("raw_text"))
    once = c.groupBy("judge_model", "result_id").agg(F.min("raw_text").alias("raw_text"))
    first = reports.save_raw_answers(once, at).agg(F.count_if("written").alias("written")).first()[0]
    again = reports.save_raw_answers(once, at).agg(F.count_if("written").alias("written")).first()[0]
    back = tree.read_tree(spark, at, content=True, depth=2).where("suffix = '.txt'")
    return back.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("name").alias("first_name")).withColumns({"written": F.lit(first).cast("long"), "written_again": F.lit(again).cast("long")})


def unfolded_lines(spark: SparkSession, d: str) -> DataFrame:
    """Table function: result lines that were glued together or torn, unfolded into objects and torn pieces; ids once each, by what they were."""
    e = table(spark, d, "events").select("event_id")
    i = F.col("event_id")
    one = lambda k: F.concat(F.lit('{"result_id": "r'), i * 2 + k, F.lit('", "note": "a } b { c"}'))
    line = F.concat(one(0), F.when(i % 5 == 0, '{"result_id": "to').otherwise(""), F.when(i % 3 == 0, one(1)).otherwise(""), F.when(i % 7 == 0, " tail").otherwise(""))
    parts = unfold.unfold_lines(e.select("event_id", F.when(i % 11 == 0, F.lit(" ")).otherwise(line).alias("value")))
    told = parts.where("part is not null").select("part", "problem", F.get_json_object("value", "$.result_id").alias("id"))
    return told.groupBy("part", "problem").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def audit_regions(spark: SparkSession, d: str) -> DataFrame:
    """SRC16: regions nested in regions of audits, unfolded at any depth through SQL."""
    unfold.register(spark)
    i, q = F.col("l_orderkey"), F.col("l_quantity").cast("int")
    inner = F.struct(F.lit("inner").alias("name"), F.array(q, q, q + 2, q + 3).alias("box"))
    outer = F.struct(F.concat(F.lit("o"), F.col("l_linenumber")).alias("name"), F.array(F.lit(0), F.lit(0), q + 10, q + 10).alias("box"), F.when(F.col("l_linenumber") % 2 == 0, F.array(inner, inner)).otherwise(F.array(inner)).alias("parts"))
    # Lines of an order are seven at most.
    audits = table(spark, d, "lineitem").groupBy(i.alias("audit_id")).agg(F.to_json(F.struct(F.lit("x").alias("image"), F.collect_list(outer).alias("regions"))).alias("audit"))
    audits.createOrReplaceTempView("audits_of_orders")
    return spark.sql("SELECT depth, name, count(*) AS n, sum((right - left) * (bottom - top)) AS area FROM audits_of_orders a, LATERAL unfold_regions(a.audit) GROUP BY ALL")


def open_filters(spark: SparkSession, d: str) -> DataFrame:
    """FLT1 over VARIANT: records filtered by nested metadata, by value, by list and by kind: the number 3 is not the text "3"."""
    e = table(spark, d, "events").withColumn("k", _k())
    raw = F.to_json(F.struct(
        F.struct(F.when(F.col("k") % 2 == 0, "breadth").otherwise("anchor").alias("subset"), (F.col("k") % 7).alias("size")).alias("block"), F.when(F.col("k") % 3 == 0, F.lit("3")).otherwise(F.lit(None)).alias("note"), (F.col("k") % 5 == 0).alias("has_mask"),
    ))
    rows = e.select("event_id", "event_type", metadata.open_metadata(F.when(F.col("event_id") % 97 == 0, F.lit("{torn")).otherwise(raw)).alias("metadata"))
    wanted = {"breadth": {"block.subset": "breadth"}, "sizes": {"block.size": [1, 3], "event_type": ["click", "view"]}, "text_3": {"note": "3"}, "number_3": {"note": 3}, "no_note": {"note": None}, "masked": {"has_mask": True, "block.subset": "anchor"}}
    return rows.agg(*[F.count_if(metadata.matches(rows, w)).alias(k) for k, w in wanted.items()], F.sum(metadata.meta(F.col("metadata"), "block.size", "long")).alias("sizes_sum"))


def instruction_cells(spark: SparkSession, d: str) -> DataFrame:
    """STR11, STR13: instruction cells that are a text or a list of paraphrases, by row; the first that is not blank counts. Bracketed spans, numbers and yes or no of prompts and answers."""
    c = table(spark, d, "conversations").withColumn("line", F.coalesce(F.get(F.split("text", "\n"), F.lit(0)), F.lit("")))
    cell = F.when(F.col("turn") % 3 == 0, F.to_json(F.array(F.lit("  "), F.col("line"), F.lit("other")))).when(F.col("turn") % 3 == 1, F.to_json(F.array())).otherwise(F.concat(F.lit('"  '), F.regexp_replace("line", r'["\\]', ""), F.lit(' "')))
    rows = c.select("conv_id", "turn", "line", metadata.open_metadata(cell).alias("cell"), F.concat(F.lit("Edit by [ "), "role", F.lit(" ], answer in [json] "), "turn").alias("query"))
    told = rows.select("turn", metadata.instruction_text(rows, "cell").alias("text"), metadata.bracketed(F.col("query")).alias("bracketed"), metadata.first_number(F.col("query")).alias("number"), metadata.yes_or_no(F.col("line")).alias("yes"))
    return told.groupBy("bracketed").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("text") == "").alias("empty"), F.sum("number").alias("numbers"), F.count_if("yes").alias("yes"), F.count_if(~F.col("yes")).alias("no"))


QUERIES = {f.__name__: f for f in (record_files, label_sheets, second_rater, audit_boxes, verdict_files, raw_answers, unfolded_lines, audit_regions, open_filters, instruction_cells)}

_KS = "CAST(json_extract_string(props, '$.k') AS INT)"

ORACLES = {
    "record_files": "SELECT kind, status, count(*) AS n, count(DISTINCT sale_id) AS ids, count(client_id) AS named, round(sum(total), 2) AS total, CAST(sum(priority) AS BIGINT) AS priorities FROM sales, (VALUES ('json'), ('csv')) k(kind) GROUP BY ALL",
    "label_sheets": """
        WITH r AS (SELECT doc_id AS i, 'c' || (doc_id % 5) AS bias_type, CASE WHEN doc_id % 4 <> 0 THEN doc_id END AS id, CASE WHEN doc_id % 2 = 0 THEN 'pilot' ELSE 'second' END AS package FROM labels WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0)
        SELECT bias_type, count(*) AS n_human, string_agg(DISTINCT package, ',' ORDER BY package) AS packages, count(DISTINCT id) AS n_ids, count(DISTINCT id) FILTER (i % 3 = 0) AS n_human_matched FROM r GROUP BY 1""",
    "second_rater": "SELECT 'c' || (doc_id % 5) AS bias_type, count(*) AS n, count(*) FILTER ((quality = 1) = (toxic = 1)) AS agreed FROM (SELECT DISTINCT * FROM labels) WHERE doc_id % 17 <> 0 GROUP BY 1",
    "audit_boxes": f"SELECT event_type AS bias_type, count(*) AS n, CAST(sum((10 + {_KS} % 7) * 8) AS BIGINT) AS area FROM events WHERE event_id % 3 = 0 AND event_type IN ('click', 'error') GROUP BY 1",
    "verdict_files": f"""
        WITH v AS (SELECT 'v' || ({_KS} % 5) AS judge, event_id AS i, CASE WHEN event_id % 37 <> 0 THEN 's_' || (event_id % 900) || '__x' ELSE '' END AS base, CASE WHEN event_id % 37 <> 0 THEN event_type ELSE '' END AS cue, CAST(floor(value) AS BIGINT) % 3 <> 0 AS passed FROM events
                   WHERE event_id % 9 <> 0 AND event_id % 50 <> 0 AND (event_id % 4 = 0 OR event_id % 8 <> 1)),
        o AS (SELECT judge, base, cue, arg_max(passed, i) AS passed FROM v GROUP BY ALL)
        SELECT judge, cue, count(*) AS n, count(*) FILTER (passed) AS passed, max(base) AS last_base FROM o WHERE judge IN ('v0', 'v1', 'v3') GROUP BY ALL""",
    "raw_answers": """
        WITH o AS (SELECT role, 'c' || conv_id || '__' || turn || '.txt' AS name, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL)
        SELECT 'raw/lab-' || role AS folder, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, min(name) AS first_name, (SELECT count(*) FROM o) AS written, 0::BIGINT AS written_again FROM o GROUP BY role""",
    "unfolded_lines": """
        WITH l AS (SELECT event_id AS i, event_id % 5 = 0 AS torn, event_id % 3 = 0 AS two, event_id % 7 = 0 AS tail FROM events WHERE event_id % 11 <> 0),
        p AS (SELECT 0 AS part, NULL AS problem, i * 2 AS id FROM l UNION ALL SELECT 1, 'torn', NULL FROM l WHERE torn OR (tail AND NOT two) UNION ALL SELECT CASE WHEN torn THEN 2 ELSE 1 END, NULL, i * 2 + 1 FROM l WHERE two
              UNION ALL SELECT CASE WHEN torn THEN 3 ELSE 2 END, 'torn', NULL FROM l WHERE tail AND two)
        SELECT part, problem, count(*) AS n, count(DISTINCT id) AS ids FROM p GROUP BY ALL""",
    "audit_regions": """
        WITH l AS (SELECT l_linenumber AS n, CAST(l_quantity AS INT) AS q FROM lineitem)
        SELECT 0 AS depth, 'o' || n AS name, count(*) AS n, CAST(sum((q + 10) * (q + 10)) AS BIGINT) AS area FROM l GROUP BY ALL
        UNION ALL SELECT 1, 'inner', CAST(sum(CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT), CAST(sum(CASE WHEN n % 2 = 0 THEN 12 ELSE 6 END) AS BIGINT) FROM l""",
    "open_filters": f"""
        WITH e AS (SELECT event_type, event_id % 97 = 0 AS torn, {_KS} AS k FROM events)
        SELECT count(*) FILTER (NOT torn AND k % 2 = 0) AS breadth, count(*) FILTER (NOT torn AND k % 7 IN (1, 3) AND event_type IN ('click', 'view')) AS sizes, count(*) FILTER (NOT torn AND k % 3 = 0) AS text_3, 0::BIGINT AS number_3,
               count(*) FILTER (torn OR k % 3 <> 0) AS no_note, count(*) FILTER (NOT torn AND k % 5 = 0 AND k % 2 <> 0) AS masked, CAST(sum(k % 7) FILTER (NOT torn) AS BIGINT) AS sizes_sum FROM e""",
    "instruction_cells": r"""
        WITH c AS (SELECT role, turn, coalesce(string_split(text, chr(10))[1], '') AS line FROM conversations),
        t AS (SELECT role, turn, line, CASE turn % 3 WHEN 0 THEN CASE WHEN trim(line) = '' THEN 'other' ELSE trim(line) END WHEN 1 THEN '' ELSE trim(regexp_replace(line, '["\\]', '', 'g')) END AS text FROM c)
        SELECT role AS bracketed, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (text = '') AS empty, sum(turn)::DOUBLE AS numbers, count(*) FILTER (lower(line) LIKE '%yes%') AS yes,
               count(*) FILTER (lower(line) NOT LIKE '%yes%' AND lower(line) LIKE '%no%') AS no FROM t GROUP BY 1""",
}
