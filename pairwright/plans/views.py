"""Stand-ins: the test tables dressed as verdicts, samples and pairs, in DataFrame and in SQL form. They are synthetic; what is computed
on them has no scientific meaning.

verdicts   events: judge by props.k mod 5, sample by user, condition by event type (view: baseline, error: control), three ratings by digits
           of the value; event_id is the stable order.
pool       lineitem: turn by order, editor by supplier mod 17, human score by price; the first row of each editor in a turn.
pairs      two editors of a turn, with verdicts in both display orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairwright.schemas import CONTROL

PART_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, judge, sample, cue, biased_id, d1, d2, d3, fine, overall, scale, parsed, repeat_index)."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    digit = lambda m: (1 + F.pmod(F.floor(F.col("value") * m + 1e-9), F.lit(10))).cast("int")
    cue = F.when(F.col("event_type") == "view", F.lit(None)).when(F.col("event_type") == "error", CONTROL).otherwise(F.col("event_type"))
    base = e.select(
        F.col("event_id").alias("ord"), F.concat(F.lit("j"), k % 5).alias("judge"), F.concat(F.lit("s"), F.col("user_id") % 40).alias("sample"), cue.alias("cue"), digit(1).alias("d1"), digit(10).alias("d2"), digit(100).alias("d3"),
        F.lit(10).alias("scale"), (F.col("event_id") % 50 != 0).alias("parsed"), F.when(F.col("event_id") % 7 == 0, 2).otherwise(1).alias("repeat_index"),
    )
    named = F.when(F.col("cue").isNotNull() & (F.col("cue") != "signup"), F.concat("sample", F.lit("__"), "cue"))
    return base.withColumn("biased_id", named).withColumn("fine", F.col("d1") + F.col("d2") + F.col("d3")).withColumn("overall", F.col("d1"))


VERDICTS = """
verdicts AS (
  SELECT ord, judge, sample, cue, CASE WHEN cue IS NOT NULL AND cue <> 'signup' THEN sample || '__' || cue END AS biased_id,
         d1, d2, d3, d1 + d2 + d3 AS fine, d1 AS overall, 10 AS scale, parsed, repeat_index
  FROM (SELECT event_id AS ord, 'j' || (CAST(json_extract_string(props, '$.k') AS INT) % 5) AS judge, 's' || (user_id % 40) AS sample,
               CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN 'sham' ELSE event_type END AS cue,
               CAST(1 + floor(value * 1 + 1e-9) % 10 AS INT) AS d1, CAST(1 + floor(value * 10 + 1e-9) % 10 AS INT) AS d2,
               CAST(1 + floor(value * 100 + 1e-9) % 10 AS INT) AS d3, event_id % 50 <> 0 AS parsed,
               CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS repeat_index FROM events))"""


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` before a window, so that they are sorted once, after the shuffle, and work by ``key`` finds them together; in more parts than the session's
    where a part would hold over ``PART_ROWS`` rows. Counting reads the files' footers."""
    least = -(-df.count() // PART_ROWS)
    return df.repartition(least, key) if least > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(key)


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, source, turn, editor, human, clean, sham, tint, inset): one row an editor of a turn."""
    li = table(spark, sf_dir, "lineitem")
    every = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    first = F.row_number().over(W.partitionBy("l_orderkey", F.col("l_suppkey") % 17).orderBy(*every))
    rows = _dealt(li, "l_orderkey").withColumn("_n", first).where("_n = 1")
    clean = (1 + F.col("l_quantity") % 10).cast("int")
    editor = (F.col("l_suppkey") % 17).cast("int")
    return rows.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), editor.cast("string")).alias("sample_id"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("status"), F.col("l_orderkey").alias("turn"), editor.alias("editor"),
        F.col("l_extendedprice").alias("human"), clean.alias("clean"), F.greatest(F.lit(1), clean + F.col("l_linenumber") % 3 - 1).cast("int").alias("sham"),
        F.least(F.lit(10), clean + (F.floor(F.col("l_discount") * 100 + 0.5) % 4)).cast("int").alias("tint"), F.when(F.floor(F.col("l_tax") * 100 + 0.5) != 8, 1 + (clean * 3 + F.floor(F.col("l_tax") * 100 + 0.5)) % 10).cast("int").alias("inset"),
    )


POOL = """
pool AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(editor AS VARCHAR) AS sample_id, l_returnflag AS source, l_linestatus AS status, l_orderkey AS turn, editor, l_extendedprice AS human, clean,
         CAST(greatest(1, clean + l_linenumber % 3 - 1) AS INT) AS sham,
         CAST(least(10, clean + CAST(floor(l_discount * 100 + 0.5) AS INT) % 4) AS INT) AS tint,
         CASE WHEN floor(l_tax * 100 + 0.5) <> 8 THEN CAST(1 + (clean * 3 + CAST(floor(l_tax * 100 + 0.5) AS INT)) % 10 AS INT) END AS inset
  FROM (SELECT *, CAST(l_suppkey % 17 AS INT) AS editor, CAST(1 + CAST(l_quantity AS INT) % 10 AS INT) AS clean,
               row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 17 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                                  l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem) WHERE n = 1)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, judge, cue, source, gap, winner, swapped, cued, side, preference): pairs of editors of a turn. ``winner`` and ``cued`` are on the pair's own
    sides; ``swapped`` is the letter displayed when the order is swapped; ``side`` is the side that wears the cue."""
    p = pool(spark, sf_dir)
    a, b = (p.select("turn", "source", *[F.col(c).alias(f"{c}_{s}") for c in ("editor", "human", "clean", "sham", "tint", "status")]) for s in "ab")
    both = a.join(b.drop("source"), "turn").where("editor_a < editor_b")
    verdict = lambda x, y: F.when(x > y, "A").when(x < y, "B").otherwise("Tie")
    side = F.when(F.col("turn") % 2 == 0, "A").otherwise("B")
    cued = F.when(side == "A", verdict(F.col("tint_a"), F.col("clean_b"))).otherwise(verdict(F.col("clean_a"), F.col("tint_b")))
    seen_swapped = F.when(F.col("status_a") == F.col("status_b"), verdict(F.col("clean_b"), F.col("clean_a"))).otherwise(verdict(F.col("sham_b"), F.col("clean_a")))
    gap = F.col("human_a") - F.col("human_b")
    return both.select(
        F.concat_ws("-", F.col("turn").cast("string"), F.col("editor_a").cast("string"), F.col("editor_b").cast("string")).alias("pair_id"), F.concat(F.lit("j"), F.col("turn") % 3).alias("judge"), F.lit("tint").alias("cue"), "source", "turn", "editor_a", "editor_b",
        gap.alias("gap"), verdict(F.col("clean_a"), F.col("clean_b")).alias("winner"), seen_swapped.alias("swapped"), cued.alias("cued"), side.alias("side"), F.when(gap > 0, "A").when(gap < 0, "B").otherwise("Tie").alias("preference"),
    )


PAIRS = """
pairs AS (
  SELECT CAST(a.turn AS VARCHAR) || '-' || CAST(a.editor AS VARCHAR) || '-' || CAST(b.editor AS VARCHAR) AS pair_id, 'j' || (a.turn % 3) AS judge, 'tint' AS cue, a.source, a.turn,
         a.editor AS editor_a, b.editor AS editor_b, a.human - b.human AS gap,
         CASE WHEN a.clean > b.clean THEN 'A' WHEN a.clean < b.clean THEN 'B' ELSE 'Tie' END AS winner,
         CASE WHEN a.status = b.status THEN CASE WHEN b.clean > a.clean THEN 'A' WHEN b.clean < a.clean THEN 'B' ELSE 'Tie' END
              ELSE CASE WHEN b.sham > a.clean THEN 'A' WHEN b.sham < a.clean THEN 'B' ELSE 'Tie' END END AS swapped,
         CASE WHEN a.turn % 2 = 0 THEN CASE WHEN a.tint > b.clean THEN 'A' WHEN a.tint < b.clean THEN 'B' ELSE 'Tie' END
              ELSE CASE WHEN a.clean > b.tint THEN 'A' WHEN a.clean < b.tint THEN 'B' ELSE 'Tie' END END AS cued,
         CASE WHEN a.turn % 2 = 0 THEN 'A' ELSE 'B' END AS side,
         CASE WHEN a.human > b.human THEN 'A' WHEN a.human < b.human THEN 'B' ELSE 'Tie' END AS preference
  FROM pool a JOIN pool b ON a.turn = b.turn AND a.editor < b.editor)"""


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, first, second): two binary raters."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id").select("doc_id", "source", "lang", F.col("quality").alias("first"), F.col("toxic").alias("second"))


RATERS = "raters AS (SELECT doc_id, source, lang, quality AS first, toxic AS second FROM labels JOIN documents USING (doc_id))"


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def sql(*views: str, body: str) -> str:
    return "WITH " + ", ".join(views) + "\n" + body
