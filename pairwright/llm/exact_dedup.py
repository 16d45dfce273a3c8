"""Exact dedup: rows of equal text form a group by 128-bit content hash, bytes are compared inside groups, one row of each group stays.

Plan, DataFrame functions only:

1. Bytes: the different (hash, text) pairs are one hash aggregation (its keys are compared byte by byte; copies fold before the shuffle). A
   hash that stands for more than one text gets a number for each of them; there are none unless MD5 collides, and then all goes on the same.
2. Every row is written as (id, hash, number, SHA-256, row number): a few dozen bytes a document. Texts are not touched again.
3. Groups: one aggregation of these rows gives size and the row that stays.
4. Back to the rows: groups of more than a ``hot_groups``-th of all rows, fewer than ``hot_groups`` by count, are broadcast; every other group
   is joined by its key, so no task gets more than that share of the rows for one key.

Defined results: a null text is the empty text. Ids may be null or repeated: the largest (or smallest) id that is not null is the group's, and
exactly one row of a group stays, of several rows of that id any one; a group without ids has a null keep_id and one row that stays. Long texts are
compared whole. An empty table gives an empty table. Other columns do not pass (join the result by id, or take ``kept``); their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, settled


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", keep_largest: bool = False, hash_of: Callable[[Column], Column] = content_hash, hot_groups: int = 10_000) -> DataFrame:  # noqa: A002
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256. By default the smallest id stays."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.withColumn("hash", hash_of(F.col("body")))
    texts = rows.select("hash", "body").distinct()
    collided = settled(texts.groupBy("hash").count().where("count > 1").select("hash"))
    if collided.isEmpty():
        rows = rows.withColumn("number", F.lit(-1).cast("long"))
    else:
        numbered = settled(texts.join(collided, "hash", "left_semi").withColumn("number", F.monotonically_increasing_id()))
        rows = rows.join(numbered, ["hash", "body"], "left").withColumn("number", F.coalesce("number", F.lit(-1)))
    keyed = settled(rows.select("id", "hash", "number", F.unhex(F.sha2("body", 256)).alias("sha"), F.monotonically_increasing_id().alias("row")))
    extreme, by = (F.max, F.max_by) if keep_largest else (F.min, F.min_by)
    groups = settled(keyed.groupBy("hash", "number").agg(F.count("*").alias("group_size"), extreme("id").alias("keep_id"), F.coalesce(by("row", "id"), F.min("row")).alias("stays")))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") * hot_groups > total
    key = ["hash", "number"]
    large = F.broadcast(groups.where(hot))
    joined = keyed.join(large, key).unionByName(keyed.join(large.select(key), key, "left_anti").join(groups.where(~hot), key))
    forget(spark, collided)
    return joined.select(F.col("id").alias(id), "keep_id", "group_size", (F.col("row") == F.col("stays")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
