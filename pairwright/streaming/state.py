"""Structured Streaming with state that the watermark lets go (extensions): sessions, closed windows, a join of two streams within a time, repeated asks.

Each writer drains what is there (``availableNow``) into parquet files in append mode, exactly once by its checkpoint, and returns how many late rows the
watermark dropped. What the watermark has not closed stays in the checkpoint's state for the next run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def drain(rows: DataFrame, path: str, checkpoint: str, by: list[str] | None = None) -> int:
    """Append what the stream holds to ``path``; the number of rows that came too late."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.partitionBy(*by) if by else writer).start()
    query.awaitTermination()
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in p["stateOperators"])


def sessions(stream: DataFrame, by: str, time: str, gap: str, delay: str, measures: dict[str, str]) -> DataFrame:
    """(by, start, end, n, measures): sessions that the watermark has closed. ``measures`` names sums of columns. Sessions of one task are merged before the shuffle, so that a
    key of very many rows comes as few."""
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    held = stream.where(F.col(time).isNotNull()).withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), by)
    return held.agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in measures.items()]).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", *measures)


def closed_counts(stream: DataFrame, by: str, time: str, width: str, delay: str) -> DataFrame:
    """(start, by, n) of windows that the watermark has closed; their state goes."""
    counts = stream.where(F.col(time).isNotNull()).withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), by, "n")


def matched_within(first: DataFrame, second: DataFrame, by: str, first_time: str, second_time: str, seconds: int, delay: str) -> DataFrame:
    """Each row of ``first`` with each of ``second`` of its key that follows within so many seconds (ends included), column names being different but for ``by``. Both sides wait in state for
    that time and the delay only. Rows meet by key and span of time, so a frequent key is dealt over its spans; a row of the second side stands in two."""
    span = lambda c: F.floor(F.unix_seconds(c) / seconds)
    a = first.where(F.col(by).isNotNull()).withWatermark(first_time, delay).withColumn("span_a", span(first_time))
    b = second.withColumnRenamed(by, "key_b").where("key_b is not null").withWatermark(second_time, delay)
    b = b.withColumn("span_b", F.explode(F.array(span(second_time), span(second_time) - 1)))
    near = (F.col(second_time) >= F.col(first_time)) & (F.col(second_time) <= F.col(first_time) + F.expr(f"interval {seconds} seconds"))
    return a.join(b, (F.col(by) == F.col("key_b")) & (F.col("span_a") == F.col("span_b")) & near).drop("span_a", "span_b", "key_b")


def repeated_asks(stream: DataFrame, by: list[str], time: str, order: str, score: str, delay: str, keep_ms: int) -> DataFrame:
    """(by, before, after, score_before, score_after): each ask with the one before it of the same key, by time and then ``order`` (both numbers). The state of a key is one ask; it goes when
    the watermark is ``keep_ms`` past it. A key's rows of one batch are sorted in memory, so the batch bounds them."""
    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = ", ".join([*(f"`{c}` {types[c]}" for c in by), "before long, after long, score_before double, score_after double"])

    def pairs(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values([time, order])
        made, last = [], state.get if state.exists else None
        for at, place, value in zip(rows[time], rows[order], rows[score], strict=True):
            if last is not None:
                made.append((*key, last[1], place, last[2], value))
            last = (int(at.timestamp() * 1000), int(place), float(value))
        state.update(last)
        state.setTimeoutTimestamp(max(last[0] + keep_ms, state.getCurrentWatermarkMs() + 1))
        if made:
            yield pd.DataFrame(made, columns=[*by, "before", "after", "score_before", "score_after"])

    rows = stream.where(F.col(time).isNotNull() & F.col(score).isNotNull()).withWatermark(time, delay).select(*by, time, F.col(order).cast("long").alias(order), F.col(score).cast("double").alias(score))
    return rows.groupBy(*by).applyInPandasWithState(pairs, out, "at long, place long, score double", "append", GroupStateTimeout.EventTimeTimeout)
