"""Queries by time: as-of and interval joins, and streams with state (extensions), with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairwright.operators import temporal
from pairwright.plans.record_queries import _shared
from pairwright.plans.scoring_queries import _rounded
from pairwright.plans.views import VERDICTS, sql, table, verdicts
from pairwright.streaming import log, state

HOUR, DAY = 3_600, 86_400


def drift_as_of(spark: SparkSession, d: str) -> DataFrame:
    """As-of join: each verdict under a cue with its judge's last baseline verdict of the same sample at or before it and no more than two days back; mean shift by judge and cue."""
    own = verdicts(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("ord"), temporal.seconds("ts").alias("at")), "ord")
    keyed = own.select("ord", "judge", "cue", "fine", "at", F.concat_ws("|", "judge", "sample").alias("key"))
    base = keyed.where("cue is null").select("key", "at", "ord", "fine")
    met = temporal.as_of(keyed.where("cue is not null"), base, "key", "at", "at", span=DAY, ties=["ord"], within=2 * DAY)
    told = met.groupBy("judge", "cue").agg(F.count("*").alias("n"), F.count("matched").alias("matched"), F.avg(F.col("fine") - F.col("matched.fine")).alias("drift"), F.sum(F.col("at") - F.col("matched.at")).alias("lag"))
    return _rounded(told)


def clicks_as_of(spark: SparkSession, d: str) -> DataFrame:
    """As-of join with frequent keys: the segment that each click's client was in when it came, from the log of changes."""
    clicks = table(spark, d, "clicks").select("click_id", "client_id", "kind", temporal.seconds("ts").alias("at"))
    changes = table(spark, d, "client_changes").select("client_id", temporal.seconds("valid_at").alias("from"), "change_id", "seq", "op", "segment")
    met = temporal.as_of(clicks, changes, "client_id", "at", "from", span=DAY, ties=["change_id", "seq", "op", "segment"])
    return met.groupBy("kind", F.col("matched.op").alias("op"), F.col("matched.segment").alias("segment")).agg(F.count("*").alias("n"), F.count("matched").alias("matched"), F.sum(F.col("at") - F.col("matched.from")).alias("lag"))


def open_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Interval join: sales from order to last shipment with the spans in which their client's record did not change; pairs and shared hours by segment."""
    ends = table(spark, d, "sale_lines").where("sale_id is not null").groupBy("sale_id").agg(F.max(temporal.seconds("shipped_at")).alias("end"))
    sales = table(spark, d, "sales").select("sale_id", "client_id", temporal.seconds("sold_at").alias("start")).join(ends, "sale_id")
    moments = table(spark, d, "client_changes").where("client_id is not null and valid_at is not null").groupBy("client_id", temporal.seconds("valid_at").alias("start")).agg(F.max(F.struct("change_id", "seq", "segment")).alias("c"))
    spans = moments.select("client_id", "start", "c.segment", F.lead("start").over(W.partitionBy("client_id").orderBy("start")).alias("end"))
    met = temporal.overlaps(sales, spans, "client_id", "start", "end", width=6 * HOUR)
    return met.groupBy(F.col("b.segment").alias("segment")).agg(F.count("*").alias("pairs"), F.sum("shared").alias("shared"), F.sum(F.col("a.sale_id")).alias("ids"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the click stream by client, as far as the watermark has closed them; how many are of how many clicks."""
    at = _shared(spark, "sessions")
    stream = log.stream_of(spark, d, "clicks").select("client_id", "ts", "value")
    late = state.drain(state.sessions(stream, "client_id", "ts", "2 hours", "3 days", {"total": "value"}), f"{at}/rows", f"{at}/checkpoint")
    closed = spark.read.parquet(f"{at}/rows")
    return closed.groupBy(F.least("n", F.lit(5)).alias("clicks")).agg(F.count("*").alias("sessions"), F.sum(F.unix_seconds("end") - F.unix_seconds("start")).alias("seconds"), F.count("client_id").alias("named")).withColumn("late", F.lit(late).cast("long"))


def stream_closed(spark: SparkSession, d: str) -> DataFrame:
    """Days of the event stream that the watermark has closed, counted by type and appended by day."""
    at = _shared(spark, "closed")
    counts = state.closed_counts(log.stream_of(spark, d, "events"), "event_type", "ts", "1 day", "36 hours").withColumn("day", F.to_date("start"))
    state.drain(counts, f"{at}/rows", f"{at}/checkpoint", by=["day"])
    return spark.read.parquet(f"{at}/rows").groupBy("event_type").agg(F.count("*").alias("days"), F.sum("n").alias("n"), F.max(F.unix_seconds("start")).alias("last_s"))


def stream_matches(spark: SparkSession, d: str) -> DataFrame:
    """Two streams: each sale with its client's clicks of the hour before, by kind of click."""
    at = _shared(spark, "matches")
    clicks = log.stream_of(spark, d, "clicks").select("client_id", "kind", F.col("ts").alias("clicked"))
    sales = log.stream_of(spark, d, "sales").select("client_id", "sale_id", F.col("sold_at").alias("sold"))
    state.drain(state.matched_within(clicks, sales, "client_id", "clicked", "sold", HOUR, "1 day"), f"{at}/rows", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/rows").groupBy("kind").agg(F.count("*").alias("pairs"), F.count_distinct("sale_id").alias("sales"), F.sum(F.unix_micros("sold") - F.unix_micros("clicked")).alias("micros"))


def stream_repeats(spark: SparkSession, d: str) -> DataFrame:
    """JOIN3 over a stream: each ask of a judge about a sample with the one before it, from keyed state; how far their ratings lie apart."""
    at = _shared(spark, "repeats")
    e = log.stream_of(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    asks = e.select(F.concat(F.lit("j"), k % 5).alias("judge"), F.concat(F.lit("s"), F.col("user_id") % 40).alias("sample"), "ts", "event_id", (1 + F.pmod(F.floor(F.col("value") + 1e-9), F.lit(10))).alias("score"))
    state.drain(state.repeated_asks(asks, ["judge", "sample"], "ts", "event_id", "score", "1 day", 30 * DAY * 1000), f"{at}/rows", f"{at}/checkpoint")
    apart = F.abs(F.col("score_after") - F.col("score_before"))
    return spark.read.parquet(f"{at}/rows").groupBy("judge").agg(F.count("*").alias("pairs"), F.count_if(apart == 0).alias("same"), F.sum(apart).cast("long").alias("apart"), F.sum(F.col("after") - F.col("before")).alias("steps"))


QUERIES = {f.__name__: f for f in (drift_as_of, clicks_as_of, open_overlaps, stream_sessions, stream_closed, stream_matches, stream_repeats)}

_SEC = "CAST(floor(epoch({})) AS BIGINT)"

ORACLES = {
    "drift_as_of": sql(
        VERDICTS, f"v AS (SELECT v.*, {_SEC.format('e.ts')} AS t FROM verdicts v JOIN events e ON v.ord = e.event_id)", "b AS (SELECT judge, sample, t, fine, row_number() OVER (PARTITION BY judge, sample, t ORDER BY ord DESC) AS n FROM v WHERE cue IS NULL)",
        "m AS (SELECT v.judge, v.cue, v.fine, v.t, CASE WHEN v.t - b.t <= 172800 THEN b.fine END AS base, CASE WHEN v.t - b.t <= 172800 THEN b.t END AS bt FROM (SELECT * FROM v WHERE cue IS NOT NULL) v ASOF LEFT JOIN (SELECT * FROM b WHERE n = 1) b ON v.judge = b.judge AND v.sample = b.sample AND v.t >= b.t)",
        body="SELECT judge, cue, count(*) AS n, count(base) AS matched, round(avg(fine - base), 6) AS drift, CAST(sum(t - bt) AS BIGINT) AS lag FROM m GROUP BY ALL",
    ),
    "clicks_as_of": f"""
        WITH c AS (SELECT client_id, t, op, segment FROM (SELECT *, {_SEC.format('valid_at')} AS t, row_number() OVER (PARTITION BY client_id, {_SEC.format('valid_at')} ORDER BY change_id DESC NULLS LAST, seq DESC NULLS LAST, op DESC NULLS LAST, segment DESC NULLS LAST) AS n
                   FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL) WHERE n = 1)
        SELECT kind, op, segment, count(*) AS n, count(c.t) AS matched, CAST(sum(k.t - c.t) AS BIGINT) AS lag
        FROM (SELECT *, {_SEC.format('ts')} AS t FROM clicks) k ASOF LEFT JOIN c ON k.client_id = c.client_id AND k.t >= c.t GROUP BY ALL""",
    "open_overlaps": f"""
        WITH e AS (SELECT sale_id, max({_SEC.format('shipped_at')}) AS e FROM sale_lines GROUP BY 1), s AS (SELECT sale_id, client_id, {_SEC.format('sold_at')} AS s, e FROM sales JOIN e USING (sale_id)),
        m AS (SELECT client_id, {_SEC.format('valid_at')} AS s, segment, row_number() OVER (PARTITION BY client_id, {_SEC.format('valid_at')} ORDER BY change_id DESC NULLS LAST, seq DESC NULLS LAST, segment DESC NULLS LAST) AS n FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL),
        v AS (SELECT client_id, s, segment, lead(s) OVER (PARTITION BY client_id ORDER BY s) AS e FROM m WHERE n = 1)
        SELECT v.segment, count(*) AS pairs, CAST(sum(least(s.e, v.e) - greatest(s.s, v.s)) AS BIGINT) AS shared, CAST(sum(sale_id) AS BIGINT) AS ids FROM s JOIN v ON s.client_id = v.client_id AND s.s < v.e AND v.s < s.e WHERE s.e > s.s GROUP BY 1""",
    "stream_sessions": """
        WITH c AS (SELECT client_id, ts, value, coalesce(ts > lag(ts) OVER w + INTERVAL 2 HOUR, true) AS new FROM clicks WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY client_id ORDER BY ts)),
        s AS (SELECT client_id, ts, sum(new::INT) OVER (PARTITION BY client_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM c),
        g AS (SELECT client_id, min(ts) AS a, max(ts) + INTERVAL 2 HOUR AS b, count(*) AS n FROM s GROUP BY client_id, k)
        SELECT least(n, 5) AS clicks, count(*) AS sessions, CAST(sum(CAST(floor(epoch(b)) AS BIGINT) - CAST(floor(epoch(a)) AS BIGINT)) AS BIGINT) AS seconds, count(client_id) AS named, 0::BIGINT AS late
        FROM g WHERE b <= (SELECT max(ts) - INTERVAL 3 DAY FROM clicks) GROUP BY 1""",
    "stream_closed": f"""
        WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL)
        SELECT event_type, count(*) AS days, CAST(sum(n) AS BIGINT) AS n, {_SEC.format('max(day)')} AS last_s FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 36 HOUR FROM events) GROUP BY 1""",
    "stream_matches": """
        SELECT kind, count(*) AS pairs, count(DISTINCT sale_id) AS sales, CAST(sum(epoch_us(sold_at) - epoch_us(ts)) AS BIGINT) AS micros FROM clicks JOIN sales USING (client_id) WHERE sold_at >= ts AND sold_at <= ts + INTERVAL 1 HOUR GROUP BY 1""",
    "stream_repeats": """
        WITH a AS (SELECT 'j' || (CAST(json_extract_string(props, '$.k') AS INT) % 5) AS judge, user_id % 40 AS sample, ts, event_id, CAST(1 + floor(value + 1e-9) % 10 AS BIGINT) AS score FROM events),
        p AS (SELECT *, lag(score) OVER w AS before, lag(event_id) OVER w AS prior FROM a WINDOW w AS (PARTITION BY judge, sample ORDER BY ts, event_id))
        SELECT judge, count(*) AS pairs, count(*) FILTER (score = before) AS same, CAST(sum(abs(score - before)) AS BIGINT) AS apart, CAST(sum(event_id - prior) AS BIGINT) AS steps FROM p WHERE before IS NOT NULL GROUP BY 1""",
}
