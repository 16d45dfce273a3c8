"""Peak concurrency: how many sales of a nation are open at any moment, their value, and when most were.

Plan. The latest shipment of each sale and the nation of each client come by joins on keys. Keys that hold more than a ``hot_keys``-th of the rows (fewer
than ``hot_keys`` by count) are answered from a broadcast of at most ``hot_keys`` rows, rows without a key are not joined at all, and all other keys are
joined by sort and merge, so nothing that grows is broadcast. Starts and ends fold into (nation, moment, change of count, change of cents) before the shuffle.

Scan. Moments lie in order of (nation, time) in blocks of 4,096 steps of time, so a block holds at most 4,096 rows whatever the input. Running sums and maxima
inside a block are windows. A tree up-sweep and down-sweep over the blocks (``tree_scan``) gives each block what lies before it; the summary of a run of
blocks is (nation at its end, whether a nation begins in it, count, cents and largest count since that nation began). A mirrored sweep gives each block
the next moment and the largest count that is still to come in its nation.

Defined results: sales without a start, or whose end is not after the start, take no part; no shipment at all means open forever; a total that is null or
not finite counts as no cents; a client that is null, unknown or of no nation is nation -1; a client of several nations counts for the smallest of them. Every row of
``sales`` is a sale, so a repeated row counts again. Empty sales give an empty result. Only named columns are read, so extra ones can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import settled
from .tree_scan import FAN_BITS, tree_scan

BLOCK_BITS = 12
ALL, UNKNOWN = -2, -1
RESULT = "nation_id int, from_s long, to_s long, n_open long, open_cents long, high_open long, is_peak boolean"


def seconds(ts: str, step: int = 60) -> Column:
    """Seconds since 1970 of the clock time that ``ts`` shows, whatever the session's zone, rounded down to ``step``."""
    s = F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)
    return s - F.pmod(s, F.lit(step))


def with_value(rows: DataFrame, values: DataFrame, key: str, hot_keys: int = 1_000) -> DataFrame:
    """``rows`` with the other columns of ``values`` (one row a key) by ``key``, null where there is none; no key makes a large task."""
    counts = settled(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_rows")))
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    hot = counts.where(F.col("n_rows") * hot_keys > total).select(key)
    large = F.broadcast(settled(hot.join(values.hint("merge"), key, "left")))
    rest = rows.join(large.select(key), key, "left_anti").where(F.col(key).isNotNull())
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in values.schema if f.name != key]
    return rows.join(large, key).unionByName(rest.join(values.hint("merge"), key, "left")).unionByName(rows.where(F.col(key).isNull()).select("*", *none))


def changes(sales: DataFrame, lines: DataFrame, clients: DataFrame, grace_s: int = 7 * 86_400, step: int = 60, hot_keys: int = 1_000) -> DataFrame:
    """(nation_id, from_s, dn, dc) of every moment at which the count or the cents of a nation's open sales change."""
    ends = lines.where("sale_id is not null and shipped_at is not null").groupBy("sale_id").agg((F.max(seconds("shipped_at", 1)) + grace_s).alias("end_s"))
    value = F.col("total") * 100 + 0.5
    cents = F.when(F.col("total").isNull() | F.isnan("total") | (F.abs(value) > 9e18), 0).otherwise(F.floor(value)).cast("long")
    started = sales.where("sold_at is not null").select("sale_id", "client_id", seconds("sold_at", step).alias("start_s"), cents.alias("cents"))
    spans = with_value(started, settled(ends.withColumn("end_s", F.col("end_s") - F.pmod("end_s", F.lit(step)))), "sale_id", hot_keys)
    spans = settled(spans.where("end_s is null or end_s > start_s").select("client_id", "start_s", "end_s", "cents"))
    nations = clients.where("client_id is not null").groupBy("client_id").agg(F.min("nation_id").cast("int").alias("nation_id"))
    told = with_value(spans, nations, "client_id", hot_keys).withColumn("nation_id", F.coalesce("nation_id", F.lit(UNKNOWN)))
    opens = F.struct(F.col("start_s").alias("from_s"), F.lit(1).cast("long").alias("dn"), F.col("cents").alias("dc"))
    closes = F.struct(F.col("end_s").alias("from_s"), F.lit(-1).cast("long").alias("dn"), (-F.col("cents")).alias("dc"))
    both = told.select("nation_id", F.inline(F.filter(F.array(opens, closes), lambda x: x["from_s"].isNotNull())))
    counted = both.select(F.explode(F.array("nation_id", F.lit(ALL))).alias("nation_id"), "from_s", "dn", "dc")
    return counted.groupBy("nation_id", "from_s").agg(F.sum("dn").alias("dn"), F.sum("dc").alias("dc")).where("dn <> 0 or dc <> 0")


def _before(a: Column, b: Column) -> Column:
    """Summary of a run of blocks and the run behind it."""
    same = (a["nation"] == b["nation"]) & ~b["reset"]
    return F.struct(
        b["nation"].alias("nation"), (a["reset"] | b["reset"] | (a["nation"] != b["nation"])).alias("reset"), F.when(same, a["n"] + b["n"]).otherwise(b["n"]).alias("n"),
        F.when(same, a["cents"] + b["cents"]).otherwise(b["cents"]).alias("cents"), F.when(same, F.greatest(a["high"], a["n"] + b["high"])).otherwise(b["high"]).alias("high"),
    )


def _behind(a: Column, b: Column) -> Column:
    """The same from the far end: ``a`` lies behind ``b``."""
    same = (a["nation"] == b["nation"]) & ~b["reset"]
    return F.struct(
        b["nation"].alias("nation"), (a["reset"] | b["reset"] | (a["nation"] != b["nation"])).alias("reset"), b["first_s"].alias("first_s"), F.when(same, F.greatest(a["high"], b["high"])).otherwise(b["high"]).alias("high")
    )


def sweep(moments: DataFrame, step: int = 60) -> DataFrame:
    """``changes`` summed up by nation and time: n_open, open_cents, high_open, is_peak and the next moment to_s of every moment."""
    spark = moments.sparkSession
    moments = settled(moments.select(F.col("nation_id").cast("int").alias("nation_id"), "from_s", "dn", "dc"))
    tick = F.floor(F.col("from_s") / step).cast("long")
    low, high, least = moments.agg(F.min(tick), F.max(tick), F.min("nation_id")).first()
    if low is None:
        return spark.createDataFrame([], RESULT)
    bits = -(-((high - low) >> BLOCK_BITS).bit_length() // FAN_BITS) * FAN_BITS
    at = F.shiftleft(F.col("nation_id").cast("long") - least, bits) + F.shiftright(tick - low, BLOCK_BITS)
    own = W.partitionBy("at").orderBy("from_s")
    upto = own.rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = moments.withColumn("at", at).select("*", F.sum("dn").over(upto).alias("n"), F.sum("dc").over(upto).alias("cents"), F.lead("from_s").over(own).alias("next_s"))
    inside = settled(inside.select("at", "nation_id", "from_s", "next_s", "dn", "dc", "n", "cents", F.max("n").over(upto).alias("high")))
    blocks = settled(inside.groupBy("at", "nation_id").agg(F.sum("dn").alias("n"), F.sum("dc").alias("cents"), F.max("n").alias("high"), F.min("from_s").alias("first_s")))
    summary = F.struct(F.col("nation_id").alias("nation"), F.lit(False).alias("reset"), "n", "cents", "high")
    before = tree_scan(blocks.select("at", summary.alias("own")), _before)
    held = F.col("before.nation") == F.col("nation_id")
    start = blocks.join(before.hint("merge"), "at").select(
        "at", "nation_id", "first_s", F.when(held, F.col("before.n")).otherwise(0).alias("n_0"), F.when(held, F.col("before.cents")).otherwise(0).alias("cents_0"),
        F.when(held, F.col("before.high")).alias("high_0"), F.col("high").alias("own_high"),
    )
    start = settled(start)
    top = start.agg(F.max("at")).first()[0]
    mirrored = F.struct(F.col("nation_id").alias("nation"), F.lit(False).alias("reset"), "first_s", (F.col("n_0") + F.col("own_high")).alias("high"))
    behind = tree_scan(start.select((F.lit(top) - F.col("at")).alias("at"), mirrored.alias("own")), _behind).select((F.lit(top) - F.col("at")).alias("at"), F.col("before").alias("behind"))
    goes_on = F.col("behind.nation") == F.col("nation_id")
    # greatest() passes over nulls.
    known = start.join(behind.hint("merge"), "at").select(
        "at", "n_0", "cents_0", "high_0", F.when(goes_on, F.col("behind.first_s")).alias("then_s"), F.greatest("high_0", F.col("n_0") + F.col("own_high"), F.when(goes_on, F.col("behind.high"))).alias("peak")
    )
    n_open = F.col("n_0") + F.col("n")
    return inside.join(known.hint("merge"), "at").select(
        "nation_id", "from_s", F.coalesce("next_s", "then_s").alias("to_s"), n_open.alias("n_open"), (F.col("cents_0") + F.col("cents")).alias("open_cents"),
        F.greatest("high_0", F.col("n_0") + F.col("high")).alias("high_open"), (n_open == F.col("peak")).alias("is_peak"),
    )


def peak_concurrency(sales: DataFrame, lines: DataFrame, clients: DataFrame, grace_s: int = 7 * 86_400, step: int = 60, hot_keys: int = 1_000) -> DataFrame:
    """Every moment at which the open sales of a nation (and of all, -2) change, with what is open from then on."""
    return sweep(changes(sales, lines, clients, grace_s, step, hot_keys), step)
