"""As-of and interval joins against brute force; streams over several batches with late rows and state that goes."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairwright.operators import temporal
from pairwright.streaming import log, state


@pytest.mark.parametrize("span", [1, 10, 100_000])
@pytest.mark.parametrize("within", [None, 15])
def test_as_of_by_hand(spark, span, within):  # noqa: ANN001
    """A key with most rows, nulls, repeated rows, ties, negative times, keys of one side only, columns of clashing names."""
    dice = random.Random(span)
    key = lambda: dice.choice([None, "hot", "hot", "hot", "a", "b", "c"])
    left = [(i, key(), dice.choice([None, dice.randrange(-40, 120)]), "x") for i in range(150)] + [(3, "left only", 5, "x"), (3, "hot", 50, "x"), (3, "hot", 50, "x")]
    right = [(key(), dice.choice([None, dice.randrange(-40, 120)]), dice.choice([None, *range(6)]), dice.choice("pq")) for _ in range(120)] + [("right only", 1, 1, "p"), ("hot", 50, 9, "z"), ("hot", 50, 9, "z")]
    a = spark.createDataFrame(left, "m long, k string, t long, row string").repartition(4)
    b = spark.createDataFrame(right, "k string, b long, side int, row string").repartition(3)
    got = Counter((r.m, r.k, r.t, tuple(r.matched) if r.matched else None) for r in temporal.as_of(a, b, "k", "t", "b", span, ties=["side", "row"], within=within).collect())
    low = lambda v: (v is not None, v if v is not None else 0)
    want = Counter()
    for m, k, t, _ in left:
        fit = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t]
        best = max(fit, key=lambda r: (r[1], low(r[2]), r[3]), default=None)
        want[m, k, t, best if best and (within is None or t - best[1] <= within) else None] += 1
    assert got == want
    assert temporal.as_of(a.limit(0), b, "k", "t", "b", span).collect() == []
    assert temporal.as_of(a, b.limit(0), "k", "t", "b", span).where("matched is null").count() == len(left)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlaps_by_hand(spark, width):  # noqa: ANN001
    """Intervals from one point to nearly all time, touching ends, no length, nulls, one frequent key."""
    dice = random.Random(width)

    def some(n):  # noqa: ANN001, ANN202
        out = []
        for i in range(n):
            s = dice.randrange(-300, 300)
            out.append((i, dice.choice([None, "hot", "hot", "a"]), dice.choice([s] * 9 + [None]), s + dice.choice([0, -3, 1, 2, 10, 64, 65, 500, 10**9])))
        return out

    a, b = some(60), some(60)
    schema = "i int, k string, from long, to long"
    got = Counter((r.a.i, r.b.i, r.shared) for r in temporal.overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "k", "from", "to", width).collect())
    want = Counter((x[0], y[0], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in b if None not in (x[1], x[2], y[2]) and x[1] == y[1] and x[3] > x[2] and y[3] > y[2] and x[2] < y[3] and y[2] < x[3])
    assert got == want


T0 = dt.datetime(2024, 1, 1)
CLICKS = "client string, ts timestamp, value double"


def minutes(m):  # noqa: ANN001, ANN201
    return T0 + dt.timedelta(minutes=m)


def stream(spark, folder, schema):  # noqa: ANN001, ANN201
    return spark.readStream.schema(schema).parquet(f"{folder}/in")


def add(spark, folder, rows, schema=CLICKS):  # noqa: ANN001
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_sessions_over_batches(spark, tmp_path):  # noqa: ANN001
    own = lambda: state.sessions(stream(spark, tmp_path, CLICKS), "client", "ts", "10 minutes", "30 minutes", {"total": "value"})
    run = lambda: state.drain(own(), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    add(spark, tmp_path, [("a", minutes(0), 1.0), ("a", minutes(9), 2.0), ("a", minutes(30), 4.0), ("b", minutes(5), 1.0), ("b", None, 1.0), (None, minutes(1), 8.0)])
    assert run() == 0
    add(spark, tmp_path, [("a", minutes(39), 8.0), ("b", minutes(100), 1.0)])
    assert run() == 0
    # The watermark is at 70: what is before it comes too late, what joins an open session does not.
    add(spark, tmp_path, [("a", minutes(3), 99.0), ("b", minutes(95), 1.0), ("c", minutes(200), 1.0)])
    assert run() >= 1
    got = {(r.client, r.start, r.end, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", minutes(0), minutes(19), 2, 3.0), ("a", minutes(30), minutes(49), 2, 12.0), ("b", minutes(5), minutes(15), 1, 1.0), (None, minutes(1), minutes(11), 1, 8.0), ("b", minutes(95), minutes(110), 2, 2.0)}
    assert run() == 0 and spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_closed_counts_over_batches(spark, tmp_path):  # noqa: ANN001
    def run():  # noqa: ANN202
        counts = state.closed_counts(stream(spark, tmp_path, CLICKS), "client", "ts", "1 hour", "30 minutes").withColumn("day", F.to_date("start"))
        return state.drain(counts, f"{tmp_path}/out", f"{tmp_path}/checkpoint", by=["day"])

    add(spark, tmp_path, [("a", minutes(1), 1.0), ("a", minutes(59), 1.0), ("a", minutes(60), 1.0), ("b", minutes(95), 1.0), ("b", None, 1.0)])
    run()
    assert {(r.client, r.start, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a", minutes(0), 2)}
    add(spark, tmp_path, [("a", minutes(2), 1.0), ("a", minutes(70), 1.0), ("b", minutes(300), 1.0)])
    assert run() == 1
    assert {(r.client, r.start, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a", minutes(0), 2), ("a", minutes(60), 2), ("b", minutes(60), 1)}


def test_streams_matched_within(spark, tmp_path):  # noqa: ANN001
    """Pairs across batches; each once, though the second side stands in two spans."""
    dice = random.Random(8)
    asks = [(dice.choice(["hot", "hot", "a", None]), minutes(dice.randrange(600)), i) for i in range(120)]
    sales = [(dice.choice(["hot", "hot", "a", None]), minutes(dice.randrange(600)), i) for i in range(80)]
    sides = (("first", asks, "client string, asked timestamp, ask int"), ("second", sales, "client string, sold timestamp, sale int"))

    def run():  # noqa: ANN202
        a, b = (spark.readStream.schema(s).parquet(f"{tmp_path}/{n}") for n, _, s in sides)
        return state.drain(state.matched_within(a, b, "client", "asked", "sold", 1800, "20 hours"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")

    for part in (0, 1):
        for name, rows, schema in sides:
            spark.createDataFrame(rows[part::2], schema).write.mode("append").parquet(f"{tmp_path}/{name}")
        run()
    got = Counter((r.ask, r.sale) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == Counter((i, j) for c, x, i in asks for k, y, j in sales if c is not None and c == k and dt.timedelta(0) <= y - x <= dt.timedelta(seconds=1800))


def test_repeated_asks_over_batches(spark, tmp_path):  # noqa: ANN001
    schema = "judge string, sample string, ts timestamp, ord int, score int"

    def run():  # noqa: ANN202
        asks = state.repeated_asks(stream(spark, tmp_path, schema), ["judge", "sample"], "ts", "ord", "score", "10 minutes", 3_600_000)
        return state.drain(asks, f"{tmp_path}/out", f"{tmp_path}/checkpoint")

    add(spark, tmp_path, [("j", "s", minutes(3), 2, 5), ("j", "s", minutes(3), 1, 4), ("j", "s", minutes(1), 9, 3), ("j", None, minutes(1), 7, 1), ("k", "s", minutes(1), 8, None), ("k", "s", None, 8, 1)], schema)
    run()
    add(spark, tmp_path, [("j", "s", minutes(20), 3, 7), ("j", None, minutes(21), 4, 2)], schema)
    run()
    add(spark, tmp_path, [("x", "x", minutes(500), 5, 1)], schema)
    run()
    # An hour and more past the last ask its state is gone, so the next ask has none before it; an ask from before the watermark is dropped.
    add(spark, tmp_path, [("j", "s", minutes(495), 6, 2), ("x", "x", minutes(501), 7, 3), ("x", "x", minutes(100), 8, 3)], schema)
    assert run() == 1
    got = {(r.judge, r.sample, r.before, r.after, r.score_before, r.score_after) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("j", "s", 9, 1, 3, 4), ("j", "s", 1, 2, 4, 5), ("j", "s", 2, 3, 5, 7), ("j", None, 7, 4, 1, 2), ("x", "x", 5, 7, 1, 3)}


def test_stream_of_reads_times(spark):  # noqa: ANN001
    assert dict(log.stream_of(spark, "/root/testdata/sf0.001", "clicks").dtypes)["ts"] == "timestamp"


def test_stream_of_a_file_and_of_a_folder(spark, tmp_path):  # noqa: ANN001
    """A table may be one parquet file or a folder of them; neither takes in its neighbours."""
    pd.DataFrame({"i": range(5)}).to_parquet(tmp_path / "one.parquet")
    spark.range(7).withColumnRenamed("id", "i").repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    for name, n in (("one", 5), ("many", 7)):
        state.drain(log.stream_of(spark, str(tmp_path), name), str(tmp_path / f"out-{name}"), str(tmp_path / f"at-{name}"))
        assert sorted(r.i for r in spark.read.parquet(str(tmp_path / f"out-{name}")).collect()) == list(range(n))


def test_overlaps_pairs_no_fine_intervals_on_coarse_levels(spark):  # noqa: ANN001
    """One long interval brings coarse levels; short ones of a key do not meet each other there, and levels at which none is at home are not stood in."""
    short = [("k", 100 * i, 100 * i + 5, i) for i in range(400)]
    a = spark.createDataFrame([*short, ("k", 0, 40_000, 900)], "k string, s long, e long, i int")
    b = spark.createDataFrame([(k, s + 3, e + 3, i) for k, s, e, i in short], "k string, s long, e long, i int")
    met = temporal.overlaps(a, b, "k", "s", "e", 8)
    met.collect()
    assert met.count() == 800
    joined = met.agg(F.count("*"))
    joined.collect()
    x, y = (temporal._levelled(t, "k", "s", "e", 8, side) for t, side in ((a, "a"), (b, "b")))
    assert {r.own for r in x.select("own").distinct().collect()} == {0, 13} and {r.own for r in y.select("own").distinct().collect()} == {0}
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
