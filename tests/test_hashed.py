"""Bootstraps by hashed draws: weights by hand, independence of order and partition, agreement with multinomial bootstraps."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pairwright.functions import resample
from pairwright.operators import hashed


def weight(unit, draw, seed=42):  # noqa: ANN001, ANN201
    """How often a unit counts: the Poisson(1) quantile of 32 bits."""
    j = draw % 4
    u = int(hashlib.md5(f"{seed}:{draw // 4}:{unit}".encode(), usedforsecurity=False).hexdigest()[8 * j : 8 * j + 8], 16) / 2**32
    k, total = 0, math.exp(-1)
    while u >= total and k < 12:
        k += 1
        total += math.exp(-1) / math.factorial(k)
    return k


def test_weights_by_hand(spark):  # noqa: ANN001
    units = spark.createDataFrame([(i, "x") for i in range(300)] + [(7, "again"), (None, "null")], "unit int, note string")
    got = {(r.unit, r.note, r.draw): r.weight for r in hashed.weights(units, F.col("unit"), 10, 42).collect()}
    want = {(i, n, d): w for i, n in [(i, "x") for i in range(300)] + [(7, "again")] for d in range(10) if (w := weight(i, d))}
    assert {k: v for k, v in got.items() if k[0] is not None} == want
    counts = Counter(weight(i, d) for i in range(2000) for d in range(20))
    for k in range(5):
        assert abs(counts[k] / 40_000 - math.exp(-1) / math.factorial(k)) < 0.01


def test_cluster_accuracy(spark):  # noqa: ANN001
    dice = np.random.default_rng(0)
    rows = [("a", i, int(dice.integers(0, 7)), 6) for i in range(200)] + [("b", i, 1, 2) for i in range(30)] + [("c", 1, 0, 0)]
    df = spark.createDataFrame(rows, "cell string, turn int, good int, n int")
    got = {r.cell: r for r in hashed.cluster_accuracy(df.repartition(7), ["cell"], "good", "n", "turn", n_boot=200).collect()}
    values = []
    for d in range(200):
        w = [(weight(t, d) ** 2, g, n) for c, t, g, n in rows if c == "a"]
        values.append(sum(m * g for m, g, _ in w) / sum(m * n for m, _, n in w))
    assert np.allclose([got["a"].ci_low, got["a"].ci_high], np.quantile(values, [0.025, 0.975])) and (got["b"].ci_low, got["b"].ci_high, got["c"].accuracy) == (0.5, 0.5, None)
    multinomial = {r.cell: r for r in resample.cluster_accuracy_bootstrap(df.where("cell = 'a'"), ["cell"], "good", "n", ["turn"], n_boot=1000).collect()}["a"]
    assert abs(multinomial.ci_low - got["a"].ci_low) < 0.03 and abs(multinomial.ci_high - got["a"].ci_high) < 0.03
    assert sorted(map(tuple, hashed.cluster_accuracy(df.repartition(2), ["cell"], "good", "n", "turn", n_boot=200).collect()), key=str) == sorted(map(tuple, got.values()), key=str)


def test_mean_test(spark):  # noqa: ANN001
    dice = np.random.default_rng(1)
    rows = [("far", i, float(x)) for i, x in enumerate(dice.normal(1, 1, 100))] + [("near", i, float(x)) for i, x in enumerate(dice.normal(0, 1, 100))] + [("null", 1, None), ("one", 1, 2.0), (None, 3, 1.0)]
    df = spark.createDataFrame(rows, "cell string, i int, x double")
    got = {r.cell: r for r in hashed.mean_test(df, ["cell"], "x", F.col("i"), n_boot=100).collect()}
    for cell in ("far", "near"):
        own = [(i, x) for c, i, x in rows if c == cell]
        means = np.array([np.average([x for _, x in own], weights=[weight(i, d) for i, _ in own]) for d in range(100)])
        assert np.allclose([got[cell].ci_low, got[cell].ci_high], np.quantile(means, [0.025, 0.975]))
        assert math.isclose(got[cell].p, min(1, 2 * (min((means <= 0).sum(), (means >= 0).sum()) + 1) / 101))
    assert got["far"].p < 0.05 < got["near"].p and "null" not in got and got["one"].n == 1


def test_tau_change(spark):  # noqa: ANN001
    dice = np.random.default_rng(2)
    rows = [("b", t, e, float(e + dice.normal()), float(e + dice.normal()), float(-e + dice.normal())) for t in range(40) for e in range(4)] + [("b", 99, 1, 5.0, 5.0, 5.0), ("b", 98, 1, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "board string, turn int, editor int, human double, clean double, cued double").repartition(5)
    r = hashed.tau_change(df, ["board"], "human", "clean", "cued", n_boot=40).first()
    same = hashed.tau_change(df, ["board"], "human", "clean", "clean", n_boot=40).first()
    assert (r.turns, r.excludes_zero) == (40, True) and r.ci_high < -1 and (same.ci_low, same.ci_high, same.excludes_zero) == (0.0, 0.0, False)


def test_totals_need_no_row_a_draw(spark):  # noqa: ANN001
    """Sums by hand of null keys and units, squares, infinite numbers and a task that hands on often; no plan makes a row for each unit and draw."""
    rows = [("a", i, float(i)) for i in range(60)] + [(None, i, 1.0) for i in range(9)] + [("b", None, 2.0), ("c", 1, math.inf)]
    df = spark.createDataFrame(rows, "cell string, unit int, x double").repartition(3)
    for squared in (False, True):
        got = hashed.totals(df.withColumn("_w", hashed.words(F.col("unit"), 10, 42)), ["cell"], "_w", ["x"], 10, squared, most=20)
        want: dict = {}
        told = {(r.cell, r.unit, r.draw): r.weight for r in hashed.weights(df, F.col("unit"), 10, 42).collect()}
        for (cell, unit, x), d in ((row, d) for row in rows for d in range(10)):
            if w := told.get((cell, unit, d), 0) ** (2 if squared else 1):
                n, s = want.get((cell, d), (0, 0.0))
                want[cell, d] = (n + w, s + w * x)
        assert {(r.cell, r.draw): (r.weight, r.x) for r in got.collect()} == want
    for made in (hashed.mean_test(df, ["cell"], "x", F.col("unit")), hashed.cluster_accuracy(df, ["cell"], "x", "x", "unit")):
        assert "explode" not in made._jdf.queryExecution().optimizedPlan().toString()
