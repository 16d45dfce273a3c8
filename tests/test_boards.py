"""Boards with one editor cued at a time, and signed ranks from counts, against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from pairwright.functions import stats
from pairwright.operators import agreement


def boards_by_hand(rows, target=None, cued=False):  # noqa: ANN001, ANN201
    """Turn-centred means of the scores played."""
    turns, out = defaultdict(list), defaultdict(list)
    for turn, editor, clean, tint in rows:
        x = tint if cued or editor == target else clean
        if x is not None:
            turns[turn].append((editor, x))
    for played in turns.values():
        if len(played) >= 2:
            mean = sum(x for _, x in played) / len(played)
            for e, x in played:
                out[e].append(x - mean)
    return {e: sum(v) / len(v) for e, v in out.items()}


def ranks(means):  # noqa: ANN001, ANN201
    values = {e: round(m, 12) for e, m in means.items()}
    return {e: sum(w > v for w in values.values()) + (sum(w == v for w in values.values()) + 1) / 2 for e, v in values.items()}


def test_single_boards(spark):  # noqa: ANN001
    """Missing clean or cued scores, turns of one editor, ties, an editor that plays only when cued."""
    dice = random.Random(2)
    rows = [(t, e, dice.choice([None, 1, 2, 3]), dice.choice([None, 1, 4, 5])) for t in range(30) for e in dice.sample(range(6), dice.randrange(1, 6))]
    rows += [(100, 9, None, 5), (100, 0, 2, 2), (101, 7, 3, None), (101, 1, 2, 2), (102, 8, 1, 1)]
    df = spark.createDataFrame([("b", *r) for r in rows] + [("other", *r) for r in rows[::2]], "board string, turn int, editor int, clean int, tint int").repartition(5)
    for board, own in (("b", rows), ("other", rows[::2])):
        got = defaultdict(dict)
        for r in agreement.single_boards(df, ["board"], "clean", "tint").where(F.col("board") == board).collect():
            got[r.target][r.editor] = r["mean"]
        for target in {e for _, e, _, _ in own}:
            want = boards_by_hand(own, target)
            assert got.get(target, {}).keys() == want.keys() and all(abs(got[target][e] - m) < 1e-12 for e, m in want.items()), target
        moves = {(r.scenario, r.target): r for r in agreement.rank_moves(df, ["board"]).where(F.col("board") == board).collect()}
        before = ranks(boards_by_hand(own))
        for target in sorted({e for _, e, _, _ in own}):
            after = {e: r for e, r in ranks(boards_by_hand(own, target)).items() if e in before}
            if after:
                m = moves["single", target]
                assert (m.editors, m.max_move) == (len(after), max(abs(before[e] - after[e]) for e in after))
                assert m.mean_gain == (before[target] - after[target] if target in after else None)
        after = {e: r for e, r in ranks(boards_by_hand(own, cued=True)).items() if e in before}
        assert moves["all", -1].max_move == max(abs(before[e] - after[e]) for e in after)


def test_rows_without_a_turn_are_one_turn_of_single_boards(spark):  # noqa: ANN001
    rows = [(None, 1, 2, 5), (None, 2, 3, 1), (None, 3, 1, None), (4, 1, 1, 4), (4, 2, 2, 2), (4, 2, 5, 3), (5, 3, 4, 4)]
    df = spark.createDataFrame([("b", *r) for r in rows], "board string, turn int, editor int, clean int, tint int")
    got = defaultdict(dict)
    for r in agreement.single_boards(df, ["board"], "clean", "tint").collect():
        got[r.target][r.editor] = r["mean"]
    for target in (1, 2, 3):
        want = boards_by_hand(rows, target)
        assert got[target].keys() == want.keys() and all(abs(got[target][e] - m) < 1e-12 for e, m in want.items()), target


def test_signed_rank_from_counts(spark):  # noqa: ANN001
    dice = np.random.default_rng(1)
    rows = [("a", float(x)) for x in dice.integers(-5, 9, 300)] + [("b", float(x)) for x in dice.normal(0.1, 1, 80)] + [("c", 0.0), ("c", None), (None, 2.0)]
    got = {r.k: r for r in stats.signed_rank(spark.createDataFrame(rows, "k string, shift double").repartition(3), ["k"], "shift").collect()}
    assert set(got) == {"a", "b", None}
    for k in ("a", "b"):
        d = np.array([x for c, x in rows if c == k and x])
        size = np.abs(d)
        r = np.array([(size < v).sum() + ((size == v).sum() + 1) / 2 for v in size])
        ties = sum(n**3 - n for n in np.unique(size, return_counts=True)[1].tolist())
        assert (got[k].n_nonzero, got[k].tie_term) == (len(d), ties) and abs(got[k].w_plus - r[d > 0].sum()) < 1e-6


def test_spearman_of_several_columns(spark, monkeypatch):  # noqa: ANN001
    """Ties, signs, a null group, missing values, constant sides, two rows; values broadcast or joined."""
    dice = random.Random(5)
    rows = [(g, dice.choice([None, -3.0, 0.0, dice.gauss(0, 50), dice.gauss(0, 50)]), dice.randrange(4), dice.choice([None, *range(-9, 9)]), 1) for g in ("a", None) for _ in range(200)]
    rows += [("flat", 0.1, i, i, 1) for i in range(7)] + [("two", 1.0, 1, 2, 1), ("two", 2.0, 2, 1, 1), ("none", None, 1, 1, 1)]
    df = spark.createDataFrame(rows, "g string, x double, y int, z long, one int").repartition(3)

    def rank(v):  # noqa: ANN001, ANN202
        return np.array([sum(w < u for w in v) + (sum(w == u for w in v) + 1) / 2 for u in v])

    for few in (20_000, 3):
        monkeypatch.setattr(stats, "FEW", few)
        got = {r.g: r for r in stats.spearmans(df, ["g"], "x", {"y": "ry", "z": "rz", "one": "r1"}).collect()}
        assert set(got) == {"a", None, "flat", "two"}
        for g in got:
            own = [r[1:] for r in rows if r[0] == g and None not in r[1:]]
            assert got[g].n == len(own) and got[g].r1 is None
            if g in ("flat", "two"):
                assert got[g].ry is None and got[g].rz is None
            else:
                x, y, z, _ = (rank(v) for v in zip(*own))
                assert abs(got[g].ry - np.corrcoef(x, y)[0, 1]) < 1e-12 and abs(got[g].rz - np.corrcoef(x, z)[0, 1]) < 1e-12
