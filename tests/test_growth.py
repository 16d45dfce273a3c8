"""Steps whose work or memory has to stay in bounds on large tables."""

from __future__ import annotations

from itertools import permutations, product

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pairwright.functions import features, resample, rules
from pairwright.operators import agreement, images, sampling
from pairwright.plans import image_queries, more_queries, pairwise_queries, record_queries, views


def test_equal_draws_of_few_points_are_solved_once(monkeypatch):  # noqa: ANN001
    solved, plain = [], features._solve
    monkeypatch.setattr(features, "_solve", lambda a, b: solved.append(len(a)) or plain(a, b))
    for n in (4, 6, 11, 30):
        a = np.random.default_rng(n).uniform(0, 90, (n, 2))
        h, kept = features.homography(a, a + 3.0, 7)
        assert kept.all() and np.allclose(h, [[1, 0, 3], [0, 1, 3], [0, 0, 1]], atol=1e-6)
    assert solved[0] <= 24 and solved[1] <= 360 and solved[3] == 500


def test_hashed_draws_are_dealt_out_in_blocks(spark, monkeypatch):  # noqa: ANN001
    for n, first, end in ((7, 0, 5), (123, 95, 123), (10**6, 9_998, 10_003)):
        assert resample.hash_indices(7, 31, first, end, n).tolist() == [resample.hash_index(7, 31, i, n) for i in range(first, end)]
    monkeypatch.setattr(resample, "PLACES", 64)
    rows = [("a", f"s{i % 7}", float(i % 11 - 5)) for i in range(301)] + [("b", "s", 1.0), ("c", None, None)]
    df = spark.createDataFrame(rows, "judge string, sample string, delta double")
    got = {(r["judge"], r["draw"]): r["m"] for r in resample.hashed_draws(df, ["judge"], "delta", ["sample", "delta"], 12, 7).collect()}
    v = np.array([x[2] for x in sorted(rows[:301], key=lambda x: x[1:])])
    want = {("a", b): np.mean([v[resample.hash_index(7, b, i, 301)] for i in range(301)]) for b in range(12)} | {("b", b): 1.0 for b in range(12)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_rasters_are_made_and_cued_in_one_pass(spark):  # noqa: ANN001
    for query in (image_queries.exact_cues, image_queries.aligned_similarity):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_labels_take_the_places_of_their_hashes():
    keys = np.random.default_rng(3).integers(0, 2**63, 500).astype(np.uint64)
    for draw, k in ((0, 3), (199, 3), (5, 6)):
        places = resample._places(keys, draw, k)
        order = np.argsort(np.stack([resample._mixed(keys, draw, i) for i in range(k)], axis=1), axis=1)
        assert (np.take_along_axis(places.T, order, axis=1) == np.arange(k)).all()


def test_permutations_are_drawn_once(spark, monkeypatch):  # noqa: ANN001
    plans, frame = [], type(spark.range(1))
    plain = frame.toPandas
    monkeypatch.setattr(frame, "toPandas", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    rows = [(j, f"i{i}", float(i), i % 5, i * 7 % 5, i * 3 % 4, (i + 1) % 5) for j in ("a", "b") for i in range(40)]
    cells = spark.createDataFrame(rows, "judge string, item string, human double, baseline int, x int, y int, z int")
    assert resample.permutation_worst_cue(cells, "judge", "item", "human", ["x", "y", "z"], n_perm=9).count() == 6
    assert len(plans) == 1 and plans[0].count("MapInPandas") == 1


def test_rules_ask_once_where_a_word_begins():
    for patterns in (rules.EDIT_TYPE_PATTERNS, rules.CONTENT_PATTERNS):
        for _, p in rules.rules(patterns):
            assert rules.at_words(p).count(r"(?=\w)") == 1 and "|\\b" not in rules.at_words(p).replace(r"\b(?:", "")
    assert rules.at_words(r"\ba|x\b") == r"\ba|x\b" and rules.alternatives("a(b|c)|[|]d") == ["a(b|c)", "[|]d"]


def test_finished_jobs_meet_samples_not_jobs(spark):  # noqa: ANN001
    samples = spark.createDataFrame([("s1",), ("s2",)], "sample_id string")
    done = spark.createDataFrame([("s1", "s1__tint__r1"), ("s1", "s1__tint__r1"), ("s2", "s2__base__r2"), ("s9", "s9__base__r1")], "sample_id string, result_id string")
    left = {r[0] for r in sampling.outstanding(samples, [None, "tint"], 2, done).select("result_id").collect()}
    assert left == {f"{s}__{c}__r{i}" for s in ("s1", "s2") for c in ("base", "tint") for i in (1, 2)} - {"s1__tint__r1", "s2__base__r2"}


def test_tau_bootstrap_deals_turns_into_chunks(spark):  # noqa: ANN001
    plan = more_queries.delta_tau_bootstrap(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan


def test_sticker_slots_need_no_lambda(spark):  # noqa: ANN001
    assert "lambda" not in record_queries.sticker_slots(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_boards_neither_meet_rows_with_targets_nor_sort_them_before_a_shuffle(spark, monkeypatch):  # noqa: ANN001
    pool = views.pool(spark, "/root/testdata/sf0.001")
    plan = agreement.single_boards(pool, ["source"], "clean", "tint")._jdf.queryExecution().optimizedPlan().toString()
    assert "turn" not in "".join(line for line in plan.splitlines() if "Join" in line)
    dealt = pool._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Repartition" in line for line in dealt[[i for i, line in enumerate(dealt) if "Window" in line][-1] :])
    monkeypatch.setattr(views, "PART_ROWS", 500)  # about 6,000 rows, the session has 4 parts
    assert views.pool(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 4


def test_rank_correlations_read_their_rows_once(spark):  # noqa: ANN001
    for query in (more_queries.agreement_by_dimension, pairwise_queries.spearman_agreement):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1


def test_what_is_broadcast_of_a_sample_is_its_keypoints_not_their_bands(spark):  # noqa: ANN001
    made = image_queries._mosaics(spark, "/root/testdata/sf0.001", 12).withColumn("image_id", F.col("vec_id").cast("string"))
    every = images.find_keypoints(made.select("image_id", "width", "height", "pixels"))
    plan = images.hamming_matches(every.where("image_id < '2'"), every)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("posexplode") == 0 and images.BROADCAST_ROWS * 100 <= 25_000_000


def test_permutation_reads_the_pool_once(spark, monkeypatch):  # noqa: ANN001
    stored, plain, read = [], pairwise_queries._stored, []
    monkeypatch.setattr(pairwise_queries, "_stored", lambda df: stored.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    frame = type(spark.range(1))
    pandas = frame.toPandas
    monkeypatch.setattr(frame, "toPandas", lambda df: read.append(df._jdf.queryExecution().optimizedPlan().toString()) or pandas(df))
    assert pairwise_queries.permutation(spark, "/root/testdata/sf0.001").count() == 6
    assert ["l_orderkey" in x for x in stored] == [True, False, False] and len(read) == 1 and "l_orderkey" not in read[0]


def test_relabelling_counts_as_item_by_item():
    dice = np.random.default_rng(6)
    for k, scores, few in ((3, 2, True), (3, 400, False), (1, 3, True), (7, 3, False)):
        keys, codes, rank = dice.integers(0, 2**63, 900).astype(np.uint64), dice.integers(0, scores, (900, 2, k)), dice.random(900)
        got = np.concatenate(list(resample._relabelled(keys, rank, codes, scores, 20)), axis=1)
        table = np.array(list(permutations(range(k)))) if k <= resample.LISTED else None
        want = np.zeros((2, 20, 2, k, scores))
        for draw, order in enumerate(resample._orders(keys, 20, k) if table is not None else range(20)):
            places = table[order] if table is not None else resample._places(keys, draw, k).T
            for j in range(2):
                np.add.at(want[0, draw, j], (places, codes[:, j]), 1)
                np.add.at(want[1, draw, j], (places, codes[:, j]), np.repeat(rank[:, None], k, axis=1))
        assert np.allclose(got, want) and (len(np.unique(codes.reshape(900, -1), axis=0)) * 6 <= 1800) == few
    orders = np.array(list(resample._orders(dice.integers(0, 2**63, 5000).astype(np.uint64), 60, 3)))
    counts = np.array([np.bincount(o, minlength=6) for o in orders])
    assert (abs(counts - 5000 / 6) < 150).all() and abs(np.corrcoef(orders) - np.eye(60)).max() < 0.08


def test_null_of_relabelling_is_that_of_all_orders(spark):  # noqa: ANN001
    """Five items, one judge: shares of 4,000 draws against all 6^5 relabellings; with few sums held at a time too, and whether one judge has a row twice."""
    human, scores = [1.0, 2.0, 3.0, 4.0, 5.0], [(3, 1, 2, 5), (1, 2, 2, 4), (4, 5, 1, 1), (2, 3, 4, 2), (5, 4, 4, 1)]
    rows = [("j", f"i{i}", h, *s) for i, (h, s) in enumerate(zip(human, scores, strict=True))]
    rho = lambda v: np.corrcoef(pd.Series(v).rank(), human)[0, 1]
    base, table = rho([s[0] for s in scores]), list(permutations(range(3)))
    null = np.array([[rho([scores[i][1 + table[o][c]] for i, o in enumerate(os_)]) - base for c in range(3)] for os_ in product(range(6), repeat=5)])
    seen = [rho([s[1 + c] for s in scores]) - base for c in range(3)]
    cells = spark.createDataFrame([*rows, rows[0]], "judge string, item string, human double, baseline int, x int, y int, z int")
    for flush in (16_000_000, 1):
        got = {(r.statistic, r.cue): r for r in resample.permutation_worst_cue(cells, "judge", "item", "human", ["x", "y", "z"], n_perm=4000, flush=flush).collect()}
        for c, cue in enumerate("xyz"):
            r = got["mean_delta_rho", cue]
            assert abs(r.observed - seen[c]) < 1e-9
            assert abs(r.p_label - (null <= seen[c] + 1e-9).mean()) < 0.03 and abs(r.p_selected - (np.nanmin(null, axis=1) <= seen[c] + 1e-9).mean()) < 0.03


def test_permutation_makes_all_its_draws(spark):  # noqa: ANN001
    for r in pairwise_queries.permutation(spark, "/root/testdata/sf0.001").collect():
        draws = (r.p_selected * 10_001, r.p_label * 30_001)
        assert all(abs(x - round(x)) < 1e-6 and round(x) >= 1 for x in draws)
