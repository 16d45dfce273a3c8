"""Hand-made rows: the guards and choices that decide the answers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.functions import geometry, judge, parse, raster, resample, rules, stats, text
from pairwright.operators import agreement, pairwise, sampling, scoring, sets, validation
from pairwright.sources import files

ROW = "ord long, judge string, sample string, cue string, biased_id string, fine int, overall int, scale int, parsed boolean, repeat_index int"


def rows(spark, data):  # noqa: ANN001, ANN201
    """(judge, sample, cue, biased_id, score[, repeat]) in order."""
    return spark.createDataFrame([(i, r[0], r[1], r[2], r[3], r[4], r[4], 10, True, r[5] if len(r) > 5 else None) for i, r in enumerate(data)], ROW)


def test_which_duplicate_counts(spark):  # noqa: ANN001
    v = rows(spark, [("j", "s", None, None, 5), ("j", "s", None, None, 7), ("j", "s", None, None, 1, 2), ("j", "s", "c", "s__c", 9), ("j", "s", "c", "s__c", 3), ("j", "s", "p", None, 8), ("j", "s", "p", None, 10), ("j", "t", "c", "t__c", 4)])
    got = {(r.cue): r for r in scoring.score_shift(v).collect()}
    assert (got["c"].n, got["c"].mean_before, got["c"].mean_shift, got["c"].sir) == (1, 7.0, 2.0, 1.0)  # baseline: last, no repeats; cued: first; t has no baseline
    assert (got["p"].n, got["p"].mean_shift, got["p"].asc) == (2, 2.0, 2.0)  # rows without biased_id all count


def test_quality_filter_comes_after_duplicates(spark):  # noqa: ANN001
    v = rows(spark, [("j", "s", None, None, 5), ("j", "s", "c", "a", 9), ("j", "s", "", "b", 6)])
    keep = spark.createDataFrame([("a",)], "biased_id string")
    assert [r.cue for r in scoring.score_shift(v, "fine", keep).collect()] == ["c"]
    assert {r.cue for r in scoring.score_shift(v).collect()} == {"c", "unknown"}


def test_scale_and_score_guards(spark):  # noqa: ANN001
    v = rows(spark, [("j", "s", None, None, 5), ("j", "t", None, None, 5)])
    scoring.check_single_scale(v)
    with pytest.raises(scoring.MixedRows):
        scoring.check_single_scale(v.withColumn("scale", F.when(F.col("ord") == 0, 10)))
    assert scoring.resolve_score(v) == "fine"
    assert scoring.resolve_score(v.withColumn("fine", F.lit(None).cast("int"))) == "overall"
    with pytest.raises(scoring.MixedRows):
        scoring.resolve_score(v.withColumn("fine", F.when(F.col("ord") == 0, 3)))


def test_retest_orders_asks(spark):  # noqa: ANN001
    v = rows(spark, [("j", "s", None, None, 5, 2), ("j", "s", None, None, 3, 1), ("j", "s", None, None, 5, 3)])
    r = scoring.retest(v).first()
    assert (r.n, r.mean_abs_delta, r.identical_rate, r.drift) == (2, 1.0, 0.5, 1.0)


def test_filters_are_null_safe(spark):  # noqa: ANN001
    v = rows(spark, [("j", "s", None, None, 5), ("j", "s", "c", "a", 9)]).withColumn("metadata", F.lit('{"block": "x"}'))
    assert v.where(scoring.matches(v, {"cue": None})).count() == 1
    assert v.where(scoring.matches(v, {"cue": [None, "c"], "block": "x"})).count() == 2
    assert v.where(~scoring.cue_is(None)).count() == 1


def test_flip_rates(spark):  # noqa: ANN001
    p = spark.createDataFrame([("j", "A", "B"), ("j", "A", "A"), ("j", "B", "B"), ("j", "Tie", "Tie"), ("j", "A", "Tie")], "judge string, winner string, swapped string")
    f, j = pairwise.position_flips(p, ["judge"]).first(), pairwise.position_joint(p, ["judge"]).first()
    assert (f.rr, f.strict_flip_rate, f.soft_flip_rate) == (0.4, 0.4, 0.6)
    assert j.sticky_rate == f.strict_flip_rate and j.a_a == 1 and j.tie_b == 0
    assert f.p_mcnemar == 1.0


def test_one_sided_counts(spark):  # noqa: ANN001
    p = spark.createDataFrame([("j", "B", "A", "A", "B"), ("j", "A", "A", "A", "A"), ("j", "Tie", "B", "A", None)], "judge string, winner string, cued string, side string, preference string")
    r = pairwise.one_sided(p, ["judge"]).first()
    assert (r.flips_toward, r.flips_away, r.n_decisive, r.acc_before, r.acc_after, r.acc_cue_on_winner, r.acc_cue_on_loser) == (1, 0, 2, 1.0, 0.5, 1.0, 0.0)
    assert abs(r.advantage - 1 / 3) < 1e-12


def test_exact_tests(spark):  # noqa: ANN001
    one = spark.range(1)
    p = one.select(*[stats.mcnemar_exact(F.lit(b), F.lit(c)).alias(f"p{b}_{c}") for b, c in ((20, 5), (0, 0), (3, 3), (0, 1), (2000, 1500))]).first()
    tail = lambda n, k: sum(math.comb(n, i) for i in range(k + 1)) / 2**n
    assert abs(p["p20_5"] - 2 * tail(25, 5)) < 1e-12 and p["p0_0"] is None and p["p3_3"] == 1.0 and p["p0_1"] == 1.0
    assert p["p2000_1500"] < 1e-12
    assert abs(resample.fisher_p(8, 2, 1, 5) - 0.034965034965) < 1e-9 and resample.fisher_p(0, 0, 1, 2) is None
    low, high = stats.wilson(F.lit(8), F.lit(10))
    w = one.select(low.alias("a"), high.alias("b")).first()
    assert abs(w.a - 0.49016) < 1e-4 and abs(w.b - 0.94332) < 1e-4
    z = one.select(*[stats.two_sided(F.lit(x)).alias(f"z{i}") for i, x in enumerate((0.0, 1.0, -1.96, 5.0))]).first()
    assert all(abs(z[i] - math.erfc(abs(x) / math.sqrt(2))) < 1e-9 for i, x in enumerate((0.0, 1.0, -1.96, 5.0)))


def test_signed_rank():
    assert resample.wilcoxon_p(np.array([0.0, 0.0])) is None
    assert abs(resample.wilcoxon_p(np.array([1.0, 2, 3, 4, -5])) - 0.625) < 1e-12  # W- = 5: (1+1+1+2+2+3)/32 * 2
    a = resample.wilcoxon_p(np.array([1.0, 1, 2, -1, 3, 3, 0]))
    b = resample.wilcoxon_p(np.array([1.0, 1, 2, -1, 3, 3, 0]), "pratt")
    assert 0 < a < 1 and 0 < b < 1 and a != b


def test_false_discovery(spark):  # noqa: ANN001
    p = spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.03), ("f", None), ("g", 0.9)], "family string, p double")
    q = sorted((r.family, r.p or 9, r.q) for r in stats.with_bh(p, "p", ["family"]).collect())
    assert [(f, round(x, 10) if x is not None else None) for f, _, x in q] == [("f", 0.03), ("f", 0.04), ("f", 0.04), ("f", None), ("g", 0.9)]


def test_ranks_and_correlations(spark):  # noqa: ANN001
    d = spark.createDataFrame([("g", i, float(x), float(y)) for i, (x, y) in enumerate([(1, 2), (2, 2), (3, 1), (3, 5), (9, 7)])], "g string, i int, x double, y double")
    rho = stats.spearman(d, ["g"], "x", "y").first().rho
    assert abs(rho - np.corrcoef([1, 2, 3.5, 3.5, 5], [2.5, 2.5, 1, 4, 5])[0, 1]) < 1e-12
    assert abs(stats.kendall_tau_b(d, ["g"], "i", "x", "y").first().tau - 4 / 9) < 1e-12
    assert stats.spearman(d.limit(2), ["g"], "x", "y").first().rho is None


def test_decisive_thresholds(spark):  # noqa: ANN001
    items = spark.createDataFrame([("s", 1, e, h, b, a) for e, h, b, a in [(1, 10.0, 5, 5), (2, 20.0, 6, 5), (3, 20.0, 7, 9)]], "source string, turn int, editor int, human double, before int, after int")
    none = spark.createDataFrame([], "source string, sd double")
    pairs = agreement.derived_pairs(items, none)
    r = agreement.accuracy(pairs, ["source"]).first()
    assert (r.n_pairs, r.acc_before, r.acc_after, r.tie_after) == (2, 1.0, 0.5, 0.5)  # human ties go; a judge's tie is wrong
    assert agreement.derived_pairs(items, spark.createDataFrame([("s", 100.0)], "source string, sd double")).count() == 0
    tiers = agreement.decisive_tier(spark.createDataFrame([("s", 5.0, "A"), ("s", 0.0, "Tie"), ("t", 5.0, "B")], "source string, gap double, preference string"), spark.createDataFrame([("s", 10.0)], "source string, sd double"))
    assert sorted((r.source, r.gap, r.tier) for r in tiers.collect()) == [("s", 0.0, 2), ("s", 5.0, 0), ("t", 5.0, 1)]


def test_cluster_bootstrap_brackets_accuracy(spark):  # noqa: ANN001
    t = spark.createDataFrame([("c", i, 3 if i % 3 else 1, 4) for i in range(60)], "cell string, turn int, good long, n long")
    r = resample.cluster_accuracy_bootstrap(t, ["cell"], "good", "n", ["turn"], n_boot=300).first()
    assert r.ci_low < r.accuracy < r.ci_high


def test_planted_cue_is_found(spark):  # noqa: ANN001
    rng = np.random.default_rng(0)
    people = rng.normal(size=80)
    data = [(f"j{j}", i, float(h), *(float(h + rng.normal(0, 0.3)) for _ in range(3)), float(rng.normal())) for j in range(8) for i, h in enumerate(people)]
    cells = spark.createDataFrame(data, "judge string, item int, human double, baseline double, a double, b double, planted double")
    got = {(r.statistic, r.cue): r for r in resample.permutation_worst_cue(cells, "judge", "item", "human", ["a", "b", "planted"], n_perm=200).collect()}
    assert got["worst_count", "planted"].observed == 8
    assert got["mean_delta_rho", "planted"].p_selected < 0.05 < got["mean_delta_rho", "a"].p_selected


def test_rater_coefficients(spark):  # noqa: ANN001
    d = spark.createDataFrame([("x", a, b) for a, b in [(1, 1)] * 4 + [(0, 0)] * 3 + [(1, 0)] * 2 + [(0, 1)]], "g string, a int, b int")
    r = validation.rater_agreement(d, ["g"], "a", "b", [0, 1]).first()
    assert abs(r.po - 0.7) < 1e-12 and abs(r.kappa - (0.7 - 0.5) / 0.5) < 1e-12 and abs(r.pabak - 0.4) < 1e-12


def test_larger_draw_holds_smaller(spark):  # noqa: ANN001
    d = spark.range(500).select((F.col("id") % 4).alias("s"), F.col("id").alias("k"), (F.col("id") % 2).alias("t"))
    small, large = ({r.k for r in sampling.stratified_take(d, ["s"], "k", n, tier="t").collect()} for n in (5, 9))
    assert small < large and len(large) == 36
    alone = {r.k for r in sampling.stratified_take(d.where("s = 1"), ["s"], "k", 5, tier="t").collect()}
    assert alone == {k for k in small if k % 4 == 1}


def test_even_spread_places(spark):  # noqa: ANN001
    d = spark.range(10).withColumn("g", F.lit("x"))
    for n in (1, 3, 4, 7, 10, 12):
        got = sorted(r.id for r in sampling.evenly_spaced(d, ["g"], ["id"], n).collect())
        assert got == sorted({min(9, int(i * 10 / n)) for i in range(n)}), n


def test_json_extraction():
    assert parse.json_object('x ```json\n{"a": 1,}\n``` {"b": 2}') == '{"a": 1}'
    assert parse.json_object('say {"a": "}{", "b": {"c": 1}} end }') == '{"a": "}{", "b": {"c": 1}}'
    assert parse.json_object("[1]") is None and parse.json_object("{ no") is None and parse.json_object("") is None and parse.json_object("{{}") == "{}"


def test_coercions(spark):  # noqa: ANN001
    raw = [(1, '{"overall_score": 2.5}'), (2, '{"overall_score": true}'), (3, '{"overall_score": "about 7/10", "instruction_adherence": 99, "editing_quality": -3, "detail_preservation": "x"}'), (4, None), (5, '{"overall_score": 3.5, "instruction_adherence": 1, "editing_quality": 2, "detail_preservation": 3}')]
    got = {r.i: r for r in parse.parse_scoring(spark.createDataFrame(raw, "i int, raw string"), "raw").collect()}
    assert (got[1].overall_score, got[2].parse_success, got[3].overall_score, got[3].instruction_adherence, got[3].editing_quality, got[3].fine_score, got[4].parse_success, got[5].overall_score, got[5].fine_score) == (2, False, 7, 10, 1, None, False, 4, 6)
    win = spark.createDataFrame([(1, '{"winner": " Image B "}'), (2, '{"winner": "neither"}'), (3, '{"winner": 1}')], "i int, raw string")
    assert [r.winner for r in parse.parse_pairwise(win, "raw").orderBy("i").collect()] == ["B", "Tie", None]
    val = spark.createDataFrame([(1, '{"major_semantic_shift": "no"}'), (2, '{"editing_quality_changed": "changed"}'), (3, '{"pass": "yes", "editing_quality_changed": true}'), (4, '{"z": 1}')], "i int, raw string")
    assert [(r.parse_success, r.passed) for r in parse.parse_validation(val, "raw").orderBy("i").collect()] == [(True, True), (True, False), (True, True), (False, None)]


def test_rules_first_match_wins(spark):  # noqa: ANN001
    cases = {"Change the background to a beach": "background", "make it a black and white photo": "low-level", "Make all the grass green": "color", "remove the man holding a cup": "remove", "let the bed be wooden": "replace", "Have the cow wear a hat": "add", "Can we have a blue airplane?": "color", "paint the wall": "color", "Let the faucet be turned on.": None, "  ": None}
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", rules.edit_type(F.col("t")).alias("e"))
    assert {r.t: r.e for r in d.collect()} == cases
    c = spark.createDataFrame([("the dog and a man",), ("a pizza",), ("abstract",)], "t string").select(rules.content_category(F.col("t")).alias("c"))
    assert [r.c for r in c.collect()] == ["human", "object", "global"]


def test_texts(spark):  # noqa: ANN001
    d = spark.createDataFrame([("Please add a Red hat!", "pix2pix-Zero", "a b//c?")], "t string, e string, s string")
    r = d.select(text.keyword(F.col("t")).alias("k"), text.normalize_instruction(F.col("t")).alias("n"), text.editor_family(F.col("e")).alias("f"), text.slug(F.col("s")).alias("s"), text.word_wrap(F.col("t"), 10).alias("w")).first()
    assert (r.k, r.n, r.f, r.s, r.w) == ("hat", "please add a red hat", "pix2pixzero", "a-b-c", ["Please add", "a Red hat!"])
    with pytest.raises(Exception, match="no sample uid"):
        d.select(text.parse_uid(F.col("t"))).collect()
    prompt = d.select(text.scoring_prompt(F.col("t"), "viescore").alias("p")).first().p
    assert 'Editing instruction: "Please add a Red hat!"' in prompt and "1-10 scale" in prompt and prompt.endswith("}")


def test_derangement(spark):  # noqa: ANN001
    got = sampling.derangement(spark.createDataFrame([(x,) for x in "abcde"], "n string"), "n").collect()
    assert all(r.n != r.other for r in got) and {r.other for r in got} == set("abcde")


def test_mock_judge(spark):  # noqa: ANN001
    import hashlib

    d = spark.createDataFrame([("scoring", "p1"), ("pairwise", "p2")], "task string, prompt string")
    raw = {r.task: r.raw for r in d.select("task", judge.mock_answer(F.col("task"), F.col("prompt")).alias("raw")).collect()}
    n = int.from_bytes(hashlib.sha256(b"0|pairwise|p2").digest()[:8], "big")
    assert f'"winner": "{["A", "B", "Tie"][n % 3]}"' in raw["pairwise"]
    n = int.from_bytes(hashlib.sha256(b"0|scoring|p1").digest()[:8], "big")
    assert f'"editing_quality": {1 + (n >> 3) % 10}' in raw["scoring"]


def test_geometry(spark):  # noqa: ANN001
    one = spark.range(1).select(F.lit(100).alias("w"), F.lit(80).alias("h"))
    r = one.select(
        geometry.clamp(geometry.rect(F.lit(-5), F.lit(70), F.lit(200), F.lit(60)), F.col("w"), F.col("h")).alias("c"), geometry.iou(geometry.rect(F.lit(0), F.lit(0), F.lit(10), F.lit(10)), geometry.rect(F.lit(5), F.lit(0), F.lit(15), F.lit(10))).alias("i"), geometry.centred(F.col("w"), F.col("h")).alias("m"),
        geometry.least_overlap(geometry.sticker_slots(F.col("w"), F.col("h"), F.lit(10)), geometry.rect(F.lit(0), F.lit(0), F.lit(50), F.lit(80)))["overlap"].alias("o"),
    ).first()
    assert tuple(r.c) == (0, 70, 100, 71) and abs(r.i - 1 / 3) < 1e-12 and tuple(r.m) == (20, 16, 80, 64) and r.o == 0


def test_rasters():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (40, 50, 3)).astype(np.uint8)
    b = a.copy()
    b[10:20, 5:25] = 255 - b[10:20, 5:25]
    b[30, 40] = 255 - b[30, 40]
    box, how = raster.edit_region(b, a)
    assert how == "diff" and box[0] >= 5 and box[2] <= 25 and box[1] >= 10 and box[3] <= 20
    assert raster.edit_region(a, a)[1] == "fallback"
    assert (raster.revert(b, a, (5, 10, 25, 20))[10:20, 5:25] == a[10:20, 5:25]).all()
    assert raster.ssim(a, a) == pytest.approx(1) and raster.ssim(a, b) < 1
    assert raster.padding(a).shape == (48, 60, 3) and (raster.brightness(a) >= a).all()
    assert raster.components(np.array([[1, 1, 0], [0, 0, 0], [1, 0, 1]], bool)).max() == 3


def test_sets(spark):  # noqa: ANN001
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w"), (3, "q")], "k int, v string")
    kept, dropped = sets.first_wins([a, b], "k", "v")
    assert sorted(map(tuple, kept.collect())) == [(1, "x"), (2, "y"), (3, "q")] and sorted(map(tuple, dropped.collect())) == [(2, 1), (3, 1)]
    assert sorted(map(tuple, sets.audit(a, b, ["k"]).collect())) == [("extra", 1), ("missing", 1), ("ok", 1)]
    v = spark.range(1).select(*[sets.verdict(F.lit(t).cast("double"), F.lit(p).cast("double")).alias(f"v{i}") for i, (t, p) in enumerate(((0.7, 0), (0.1, 0), (0, 0.05), (0.09, 0.04), (None, None)))]).first()
    assert list(v) == ["reject", "needs_exclusion", "needs_exclusion", "independent", "independent"]


@pytest.mark.parametrize("block", [2000, 7])
def test_near_duplicates_are_the_nearest(spark, block):  # noqa: ANN001
    rng = np.random.default_rng(8)
    v = rng.standard_normal((300, 24))
    v[10] = v[200] = v[20]
    df = spark.createDataFrame([(i, [float(z) for z in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 9)
    np.fill_diagonal(cosine, -2)
    want = {(i, int(cosine[i].argmax()), round(cosine[i].max(), 6)) for i in range(0, 300, 10) if cosine[i].max() >= 0.3}
    got = sets.near_duplicates(df.where("vec_id % 10 = 0"), df, "vec_id", "embedding", 0.3, block=block).collect()
    assert {(r.vec_id, r.other, round(r.cosine, 6)) for r in got} == want and len(got) == len(want)


def test_jsonl_is_strict(spark, tmp_path):  # noqa: ANN001
    schema = "a int, b string"
    from pyspark.sql.types import StructField, StructType, StringType, IntegerType

    s = StructType([StructField("a", IntegerType(), False), StructField("b", StringType())])
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "u"}\n\n{"a": 2}\n')
    assert sorted((r.a, r.b) for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), s).collect()) == [(1, "u"), (2, None)]
    for bad in ('{"a": 1', '{"b": "no a"}', '{"a": "text"}'):
        (tmp_path / "y.jsonl").write_text(bad + "\n")
        with pytest.raises(files.BadRows, match="y.jsonl"):
            files.read_jsonl(spark, str(tmp_path / "y.jsonl"), s)
    assert files.read_or_empty(spark, str(tmp_path / "none"), s).count() == 0
    with pytest.raises(files.BadRows):
        files.read_required(spark, str(tmp_path / "none"), s)
    assert schema


def test_append_writes_an_id_once(spark, tmp_path):  # noqa: ANN001
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "result_id string, ord int")
    for _ in range(2):
        files.append_new(d, str(tmp_path / "log"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "log")).collect())) == [("a", 1), ("b", 3)]
    lines = spark.createDataFrame([('{"result_id": "a"}', 1), ('{"result_id": "a"}', 2), ('{"resu', 3), ("{}", 4), ("", 5)], "value string, ord int")
    assert sorted((r.problem, r.id, r.n) for r in files.audit_tree(lines).collect()) == [("met again", "a", 2), ("no id", None, 1), ("not an object", None, 1)]


def test_csv(spark, tmp_path):  # noqa: ANN001
    (tmp_path / "x.csv").write_text("﻿id, n\n a ,1\n,2\n", encoding="utf-8")
    with pytest.raises(files.BadRows):
        files.read_csv(spark, str(tmp_path / "x.csv"), ["id", "zz"])


def test_fingerprints_ignore_order(spark):  # noqa: ANN001
    a = spark.createDataFrame([("g", "1"), ("g", "2")], "k string, line string")
    assert files.fingerprint(a, ["k"], "line").first().digest == files.fingerprint(a.orderBy(F.desc("line")), ["k"], "line").first().digest


def test_by_dimension_keeps_every_dimension(spark):  # noqa: ANN001
    from pairwright.operators import scoring
    from pairwright.plans.views import verdicts

    v = verdicts(spark, "/root/testdata/sf0.001").withColumn("coarse", F.col("fine") / 2)
    for names in (["fine"], ["fine", "coarse"], ["fine", "coarse", "d1", "d2"]):
        assert {r.dimension for r in scoring.by_dimension(v, names).select("dimension").distinct().collect()} == set(names)


def test_ranks_and_places_match_numpy(spark):  # noqa: ANN001
    values = [0.0, -2.5, 3.25, 3.25, 1e12, -1e9, float("inf"), 0.1, 0.1004, 7.0] * 3 + [float(x) for x in range(40)]
    data = [(g, i, v) for g in ("a", None) for i, v in enumerate(values)] + [("a", 99, None), ("b", 0, 5.0)]
    d = spark.createDataFrame(data, "g string, i int, v double")
    for down in (False, True):
        got = {(r.g, r.i): r.r for r in stats.with_average_rank(d, ["g"], "v", "r", down).collect()}
        assert len(got) == len(data) and got["a", 99] is None and got["b", 0] == 1.0
        for i, v in enumerate(values):
            before = sum(w > v if down else w < v for w in values)
            assert got["a", i] == got[None, i] == before + (values.count(v) + 1) / 2
    cut = {r.g: r.m for r in sampling.value_at(d, ["g"], "v", {"m": F.floor(F.col("_size") / 3)}).collect()}
    assert cut["a"] == sorted(values)[len(values) // 3] and cut["b"] == 5.0


def test_exact_tests_of_large_counts(spark):  # noqa: ANN001
    b, c = 500_200_000, 500_100_000
    p = spark.range(1).select(stats.mcnemar_exact(F.lit(b), F.lit(c))).first()[0]
    z = (b - c - 1) / math.sqrt(b + c)
    assert abs(p - math.erfc(z / math.sqrt(2))) < 1e-4
    for t in ((8, 2, 1, 5), (3, 3, 3, 3), (0, 7, 9, 1), (40, 10, 22, 31), (12, 0, 0, 12), (1, 0, 0, 1)):
        row, column, n = t[0] + t[1], t[0] + t[2], sum(t)
        w = {k: math.comb(row, k) * math.comb(n - row, column - k) for k in range(max(0, row + column - n), min(row, column) + 1)}
        assert abs(resample.fisher_p(*t) - sum(x for x in w.values() if x <= w[t[0]]) / sum(w.values())) < 1e-9, t
    assert 0 < resample.fisher_p(10**6, 10**6 + 3000, 10**6, 10**6) < 1


def test_counts_stand_for_rows():
    rng = np.random.default_rng(3)
    v = rng.integers(-4, 5, 300).astype(float)
    for zero in ("wilcox", "pratt"):
        assert abs(resample.wilcoxon_p(v, zero) - resample.wilcoxon_p(*np.unique(v, return_counts=True)[:1], zero, np.unique(v, return_counts=True)[1])) < 1e-12
    m = resample.multinomial_means(*np.unique(v, return_counts=True), 4000, 1, most=1000)
    assert len(m) == 4000 and abs(m.mean() - v.mean()) < 0.02 and abs(m.std() - v.std() / math.sqrt(300)) < 0.01


def test_guards_refuse(spark):  # noqa: ANN001
    v = rows(spark, [("j", "s", None, None, 5), ("j", "s", "c", "s__c", 9)])
    with pytest.raises(scoring.MixedRows):
        scoring.check_single_scale(v.withColumn("scale", F.when(F.col("ord") == 0, -1)))  # no scale is not -1
    scored = v.withColumn("score_field", F.when(F.col("ord") == 0, "fine"))
    assert scoring.check_single_score(scored).count() == 2  # a row that names none says nothing
    with pytest.raises(scoring.MixedRows):
        scoring.check_single_score(scored.withColumn("score_field", F.coalesce("score_field", F.lit("overall"))))
    assert scoring.only_values(v, "cue", ["c"]).count() == 1 and scoring.only_values(v, "cue", []).count() == 2
    with pytest.raises(scoring.MixedRows, match="d"):
        scoring.only_values(v, "cue", ["c", "d"])


def test_endorsed_side_must_agree(spark):  # noqa: ANN001
    def side(cue, params, given):  # noqa: ANN001, ANN202
        return scoring.with_endorsed_side(spark.createDataFrame([(cue, params, given)], "cue string, params string, side string"), {"c": "target"}).first().side

    assert side("c", '{"target": " a"}', None) == "a" and side("c", '{"target": "B"}', "b") == "b"
    assert side("other", None, "x") == "x" and side(None, None, None) is None
    for params, given in (('{"target": "A"}', "b"), ('{"target": "C"}', None), (None, None), ("{}", "a")):
        with pytest.raises(Exception, match="no side, or another one"):
            side("c", params, given)


def test_provenance_and_main_grid(spark):  # noqa: ANN001
    t = spark.createDataFrame([(1, "f", "fill"), (2, "f", None), (3, "f", ""), (4, "f", "main")], "n int, family string, collection string")
    assert sorted(r.n for r in scoring.main_grid(t).collect()) == [2, 3, 4]
    assert scoring.main_grid(t.drop("collection")).count() == 4
    assert scoring.with_provenance(t, "sham", "fill").columns == ["n", "reference", "collection", "family"]
    assert scoring.with_provenance(t.select("n"), "sham", "fill").columns == ["n", "reference", "collection"]


def test_append_keeps_rows_without_order(spark, tmp_path):  # noqa: ANN001
    t = spark.createDataFrame([("a", None, 1), ("a", 2, 2), ("b", None, 3), (None, 1, 4)], "result_id string, ord int, n int")
    for _ in range(2):
        files.append_new(t.where("result_id is not null"), str(tmp_path / "log"))
    assert sorted((r.result_id, r.n) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [("a", 1), ("b", 3)]
    files.append_new(t, str(tmp_path / "other"))
    assert spark.read.parquet(str(tmp_path / "other")).count() == 3


def test_late_rows_stay_in_the_log(spark, tmp_path):  # noqa: ANN001
    from pairwright.streaming import log

    schema = "result_id long, ts timestamp"
    for i, (id_, ts) in enumerate([(1, "2024-01-10 00:00:00"), (2, "2024-01-01 00:00:00")]):  # the second comes nine days late
        spark.sql(f"SELECT {id_}L AS result_id, timestamp'{ts}' AS ts").write.mode("append").parquet(str(tmp_path / "in"))
        log.append_log(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "checkpoint"))
        assert spark.read.parquet(str(tmp_path / "log")).count() == i + 1


def test_region_cues(spark):  # noqa: ANN001
    a = np.full((40, 60, 3), 50, np.uint8)
    b = a.copy()
    b[10:20, 5:25] = 200
    t = spark.createDataFrame([("x", 60, 40, bytearray(b.tobytes()), bytearray(a.tobytes())), ("y", 60, 40, bytearray(b.tobytes()), None), ("z", 60, 40, None, None)], "sample_id string, width int, height int, pixels binary, original binary")
    got = raster.region_cues(t, (0.5, 1.0)).collect()
    box, how = raster.edit_region(b, a)
    x = [r for r in got if r.sample_id == "x"]
    assert {(r.left, r.top, r.right, r.bottom, r.method) for r in x} == {(*box, how)} and how == "diff"
    sha = lambda v: hashlib.sha1(v.tobytes()).hexdigest()  # noqa: E731, S324
    assert {(r.bias_type, r.severity): r.sha1 for r in x} == {("region_annotation", None): sha(raster.region_box(b, box)), ("edit_damage", 0.5): sha(raster.revert(b, a, box, 0.5)), ("edit_damage", 1.0): sha(raster.revert(b, a, box))}
    assert [(r.sample_id, r.bias_type, r.method) for r in got if r.sample_id != "x"] == [("y", "region_annotation", "fallback")]
    small = raster.region_box(a, (0, 0, 60, 2))  # a box flatter than its line
    assert (small[:2] == (255, 0, 0)).all() and (small[2:] == 50).all()


def test_cluster_bootstrap_in_chunks(spark):  # noqa: ANN001
    """A cell of one chunk is drawn from as ever; chunks of a larger one make whole resamples of the same law, and no task holds more than a chunk of it."""
    dice = np.random.default_rng(3)
    rows = [(c, i, int(g), 4) for c, size in (("a", 40), ("b", 3000), (None, 2)) for i, g in enumerate(dice.integers(0, 5, size))] + [("none", 1, 0, 0)]
    t = spark.createDataFrame(rows, "cell string, turn int, good long, n long").repartition(5)
    whole, parts = ({r.cell: r for r in resample.cluster_accuracy_bootstrap(t, ["cell"], "good", "n", ["turn"], n_boot=400, most=m).collect()} for m in (65_536, 100))
    for cell in ("a", "b"):
        g = np.array([x for c, _, x, _ in rows if c == cell], float)
        m = np.stack([np.bincount(p, minlength=len(g)) for p in np.random.default_rng(42).integers(0, len(g), size=(400, len(g)))]).astype(float) ** 2
        assert np.allclose([whole[cell].ci_low, whole[cell].ci_high], np.quantile(m @ g / (m.sum(axis=1) * 4), [0.025, 0.975]))
    assert whole["a"] == parts["a"] and whole[None] == parts[None] and (parts["none"].accuracy, parts["none"].ci_low) == (None, None)
    assert parts["b"].accuracy == whole["b"].accuracy and parts["b"].ci_low != whole["b"].ci_low
    assert abs(parts["b"].ci_low - whole["b"].ci_low) < 0.01 and abs(parts["b"].ci_high - whole["b"].ci_high) < 0.01
    placed, plan = resample.dealt(t, ["cell"], "turn", 50, 42, most=100)
    assert placed.count() == len(rows) and placed.groupBy("cell", "_chunk").count().agg(F.max("count")).first()[0] <= 100
    assert {r.cell: [sum(d) for d in zip(*r.d, strict=True)] for r in plan.groupBy("cell").agg(F.collect_list("_drawn").alias("d")).collect()}["b"] == [3000] * 50
