"""Files of an audit, table functions and open metadata on hand-made cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pairwright.functions import metadata, unfold
from pairwright.sources import reports
from pairwright.sources.files import BadRows


def test_sheets(spark, tmp_path):  # noqa: ANN001
    head = f"biased_id,bias_type,{reports.LABEL}"
    (tmp_path / "a.csv").write_text(f'﻿{head}\nx1,sham,No\n,sham, Yes \nx2,,No\nx3,blur,\n"x,4",blur,Slightly\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text(f"bias_type,{reports.LABEL}\nsham,No\n")
    rows = reports.read_sheets(spark, [f"{tmp_path}/{n}.csv" for n in ("a", "b", "none")])
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, [("a", "x1", "sham", "No"), ("a", None, "sham", "Yes"), ("a", "x,4", "blur", "Slightly"), ("b", None, "sham", "No")]))
    seen = spark.createDataFrame([("sham", "x1"), ("blur", "other"), ("sham", "x1")], "bias_type string, biased_id string")
    assert {tuple(r) for r in reports.fold_sheets(rows, seen).select("bias_type", "n_human", "n_ids", "n_human_matched", "packages").collect()} == {("sham", 3, 1, 1, "a,b"), ("blur", 1, 1, 0, "a")}
    assert reports.read_sheets(spark, []).count() == 0
    (tmp_path / "r.csv").write_text(f"{head}\nx1,sham,No\nx1,sham,Yes\nx2,blur,maybe\n")
    assert [tuple(r) for r in reports.read_resolved(spark, f"{tmp_path}/r.csv").collect()] == [("x1", "sham", "Yes")]
    (tmp_path / "l.csv").write_text(f"index,{reports.LABEL}\n12,No\n13,Yes\n14,?\n")
    (tmp_path / "k.csv").write_text("index,biased_id\n13,x1\n12,x9\n")
    assert {tuple(r) for r in reports.read_second_sheet(spark, f"{tmp_path}/l.csv", f"{tmp_path}/k.csv").collect()} == {("x9", "No"), ("x1", "Yes")}
    (tmp_path / "k.csv").write_text("index,biased_id\n13,x1\n")
    with pytest.raises(BadRows, match="12"):
        reports.read_second_sheet(spark, f"{tmp_path}/l.csv", f"{tmp_path}/k.csv")


def test_verdict_files_by_hand(spark, tmp_path):  # noqa: ANN001
    raw = tmp_path / "raw_judgments"
    raw.mkdir()
    lines = [
        {"biased_id": "s__a__sham", "pass": True}, {"biased_id": "s__a__sham", "passed": False}, {"biased_id": "t__blur", "parse_success": False, "pass": True}, {"biased_id": "t__blur", "pass": None, "passed": None}, {"biased_id": "u___x", "parse_success": True, "passed": True},
        {"biased_id": None, "pass": False}, {"biased_id": "nocue", "pass": True, "parse_success": None},
    ]
    (raw / "validation__m-1__x.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    (raw / "scoring__other.jsonl").write_text('{"biased_id": "q__sham", "pass": true}\n')
    got = {tuple(r) for r in reports.read_verdicts(spark, str(raw)).collect()}
    assert got == {("m-1__x", "s__a", "sham", False), ("m-1__x", "u_", "x", True), ("m-1__x", "", "", False), ("m-1__x", "", "nocue", True)}
    assert [r.judge for r in reports.discover_judges(spark, str(tmp_path), "validation").collect()] == ["m-1__x"]
    assert reports.discover_judges(spark, str(tmp_path), "validation", roster=["other"]).count() == 0 and reports.discover_judges(spark, f"{tmp_path}/none", "scoring").count() == 0
    (tmp_path / "control.jsonl").write_text('{"bias_type": "full", "base_sample_id": "s", "bias_params": {"mean_abs_change": 2.5}}\n{"bias_type": "full", "base_sample_id": "s", "bias_params": {"mean_abs_change": 3}}\n\n{"bias_type": "half", "base_sample_id": "s"}\n')
    control = reports.read_control(spark, f"{tmp_path}/control.jsonl").select("condition", "base", metadata.meta(F.col("params"), "mean_abs_change", "double").alias("c"))
    assert {tuple(r) for r in control.collect()} == {("full", "s", 3.0), ("half", "s", None)}
    (tmp_path / "audit.json").write_text(json.dumps({"note": 1, "per_sample": [{"sample_id": "a", "bbox_fixed": [1, 2, 3, 4], "more": {}}, {"sample_id": "b", "bbox_fixed": None}]}, indent=2))
    assert [tuple(r) for r in reports.read_audit(spark, f"{tmp_path}/audit.json").collect()] == [("a", [1, 2, 3, 4]), ("b", None)]
    answers = spark.createDataFrame([("lab/m 1", "a::b/c", "said"), ("lab/m 1", "d", None)], "judge_model string, result_id string, raw_text string")
    assert [tuple(r) for r in reports.save_raw_answers(answers, str(tmp_path)).collect()] == [("raw/lab-m-1/a__b-c.txt", 4, True)]
    assert (tmp_path / "raw/lab-m-1/a__b-c.txt").read_text() == "said"


def test_unfolded(spark):  # noqa: ANN001
    deep = '{"a":' * 3000
    lines = {
        0: ('{"a": 1}', [('{"a": 1}', None)]), 1: ('{"a": 1}{"b": "}{"}', [('{"a": 1}', None), ('{"b": "}{"}', None)]), 2: ('{"a": {"b"{"c": 2}', [('{"a": {"b"', "torn"), ('{"c": 2}', None)]), 3: ("  ", []), 4: (None, []), 5: ("rest", [("rest", "torn")]),
        6: ("[1, 2]", [("[1, 2]", "torn")]), 7: (' {"x": [{"y": 1}]} tail {"z', [('{"x": [{"y": 1}]}', None), ('tail {"z', "torn")]), 8: (deep, [(deep, "torn")]),
    }
    rows = spark.createDataFrame([(i, x) for i, (x, _) in lines.items()], "i int, value string")
    got = {}
    for r in unfold.unfold_lines(rows).orderBy("i", "part").collect():
        got.setdefault(r.i, []).append((r.value, r.problem))
    assert got == {i: want for i, (_, want) in lines.items() if want}
    audit = {"per_sample": [{"name": "a", "box": [0, 0, 9, 9], "parts": {"k": [{"box": [1, 1, 2.0, 2]}, {"box": [1, 2]}]}}, {"name": 7, "box": [3, 3, 4, 4]}], "box": "none"}
    audits = spark.createDataFrame([(1, json.dumps(audit)), (2, "{torn"), (3, None), (4, "[]")], "i int, audit string")
    assert [tuple(r) for r in unfold.unfold_regions(audits).orderBy("path").collect()] == [
        (1, "$.per_sample[0]", 0, "a", 0, 0, 9, 9), (1, "$.per_sample[0].parts.k[0]", 1, None, 1, 1, 2, 2), (1, "$.per_sample[1]", 0, "7", 3, 3, 4, 4),
    ]
    unfold.register(spark)
    assert spark.sql("""SELECT value FROM unfold_line('{"a":1}{"b":2}') ORDER BY part DESC LIMIT 1""").first().value == '{"b":2}'


def test_open_metadata(spark):  # noqa: ANN001
    docs = ['{"a": {"b": 3}, "flag": true, "n": null, "we\'ird": "x"}', '{"a": {"b": "3"}, "flag": 1}', '{"a": 3.0, "kind": "own"}', "{torn", None, "[1]"]
    rows = spark.createDataFrame([(i, "column" if i == 2 else None, d) for i, d in enumerate(docs)], "i int, kind string, raw string").withColumn("metadata", metadata.open_metadata(F.col("raw")))
    fit = lambda **w: sorted(r.i for r in rows.where(metadata.matches(rows, {k.replace("__", "."): v for k, v in w.items()})).collect())
    assert fit(a__b=3) == [0] and fit(a__b="3") == [1] and fit(a=3) == [2] and fit(a__b=[3, "3"]) == [0, 1]
    assert fit(flag=True) == [0] and fit(flag=1) == [1] and fit(n=None) == [0, 1, 2, 3, 4, 5] and fit(flag=None) == [2, 3, 4, 5]
    # A column of the name decides where it is not null.
    assert fit(kind="own") == [] and fit(kind="column") == [2] and fit(kind=None) == [0, 1, 3, 4, 5]
    assert fit(**{"we'ird": "x"}) == [0] and fit() == [0, 1, 2, 3, 4, 5] and fit(a__b=[]) == []
    assert [r[0] for r in rows.orderBy("i").select(metadata.meta(F.col("metadata"), "a.b", "int")).collect()] == [3, 3, None, None, None, None]


def test_instruction_cells(spark):  # noqa: ANN001
    cells = {'"  one "': "one", '["", " \\u00a0", " two ", "three"]': "two", "[]": "", "null": "", "3": "3", "true": "true", "[1, 2]": "1", '[null, "x"]': "x"}
    rows = spark.createDataFrame([(k, [k, "b"], f" {k} ") for k in cells], "raw string, listed array<string>, plain string").withColumn("cell", metadata.open_metadata(F.col("raw")))
    got = {r.raw: (r.a, r.b, r.c) for r in rows.select("raw", metadata.instruction_text(rows, "cell").alias("a"), metadata.instruction_text(rows, "listed").alias("b"), metadata.instruction_text(rows, "plain").alias("c")).collect()}
    assert got == {k: (v, k, k) for k, v in cells.items()}
    empty = spark.createDataFrame([(None, None, None)], "raw string, listed array<string>, plain string")
    assert tuple(empty.select(metadata.instruction_text(empty, "listed"), metadata.instruction_text(empty, "plain")).first()) == ("", "")
    told = spark.createDataFrame([("Please [ make it red ] as [x]", "score is -4.5 of 10", "I say YES"), ("none []", "none", "nothing"), (None, None, "ok")], "q string, s string, a string")
    assert [tuple(r) for r in told.select(metadata.bracketed(F.col("q")), metadata.first_number(F.col("s")), metadata.yes_or_no(F.col("a"))).collect()] == [("make it red", -4.5, True), (None, None, False), (None, None, None)]
