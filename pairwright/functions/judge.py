"""Judges: an adapter turns (task, prompt) into an answer's text; Spark maps it over jobs that have no answer yet."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Adapter(Protocol):
    model_name: str

    def generate(self, task: str, prompt: str) -> str: ...


def mock_number(seed: int, task: Column, prompt: Column) -> Column:
    """The first eight bytes of SHA-256 of seed|task|prompt, as an exact decimal."""
    digits = F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), task, prompt), 256), 1, 16)
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def mock_answer(task: Column, prompt: Column, seed: int = 0, scale: int = 10, style: str = "valid") -> Column:
    """A deterministic answer of the mock judge, in Catalyst. style: valid, fenced, prose or invalid."""
    if style == "invalid":
        return F.lit("I cannot produce a structured judgment for this input.")
    base = mock_number(seed, task, prompt)
    mod = lambda x, n: (x % F.lit(n).cast("decimal(20,0)")).cast("int")
    shifted = lambda bits: F.floor(base / F.lit(1 << bits)).cast("decimal(20,0)")
    a, b, c = 1 + mod(base, scale), 1 + mod(shifted(3), scale), 1 + mod(shifted(6), scale)
    overall = F.bround((a + b + c) / 3.0).cast("int")
    scoring = F.format_string('{"instruction_adherence": %d, "editing_quality": %d, "detail_preservation": %d, "overall_score": %d, "reason": "mock scoring verdict"}', a, b, c, overall)
    winner = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("Tie")), mod(base, 3) + 1)
    pairwise = F.format_string('{"winner": "%s", "reason": "mock pairwise verdict"}', winner)
    changed = mod(base, 5) == 0
    validation = F.format_string(
        '{"instruction_adherence_changed": false, "editing_quality_changed": %s, "detail_preservation_changed": false, "major_semantic_shift": false, "pass": %s, "reason": "mock validation verdict"}', changed.cast("string"), (~changed).cast("string")
    )
    body = F.when(task == "pairwise", pairwise).when(task == "validation", validation).otherwise(scoring)
    if style == "fenced":
        return F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    return F.concat(F.lit("Sure, here is my evaluation:\n"), body, F.lit("\nLet me know if you need more.")) if style == "prose" else body


def ask(jobs: DataFrame, adapter: Adapter, allow_paid: bool = False) -> DataFrame:
    """jobs (result_id, task, prompt, ...) with raw_text. An adapter that says it is paid needs ``allow_paid``."""
    if getattr(adapter, "paid", False) and not allow_paid:
        raise PermissionError(f"{adapter.model_name} is paid; pass allow_paid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(raw_text=[adapter.generate(t, p) for t, p in zip(batch["task"], batch["prompt"], strict=True)])

    return jobs.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in jobs.schema), "raw_text string"]))


def pending(jobs: DataFrame, *done: DataFrame) -> DataFrame:
    """Jobs whose result_id stands in none of the tables."""
    for d in done:
        jobs = jobs.join(d.select("result_id"), "result_id", "left_anti")
    return jobs
