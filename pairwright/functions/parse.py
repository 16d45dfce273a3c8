"""Judge answers to typed columns. Finding the JSON object needs brace matching and runs in Arrow batches; all coercion is in Catalyst."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What marks a fenced block and a trailing comma.
_FENCED = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S | re.I)
_TRAILING = re.compile(r",(\s*[}\]])")

# What counts as a winner, as true and as false.
WINNERS = {"a": "A", "image a": "A", "edited image a": "A", "first": "A", "b": "B", "image b": "B", "edited image b": "B", "second": "B", "tie": "Tie", "equal": "Tie", "draw": "Tie", "neither": "Tie", "both": "Tie"}
TRUE, FALSE = "true yes 1 y t changed".split(), "false no 0 n f unchanged none".split()


def _balanced(text: str) -> str | None:
    """The first {...} whose braces balance outside of strings."""
    for opening in re.finditer(r"\{", text):
        depth = 0
        for m in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}]', text[opening.start() :], re.S):
            depth += {"{": 1, "}": -1}.get(m.group(), 0)
            if depth == 0:
                return text[opening.start() : opening.start() + m.end()]
    return None


def json_object(text: str | None) -> str | None:
    """The first object that parses, among fenced blocks, the whole text and the first balanced braces; each also without
    trailing commas. Returned as compact JSON text."""
    if not text:
        return None
    for candidate in (*_FENCED.findall(text), text.strip(), _balanced(text)):
        for attempt in (candidate, _TRAILING.sub(r"\1", candidate)) if candidate is not None else ():
            try:
                found = json.loads(attempt)
            except ValueError:
                continue
            if isinstance(found, dict):
                return json.dumps(found, ensure_ascii=False)
    return None


@F.pandas_udf(T.StringType())
def extract_json(texts: pd.Series) -> pd.Series:
    return texts.map(json_object, na_action="ignore")


def _field(obj: Column, name: str) -> Column:
    return F.get_json_object(obj, f"$.{name}")


def score(value: Column, scale: int = 10) -> Column:
    """The first number of a value, rounded half to even and clamped to 1..scale; booleans and values without a number are null,
    as are NaN and infinities."""
    number = F.regexp_extract(value, r"-?\d+(\.\d+)?", 0)
    usable = value.isNotNull() & ~F.lower(value).isin("true", "false") & (number != "")
    return F.when(usable, F.greatest(F.lit(1), F.least(F.lit(scale), F.bround(number.cast("double")).cast("int"))))


def winner(value: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in WINNERS.items() for x in pair])
    return F.try_element_at(known, F.lower(F.trim(value)))


def truth(value: Column) -> Column:
    word = F.lower(F.trim(value))
    number = word.try_cast("double")
    return F.when(word.isin(TRUE), True).when(word.isin(FALSE), False).when(number.isNotNull(), number != 0)


def parse_scoring(df: DataFrame, raw: str, scale: int = 10) -> DataFrame:
    """Adds parse_success, the three dimensions, overall_score, fine_score (null unless all dimensions are there), score_scale, reason."""
    out = df.withColumn("_o", extract_json(F.col(raw)))
    dims = ("instruction_adherence", "editing_quality", "detail_preservation")
    overall = score(_field(F.col("_o"), "overall_score"), scale)
    ok = F.col("_o").isNotNull() & overall.isNotNull()
    out = out.withColumns({d: F.when(ok, score(_field(F.col("_o"), d), scale)) for d in dims})
    return out.withColumns({"parse_success": ok, "overall_score": F.when(ok, overall), "fine_score": sum((F.col(d) for d in dims[1:]), F.col(dims[0])), "score_scale": F.lit(scale), "reason": F.when(ok, F.coalesce(_field(F.col("_o"), "reason"), F.lit("")))}).drop("_o")


def parse_pairwise(df: DataFrame, raw: str) -> DataFrame:
    """Adds parse_success, winner (A, B, Tie) and reason."""
    out = df.withColumn("_o", extract_json(F.col(raw)))
    found = winner(_field(F.col("_o"), "winner"))
    return out.withColumns({"parse_success": found.isNotNull(), "winner": found, "reason": F.when(found.isNotNull(), F.coalesce(_field(F.col("_o"), "reason"), F.lit("")))}).drop("_o")


def parse_validation(df: DataFrame, raw: str) -> DataFrame:
    """Adds four change flags and ``passed``, which is that no flag is true where the answer does not say."""
    flags = ("instruction_adherence_changed", "editing_quality_changed", "detail_preservation_changed", "major_semantic_shift")
    out = df.withColumn("_o", extract_json(F.col(raw)))
    values = {f: truth(_field(F.col("_o"), f)) for f in flags}
    said = _field(F.col("_o"), "pass")
    any_true = F.greatest(*[F.coalesce(v, F.lit(False)) for v in values.values()])
    ok = F.col("_o").isNotNull() & (F.coalesce(*values.values()).isNotNull() | said.isNotNull())
    return out.withColumns({"parse_success": ok, **{f: F.when(ok, v) for f, v in values.items()}, "passed": F.when(ok, F.coalesce(truth(said), ~any_true))}).drop("_o")
