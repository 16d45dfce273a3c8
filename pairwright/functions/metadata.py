"""Open metadata as VARIANT: typed paths, nested filters, cells that are one text or several."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)$"


def open_metadata(raw: Column) -> Column:
    """JSON text as VARIANT; text that does not read is null."""
    return F.try_parse_json(raw)


def _path(key: str) -> str:
    """``a.b`` is a key in a key; a key with other signs is quoted, by the quote that it does not hold."""
    quoted = lambda k: f"[\"{k}\"]" if "'" in k else f"['{k}']"
    return "$" + "".join(f".{k}" if k.isidentifier() else quoted(k) for k in key.split("."))


def meta(v: Column, key: str, kind: str = "string") -> Column:
    """The value at a key (``a.b`` for one in another) as a type; null if it is absent or does not fit."""
    return F.try_variant_get(v, _path(key), kind)


def _equals(v: Column, key: str, want: object) -> Column:
    """Whether the value at ``key`` is ``want``, of its kind: the number 3 is not the text "3"."""
    kind = F.schema_of_variant(F.try_variant_get(v, _path(key), "variant"))
    if want is None:
        return kind.isNull() | (kind == "VOID")
    if isinstance(want, bool):
        return F.coalesce((kind == "BOOLEAN") & (meta(v, key, "boolean") == F.lit(want)), F.lit(False))
    if isinstance(want, (int, float)):
        return F.coalesce(kind.rlike(_NUMBERS) & (meta(v, key, "double") == F.lit(float(want))), F.lit(False))
    return F.coalesce((kind == "STRING") & (meta(v, key, "string") == F.lit(str(want))), F.lit(False))


def matches(df: DataFrame, wanted: dict[str, object], metadata: str = "metadata") -> Column:
    """Whether a row has every wanted value (of a list: one of them): in a column of that name, if there is one and it is not null, else in the metadata."""

    def one(key: str, value: object) -> Column:
        inside = _equals(F.col(metadata), key, value)
        if key not in df.columns:
            return inside
        own = F.col(f"`{key}`")
        return F.when(own.isNotNull(), own == F.lit(value) if value is not None else F.lit(False)).otherwise(inside)

    each = [reduce(lambda a, b: a | b, [one(k, v) for v in (want if isinstance(want, (list, tuple, set)) else [want])], F.lit(False)) for k, want in wanted.items()]
    return reduce(lambda a, b: a & b, each, F.lit(True))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def instruction_text(df: DataFrame, column: str) -> Column:
    """The instruction of a cell that is a text or a list of texts (an array, or JSON as VARIANT, of either kind by row): trimmed; of a list the first that is not blank; of null or an empty list an empty text."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    first = lambda texts: F.coalesce(F.get(F.filter(F.transform(texts, _stripped), lambda x: x != ""), F.lit(0)), F.lit(""))
    if isinstance(kind, T.ArrayType):
        return first(c.cast("array<string>"))
    if isinstance(kind, T.VariantType):
        is_list = F.schema_of_variant(c).startswith("ARRAY")
        return F.when(is_list, first(F.try_variant_get(c, "$", "array<string>"))).otherwise(F.coalesce(_stripped(F.try_variant_get(c, "$", "string")), F.lit("")))
    return F.coalesce(_stripped(c.cast("string")), F.lit(""))


def bracketed(query: Column) -> Column:
    """The first bracketed span of a prompt, trimmed; null without one."""
    return _stripped(F.nullif(F.regexp_extract(query, r"\[([^\]]+)\]", 1), F.lit("")))


def first_number(answer: Column) -> Column:
    return F.nullif(F.regexp_extract(answer, r"(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")


def yes_or_no(answer: Column) -> Column:
    """True if it says yes anywhere, else false if it says no, else null."""
    low = F.lower(answer)
    return F.when(low.contains("yes"), True).when(low.contains("no"), False)
