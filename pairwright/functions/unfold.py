"""Table functions: torn or glued result lines, and audits nested to any depth. Usable from SQL once registered."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "part: int, value: string, problem: string"
REGION = "path: string, depth: int, name: string, left: int, top: int, right: int, bottom: int"


@F.udtf(returnType=LINE)
class UnfoldLine:
    """The JSON objects of a line, in order, however they are glued; what lies between and does not read is one row with a problem each. Blank and null lines have none."""

    def eval(self, line: str) -> Iterator[tuple]:
        part, at, torn, read = 0, 0, "", json.JSONDecoder().raw_decode
        line = line or ""
        while at < len(line):
            end = None
            if line[at] == "{":
                try:
                    end = read(line, at)[1]
                except (ValueError, RecursionError):
                    end = None
            if end is None:
                nxt = line.find("{", at + 1)
                nxt = len(line) if nxt < 0 else nxt
                torn, at = torn + line[at:nxt], nxt
                continue
            if torn.strip():
                yield part, torn.strip(), "torn"
                part += 1
            yield part, line[at:end], None
            part, at, torn = part + 1, end, ""
        if torn.strip():
            yield part, torn.strip(), "torn"


@F.udtf(returnType=REGION)
class UnfoldRegions:
    """The regions of an audit, objects with a ``box`` of four numbers, at any depth of lists and objects, in document order; ``path`` leads to each, ``depth`` counts the regions around it."""

    def eval(self, audit: str) -> Iterator[tuple]:
        try:
            top = json.loads(audit) if audit else None
        except ValueError:
            return
        todo = [(top, "$", 0)]
        while todo:
            x, path, depth = todo.pop()
            if isinstance(x, list):
                todo += [(y, f"{path}[{i}]", depth) for i, y in reversed(list(enumerate(x)))]
            elif isinstance(x, dict):
                box = x.get("box")
                found = isinstance(box, list) and len(box) == 4 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in box)
                if found:
                    yield path, depth, None if x.get("name") is None else str(x["name"]), *map(int, box)
                todo += [(y, f"{path}.{k}", depth + found) for k, y in reversed(list(x.items())) if k != "box" or not found]


def register(spark: SparkSession) -> None:
    """``unfold_line`` and ``unfold_regions`` for SQL."""
    spark.udtf.register("unfold_line", UnfoldLine)
    spark.udtf.register("unfold_regions", UnfoldRegions)


def unfold_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """All columns but ``value``, with part, value and problem of each piece of its lines."""
    found = lines.lateralJoin(UnfoldLine(F.col(value).outer()).toDF("part", "piece", "problem"))
    return found.drop(value).withColumnRenamed("piece", "value")


def unfold_regions(audits: DataFrame, audit: str = "audit") -> DataFrame:
    """All columns but ``audit``, with the columns of its regions."""
    return audits.lateralJoin(UnfoldRegions(F.col(audit).outer())).drop(audit)
