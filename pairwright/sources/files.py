"""Scans and sinks: JSON lines, CSV and TSV, label files, trees, parquet, appends that write each id once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.functions.text import slug, stem


class BadRows(ValueError):
    """Rows that a scan refuses."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, strict: bool = True) -> DataFrame:
    """One object a line by a declared schema, blank lines skipped. strict: any bad line is an error that names its file."""
    read = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema], T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).withColumn("_file", F.col("_metadata.file_path")).where(F.trim("value") != "")
    rows = lines.withColumn("r", F.from_json("value", read, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    if strict:
        missing = reduce(lambda a, b: a | b, [F.col(f"r.{f.name}").isNull() for f in schema if not f.nullable], F.lit(False))
        if first := rows.where(F.col("r._corrupt").isNotNull() | missing).select("_file", "value").head(1):
            raise BadRows(f"{first[0]['_file']}: {first[0]['value'][:200]}")
    return rows.select(*[F.col(f"r.{f.name}") for f in schema])


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A missing file is an empty table."""
    return read_jsonl(spark, path, schema) if _exists(spark, path) else spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in schema]))


def read_required(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A missing or empty file is an error."""
    if not _exists(spark, path):
        raise BadRows(f"{path} is missing")
    df = read_jsonl(spark, path, schema)
    if df.isEmpty():
        raise BadRows(f"{path} has no rows")
    return df


def read_csv(spark: SparkSession, path: str | list[str], required: list[str], typed: dict[str, str] | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header (a byte-order mark is skipped): required columns must be there; cells are trimmed, blank is null, ``typed``
    columns are cast and a value that does not fit is an error."""
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise BadRows(f"{path} lacks columns {missing}")
    df = df.select([F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns])
    return df.withColumns({c: F.col(c).cast(t) for c, t in (typed or {}).items() if c in df.columns})


def unpivot_ratings(wide: DataFrame, key: str, empty: tuple[str, ...] = ("", "-", "na", "n/a", "nan", "none", "null", "[]")) -> DataFrame:
    """(key, model, rater scores sc and pq) from one column a model holding ``[sc, pq]`` text; cells that are empty, malformed
    or outside of 0..1 are dropped."""
    long = wide.unpivot([key], [c for c in wide.columns if c != key], "model", "cell")
    pair = F.from_json(F.col("cell"), "array<double>")
    ok = ~F.lower(F.trim("cell")).isin(*empty) & (F.size(pair) == 2) & pair[0].between(0, 1) & pair[1].between(0, 1)
    return long.where(ok).select(key, "model", pair[0].alias("sc"), pair[1].alias("pq"))


def mean_ratings(ratings: DataFrame, by: list[str]) -> DataFrame:
    """Mean SC and PQ over raters, and their geometric mean."""
    means = ratings.groupBy(*by).agg(F.avg("sc").alias("sc"), F.avg("pq").alias("pq"), F.count("*").alias("raters"))
    return means.withColumn("overall", F.sqrt(F.col("sc") * F.col("pq")))


def join_labels(labels: DataFrame, key: list[str], dimension: str, value: str, dimensions: list[str]) -> DataFrame:
    """One row a key with a column a dimension (last value wins by ``ord`` if there), and whether all are there."""
    order = F.col("ord") if "ord" in labels.columns else F.monotonically_increasing_id()
    held = labels.withColumn("_o", order).groupBy(*key).agg(*[F.max_by(F.when(F.col(dimension) == d, F.col(value)), F.when(F.col(dimension) == d, F.col("_o"))).alias(d) for d in dimensions])
    return held.withColumn("complete", reduce(lambda a, b: a & b, [F.col(d).isNotNull() for d in dimensions]))


def shards(found: list[str], listed: list[str] | None = None, prefix: str = "", most: int | None = None) -> list[str]:
    """The listed files, else the sorted ones of a prefix, the first ``most`` of them."""
    return list(listed) if listed else sorted(f for f in found if f.rsplit("/", 1)[-1].startswith(prefix))[:most]


def project(spark: SparkSession, paths: list[str], columns: list[str], strict: bool = True) -> DataFrame:
    """Parquet with only these columns read; strict: a missing one is an error, else it is left out."""
    df = spark.read.parquet(*paths)
    columns = list(dict.fromkeys(columns))
    missing = [c for c in columns if c not in df.columns]
    if missing and strict:
        raise BadRows(f"no such columns: {missing}")
    return df.select([c for c in columns if c in df.columns])


def files_by_stem(listing: DataFrame, path: str = "path") -> DataFrame:
    """(stem, path): the first path of each stem, whatever its extension."""
    return listing.groupBy(stem(F.col(path)).alias("stem")).agg(F.min(path).alias("path"))


def flatten_tree(spark: SparkSession, path: str, prefix: str = "", kind: str = "file") -> DataFrame:
    """(path, size) of a JSON listing of nested entries {path, type, size}."""
    tree = spark.read.option("multiLine", True).schema("path string, type string, size long").json(path)
    return tree.where((F.col("type") == kind) & F.col("path").startswith(prefix)).select("path", "size")


def write_jsonl(df: DataFrame, path: str, append: bool = False, by: list[str] | None = None) -> None:
    writer = df.write.mode("append" if append else "overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, refuse_empty: bool = False) -> None:
    """A report (few rows) as one CSV file with a header."""
    if refuse_empty and df.isEmpty():
        raise BadRows(f"nothing to write to {path}")
    df.select(columns or df.columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def route(df: DataFrame) -> DataFrame:
    """Adds the tree a verdict belongs to and a file-safe judge name, to partition by."""
    return df.withColumn("tree", F.when(F.col("bias_type").isNull(), "raw_judgments").otherwise("biased_judgments")).withColumn("judge_slug", slug(F.col("judge_model")))


def append_new(df: DataFrame, path: str, key: str = "result_id") -> None:
    """Append rows whose key is not there yet, each key once (the first by ``ord`` if there). A null key is a key like any other."""
    spark = df.sparkSession
    order = F.struct(F.col("ord") if "ord" in df.columns else F.lit(0))  # a struct is never null, so no row is passed over
    fresh = df.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(F.col(key).alias("_held")), F.col(key).eqNullSafe(F.col("_held")), "left_anti")
    fresh.write.mode("append").parquet(path)


def audit_tree(lines: DataFrame, key: str = "result_id") -> DataFrame:
    """(problem, id, n) of raw JSON lines (value, ord): torn or non-object lines, rows without id, ids met more than once."""
    rows = lines.where(F.trim("value") != "").withColumn("_id", F.get_json_object("value", f"$.{key}"))
    is_object = F.trim("value").rlike(r"(?s)^\{.*\}$") & F.try_parse_json("value").isNotNull()
    torn = rows.where(~is_object).groupBy(F.lit("not an object").alias("problem"), F.lit(None).cast("string").alias("id")).agg(F.count("*").alias("n"))
    nameless = rows.where(is_object & F.col("_id").isNull()).groupBy(F.lit("no id").alias("problem"), F.lit(None).cast("string").alias("id")).agg(F.count("*").alias("n"))
    twice = rows.where(is_object & F.col("_id").isNotNull()).groupBy(F.col("_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("met again").alias("problem"), "id", "n")
    return torn.unionByName(nameless).unionByName(twice)


def content_name(content: Column, n: int = 12) -> Column:
    """The head of a content's SHA-1, as its file name."""
    return F.substring(F.sha1(content), 1, n)


def fingerprint(df: DataFrame, by: list[str], line: str) -> DataFrame:
    """(by, n, digest): SHA-256 over the number of a group's lines and the sums of four 60-bit words of each line's SHA-256. Neither the order of
    rows nor their partition matters, repeated lines count, and the sums are combined before the shuffle. Null lines do not count."""
    own = df.where(F.col(line).isNotNull()).select(*by, F.sha2(line, 256).alias("_h"))
    words = [F.sum(F.conv(F.substring("_h", i, 15), 16, 10).cast("decimal(28,0)")).alias(f"_w{i}") for i in (1, 16, 31, 46)]
    summed = own.groupBy(*by).agg(F.count("*").alias("n"), *words)
    return summed.select(*by, "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"_w{i}").cast("string") for i in (1, 16, 31, 46)]), 256).alias("digest"))


def compare_fingerprints(found: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """(by, status): OK, DIFFERS, MISSING or EXTRA."""
    a, b = found.select(*by, F.col("digest").alias("_f")), expected.select(*by, F.col("digest").alias("_e"))
    status = F.when(F.col("_e").isNull(), "EXTRA").when(F.col("_f").isNull(), "MISSING").when(F.col("_e") == F.col("_f"), "OK").otherwise("DIFFERS")
    return a.join(b, by, "full_outer").select(*by, status.alias("status"))
