"""Statistics as Column expressions: intervals, exact tests on counts, ranks, false-discovery control.

Everything here stays in the JVM. Ranks within a group come from counts by distinct value, cumulated in order-keeping parts of the
group, so no task sorts a whole group.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed value: the 97.5 % point of the normal distribution.
Z95 = 1.959963985

#: So many counted values may pass through the driver and be broadcast.
FEW = 20_000


def share(condition: Column) -> Column:
    """The share of rows that meet a condition, nulls left out."""
    return F.avg(condition.cast("double"))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """The Wilson interval at 95 %, null where n is 0."""
    p, z2 = successes / n, Z95 * Z95
    scale = 1 + z2 / n
    centre, half = (p + z2 / (2 * n)) / scale, Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / scale
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def minimum_detectable_effect(n: Column, reference_n: int = 611, reference_mde: float = 0.113) -> Column:
    """In standard deviations of the paired difference, from a reference design; null where n is 0."""
    return F.when(n > 0, reference_mde * F.sqrt(reference_n / n))


def log_factorial(x: Column) -> Column:
    """log x! by Stirling's series at x + 10, brought back by ten factors."""
    x = x.cast("double")
    y = x + 10
    series = y * F.log(y) - y + F.log(y * (2 * math.pi)) / 2 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7))) + 1 / (1188 * F.pow(y, F.lit(9)))
    return F.when(x < 2, 0.0).otherwise(series - F.log(reduce(lambda a, i: a * (x + i), range(2, 11), x + 1)))


def binomial_tail(n: Column, k: Column) -> Column:
    """The sum of C(n, i) / 2^n for i from 0 to k, for k up to n / 2: the last term from factorials, the ones below it by their ratios. Terms 20 standard
    deviations below are under 1e-300 of it; none after them are walked, so a row takes in the order of sqrt(n) steps."""
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n.cast("double") * math.log(2)
    steps = F.least(k, F.ceil(20 * F.sqrt(n.cast("double")))).cast("bigint")
    down = lambda acc, i: F.struct((acc["t"] * (k - i) / (n - k + i + 1)).alias("t"), (acc["total"] + acc["t"] * (k - i) / (n - k + i + 1)).alias("total"))
    total = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.greatest(steps, F.lit(1)) - 1), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("total")), down)["total"]
    return F.exp(first + F.when(k < 1, 0.0).otherwise(F.log(total)))


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p of b against c discordant pairs; null where there are none."""
    return F.when(b + c > 0, F.least(F.lit(1.0), 2 * binomial_tail(b + c, F.least(b, c))))


def _matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of both sides in which null equals null; they are kept once."""
    other = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return left.join(other, met, how).drop(*[f"_on_{c}" for c in on])


def _part(value: str) -> Column:
    """The part of a value: parts are in the order of values and 0.4 % wide."""
    v = F.col(value).cast("double")
    part = F.greatest(F.least(F.signum(v) * F.log1p(F.abs(v) * 1e6) * 256, F.lit(1e15)), F.lit(-1e15))
    return F.coalesce(F.floor(part).cast("bigint"), F.lit(-(2**62)))


def cumulated(df: DataFrame, by: list[str], value: str, n: str, descending: bool = False, head: str | None = None) -> DataFrame:
    """Adds ``_upto`` (the sum of ``n`` within ``by`` over the rows up to this one in the order of ``value``) and ``_size`` (over all of them). A group is cut
    into parts by the logarithm of the value, 0.4 % wide; parts run side by side, and the sums of lower parts are added. ``value`` is a number, or a
    struct with a number ``head`` as its first field. Parts decide the work of a task, not the result. Rows of one value should be counted before."""
    placed = df.withColumn("_part", _part(head or value))
    sums = placed.groupBy(*by, "_part").agg(F.sum(n).alias("_sum"))
    turn = (lambda c: F.col(c).desc()) if descending else F.col
    lower = F.sum("_sum").over(W.partitionBy(*by).orderBy(turn("_part"))) - F.col("_sum")
    parts = sums.select(*by, "_part", lower.alias("_lower"), F.sum("_sum").over(W.partitionBy(*by)).alias("_size"))
    running = F.sum(n).over(W.partitionBy(*by, "_part").orderBy(turn(value)).rowsBetween(W.unboundedPreceding, 0))
    return _matched(placed, parts, [*by, "_part"]).withColumn("_upto", F.col("_lower") + running).drop("_part", "_lower")


def average_ranks(df: DataFrame, by: list[str], value: str, out: str, descending: bool = False) -> DataFrame:
    """(by, value, out): the average rank (1 first) of each distinct number of a group; null is unranked."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return cumulated(counts, by, value, "_n", descending).select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))


def with_average_rank(df: DataFrame, by: list[str], value: str, out: str, descending: bool = False) -> DataFrame:
    """Adds average ranks (1 first) of ``value`` within ``by``; null values are unranked."""
    if not by:
        return with_average_rank(df.withColumn("_all", F.lit(0)), ["_all"], value, out, descending).drop("_all")
    return _matched(df, average_ranks(df, by, value, out, descending), [*by, value], "left")


def board_rank(df: DataFrame, by: list[str], value: str, out: str, descending: bool = False) -> DataFrame:
    """Adds average ranks (1 first) of ``value``, to twelve digits, within groups that are small by nature, such as the editors of a board: one window. Null values are unranked."""
    v = F.round(F.col(value).cast("double"), 12)
    own = W.partitionBy(*by)
    rank = F.rank().over(own.orderBy(v.desc_nulls_last() if descending else v.asc_nulls_last()))
    alike = F.count("*").over(W.partitionBy(*by, v))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), rank + (alike - 1) / 2.0))


def spearman(df: DataFrame, by: list[str], x: str, y: str, out: str = "rho") -> DataFrame:
    """One row for each of ``by``: n and Spearman's coefficient with average ranks; null below three rows or with a constant side."""
    return spearmans(df, by, x, {y: out})


def _centred_ranks(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Rows with the average ranks of columns, less their mean, in place of the columns. One pass counts the values of all; up to ``FEW`` are ranked and broadcast, more are joined."""
    base, last = rows, 2 ** len(names) - 1
    counts = rows.groupingSets([[*by, c] for c in names], *by, *names).agg(F.grouping_id().alias("_set"), F.count("*").alias("_n"))
    held = counts.limit(FEW + 1).collect()
    own = W.partitionBy(*by, "_set")
    few = rows.sparkSession.createDataFrame(held, counts.schema).withColumns({"_upto": F.sum("_n").over(own.orderBy(*names)), "_size": F.sum("_n").over(own)}) if len(held) <= FEW else None
    for i, c in enumerate(names):
        # The grouping id has a bit for each column left out, the first column's highest.
        placed = cumulated(base.groupBy(*by, c).agg(F.count("*").alias("_n")), by, c, "_n") if few is None else F.broadcast(few.where(F.col("_set") == last - 2 ** (len(names) - 1 - i)))
        rank = F.col("_upto") - (F.col("_n") - 1) / 2.0 - (F.col("_size") + 1) / 2.0
        rows = _matched(rows, placed.select(*by, c, rank.alias(f"_rank_{c}")), [*by, c]).drop(c).withColumnRenamed(f"_rank_{c}", c)
    return rows


def spearmans(df: DataFrame, by: list[str], x: str, ys: dict[str, str]) -> DataFrame:
    """``spearman`` of ``x`` with several columns (column: name of its result), over the rows that have them all. Rows are counted, and their other ranks added up, by value of
    ``x`` once; values take places within parts as in ``cumulated``, and what lies below a part is added to the part's sums."""
    ranks = [f"_r{i}" for i in range(len(ys))]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (x, *ys)])
    rows = _centred_ranks(df.where(known).select(*by, F.col(x).alias("_x"), *[F.col(c).alias(r) for r, c in zip(ranks, ys)]), by, ranks)
    values = rows.groupBy(*by, "_x").agg(F.count("*").alias("_n"), *[F.sum(r).alias(f"_sum{r}") for r in ranks], *[F.sum(F.col(r) * F.col(r)).alias(f"_square{r}") for r in ranks])
    running = F.sum("_n").over(W.partitionBy(*by, "_part").orderBy("_x").rowsBetween(W.unboundedPreceding, 0))
    placed = values.withColumn("_part", _part("_x")).withColumn("_at", running - (F.col("_n") - 1) / 2.0)
    at, n, low = F.col("_at"), F.col("_n"), F.col("_low")
    parts = placed.groupBy(*by, "_part").agg(
        F.sum(n).alias("_n"), F.count("*").alias("_values"), F.sum(n * at).alias("_at1"), F.sum(n * at * at).alias("_at2"), *[F.sum(at * F.col(f"_sum{r}")).alias(f"_product{r}") for r in ranks],
        *[F.sum(c).alias(c) for r in ranks for c in (f"_sum{r}", f"_square{r}")],
    )
    own = W.partitionBy(*by)
    parts = parts.withColumn("_low", F.sum("_n").over(own.orderBy("_part")) - n - (F.sum("_n").over(own) + 1) / 2.0)
    spread = F.sqrt(F.sum(n * low * low + 2 * low * F.col("_at1") + F.col("_at2")))
    rho = lambda r: F.try_divide(F.sum(low * F.col(f"_sum{r}") + F.col(f"_product{r}")), spread * F.sqrt(F.sum(f"_square{r}")))
    varied = (F.sum("_n") >= 3) & (F.sum("_values") > 1)
    return parts.groupBy(*by).agg(F.sum("_n").alias("n"), *[F.when(varied, rho(r)).alias(out) for r, out in zip(ranks, ys.values())])


def kendall_tau_b(df: DataFrame, by: list[str], item: str, x: str, y: str, out: str = "tau") -> DataFrame:
    """Kendall's tau-b over the items of each group (a group is a board of few items); null below three items or with a constant side."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, item, x, y)
    left = own.select(*by, F.col(item).alias("_i"), F.col(x).alias("_x1"), F.col(y).alias("_y1"))
    right = own.select(*by, F.col(item).alias("_j"), F.col(x).alias("_x2"), F.col(y).alias("_y2"))
    pairs = left.join(right, by).where("_i < _j")
    sx, sy = F.signum(F.col("_x1") - F.col("_x2")), F.signum(F.col("_y1") - F.col("_y2"))
    counted = pairs.groupBy(*by).agg(F.count("*").alias("_pairs"), F.sum(sx * sy).alias("_s"), count_if(sx != 0).alias("_nx"), count_if(sy != 0).alias("_ny"))
    sizes = own.groupBy(*by).agg(F.count("*").alias("n"))
    tau = F.when((F.col("n") >= 3) & (F.col("_nx") > 0) & (F.col("_ny") > 0), F.col("_s") / F.sqrt(F.col("_nx").cast("double") * F.col("_ny")))
    return sizes.join(counted, by, "left").select(*by, "n", tau.alias(out))


def with_bh(df: DataFrame, p: str, family: list[str], q: str = "q", alpha: float = 0.05, significant: str | None = "significant") -> DataFrame:
    """Adds Benjamini-Hochberg q-values within each family. Null p-values pass through as null and do not count."""
    known = F.col(p).isNotNull()
    m = F.count(F.col(p)).over(W.partitionBy(*family))
    up = F.row_number().over(W.partitionBy(*family).orderBy(F.col(p).asc_nulls_last()))
    ranked = df.withColumn("_scaled", F.when(known, F.col(p) * m / up)).withColumn("_up", up)
    floor = F.min("_scaled").over(W.partitionBy(*family).orderBy(F.desc("_up")).rowsBetween(W.unboundedPreceding, 0))
    out = ranked.withColumn(q, F.when(known, F.least(F.lit(1.0), floor))).drop("_scaled", "_up")
    return out.withColumn(significant, F.coalesce(F.col(q) < alpha, F.lit(False))) if significant else out


def signed_rank(df: DataFrame, by: list[str], shift: str) -> DataFrame:
    """For each of ``by``: n of non-zero shifts, W+, the tie term and z of Wilcoxon's signed-rank statistic (no continuity
    correction)."""
    own = df.where((F.col(shift) != 0) & F.col(shift).isNotNull())
    # Counts by size carry all there is to know; rows are not ranked.
    counts = own.groupBy(*by, F.abs(shift).alias("_abs")).agg(F.count("*").alias("_n"), count_if(F.col(shift) > 0).alias("_plus"))
    ranked = cumulated(counts, by, "_abs", "_n").withColumn("_rank", F.col("_upto") - (F.col("_n") - 1) / 2.0)
    sums = ranked.groupBy(*by).agg(F.sum("_n").alias("n_nonzero"), F.sum(F.col("_plus") * F.col("_rank")).alias("w_plus"), F.sum(F.col("_n") * F.col("_n") * F.col("_n") - F.col("_n")).alias("tie_term"))
    n = F.col("n_nonzero").cast("double")
    low = F.least(F.col("w_plus"), n * (n + 1) / 2 - F.col("w_plus"))
    sigma = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("tie_term") / 2.0) / 24)
    return sums.withColumn("z", F.when(sigma > 0, (low - n * (n + 1) / 4) / sigma))


def two_sided(z: Column) -> Column:
    """2 * Phi(-|z|), by the error function's series (small |z|) or its continued fraction (large |z|), in one expression each."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    term = lambda acc, i: F.struct((-acc["t"] * x * x / i).alias("t"), (acc["s"] - acc["t"] * x * x / i / (2 * i + 1)).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), term)["s"]
    small = 1 - 2 / F.sqrt(F.lit(3.141592653589793)) * x * series
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda acc, i: (i / 2.0) / (x + acc))
    large = F.exp(-x * x) / F.sqrt(F.lit(3.141592653589793)) / (x + fraction)
    return F.when(z.isNotNull(), F.when(x < 2.5, small).otherwise(large))


def kappa(po: Column, pe: Column) -> Column:
    return F.when(pe != 1, (po - pe) / (1 - pe))
