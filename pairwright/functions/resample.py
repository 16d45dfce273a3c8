"""Resampling and exact tests in Arrow batches: a cell, or where units are resampled a bounded chunk of one, at a time, vectorised inside it.

Two ways to draw: ``numpy`` (a seeded PCG64 index matrix) and ``hash`` (index = md5 of seed, draw and place, modulo n), which SQL can
repeat. Where a cell's rows could be many, they are counted by distinct value first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairwright.functions.stats import _matched, with_average_rank


def hash_index(seed: int, draw: int, place: int, n: int) -> int:
    return int(hashlib.md5(f"{seed}:{draw}:{place}".encode(), usedforsecurity=False).hexdigest()[:8], 16) % n


#: MD5's additions and turns (RFC 1321).
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
TURNS = [np.uint32((7, 12, 17, 22, 5, 9, 14, 20, 4, 11, 16, 23, 6, 10, 15, 21)[i // 16 * 4 + i % 4]) for i in range(64)]


def hash_heads(prefix: str, places: np.ndarray) -> np.ndarray:
    """The first 32 bits of md5(prefix and place) for places of one number of digits, side by side: only the words that hold digits are arrays. Prefix and place have up to 55 bytes."""
    head, size = prefix.encode(), len(str(int(places[0])))
    length = len(head) + size
    block = np.frombuffer((head + b"\0" * size + b"\x80").ljust(56, b"\0") + (8 * length).to_bytes(8, "little"), "<u4")
    words: list = [np.uint32(w) for w in block]
    for i in range(size):
        at = len(head) + i
        words[at // 4] = words[at // 4] + ((places // 10 ** (size - 1 - i) % 10 + 48).astype(np.uint32) << np.uint32(8 * (at % 4)))
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start
    with np.errstate(over="ignore"):
        for i in range(64):
            if i < 16:
                f, w = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, w = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, w = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, w = c ^ (b | ~d), 7 * i % 16
            f = f + a + (SINES[i] + words[w])
            a, d, c, b = d, c, b, b + ((f << TURNS[i]) | (f >> (np.uint32(32) - TURNS[i])))
        return (a + start[0]).byteswap()


def hash_indices(seed: int, draw: int, first: int, end: int, n: int) -> np.ndarray:
    """``hash_index`` of the places from ``first`` to before ``end``."""
    cuts = [first, *(10**k for k in range(1, 19) if first < 10**k < end), end]
    return np.concatenate([hash_heads(f"{seed}:{draw}:", np.arange(x, y)) for x, y in zip(cuts, cuts[1:], strict=False)]).astype(np.int64) % n


#: Places of a cell that are drawn at a time.
PLACES = 8_192


def hashed_draws(df: DataFrame, by: list[str], value: str, order: list[str], n_boot: int, seed: int) -> DataFrame:
    """(by, draw, m): the means of ``n_boot`` resamples of each cell's numbers, null ones left out. The place i of a draw takes the row of number ``hash_index`` in ``order``. Rows are counted by order and
    value; a cell's counts go to blocks of its places, so that the work is of the size of rows by draws, over all tasks, and a task holds the counts of a cell and a block."""
    spark, names = df.sparkSession, list(dict.fromkeys([*order, value]))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(names)]).agg(F.count("*").alias("_n"))
    told = [x for i in range(len(names)) for x in (F.col(f"_o{i}").isNull().alias(f"_u{i}"), F.col(f"_o{i}"))]
    cells = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*told, F.col(f"_o{names.index(value)}").cast("double").alias("_x"), "_n"))).alias("_c"), F.sum("_n").alias("_size"))
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_size") - 1, F.lit(PLACES).cast("bigint"))).alias("_first")
    blocks = cells.select(*by, F.col("_c._x").alias("_x"), F.col("_c._n").alias("_n"), "_size", first).repartition(4 * spark.sparkContext.defaultParallelism, *by, "_first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                x, upto, n = np.asarray(r[-4], float), np.cumsum(r[-3]), int(r[-2])
                sums = [x[np.searchsorted(upto, hash_indices(seed, draw, int(r[-1]), min(n, int(r[-1]) + PLACES), n), side="right")].sum() for draw in range(n_boot)]
                yield pd.DataFrame({**{c: pd.Series([k] * n_boot, dtype=object) for c, k in zip(by, r, strict=False)}, "draw": range(n_boot), "n": n, "s": sums})

    parts = blocks.mapInPandas(run, f"{kinds}draw int, n long, s double")
    return parts.groupBy(*by, "draw").agg((F.sum("s") / F.max("n")).alias("m"))


def bootstrap_mean(df: DataFrame, by: list[str], value: str, order: list[str], n_boot: int = 2000, alpha: float = 0.05, seed: int = 42, rng: str = "numpy") -> DataFrame:
    """(by, n, mean, ci_low, ci_high): percentile bootstrap of the mean; null below two values. ``numpy`` draws from counts by distinct value (how often
    each value is drawn is multinomial), so a cell weighs as many rows as it has values; ``hash`` takes the rows in ``order``, for cells that SQL repeats."""
    if rng == "hash":
        bounds = hashed_draws(df, by, value, order, n_boot, seed).groupBy(*by).agg(F.percentile("m", F.lit(alpha / 2)).alias("_low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("_high"))
        whole = _matched(df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean")), bounds, by, "left")
        return whole.select(*by, "n", "mean", *[F.when(F.col("n") >= 2, F.col(f"_{c}")).alias(f"ci_{c}") for c in ("low", "high")])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in by)

    def cell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["_n"] > 0].sort_values(value)
        v, c = rows[value].to_numpy(float), rows["_n"].to_numpy(np.int64)
        n, mean = int(c.sum()), float(v @ c / c.sum()) if len(v) else None
        low, high = np.quantile(multinomial_means(v, c, n_boot, seed), [alpha / 2, 1 - alpha / 2]) if n >= 2 else (None, None)
        return pd.DataFrame([[*key, n, mean, low, high]], columns=[*by, "n", "mean", "ci_low", "ci_high"])

    return df.groupBy(*by, value).agg(F.count(value).alias("_n")).groupBy(*by).applyInPandas(cell, f"{fields}, n long, mean double, ci_low double, ci_high double")


def hashed_p(df: DataFrame, by: list[str], value: str, order: list[str], n_boot: int = 200, seed: int = 42) -> DataFrame:
    """(by, n, p): two-sided bootstrap p of the mean from hashed draws, those on the rarer side of zero."""
    rarer = F.least(F.count_if(F.col("m") <= 0), F.count_if(F.col("m") >= 0))
    tests = hashed_draws(df, by, value, order, n_boot, seed).groupBy(*by).agg(F.least(F.lit(1.0), 2 * (rarer + 1) / (F.count("*") + 1)).alias("p"))
    return _matched(df.groupBy(*by).agg(F.count(value).alias("n")), tests, by, "left").select(*by, "n", "p")


def multinomial_means(v: np.ndarray, c: np.ndarray, n_boot: int, seed: int, most: int = 20_000_000) -> np.ndarray:
    """Means of ``n_boot`` resamples of values ``v`` that are there ``c`` times, a bounded number of counts at a time from one stream."""
    g, n = np.random.default_rng(seed), int(c.sum())
    step = max(1, most // len(v))
    return np.concatenate([g.multinomial(n, c / n, size=min(step, n_boot - i)) @ v / n for i in range(0, n_boot, step)])


SLOTS, CHUNK = 4_096, 65_536


def dealt(units: DataFrame, by: list[str], unit: str, n_boot: int, seed: int, most: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(placed, plan): the rows with ``_chunk``, a part of their cell of about ``most`` units, and (by, _chunk, _seed, _drawn), how many of a cell's n draws of n units fall on each chunk in each
    resample: multinomial, so that draws inside chunks make whole resamples and no task holds a cell. A cell of one chunk is drawn from as it is, by ``seed``."""
    slotted = units.withColumn("_slot", F.pmod(F.xxhash64(unit), F.lit(SLOTS)).cast("int"))
    sizes = slotted.groupBy(*by, "_slot").agg(F.count_distinct(F.struct(unit)).alias("_n"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in units.schema if f.name in by)

    def cell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_slot")
        chunk, held = [], [0]
        for n in rows["_n"]:
            if held[-1] and held[-1] + n > most:
                held.append(0)
            held[-1] += int(n)
            chunk.append(len(held) - 1)
        n, single = sum(held), len(held) == 1
        drawn = np.full((n_boot, 1), n) if single else np.random.default_rng([seed, n]).multinomial(n, np.array(held) / n, size=n_boot)
        first = {c: i for i, c in reversed(list(enumerate(chunk)))}
        told = [drawn[:, c].tolist() if first[c] == i else None for i, c in enumerate(chunk)]
        return pd.DataFrame({**{c: pd.Series([k] * len(rows), dtype=object) for c, k in zip(by, key, strict=True)}, "_slot": rows["_slot"].to_numpy(), "_chunk": chunk, "_seed": [[seed] if single else [seed, n, c + 1] for c in chunk], "_drawn": told})

    parts = sizes.groupBy(*by).applyInPandas(cell, f"{kinds}_slot int, _chunk int, _seed array<long>, _drawn array<long>")
    return _matched(slotted, parts.select(*by, "_slot", "_chunk"), [*by, "_slot"]).drop("_slot"), parts.where("_drawn is not null").select(*[F.col(c).alias(c) for c in [*by, "_chunk", "_seed", "_drawn"]])


def multiplicities(n: int, plan: pd.DataFrame) -> Iterator[np.ndarray]:
    """How often each of a chunk's n units is drawn, one resample after the other."""
    g = np.random.default_rng([int(x) for x in plan["_seed"].iloc[0]] if len(plan["_seed"].iloc[0]) > 1 else int(plan["_seed"].iloc[0][0]))
    for m in plan["_drawn"].iloc[0]:
        yield np.bincount(g.integers(0, n, size=int(m)), minlength=n)


def cluster_accuracy_bootstrap(turns: DataFrame, by: list[str], good: str, total: str, order: list[str], n_boot: int = 1000, alpha: float = 0.05, seed: int = 42, most: int = CHUNK) -> DataFrame:
    """(by, accuracy, ci_low, ci_high) from counts by turn. A turn drawn m times counts m squared times: its copies pair with each other. Tasks hold about ``most`` turns; ``order`` names a turn within its
    cell."""
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in turns.schema if f.name in by)
    own = turns.select(*dict.fromkeys([*by, *order]), F.struct(*order).alias("_unit"), F.col(good).cast("double").alias("_g"), F.col(total).cast("double").alias("_t"))
    placed, plan = dealt(own, by, "_unit", n_boot, seed, most)

    def chunk(key: tuple, rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        g, t = rows["_g"].to_numpy(), rows["_t"].to_numpy()
        sums = np.array([[m @ g, m @ t] for x in multiplicities(len(g), plan) for m in [x.astype(float) ** 2]])
        return pd.DataFrame({**{c: pd.Series([k] * len(sums), dtype=object) for c, k in zip(by, key, strict=False)}, "draw": range(len(sums)), "g": sums[:, 0], "t": sums[:, 1]})

    parts = placed.drop("_unit").groupBy(*by, "_chunk").cogroup(plan.groupBy(*by, "_chunk")).applyInPandas(chunk, f"{kinds}draw int, g double, t double")
    values = parts.groupBy(*by, "draw").agg(F.sum("g").alias("_g"), F.sum("t").alias("_t")).where("_t > 0").groupBy(*by)
    bounds = values.agg(F.percentile(F.col("_g") / F.col("_t"), F.lit(alpha / 2)).alias("ci_low"), F.percentile(F.col("_g") / F.col("_t"), F.lit(1 - alpha / 2)).alias("ci_high"))
    return _matched(own.groupBy(*by).agg(F.try_divide(F.sum("_g"), F.sum("_t")).alias("accuracy")), bounds, by, "left")


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_p(a: int, b: int, c: int, d: int) -> float | None:
    """Two-sided Fisher p of a 2 by 2 table: all tables with these margins that are no likelier; None where a row is empty. Likelihoods fall on
    both sides of the mode, so each side is walked outwards from its first table that counts until terms no longer matter."""
    if a + b == 0 or c + d == 0:
        return None
    row, column, n = a + b, a + c, a + b + c + d
    low, high = max(0, row + column - n), min(row, column)
    log = lambda k: log_choose(row, k) + log_choose(n - row, column - k) - log_choose(n, column)
    mode = min(high, max(low, (row + 1) * (column + 1) // (n + 2)))
    bound = log(a) + 1e-7
    if log(mode) <= bound:
        return 1.0
    p = 0.0
    for end, step in ((low, -1), (high, 1)):
        if log(end) > bound:
            continue
        near, far = mode, end  # near is likelier than the table, far is not: halve the way between them
        while abs(far - near) > 1:
            k = (near + far) // 2
            near, far = (k, far) if log(k) > bound else (near, k)
        term, k = math.exp(log(far)), far
        side = term
        while k != end and term > side * 1e-18:
            up = (row - k) * (column - k) / ((k + 1) * (n - row - column + k + 1)) if step > 0 else k * (n - row - column + k) / ((row - k + 1) * (column - k + 1))
            term, k = term * up, k + step
            side += term
        p += side
    return min(1.0, p)


def with_fisher(df: DataFrame, a: str, b: str, c: str, d: str, out: str = "p") -> DataFrame:
    """Adds the two-sided Fisher p of four counts; rows are cells of a summary."""

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else x for x in (fisher_p(*map(int, t)) if not any(map(pd.isna, t)) else None for t in zip(a, b, c, d, strict=True))], dtype=float)

    return df.withColumn(out, p(a, b, c, d))


def wilcoxon_p(shifts: np.ndarray, zero: str = "wilcox", counts: np.ndarray | None = None) -> float | None:
    """Two-sided signed-rank p of shifts (each there once, or ``counts`` times): exact for up to 50 shifts without ties or zeros, else the normal
    approximation. zero: ``wilcox`` drops zeros, ``pratt`` ranks them and drops their ranks."""
    d = np.asarray(shifts, float)
    times = np.ones(len(d)) if counts is None else np.asarray(counts, float)
    use = np.isfinite(d) & ((d != 0) | (zero != "wilcox"))
    d, times = d[use], times[use]
    n, zeros = float(times.sum()), float(times[d == 0].sum())
    if n == zeros:
        return None
    size, inverse = np.unique(np.abs(d), return_inverse=True)
    ties = np.bincount(inverse, times)
    ranks = (np.cumsum(ties) - (ties - 1) / 2)[inverse]
    plus, minus = (times * ranks)[d > 0].sum(), (times * ranks)[d < 0].sum()
    t = min(plus, minus)
    if n <= 50 and (ties == 1).all() and not zeros:
        ways = np.zeros(int(n * (n + 1) // 2) + 1)
        ways[0] = 1
        for r in range(1, int(n) + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(min(1.0, 2 * ways[: int(t) + 1].sum() / 2.0**n))
    mean, variance = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24
    if zeros:
        mean -= zeros * (zeros + 1) / 4
        variance -= zeros * (zeros + 1) * (2 * zeros + 1) / 24
        ties = ties[size > 0]
    variance -= (ties**3 - ties).sum() / 48
    return float(math.erfc(abs(t - mean) / math.sqrt(2 * variance))) if variance > 0 else None


def wilcoxon(df: DataFrame, by: list[str], shift: str, zero: str = "wilcox", out: str = "p") -> DataFrame:
    """(by, p) of each cell, from counts by distinct shift."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in by)

    def cell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, wilcoxon_p(rows[shift].to_numpy(float), zero, rows["_n"].to_numpy(float))]], columns=[*by, out])

    return df.groupBy(*by, shift).agg(F.count("*").alias("_n")).groupBy(*by).applyInPandas(cell, f"{fields}, {out} double")


def _mixed(keys: np.ndarray, draw: int, label: int) -> np.ndarray:
    """A hash of key, draw and label (splitmix64)."""
    shift = (draw + 1) * 0x9E3779B97F4A7C15 + (label + 1) * 0xD1B54A32D192ED03
    with np.errstate(over="ignore"):
        x = keys + np.uint64(shift % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _places(keys: np.ndarray, draw: int, k: int) -> np.ndarray:
    """(k, keys): the place of each of k labels in the order of their hashes; of equal hashes the first label comes first."""
    hashes = [_mixed(keys, draw, i) for i in range(k)]
    out = np.zeros((k, len(keys)), np.int16)
    for i in range(k):
        for j in range(i):
            later = hashes[j] > hashes[i]
            out[j] += later
            out[i] += ~later
    return out


#: Items that a task relabels at a time, and the most cues whose orders are listed.
ITEMS, LISTED = 65_536, 6


def _orders(keys: np.ndarray, n_perm: int, k: int) -> Iterator[np.ndarray]:
    """For draw after draw the number of each item's order of k labels, from a hash of item and draw: a hash has several digits to the base k!, each uniform within a millionth."""
    orders = math.factorial(k)
    bits = 64 - (orders - 1).bit_length()
    digits = max(1, int((bits - 20) / math.log2(orders))) if orders > 1 else n_perm
    for first in range(0, n_perm, digits):
        x = _mixed(keys, first, k) >> np.uint64(64 - bits) if orders > 1 else np.zeros(len(keys), np.uint64)
        for _ in range(min(digits, n_perm - first)):
            x = x * np.uint64(orders)
            yield (x >> np.uint64(bits % 64) if orders > 1 else x).view(np.int64)
            x &= np.uint64(2**bits - 1 if orders > 1 else 0)


def _relabelled(keys: np.ndarray, rank: np.ndarray, codes: np.ndarray, m: int, n_perm: int) -> Iterator[np.ndarray]:
    """For some draws after each other, (2, draws, judges, cues, m): how many items have which of ``m`` scores, and the sum of their ranks, after relabelling; ``codes`` are the scores' numbers by item, judge
    and cue. An item counts by its scores and its order alone, so where few items differ in all scores, a draw counts by these first and a product hands on to judges, cues and scores."""
    n, judges, k = codes.shape
    if k <= LISTED:
        table = np.array(list(permutations(range(k))))
        profiles, which = np.unique(codes.reshape(n, -1), axis=0, return_inverse=True)
        cells = len(profiles) * len(table)
        if cells <= 2 * n and cells * judges * k * m <= 8_000_000:
            to = np.zeros((judges, k, m, len(profiles), len(table)))
            p, j, i, o = np.indices((len(profiles), judges, k, len(table)))
            np.add.at(to, (j, table[o, i], profiles.reshape(-1, judges, k)[p, j, i], p, o), 1)
            to, base, held = to.reshape(judges * k * m, cells), which.reshape(-1) * len(table), []
            for draw, order in enumerate(_orders(keys, n_perm, k), 1):
                at = base + order
                held += [np.bincount(at, minlength=cells), np.bincount(at, rank, minlength=cells)]
                if len(held) == 32 or draw == n_perm:
                    yield (to @ np.array(held, float).T).T.reshape(-1, 2, judges, k, m).swapaxes(0, 1)
                    held = []
            return
    for draw, order in enumerate(_orders(keys, n_perm, k) if k <= LISTED else range(n_perm)):
        places = table[order].T if k <= LISTED else _places(keys, draw, k)
        t = np.zeros((2, 1, judges, k, m))
        for j in range(judges):
            for i in range(k):
                at = places[i] * np.int64(m) + codes[:, j, i]
                t[0, 0, j] += np.bincount(at, minlength=m * k).reshape(k, m)
                t[1, 0, j] += np.bincount(at, rank, minlength=m * k).reshape(k, m)
        yield t


def permutation_worst_cue(cells: DataFrame, judge: str, item: str, human: str, cues: list[str], n_perm: int = 10_000, seed: int = 42, flush: int = 16_000_000, store: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(statistic, cue, observed, p_label, p_selected): is one cue the worst of its judges more often than relabelling cues within items
    would have it? ``cells`` has a row for each judge and item with the human score, ``baseline`` and one score a cue (of several the least); only complete rows of items
    that every judge has count. ``store`` keeps what is read more than once.

    A rank correlation needs, of each score, only how many items have it and the sum of their human ranks. So each task relabels its own items by a
    hash of item and draw (alike for all judges) and hands on those two sums by judge, draw, cue and score, holding about ``flush`` sums at a time; what is left is of the
    size draws by cues by scores. No task and no driver holds the items."""
    spark = cells.sparkSession
    schema = "statistic string, cue string, observed double, p_label double, p_selected double"
    scores = F.array(*[F.col(c).cast("double") for c in ("baseline", *cues)])
    complete = store(cells.dropna(subset=[human, "baseline", *cues]).select(F.col(judge).cast("string").alias("_judge"), F.col(item).alias("_item"), F.col(human).alias("_h"), scores.alias("_scores")).where("_judge is not null"))
    judges = sorted(r[0] for r in complete.select("_judge").distinct().collect())
    if not judges:
        return spark.createDataFrame([], schema)
    by_judge = complete.groupBy("_item").agg(F.min_by("_h", "_judge").alias("_h"), *[F.min(F.when(F.col("_judge") == j, F.col("_scores"))).alias(f"_s{i}") for i, j in enumerate(judges)])
    shared = by_judge.dropna(subset=[f"_s{i}" for i in range(len(judges))]).select(F.xxhash64("_item", F.lit(seed)).alias("key"), "_h", F.concat(*[f"_s{i}" for i in range(len(judges))]).alias("scores"))
    ranked = store(with_average_rank(store(shared), [], "_h", "_rank").select("key", "_rank", "scores"))
    items, spread = ranked.agg(F.count("*"), F.stddev_pop("_rank")).first()
    if not items:
        return spark.createDataFrame([], schema)
    k = len(cues)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, t = np.zeros(0), np.zeros((2, n_perm + 1, len(judges), k + 1, 0))  # scores met; counts and rank sums by draw (the first: as observed), judge, cue (the first: the baseline) and score

        def out(t: np.ndarray, values: np.ndarray, first: int) -> Iterator[pd.DataFrame]:
            step = max(1, 200_000 * t.shape[1] // max(1, t[0].size))
            for lo in range(0, t.shape[1], step):
                draw, j, cue, v = np.nonzero(t[0, lo : lo + step])
                n, s = (x[lo : lo + step][draw, j, cue, v] for x in t)
                yield pd.DataFrame({"judge": j.astype(np.int32), "draw": draw + lo + first, "cue": cue.astype(np.int32), "v": values[v], "n": n.astype(np.int64), "s": s})

        def counted(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            nonlocal values, t
            rows = pd.concat(held)
            keys, rank = rows["key"].to_numpy(np.int64).view(np.uint64), rows["_rank"].to_numpy(float)
            own, codes = np.unique(np.concatenate(rows["scores"].to_list()), return_inverse=True)
            codes = codes.reshape(len(keys), len(judges), k + 1)
            seen = np.zeros((2, 1, len(judges), k + 1, len(own)))
            for j in range(len(judges)):
                for i in range(k + 1):
                    seen[:, 0, j, i] = np.bincount(codes[:, j, i], minlength=len(own)), np.bincount(codes[:, j, i], rank, minlength=len(own))
            both = np.union1d(values, own)
            if 2 * (n_perm + 1) * len(judges) * (k + 1) * len(both) > flush:  # too many scores to be held for all draws: some draws at a time
                yield from out(seen, own, -1)
                first, parts, size = 0, [], 0
                for part in _relabelled(keys, rank, codes[..., 1:], len(own), n_perm):
                    parts.append(part)
                    size += part.size
                    if size > flush // 4:
                        yield from drawn(parts, own, first)
                        first, parts, size = first + sum(p.shape[1] for p in parts), [], 0
                yield from drawn(parts, own, first)
                return
            if len(both) > len(values):
                wider = np.zeros((*t.shape[:-1], len(both)))
                wider[..., np.searchsorted(both, values)] = t
                values, t = both, wider
            at = np.searchsorted(values, own)
            t[:, :1, ..., at] += seen
            first = 1
            for part in _relabelled(keys, rank, codes[..., 1:], len(own), n_perm):
                t[:, first : first + part.shape[1], :, 1:, at] += part
                first += part.shape[1]

        def drawn(parts: list[np.ndarray], own: np.ndarray, first: int) -> Iterator[pd.DataFrame]:
            if parts:
                part = np.concatenate(parts, axis=1)
                yield from out(np.concatenate([np.zeros((*part.shape[:3], 1, part.shape[4])), part], axis=3), own, first)

        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= ITEMS:
                yield from counted(held)
                held = []
        if sum(map(len, held)):
            yield from counted(held)
        yield from out(t, values, -1)

    # Each task hands on sums for all draws, so there are as many tasks as are of use.
    rows = ranked.coalesce(2 * spark.sparkContext.defaultParallelism)
    parts = rows.mapInPandas(sums, "judge int, draw long, cue int, v double, n long, s double").groupBy("judge", "draw", "cue", "v").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    own = W.partitionBy("judge", "draw", "cue").orderBy("v")
    rank = parts.withColumn("r", F.sum("n").over(own) - (F.col("n") - 1) / 2.0)
    mean = (items + 1) / 2.0
    var = F.greatest(F.sum(F.col("n") * F.col("r") * F.col("r")) / items - mean * mean, F.lit(0.0))
    rho = rank.groupBy("judge", "draw", "cue").agg(F.when((var > 1e-12) & F.lit(spread > 0), (F.sum(F.col("r") * F.col("s")) / items - mean * mean) / (F.sqrt(var) * spread)).alias("rho"))
    # Windows over what is left, not joins with itself: the draws above are made once.
    before = F.max(F.when((F.col("draw") == -1) & (F.col("cue") == 0), F.col("rho"))).over(W.partitionBy("judge"))
    delta = rho.withColumn("delta", F.round(F.col("rho") - before, 12)).where("cue > 0")
    worst = F.min(F.when(F.col("delta").isNotNull(), F.struct("delta", "cue"))).over(W.partitionBy("judge", "draw"))["cue"] == F.col("cue")
    rows = delta.withColumn("worst", worst).groupBy("draw", "cue").agg(F.avg("delta").alias("delta"), F.count_if("worst").alias("worst")).toPandas().sort_values(["draw", "cue"])
    w, d = (rows.pivot(index="draw", columns="cue", values=c) for c in ("worst", "delta"))
    seen_w, seen_d, w, d = w.loc[-1].fillna(0).to_numpy(), d.loc[-1].to_numpy(float), w.drop(index=-1).fillna(0).to_numpy(), d.drop(index=-1).to_numpy(float)
    out = []
    for k, cue in enumerate(cues):
        out.append(("worst_count", cue, float(seen_w[k]), float((1 + (w >= seen_w[k]).sum()) / (1 + w.size)), float((1 + (w.max(axis=1) >= seen_w[k]).sum()) / (1 + len(w)))))
        out.append(("mean_delta_rho", cue, float(seen_d[k]), float((1 + (d <= seen_d[k]).sum()) / (1 + d.size)), float((1 + (d.min(axis=1) <= seen_d[k]).sum()) / (1 + len(d)))))
    return spark.createDataFrame(out, schema)
