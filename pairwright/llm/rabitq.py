"""Nearest neighbours by randomly rotated one-bit codes.

Index. Every vector is scaled to length one, rotated by a fixed random orthogonal matrix and kept as the signs of its
components, packed, with one correction scalar: the inner product of the vector and its code. Nothing is fitted. The index is a stored
table, made once: queries of all blocks read its codes.

Search. A query is rotated likewise and kept in ``PLANES`` bit planes (components rounded to 2^PLANES steps), so that its inner product with a code
is a weighted sum of the bits that code and plane have in common, counted on packed words. Divided by the correction scalar, it estimates
the cosine; the error stays within ``BOUND`` times the root of (1 - c^2) / c^2 / (d - 1), for a correction scalar c, and of the variance
of the rounding, but for a chance that falls with the bound as that of a normal deviate. A vector whose upper bound reaches the k-th best found so far
(at first, the k-th best lower bound of different ids) has its exact cosine computed, in double precision on the original vectors; all others are never looked at again.

Queries are taken in blocks of at most about ``block`` vectors, each broadcast in turn; every task keeps k ids a query, and these are
merged by query. A block's results are stored before the next block is sent, and its broadcast goes.

Defined results: vectors that are null, zero, of another length than most queries, or that hold null or non-finite components take no
part, as query or candidate, nor do rows without an id; with fewer candidates than k, all are found; ties go to the smaller id; rows of the
same id are one vector to search for and to be found (a query's own id is never found, an id is found once, and two ids' nearness is the best of their rows);
lengths far from one do no harm (components are scaled by a power of two first); no rows: no result. Other columns are not returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import forget, settled, share

BOUND, PLANES = 4.0, 4
ROWS = 2048


def rotation(d: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, their vectors in double precision) of those that take part."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array([-1 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    fit = np.flatnonzero(sizes == d)
    if not len(fit):
        return fit, np.zeros((0, d))
    flat = column.take(pa.array(fit)).flatten().cast(pa.float64())
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(fit), d)
    good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
    return fit[good], values[good]


def scaled(v: np.ndarray) -> np.ndarray:
    """The vectors with their largest component near one, by an exact factor, so that no square over- or underflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None]) if len(v) else v


def _lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits in 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, -packed.shape[-1] % 8)])).view(np.uint64)


def codes(v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs in 64-bit words, correction scalars) of vectors."""
    v = scaled(v)
    unit = (v / _lengths(v)[:, None]) @ turn
    return _words(unit > 0), np.abs(unit).sum(axis=1) / np.sqrt(v.shape[1])


def planes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Turned unit queries as (bit planes in words, lowest value, step, sum of the rounded values)."""
    low = turned.min(axis=1)
    step = np.maximum(turned.max(axis=1) - low, 1e-12) / (2**PLANES - 1)
    rounded = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    bits = (rounded[:, None, :] >> np.arange(PLANES)[None, :, None]) & 1
    return _words(bits.astype(bool)), low, step, low * turned.shape[1] + step * rounded.sum(axis=1)


def estimates(words: np.ndarray, correction: np.ndarray, queries: tuple, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimated cosines of code rows and queries, their standard errors)."""
    plane, low, step, total = queries
    common = np.zeros((len(words), len(low)), np.int32)
    for j in range(PLANES):
        for w in range(words.shape[1]):
            common += np.bitwise_count(words[:, w, None] & plane[None, :, j, w]).astype(np.int32) << j
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    inner = (2 * (step * common + low * ones[:, None]) - total) / np.sqrt(d)
    spread = np.maximum(0, 1 - correction**2) / max(1, d - 1)
    return inner / correction[:, None], np.sqrt(spread[:, None] + step**2 / 12) / correction[:, None]


def index(vectors: DataFrame, d: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, embedding, code binary, correction double) of every vector that takes part."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(d)
        for batch in batches:
            rows, v = _matrix(batch.column(1), d)
            words, correction = codes(v, turn)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(v.tolist(), pa.list_(pa.float64())), pa.array([x.tobytes() for x in words], pa.binary()), pa.array(correction)], names=[key, "embedding", "code", "correction"])

    return vectors.where(F.col(key).isNotNull()).select(key, F.col(vector).alias("embedding")).mapInArrow(run, f"`{key}` {kind}, embedding array<double>, code binary, correction double")


def _block(indexed: DataFrame, ids: list, queries: np.ndarray, k: int, key: str) -> DataFrame:
    """Each task's k best ids of each query row of one block, exact scores."""
    d = queries.shape[1]
    kind = indexed.schema[key].dataType.simpleString()
    queries = scaled(queries)
    sent = share(indexed.sparkSession, (ids, queries, planes((queries / _lengths(queries)[:, None]) @ rotation(d))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, coded = sent.value
        size = _lengths(queries)
        asking: dict = {}  # the query rows of an id
        for i, x in enumerate(ids):
            asking.setdefault(x, []).append(i)
        best: list[dict] = [{} for _ in ids]
        reach = np.full(len(ids), -np.inf)  # the k-th best so far
        arrow_kind = pa.int64()
        for batch in batches:
            arrow_kind = batch.column(0).type
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                own = part.column(0).to_pylist()
                v = scaled(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), d))
                words = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint64).reshape(len(own), -1)
                guess, error = estimates(words, part.column(3).to_numpy(), coded, d)
                error = BOUND * error + 1e-9
                once = np.fromiter({x: r for r, x in enumerate(own)}.values(), np.int64)  # a row of each id
                if len(once) > k and np.isinf(reach).any():  # start from the k-th best lower bound of different ids, the query's own aside
                    lower = (guess - error)[once]
                    for r, x in enumerate(own[i] for i in once.tolist()):
                        if x in asking:
                            lower[r, asking[x]] = -np.inf
                    first = np.partition(lower, len(once) - k, axis=0)[len(once) - k]
                    near = guess + error >= np.maximum(reach, first)
                else:
                    near = guess + error >= reach
                row, query = np.nonzero(near)
                length = _lengths(v)
                score = np.empty(len(row))
                for a in range(0, len(row), 1 << 16):
                    r, q = row[a : a + (1 << 16)], query[a : a + (1 << 16)]
                    score[a : a + (1 << 16)] = (v[r] * queries[q]).sum(axis=1) / (length[r] * size[q])
                over = score >= reach[query]
                order = np.lexsort((-score[over], query[over]))
                row, query, score = row[over][order], query[over][order], score[over][order]
                ends = np.flatnonzero(np.diff(query, append=-1)) + 1
                start = 0
                for end in ends.tolist():
                    q = int(query[start])
                    held = best[q]
                    for r, s in zip(row[start:end].tolist(), score[start:end].tolist(), strict=True):
                        x = own[r]
                        if x != ids[q] and s > held.get(x, -2.0):
                            held[x] = s
                    if len(held) >= k:
                        top = sorted(held.items(), key=lambda p: (-p[1], p[0]))[:k]
                        best[q] = dict(top)
                        reach[q] = top[-1][1]
                    start = end
        found = [(ids[q], x, s) for q, held in enumerate(best) for x, s in held.items()]
        a, b, c = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, arrow_kind), pa.array(b, arrow_kind), pa.array(c, pa.float64())], names=["query_id", key, "score"])

    merged = indexed.mapInArrow(run, f"query_id {kind}, `{key}` {kind}, score double").groupBy("query_id", key).agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key))
    found = settled(merged.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", key, "score"))
    sent.unpersist()
    return found


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = 10_000) -> DataFrame:
    """(query_id, rank, key, score): the k nearest by cosine of every id of a row that meets ``is_query``, among all rows of other ids."""
    spark = vectors.sparkSession
    asked = vectors.where(is_query & F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, F.col(vector).alias("embedding")).distinct()
    sizes = Counter({r[0]: r[1] for r in asked.groupBy(F.size("embedding")).count().collect() if r[0] > 0})
    kind = vectors.schema[key].dataType.simpleString()
    parts, indexed = [], None
    if sizes:
        d = max(sizes, key=lambda n: (sizes[n], n))
        blocks = -(-sum(sizes.values()) // block)
        indexed = settled(index(vectors, d, key, vector))
        for b in range(blocks):
            # Rows of one id are in one block.
            own = asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).toArrow() if blocks > 1 else asked.toArrow()
            rows, v = _matrix(own.column(1), d)
            if len(rows):
                parts.append(_block(indexed, own.column(0).take(pa.array(rows)).to_pylist(), v, k, key))
    if not parts:
        return spark.createDataFrame([], f"query_id {kind}, rank int, `{key}` {kind}, score double")
    forget(spark, indexed)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found
