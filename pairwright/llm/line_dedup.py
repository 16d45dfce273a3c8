"""Line dedup: lines found in many documents lose all their copies.

Plan: explode each text into normalised lines, hash them to 128 bits, count the documents of each hash (first
within a partition, then across), keep the hashes over the threshold, and rebuild each text by line position without
them. The hashes over the threshold are few; they are broadcast while there are at most ``broadcast_keys`` of them, sorted, 16 bytes each.
Beyond that the lines are joined to them by a shuffle and only positions come back to the text. There the lines of a hash that holds more than a ``HOT``-th of all counted lines (fewer than
``HOT`` hashes) are told by a broadcast of these hashes alone, so no other has more than that share in a task; copies of a text are dealt to several tasks likewise.

Defined results: a null or empty text is one empty line; every row is a document, so a repeated row counts again;
an empty table gives an empty table; texts and lines are taken whole, however long; other columns pass through untouched, but for kept_text, n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free_names, pieces, settled, share

#: Distinct hashes that a task gathers before it hands their counts on.
FLUSH = 1_000_000
#: Hashes of a larger share than one in so many are never shuffled by line; tasks that copies of one text are dealt to.
HOT, SALTS = 1_000, 64


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def _chars(key: bytes) -> int:
    return sum((b & 0xC0) != 0x80 for b in key)


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _keys(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """For each line its key's hash, or None if the key is too short to count."""
    out: list[bytes | None] = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(SPACE).lower()
        out.append(_hash(key) if len(key) >= min_chars and (min_chars <= 1 or _chars(key) >= min_chars) else None)
    return out


def _counts(min_chars: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["key", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update({k for k in _keys(text, min_chars) if k is not None})
                if len(seen) >= FLUSH:
                    yield emit()
        yield emit()

    return run


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text") -> DataFrame:
    """The hashes (key binary, n long) of the lines found in at least ``min_docs`` documents."""
    counts = docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(_counts(min_chars), "key binary, n long")
    return counts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)


def _rebuild(batch: pa.RecordBatch, column: str, dropped) -> pa.RecordBatch:  # noqa: ANN001
    """The batch with the kept text and the two counts; dropped(text, row) tells which lines go."""
    at = batch.schema.get_field_index(column)
    kept, n_lines, n_dropped = [], [], []
    for row, text in enumerate(batch.column(at).to_pylist()):
        raw = (text or "").encode()
        gone = dropped(raw, row)
        lines = raw.split(b"\n")
        n_lines.append(len(lines))
        n_dropped.append(len(gone))
        kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode() if gone else text or "")
    arrays, names = list(batch.columns), list(batch.schema.names)
    arrays += [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=[*names, "kept_text", "n_lines", "n_dropped"])


class Keys:
    """Hashes of 16 bytes in two sorted arrays; a lookup takes a list of them at once."""

    def __init__(self, keys: list[bytes]) -> None:
        halves = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2)
        halves = halves[np.lexsort((halves[:, 1], halves[:, 0]))]
        self.high, self.low = (np.ascontiguousarray(halves[:, i]).astype(np.uint64) for i in (0, 1))
        # How many hashes have the same first half, at most: nearly always one.
        self.most = int(np.unique(self.high, return_counts=True)[1].max(initial=0))

    def has(self, keys: list[bytes]) -> np.ndarray:
        if not keys or not self.most:
            return np.zeros(len(keys), bool)
        high, low = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype(np.uint64).T
        at, found = np.searchsorted(self.high, high), np.zeros(len(keys), bool)
        for step in range(self.most):
            i = np.minimum(at + step, len(self.high) - 1)
            found |= (self.high[i] == high) & (self.low[i] == low)
        return found


def _found(keys: Keys, lines: list[list[bytes | None]]) -> list[set[int]]:
    """For each text the places of its lines whose hash is among ``keys``."""
    flat = [(r, i, k) for r, own in enumerate(lines) for i, k in enumerate(own) if k is not None]
    out: list[set[int]] = [set() for _ in lines]
    for j in np.flatnonzero(keys.has([k for _, _, k in flat])).tolist():
        out[flat[j][0]].add(flat[j][1])
    return out


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", broadcast_keys: int = 2_000_000) -> DataFrame:
    """All columns of ``docs`` plus kept_text, n_lines (before) and n_dropped. Columns of these names are replaced."""
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "kept_text string, n_lines long, n_dropped long"])
    frequent = settled(frequent_lines(docs, min_docs, min_chars, text))
    if frequent.count() > broadcast_keys:
        return _by_shuffle(docs, frequent, min_chars, text, schema)
    hot = _shared_keys(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = hot.value
        for batch in pieces(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            gone = _found(keys, [_keys((t or "").encode(), min_chars) for t in texts]) if keys.most else [set()] * len(texts)
            yield _rebuild(batch, text, lambda _, row, g=gone: g[row])

    return docs.mapInArrow(run, schema)


def _shared_keys(keys: DataFrame):  # noqa: ANN202
    return share(keys.sparkSession, Keys([bytes(r.key) for r in keys.select("key").toLocalIterator()]))


def _by_shuffle(docs: DataFrame, frequent: DataFrame, min_chars: int, text: str, schema: str) -> DataFrame:
    """The way beyond the broadcast: a join of lines to frequent hashes; positions return to the text's hash."""
    total = frequent.agg(F.sum("n")).first()[0] or 0
    largest = F.col("n") * HOT > total
    told = _shared_keys(frequent.where(largest))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = told.value
        for batch in pieces(batches):
            texts = batch.column(0).to_pylist()
            own = [_hash(t or b"") for t in texts]
            each = [_keys(t, min_chars) for t in texts]
            hot = _found(keys, each)
            rows = [(own[r], i, k, i in hot[r]) for r, ks in enumerate(each) for i, k in enumerate(ks) if k is not None]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], names=["own", "pos", "key", "told"])

    texts = docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(lines, "own binary, pos int, key binary, told boolean").distinct()
    met = texts.where("told").select("own", "pos").unionByName(texts.where("not told").join(frequent.where(~largest).select("key"), "key", "left_semi").select("own", "pos"))
    c_own, c_gone, c_salt = free_names(docs, "own", "gone", "salt")
    gone = met.groupBy("own").agg(F.collect_set("pos").alias(c_gone))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            own = [_hash((t or "").encode()) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.binary())], names=[*batch.schema.names, c_own])

    # Copies of one text are dealt to all salts.
    own_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{c_own}` binary"])
    dealt = docs.mapInArrow(named, own_schema).withColumn(c_salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    gone = gone.select(F.col("own").alias(c_own), c_gone, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(c_salt))
    marked = dealt.join(gone, [c_own, c_salt], "left").drop(c_own, c_salt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone_here = batch.column(batch.schema.get_field_index(c_gone)).to_pylist()
            yield _rebuild(batch.drop_columns([c_gone]), text, lambda _, row, g=gone_here: set(g[row] or ()))

    return marked.mapInArrow(run, schema)
