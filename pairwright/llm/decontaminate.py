"""Benchmark decontamination: one automaton over all windows of the benchmark's words, each text scanned once.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. A window is ``width`` consecutive words of an
item; an item of fewer words, but not none, is one window. Windows are joined and bounded by single spaces and go into an
Aho-Corasick automaton, which finds every occurrence in a text normalised likewise; each hit is mapped back to words, and
to character offsets of the original text.

The benchmark is broadcast as text and compiled once a worker. An automaton takes at most about ``slice_chars`` characters of
windows, so memory is bounded: a larger benchmark, or item, is cut into slices of windows, every text is scanned once for each slice, and
the slices' hit words and items are merged by document. At most about ``broadcast_chars`` are broadcast at once; beyond, the documents are stored
with their hits so far and go through another pass.

Defined results: null or wordless texts have no words and no hits; wordless items have no window; items of the same text all
count; rows without an item id are no items; repeated rows are each scanned; an empty benchmark hits nothing; other columns pass through, but for
n_words, n_hit, item_ids and spans, which are replaced; texts are scanned whole, however long.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, free_names, pieces, settled, share

#: Bytes that words are made of map to themselves (A-Z to lower case), all others to a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def windows(words: list[bytes], width: int) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


class Scanner:
    """The automaton of one slice: each window's items and its number of words."""

    def __init__(self, items: list[tuple[str, str]], width: int) -> None:
        import ahocorasick

        owners: dict[bytes, set[str]] = defaultdict(set)
        for item_id, text in items:
            for w in windows(words_of(text), width):
                owners[w].add(item_id)
        self.machine = None
        if owners:
            self.machine = ahocorasick.Automaton()
            for w, ids in owners.items():
                self.machine.add_word(f" {w.decode()} ", (w.count(b" ") + 1, tuple(sorted(ids))))
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]] | None:
        """Which words are hit, and the items found; None if nothing is."""
        if self.machine is None or not words:
            return None
        flat = f" {b' '.join(words).decode()} "
        found = list(self.machine.iter(flat))
        if not found:
            return None
        starts = np.cumsum([0, *(len(w.decode()) + 1 for w in words)])
        mark, items = np.zeros(len(words) + 1, np.int64), set()
        for end, (n, ids) in found:
            last = int(np.searchsorted(starts, end, "left"))
            mark[last - n] += 1
            mark[last] -= 1
            items.update(ids)
        return np.cumsum(mark[:-1]) > 0, items


def slices(benchmark: Iterable[tuple[str, str]], width: int, slice_chars: int) -> Iterator[list[tuple[str, str]]]:
    """Items in slices of at most about ``slice_chars`` characters of windows. The windows of a longer item are parted: its pieces
    overlap by all but one word of a window."""
    out: list[tuple[str, str]] = []
    size, most = 0, max(1, slice_chars // width)
    for item_id, text in benchmark:
        words, at = words_of(text), 0
        while at == 0 or at + width - 1 < len(words):
            end, chars = at, 0
            while end < len(words) and (chars <= most or end - at < width):
                chars += len(words[end]) + 1
                end += 1
            if out and size + chars > most:
                yield out
                out, size = [], 0
            out.append((item_id, b" ".join(words[at:end]).decode()))
            size += chars
            if end >= len(words):
                break
            at = end - width + 1
    yield out


def original_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character spans of the original text, one for each run of hit words."""
    spans: list[tuple[int, int]] = []
    before = False
    for m, is_hit in zip(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text), hit, strict=True):
        if is_hit and before:
            spans[-1] = (spans[-1][0], m.end())
        elif is_hit:
            spans.append(m.span())
        before = bool(is_hit)
    return spans


def ranges(hit: np.ndarray) -> list[int]:
    """Begins and ends of the runs of hit words, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).tolist()


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", slice_chars: int = 8_000_000, broadcast_chars: int = 64_000_000) -> DataFrame:
    """All columns of ``docs`` plus n_words, n_hit, item_ids (sorted array) and spans (offsets of hit runs in the text)."""
    docs = docs.drop("n_words", "n_hit", "item_ids", "spans")
    own_names = free_names(docs, "ranges", "items")
    spark = docs.sparkSession
    own = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null and i is not null").orderBy("i", "t")
    parts = slices(((r.i, r.t) for r in own.toLocalIterator()), width, slice_chars)
    held: list[list[tuple[str, str]]] = []
    size, before = 0, None
    for part in parts:
        chars = sum(len(t) for _, t in part)
        if held and size + chars > broadcast_chars:
            marked = settled(_scanned(docs, held, width, text, own_names, last=False))
            if before is not None:
                forget(spark, before)
            docs = before = marked
            held, size = [], 0
        held.append(part)
        size += chars
    return _scanned(docs, held, width, text, own_names, last=True)


def _scanned(docs: DataFrame, slices_: list[list[tuple[str, str]]], width: int, text: str, own_names: list[str], last: bool) -> DataFrame:
    """``docs`` with the slices' hits added to those of former passes (ranges of words, items, under names of our own), or after the last pass the result."""
    at, names, (c_ranges, c_items) = docs.columns.index(text), docs.columns, own_names
    rest = [i for i, c in enumerate(names) if c not in own_names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in own_names)
    found_type = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>" if last else f"`{c_ranges}` array<int>, `{c_items}` array<string>"
    kept = share(docs.sparkSession, slices_)
    name = f"scanner-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_slices = len(kept.value)
        for batch in pieces(batches, 500 if n_slices == 1 else 10_000):
            texts = batch.column(at).to_pylist()
            many = [words_of(t) for t in texts]
            hits: list[np.ndarray | None] = [None] * len(many)
            items: list[set[str]] = [set() for _ in many]
            if c_ranges in names:
                items = [set(x) for x in batch.column(names.index(c_items)).to_pylist()]
                for row, r in enumerate(batch.column(names.index(c_ranges)).to_pylist()):
                    if r:
                        hits[row] = np.zeros(len(many[row]), bool)
                        for a, b in zip(r[::2], r[1::2], strict=True):
                            hits[row][a:b] = True
            for k in range(n_slices):
                scanner = _scanner(f"{name}-{k}", kept.value[k], width)
                for row, words in enumerate(many):
                    if got := scanner.scan(words):
                        hits[row] = got[0] if hits[row] is None else hits[row] | got[0]
                        items[row] |= got[1]
            columns, item_lists = [batch.column(i) for i in rest], pa.array([sorted(x) for x in items], pa.list_(pa.string()))
            if last:
                spans = [[{"start": a, "end": b} for a, b in original_spans(t, h)] if h is not None else [] for t, h in zip(texts, hits, strict=True)]
                n_hit = [0 if h is None else int(h.sum()) for h in hits]
                columns += [pa.array([len(w) for w in many], pa.int64()), pa.array(n_hit, pa.int64()), item_lists, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            else:
                columns += [pa.array([[] if h is None else ranges(h) for h in hits], pa.list_(pa.int32())), item_lists]
            yield pa.RecordBatch.from_arrays(columns, names=[*(names[i] for i in rest), *(["n_words", "n_hit", "item_ids", "spans"] if last else own_names)])

    return docs.mapInArrow(run, f"{schema}, {found_type}")


_SCANNERS: dict[str, Scanner] = {}


def _scanner(name: str, items: list[tuple[str, str]], width: int) -> Scanner:
    """A worker keeps one automaton at a time."""
    if name not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[name] = Scanner(items, width)
    return _SCANNERS[name]
