"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus's frequent words are compiled into a shared-suffix automaton whose path gives each word its rank among the
sorted words, and so its ids. The file is memory-mapped by every worker of a machine. Words that it lacks are merged
exactly by the vocabulary's merge ranks. What a piece between spaces encodes to is remembered, within a bound.

The result is that of the tokenizers library for the given file (special tokens in a text count as such, none are added);
``BpeSpec`` reads what it needs from the file. Defined results: null encodes as the empty text, to no ids; an empty table
stays empty; repeated rows are encoded alike; other columns pass through.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import struct
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CUT, Memory, by_pieces, has_any, pieces, write_shared

#: Pieces that a worker remembers before it starts anew.
REMEMBERED = 500_000
#: A word must be found so often by a task to be proposed for the lexicon; this bears on speed, never on results.
PROPOSED = 2


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stays, the others follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merger:
    """Exact merging of one word's symbols by rank."""

    def __init__(self, vocab: dict[str, int], merges: Iterable, suffix: str) -> None:
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.final = [vocab[c + suffix] for c in alphabet]
        # pair of ids -> rank and merged id in one integer, so that the least comes first
        self.rank: dict[int, int] = {}
        for k, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault(vocab[a] << 20 | vocab[b], k << 20 | vocab[a + b])

    def ids(self, word: bytes) -> list[int]:
        inner, get = self.inner, self.rank.get
        part = [inner[b] for b in word]
        part[-1] = self.final[word[-1]]
        if len(part) > 80:
            return self._long(part)
        none = 1 << 60
        ranks = [get(a << 20 | b, none) for a, b in zip(part, part[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            new = best & 0xFFFFF
            part[i : i + 2] = (new,)
            del ranks[i]
            if i:
                ranks[i - 1] = get(part[i - 1] << 20 | new, none)
            if i < len(ranks):
                ranks[i] = get(new << 20 | part[i + 1], none)
        return part

    def _long(self, part: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        n, rank = len(part), self.rank
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j >= 0 and (r := rank.get(part[i] << 20 | part[j])):
                heapq.heappush(heap, (r, i, part[i], part[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or part[i] != a or part[j] != b:
                continue
            part[i], alive[j], after[i] = r & 0xFFFFF, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [x for x, ok in zip(part, alive, strict=True) if ok]


def compile_transducer(words: dict[bytes, list[int]]) -> bytes:
    """The file of a minimal acyclic automaton over ``words``: states' edges, words skipped by each edge, ids by rank."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append((node[0], list(node[1])))
        return register[key]

    # path: the open nodes of the word before, each [final, edges, label of the edge to the next]
    path: list[list] = [[False, [], 0]]
    before = b""
    ordered = sorted(words)
    for w in ordered:
        shared = 0
        while shared < min(len(w), len(before)) and w[shared] == before[shared]:
            shared += 1
        while len(path) > shared + 1:
            child = settle(path.pop())
            path[-1][1].append((path[-1][2], child))
        for b in w[shared:]:
            path[-1][2] = b
            path.append([False, [], 0])
        path[-1][0] = True
        before = w
    while len(path) > 1:
        child = settle(path.pop())
        path[-1][1].append((path[-1][2], child))
    root = settle(path[0])

    reach = [0] * len(states)
    for s, (final, edges) in enumerate(states):  # children come first
        reach[s] = final + sum(reach[t] for _, t in edges)
    first, labels, target, skip, final_of = [0], bytearray(), [], [], bytearray()
    for final, edges in states:
        passed = int(final)
        for label, t in edges:
            labels.append(label)
            target.append(t)
            skip.append(passed)
            passed += reach[t]
        first.append(len(labels))
        final_of.append(final)
    ids, at = [], [0]
    for w in ordered:
        ids += words[w]
        at.append(len(ids))
    blocks = [np.array(x, np.uint32).tobytes() for x in (first, target, skip, at, ids)]
    head = struct.pack("<8I", root, len(states), len(labels), len(first), len(target), len(skip), len(at), len(ids))
    return head + b"".join(blocks) + bytes(labels) + bytes(final_of)


class Transducer:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, n_states, n_labels, *sizes = struct.unpack_from("<8I", self.map)
        view, at, parts = memoryview(self.map), 32, []
        for n in sizes:
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.target, self.skip, self.at, self.out = parts
        self.labels_at, self.final_at = at, at + n_labels
        self.out_bytes = self.out.cast("B")

    def ids(self, word: bytes) -> bytes | None:
        """The word's ids as 32-bit integers, or None if the lexicon lacks it."""
        state, rank, base, find = self.root, 0, self.labels_at, self.map.find
        first, skip, target, one = self.first, self.skip, self.target, _ONE
        for b in word:
            edge = find(one[b], base + first[state], base + first[state + 1]) - base
            if edge < 0:
                return None
            rank += skip[edge]
            state = target[edge]
        return bytes(self.out_bytes[4 * self.at[rank] : 4 * self.at[rank + 1]]) if self.map[self.final_at + state] else None


_ONE = [bytes([b]) for b in range(256)]


class BpeSpec:
    """What a byte-level word-end BPE file of the tokenizers library asks for: NFC, spaces folded, lower case, words by pattern."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        model = raw["model"]
        self.pattern = regex.compile(raw["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in raw["added_tokens"]}
        self.merger = Merger(self.vocab, model["merges"], model["end_of_word_suffix"] or "")

    def words(self, run: str) -> list[str]:
        """The words of a piece of text; white space within it parts words and is dropped."""
        if run.isascii():
            run = run.lower()
            return [run] if run.isalpha() else self.pattern.findall(run)
        return self.pattern.findall("".join(map(str.lower, unicodedata.normalize("NFC", run))))


class Encoder:
    """One worker's encoder: lexicon first, exact merging for the rest, and a bounded memory of runs and words."""

    def __init__(self, spec: BpeSpec, lexicon: Transducer | None) -> None:
        self.spec, self.lexicon = spec, lexicon
        self.runs = Memory(self._run, REMEMBERED)
        self.merged = self.looked_up = 0

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        ids = self.lexicon.ids(raw) if self.lexicon else None
        if ids is None:
            self.merged += 1
            return array("i", self.spec.merger.ids(raw)).tobytes()
        self.looked_up += 1
        return ids

    def _run(self, run: str) -> bytes:
        words = self.spec.words(run)
        return b"".join(map(self._word, words))

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.runs.__getitem__, text.split(" ")))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers."""
        text = text or ""
        if any(s in text for s in self.spec.special):
            parts = re.split("(" + "|".join(map(re.escape, self.spec.special)) + ")", text)
            return b"".join(np.array([self.spec.special[p]], np.int32).tobytes() if p in self.spec.special else self._plain(p) for p in parts)
        return self._plain(text)

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, where each text's begin and end): each different piece between spaces is looked up once."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if has_any(texts, [*self.spec.special, CUT]).any():
            coded = [self.encode(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(coded), np.int32), np.cumsum([0, *(len(c) // 4 for c in coded)])
        ids, ends, _, last = by_pieces(cut(texts), self.runs, np.int32)
        return ids, np.concatenate([[0], ends[last - 1]]) if len(last) else np.zeros(1, np.int64)


def cut(texts: pa.Array) -> pa.Array:
    """Cuts at spaces and line ends, and between a letter and what is neither letter nor mark: words part there in any case."""
    return pc.replace_substring_regex(pc.replace_substring_regex(texts, r"(\p{L})([^\p{L}\p{M} \n])", f"\\1{CUT}\\2"), "[ \n]", CUT)


def token_texts(path: str) -> list[str]:
    """Each id's token."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    names = raw["model"]["vocab"] | {x["content"]: x["id"] for x in raw["added_tokens"]}
    out = [""] * (max(names.values()) + 1)
    for k, v in names.items():
        out[v] = k
    return out


_TOKENS: dict[str, list[str]] = {}
_SPECS: dict[str, BpeSpec] = {}
_ENCODERS: dict[tuple[str, str | None], Encoder] = {}


def spec_of(path: str) -> BpeSpec:
    if path not in _SPECS:
        _SPECS[path] = BpeSpec(path)
    return _SPECS[path]


def tokens_of(path: str) -> list[str]:
    if path not in _TOKENS:
        _TOKENS[path] = token_texts(path)
    return _TOKENS[path]


def _encoder(path: str, lexicon: str | None) -> Encoder:
    if (path, lexicon) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, lexicon] = Encoder(spec_of(path), Transducer(SparkFiles.get(lexicon)) if lexicon else None)
    return _ENCODERS[path, lexicon]


def frequent_words(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word binary, n long): how often each word occurs. Runs that a task has met less than ``PROPOSED`` times when it hands on its counts
    are left out: this only decides which words the lexicon holds, so it bears on speed alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, runs = spec_of(path), Counter()

        def emit() -> pa.RecordBatch:
            words: Counter[bytes] = Counter()
            for r, n in runs.items():
                if n >= PROPOSED:
                    for w in spec.words(r):
                        words[w.encode()] += n
            runs.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for batch in pieces(batches, 2000):
            found = pc.value_counts(pc.split_pattern(cut(batch.column(0).cast(pa.large_string()).fill_null("")), CUT).flatten())
            for r, n in zip(found.field("values").to_numpy(zero_copy_only=False).tolist(), found.field("counts").to_numpy(zero_copy_only=False).tolist(), strict=True):
                runs[r] += n
            if len(runs) > REMEMBERED:
                yield emit()
        yield emit()

    return docs.select(F.col(text)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, size: int = 200_000, text: str = "text") -> str:
    """Compile the ``size`` most frequent words, ship the file to every machine, and return its name there."""
    spec = spec_of(path)
    top = frequent_words(docs, path, text).orderBy(F.desc("n"), "word").limit(size)
    words = {bytes(r.word): spec.merger.ids(bytes(r.word)) for r in top.select("word").toLocalIterator()}
    at = write_shared(docs.sparkSession, "lexicon", compile_transducer(words))
    docs.sparkSession.sparkContext.addFile(at)
    return at.rpartition("/")[2]


def decoded(token: list[str], ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """The texts of id lists that lie one behind the other: tokens joined by a space, as a file without decoder asks for."""
    return [" ".join(map(token.__getitem__, ids[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode(docs: DataFrame, path: str, lexicon: str | None = None, text: str = "text", and_decode: bool = False) -> DataFrame:
    """All columns of ``docs`` plus ids (array of int) and n_tokens; and_decode: also decoded, from the ids, as by ``decode``
    but in the same worker. Columns of these names are replaced."""
    docs = docs.drop("ids", "n_tokens", *["decoded"] * and_decode)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path, lexicon)
        for batch in pieces(batches, 1000):
            flat, ends = own.encode_many(batch.column(at))
            ends = ends.astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            texts = [pa.array(decoded(tokens_of(path), flat, ends), pa.string())] if and_decode else []
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(np.diff(ends).astype(np.int64)), *texts], names=[*batch.schema.names, "ids", "n_tokens", *["decoded"] * and_decode])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, ids array<int>, n_tokens long" + ", decoded string" * and_decode)


def decode(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns of ``coded`` plus decoded, the text of its ids. A column of this name is replaced."""
    coded = coded.drop("decoded")
    at = coded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = tokens_of(path)
        for batch in pieces(batches):
            column = batch.column(at)
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded(token, values, ends), pa.string())], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(run, f"{schema}, decoded string")
