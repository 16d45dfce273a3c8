"""Token ids in a content-addressed store.

Writing. Each text's ids (with an end id) are cut into chunks where a rolling hash of the last 16 ids meets a mask, so
equal passages give equal chunks wherever they stand. A chunk's name is the SHA-256 of its bytes; it is stored once.
A document's recipe lists its chunks, and the Merkle root over them; recipes lie in shards in ascending order of id, and a
manifest gives each shard's place in the whole id stream and the Merkle root over its recipes.

    <path>/chunks/alone, <path>/chunks/several
                      chunk binary (its name), payload binary (ids as little-endian unsigned 16- or 32-bit integers, compressed
                      by zstd), row long and seq int (the place of a chunk that stands alone, one of the places of another)
    <path>/recipes    shard int, pos long, row long, doc_id, start_in_shard long, n_tokens long, chunks array<binary>, root binary
    <path>/manifest   shard int, start long, n_docs long, n_tokens long, first_doc, last_doc, root binary

Only payloads of chunks that stand in several places are shuffled to be stored once, and only they are joined by name on reading;
all others go straight to the store, and from it to their document.

Reading verifies every chunk's name, every recipe's root and every shard's root; what does not verify raises an error.

Texts are encoded by the tokenizers library's model, word by word of its byte-level pre-tokenizer. Texts are first cut where that always parts
words; what a piece encodes to is remembered, within a bound. Texts with several spaces in a row, or with special tokens, go through the
library whole.

Defined results: null is the empty text, whose ids are the end id alone; repeated rows each have a recipe (rows of one id
in the order of their chunks' names); an empty table gives an empty store that can be read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_transducer import byte_alphabet
from .common import CUT, Memory, by_pieces, forget, has_any, settled

#: Runs that a worker remembers before it starts anew.
REMEMBERED = 420_000
#: Fixed value: the words of the byte-level pre-tokenizer.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A space before white space or the end: then the space does not belong to the next word.
_ODD = r"^ ($|[\s\p{Z}\x0b\x1c-\x1f\x{85}])"
#: Names of shared chunks that are broadcast at most (32 bytes each); beyond it they are joined.
MOST_SHARED = 1_000_000
#: Documents of a shard, about.
SHARD_DOCS = 50_000
#: Chunks: the least and most ids of one, and the mask that makes cuts about 512 ids apart.
LEAST, MOST, MASK, WINDOW = 64, 4096, 511, 16


class LibraryEncoder:
    """The tokenizers library's ids for a byte-level file, each distinct run of a text encoded once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f)["added_tokens"]]
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() < 1 << 16 else np.uint32
        self.code = "H" if self.kind is np.uint16 else "I"
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.mark = self.alphabet[32]
        self.runs = Memory(self._run, REMEMBERED)

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            word = self.mark + word[1:] if word[0] == " " else word
        else:
            word = word.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def _run(self, run: str) -> bytes:
        if (run[1:] if run[:1] == " " else run).isalpha():
            return self._word(run)
        return b"".join(map(self._word, PATTERN.findall(run)))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = has_any(texts, [*self.special, CUT])
        ids, ends, pieces, last = by_pieces(cut(texts), self.runs, self.kind)
        if not len(last):
            return []
        odd = pc.match_substring_regex(pieces.dictionary, _ODD).to_numpy(zero_copy_only=False)
        if odd.any():
            whole |= np.logical_or.reduceat(odd[pieces.indices.to_numpy(zero_copy_only=False)], np.concatenate([[0], last[:-1]]))
        raw, size, stop = ids.tobytes(), self.kind().itemsize, ends[last - 1].tolist()
        return [self._whole(texts[k].as_py()) if c else raw[a * size : b * size] for k, (a, b, c) in enumerate(zip([0, *stop[:-1]], stop, whole.tolist(), strict=True))]


def cut(texts: pa.Array) -> pa.Array:
    """Cuts before spaces, around a line end that stands between others and a letter, and between a letter and anything but a letter or space. The
    pre-tokenizer parts words there in any case, but for spaces that white space follows: such texts are told by their pieces."""
    lines = pc.replace_substring_regex(texts, r"(\S)\n(\p{L})", f"\\1{CUT}\n{CUT}\\2")
    return pc.replace_substring(pc.replace_substring_regex(lines, rf"(\p{{L}})([^\p{{L}} {CUT}])", f"\\1{CUT}\\2"), " ", f"{CUT} ")


_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def _table() -> np.ndarray:
    """A 64-bit value for each 16-bit remainder of an id."""
    x = np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_TABLE, _FACTOR = _table(), 0x9E6C63D0876A9A35


def marks(ids: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash asks for a cut, in one or several id streams that lie one behind the other (a window that
    reaches into the stream before ends within a chunk's least length, where nothing is cut)."""
    s, width = _TABLE[ids & 0xFFFF], 1
    while width < WINDOW:  # s: hash of the last ``width`` ids
        factor = np.uint64(pow(_FACTOR, width, 1 << 64))
        s[width:] += s[:-width].copy() * factor
        width *= 2
    return np.flatnonzero((s >> np.uint64(40)) & np.uint64(MASK) == 0) + 1


def cuts(n: int, wanted: list[int]) -> list[int]:
    """Ends of the chunks of one stream of n ids, given the places where the hash asks for a cut."""
    ends, last = [], 0
    for e in wanted:
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST:
            ends.append(e)
            last = e
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return ends if last == n else [*ends, n]


def merkle_root(leaves: list[bytes]) -> bytes:
    """SHA-256 tree; an odd node moves up as it is; no leaves: the hash of nothing."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _encode_rows(path: str, end_id: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = library_encoder(path), TaskContext.get().partitionId() << 40
        end, size = np.array([end_id], encoder.kind).tobytes(), encoder.kind().itemsize
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n_tokens, names, payloads = [], [], []
                coded = [c + end for c in encoder.encode(part.column(1))]
                ends = np.cumsum([0, *(len(c) // size for c in coded)])
                wanted = marks(np.frombuffer(b"".join(coded), encoder.kind)) if coded else np.zeros(0, np.int64)
                at = np.searchsorted(wanted, ends, "right").tolist()
                for k, raw in enumerate(coded):
                    own, a = [], 0
                    for b in cuts(len(raw) // size, (wanted[at[k] : at[k + 1]] - ends[k]).tolist()):
                        own.append(raw[a * size : b * size])
                        a = b
                    n_tokens.append(len(raw) // size)
                    names.append([hashlib.sha256(x).digest() for x in own])
                    payloads.append(list(map(compress, own)))
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + rows), pa.int64()), part.column(0), pa.array(n_tokens, pa.int64()), pa.array(names, pa.list_(pa.binary())), pa.array(payloads, pa.list_(pa.binary()))], names=["row", "doc_id", "n_tokens", "chunks", "payloads"])
                row += rows

    return run


def _by_sharing(coded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks of one place, chunks of several, each with one of its places)."""
    places = coded.select("row", F.posexplode("chunks").alias("seq", "chunk"))
    several = settled(places.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1").select("chunk"))
    each = coded.select("row", F.posexplode(F.arrays_zip("chunks", "payloads")).alias("seq", "c")).select("row", "seq", F.col("c.chunks").alias("chunk"), F.col("c.payloads").alias("payload"))
    few = F.broadcast(several) if several.count() <= MOST_SHARED else several
    return each.join(few, "chunk", "left_anti"), each.join(few, "chunk", "left_semi")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id") -> None:
    """Encode every text of ``docs`` and write the store."""
    kind = docs.schema[key].dataType.simpleString()
    coded = settled(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encode_rows(tokenizer, end_id), f"row long, doc_id {kind}, n_tokens long, chunks array<binary>, payloads array<binary>"))
    alone, several = _by_sharing(coded)
    alone.select("row", "seq", "chunk", "payload").write.parquet(f"{path}/chunks/alone")
    several.groupBy("chunk").agg(F.first("row").alias("row"), F.first("seq").alias("seq"), F.first("payload").alias("payload")).select("row", "seq", "chunk", "payload").write.parquet(f"{path}/chunks/several")

    shards = max(1, -(-coded.count() // SHARD_DOCS))
    ordered = coded.select("doc_id", "n_tokens", "chunks", "row").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "chunks", "row")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, pos = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            starts = start + np.cumsum(n) - n
            roots = [merkle_root(x) for x in batch.column(2).to_pylist()]
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * rows, pa.int32()), pa.array(np.arange(pos, pos + rows)), batch.column(3), batch.column(0), pa.array(starts), batch.column(1), batch.column(2), pa.array(roots, pa.binary())],
                names=["shard", "pos", "row", "doc_id", "start_in_shard", "n_tokens", "chunks", "root"],
            )
            start, pos = start + int(n.sum()), pos + rows

    schema = f"shard int, pos long, row long, doc_id {kind}, start_in_shard long, n_tokens long, chunks array<binary>, root binary"
    ordered.mapInArrow(number, schema).write.parquet(f"{path}/recipes")
    forget(docs.sparkSession, coded)
    _write_manifest(docs.sparkSession, path, schema)


def _shard_roots(recipes: DataFrame) -> DataFrame:
    def tree(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        return pa.table({"shard": table.column("shard")[:1], "found": pa.array([merkle_root(table.column("root").to_pylist())], pa.binary())})

    return recipes.select("shard", "pos", "root").groupBy("shard").applyInArrow(tree, "shard int, found binary")


def _write_manifest(spark: SparkSession, path: str, schema: str) -> None:
    """One row a shard, of ``SHARD_DOCS`` documents about; starts follow from the shards' sizes."""
    recipes = spark.read.schema(schema).parquet(f"{path}/recipes")
    sizes = recipes.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    rows, start, starts = sizes.select("shard", "n_tokens").orderBy("shard").collect(), 0, []
    for r in rows:
        starts.append((r.shard, start))
        start += r.n_tokens
    placed = spark.createDataFrame(starts, "shard int, start long")
    manifest = sizes.join(placed, "shard").join(_shard_roots(recipes).withColumnRenamed("found", "root"), "shard")
    manifest.select("shard", "start", "n_docs", "n_tokens", "first_doc", "last_doc", "root").write.parquet(f"{path}/manifest")


def read_store(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_le): each document's ids as little-endian unsigned 32-bit integers, verified.

    wide: the payloads hold 32-bit ids rather than 16-bit ones.
    """
    recipes, manifest, alone, several = (spark.read.parquet(f"{path}/{x}") for x in ("recipes", "manifest", "chunks/alone", "chunks/several"))
    stored = np.uint32 if wide else np.uint16

    checked = manifest.join(_shard_roots(recipes), "shard", "left")
    broken = checked.where(~F.col("root").eqNullSafe(F.col("found"))).limit(1).count()
    if broken:
        raise ValueError(f"{path}: a shard's recipes do not match the manifest")

    referred = recipes.select("row", F.posexplode("chunks").alias("seq", "chunk")).join(several.select("chunk", "payload"), "chunk").select("row", "seq", "chunk", "payload")
    gathered = alone.unionByName(referred).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("seq", "chunk", "payload"))).alias("parts"))
    kind = recipes.schema["doc_id"].dataType.simpleString()
    heads = recipes.select("shard", "row", "doc_id", "start_in_shard", "n_tokens", "root").join(manifest.select("shard", "start"), "shard")
    whole = heads.join(gathered, "row", "left").select("doc_id", (F.col("start") + F.col("start_in_shard")).alias("start"), "n_tokens", "root", "parts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
            out, parts = [], batch.column(4)
            held = parts.flatten()
            names, payloads = held.field("chunk").to_pylist(), list(map(expand, held.field("payload").to_pylist()))
            ends = np.cumsum([0, *pc.list_value_length(parts).fill_null(0).to_pylist()]).tolist()
            for doc_id, n, root, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), ends[:-1], ends[1:], strict=True):
                own, raw = names[a:b], b"".join(payloads[a:b])
                if [hashlib.sha256(x).digest() for x in payloads[a:b]] != own or merkle_root(own) != root or len(raw) != n * stored().itemsize:
                    raise ValueError(f"document {doc_id} does not verify")
                out.append(np.frombuffer(raw, stored).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_le"])

    return whole.mapInArrow(verify, f"doc_id {kind}, start long, n_tokens long, ids_le binary")
