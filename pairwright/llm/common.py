"""What the operators of this subpackage share: table access, shared folders and hashing of keys."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: \x20 and \x09-\x0D, which is what ``bytes.split()`` splits at.
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, one of our own, if all tasks run on this machine."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that the driver and all executors share")
        path = f"{tempfile.gettempdir()}/checkpoints"
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Has Spark delete a query's shuffle files when the query ends. Otherwise they stay until the driver collects garbage, which it does by its own needs, not by the disk's.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: lineage ends there, every reader sees one result, and the shuffle files on the way to it go."""
    spark = df.sparkSession
    path, was = fresh_path(spark, "settled"), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that ``settled`` wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(at)
        if path.getName().startswith("settled-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_shared(spark: SparkSession, what: str, data: bytes) -> str:
    """Write a file of the driver's to the shared folder; its path."""
    at = fresh_path(spark, what)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    return at


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        own = f"_{name}"
        while own.lower() in taken:
            own = f"_{own}"
        taken.add(own.lower())
        out.append(own)
    return out


def crc_of_id(name: str = "doc_id") -> Column:
    """crc32 of the id as text; what the contracts split documents by."""
    return F.crc32(F.col(name).cast("string").cast("binary"))


def crc_of(value: object) -> int:
    return zlib.crc32(str(value).encode())


def in_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time, so that a worker holds little at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def share(spark: SparkSession, value: object):  # noqa: ANN201
    return spark.sparkContext.broadcast(value)


class Memory(dict):
    """Values worked out once for each key and remembered within a bound: at ``limit`` keys the older half goes."""

    def __init__(self, work_out: Callable, limit: int) -> None:
        super().__init__()
        self.work_out, self.limit = work_out, limit

    def __missing__(self, key):  # noqa: ANN001, ANN204
        value = self.work_out(key)
        if len(self) >= self.limit:
            for k in list(islice(self, self.limit // 2)):
                del self[k]
        self[key] = value
        return value


#: Parts pieces of a text; a text that holds it goes another way.
CUT = "\x01"


def by_pieces(texts: pa.Array, codes: dict, kind: type) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray, np.ndarray]:
    """Texts cut at ``CUT``, each different piece coded once: (ids of all pieces one behind the other, where each piece's ids end, the
    pieces, where each text's pieces end)."""
    lists = pc.split_pattern(texts, CUT)
    coded = lists.flatten().dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    found = list(map(codes.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
    size = np.fromiter(map(len, found), np.int32, len(found)) // np.dtype(kind).itemsize
    starts = np.cumsum(size, dtype=np.int32) - size
    held = np.frombuffer(b"".join(found), kind)
    n = size[which]
    ends = np.cumsum(n, dtype=np.int32)
    at = np.repeat(starts[which] - (ends - n), n)
    at += np.arange(len(at), dtype=np.int32)
    return held[at], ends, coded, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)


def has_any(texts: pa.Array, parts: list[str]) -> np.ndarray:
    found = np.zeros(len(texts), bool)
    for s in parts:
        found |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    return found
