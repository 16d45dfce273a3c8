"""Folders of files as a table: a reader that plans its partitions by folder, a content-addressed sink, and files found by stem.

``read_tree`` lists only folders on the driver (to a depth); tasks list and read the files of theirs. Folders that a filter on ``top`` or on the start of ``path``
rules out are not listed, files that a filter on ``suffix`` or ``path`` rules out are not opened, and contents are read only if the schema asks for them.
Paths may be plain, or of any scheme that pyarrow's file systems know.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

LISTING = "path string, top string, folder string, name string, suffix string, size long"
WITH_CONTENT = LISTING + ", content binary"
#: Bytes of contents in a batch before it is handed on.
BATCH_BYTES = 8 << 20


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), posixpath.abspath(path))


@dataclass
class Folders(InputPartition):
    """Folders relative to the root, each with whether its folders belong to it too."""

    folders: list[tuple[str, bool]]


class TreeReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.fields, self.root = schema.fieldNames(), options["path"]
        self.depth, self.most = int(options.get("depth", 2)), int(options.get("partitions", 64))
        self.equal: dict[str, set[str]] = {}
        self.starts = ""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes equalities of top and suffix and one start of path; all others are left to Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in ("top", "suffix") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[name] = self.equal[name] & values if name in self.equal else values
            elif name == "path" and isinstance(f, StringStartsWith) and not self.starts:
                self.starts = f.value
            else:
                yield f

    def _wanted(self, folder: str) -> bool:
        """Whether a folder may hold files that pass."""
        if "top" in self.equal and folder and folder.split("/")[0] not in self.equal["top"]:
            return False
        inside = f"{folder}/" if folder else ""
        return inside.startswith(self.starts) or self.starts.startswith(inside)

    def partitions(self) -> list[Folders]:
        system, root = _at(self.root)
        found, level = [], [""]
        for _ in range(self.depth):
            found += [(f, False) for f in level]
            level = [
                posixpath.relpath(x.path, root) for f in level
                for x in system.get_file_info(fs.FileSelector(posixpath.join(root, f), allow_not_found=True)) if x.type == fs.FileType.Directory
            ]
            level = sorted(f for f in level if self._wanted(f))
        found += [(f, True) for f in level]
        return [Folders(found[i :: self.most]) for i in range(min(self.most, len(found)))]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        system, root = _at(self.root)
        rows, held = [], 0
        for folder, whole in partition.folders:
            for x in sorted(system.get_file_info(fs.FileSelector(posixpath.join(root, folder), allow_not_found=True, recursive=whole)), key=lambda x: x.path):
                path = posixpath.relpath(x.path, root)
                top = path.split("/")[0] if "/" in path else None
                suffix = posixpath.splitext(path)[1]
                own = {"top": top, "suffix": suffix}
                if x.type != fs.FileType.File or not path.startswith(self.starts) or any(own[k] not in v for k, v in self.equal.items()):
                    continue
                row = {"path": path, "folder": posixpath.dirname(path), "name": posixpath.basename(path), "size": x.size, **own}
                if "content" in self.fields:
                    with system.open_input_stream(x.path) as f:
                        row["content"] = f.read()
                    held += x.size
                rows.append(tuple(row[k] for k in self.fields))
                if held >= BATCH_BYTES or len(rows) >= 10_000:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"size": pa.int64(), "content": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.string())) for k, c in zip(self.fields, zip(*rows, strict=True), strict=True)], names=self.fields)


class TreeSource(DataSource):
    """``spark.read.format("tree")``: files below ``path``. Options: depth (folder levels that are planned on the driver, 2), partitions (most, 64)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: T.StructType) -> TreeReader:
        return TreeReader(schema, dict(self.options))


def read_tree(spark: SparkSession, path: str, content: bool = False, depth: int = 2, partitions: int = 64) -> DataFrame:
    """The files below a folder; an absent folder has none. ``top`` is null for files of the root itself."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").schema(WITH_CONTENT if content else LISTING).option("depth", depth).option("partitions", partitions).load(path)


def write_contents(files: DataFrame, root: str, path: str = "path", content: str = "content") -> DataFrame:
    """(path, size, written): each content written below ``root`` at its path, unless a file of its size is there already. Files appear whole (written aside, then moved), so
    a task that is run again does no harm; rows without content or path are passed over. Nothing happens until the result is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, top = _at(root)
        for batch in batches:
            out = []
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p is None or data is None:
                    continue
                to = posixpath.normpath(posixpath.join(top, p))
                if not to.startswith(f"{top.rstrip('/')}/"):
                    raise ValueError(f"{p} leaves the tree")
                there = system.get_file_info(to)
                new = there.type != fs.FileType.File or there.size != len(data)
                if new:
                    system.create_dir(posixpath.dirname(to), recursive=True)
                    aside = f"{posixpath.dirname(to)}/.{uuid.uuid4().hex}"
                    with system.open_output_stream(aside) as f:
                        f.write(data)
                    system.move(aside, to)
                out.append((p, len(data), new))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["path", "size", "written"])

    return files.select(F.col(path).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "path string, size long, written boolean")


def find_by_stem(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (folder, stem, ...) with ``path``: the file of that name, else the first by path whose name goes on with a dot; null if there is none."""
    names = listing.select("folder", "path", "name", F.split("name", r"\.").alias("parts"))
    heads = names.select("folder", "path", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", 1, i), "."))).alias("stem"))
    first = heads.groupBy("folder", "stem").agg(F.min(F.struct(F.col("name") != F.col("stem"), "path")).alias("m")).select("folder", "stem", F.col("m.path").alias("path"))
    return wanted.join(first, ["folder", "stem"], "left")


def match_tree(entries: DataFrame, listing: DataFrame, originals: str = "input") -> DataFrame:
    """Every entry (category, stem) with every editor, a folder of its category in ``listing`` other than ``originals``: (category, stem, editor, original, edited), null where a file is missing. Editors are
    discovered: they are the folders of a category (few), met by an equi-join on it."""
    parts = F.split("folder", "/")
    editors = listing.where(F.size(parts) == 2).select(parts[0].alias("category"), parts[1].alias("editor")).where(F.col("editor") != originals).distinct()
    wanted = entries.select("category", "stem").distinct().join(editors, "category")
    edited = find_by_stem(listing, wanted.withColumn("folder", F.concat_ws("/", "category", "editor"))).withColumnRenamed("path", "edited").drop("folder")
    return find_by_stem(listing, edited.withColumn("folder", F.concat_ws("/", "category", F.lit(originals)))).withColumnRenamed("path", "original").select("category", "stem", "editor", "original", "edited")
