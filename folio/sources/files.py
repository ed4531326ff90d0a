"""Whole files as rows, however many there are.

Spark's own readers keep a status of each file on the driver and give a task 32
small files at most (each counts as 4 MB). Here folders are listed in tasks,
level by level, into a table of paths in the shared folder, and a task reads
thousands of files; the driver sees counts only.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import materialize

#: Files and bytes that a reading task is given; rows and bytes of a batch.
TASK_FILES, TASK_BYTES = 4_000, 64 << 20
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20
_LISTED = "at string, size long, folder boolean"


def _hidden(name: str) -> bool:
    """What Spark's readers leave out."""
    return name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")


def _children(fs: FileSystem, folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path, size, whether it is a folder) of what is in ``folder``; a local
    one is read as a stream."""
    if isinstance(fs, LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if not _hidden(e.name):
                    yield e.path, 0 if e.is_dir() else e.stat().st_size, e.is_dir()
        return
    for i in fs.get_file_info(FileSelector(folder)):
        if not _hidden(i.base_name):
            yield i.path, i.size or 0, i.type == FileType.Directory


def _encoded(path: str) -> str:
    """A path as ``input_file_name`` gives it: what a URI can't hold is escaped,
    letters beyond ASCII stay."""
    return re.sub(r"[\x00-\x20\x7f\"#%<>?\[\\\]^`{|}]", lambda m: f"%{ord(m[0]):02X}", path)


def _root(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """(URI of its file system, path there) of a folder that ``pyarrow.fs``
    reaches; None for patterns, single files and other file systems."""
    if re.search(r"[*?\[\]{}\\]", path):
        return None
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    base = f"{uri.getScheme()}://{uri.getAuthority() or ''}"
    try:
        fs, _ = FileSystem.from_uri(base + "/")
        found = fs.get_file_info(uri.getPath()).type
    except (OSError, ValueError, pa.ArrowException):
        return None
    return (base, uri.getPath()) if found == FileType.Directory else None


def _list(spark: SparkSession, base: str, folder: str) -> list[DataFrame]:
    """Tables (at, size, folder) of all that is below ``folder``, one a level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = FileSystem.from_uri(base + "/")
        out: list[tuple[str, int, bool]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.bool_()))], ["at", "size", "folder"])

        for b in batches:
            for at in b.column("at").to_pylist():
                for child in _children(fs, at):
                    out.append(child)
                    if len(out) >= 10_000:
                        yield batch()
                        out.clear()
        if out:
            yield batch()

    levels, todo = [], spark.createDataFrame([(folder,)], "at string")
    while True:
        found = materialize(todo.mapInArrow(run, _LISTED))
        levels.append(found)
        folders = found.where("folder").select("at")
        n = folders.count()
        if not n:
            return levels
        todo = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "at")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each file that isn't empty, with all folders below, as one
    row; ``value`` is its text as it is. A pattern, and a file system that
    ``pyarrow.fs`` doesn't reach, is read by Spark's own reader."""
    root = _root(spark, path)
    if root is None:
        df = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.input_file_name())
        return df.select("path", "value")
    base, folder = root
    files = None
    for level in _list(spark, base, folder):
        own = level.where("NOT folder AND size > 0").select("at", "size")
        files = own if files is None else files.unionByName(own)
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(1, -(-n // TASK_FILES), -(-size // TASK_BYTES), min(n, spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = FileSystem.from_uri(base + "/")
        paths, values, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.binary())], ["path", "value"])

        for b in batches:
            for at in b.column("at").to_pylist():
                with fs.open_input_stream(at) as file:
                    value = file.read()
                paths.append(base + _encoded(at))
                values.append(value)
                held += len(value)
                if held >= BATCH_BYTES or len(paths) >= BATCH_ROWS:
                    yield batch()
                    paths, values, held = [], [], 0
        if paths:
            yield batch()

    return files.repartition(parts, "at").select("at").mapInArrow(run, "path string, value binary").select("path", F.col("value").cast("string").alias("value"))
