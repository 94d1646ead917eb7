"""Listing and reading a folder of text files, spread over tasks; no name or content passes the driver."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.decode import MAX_FILE_BYTES, decode_text
from scriptorium.functions.names import base_name, extension, is_hidden, name_warning
from scriptorium.session import shared_dir

# Fixed value: the message for a file above the size guard.
TOO_LARGE = "ValueError: too large"
BATCH_BYTES = 16 * 1024**2
TASK_BYTES = 128 * 1024**2
_LISTED = "path string, folder boolean, size long, micros long, message string"
_LISTED_TYPES = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
_READ = "path string, size long, micros long, ext string, content binary, message string"
_READ_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]


def normal_root(root: str) -> str:
    """One spelling for a root: no trailing slash, and local folders as plain paths."""
    plain = re.sub(r"^file:(//)?(?=/)", "", root)
    return plain.rstrip("/") or "/"


def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def _entries(root: str, relative: str) -> Iterator[tuple[str, bool, int | None, int | None]]:
    """(path below root, is a folder, size, microseconds) of one folder; symbolic links are left out."""
    store, base = _store(root)
    prefix = f"{relative}/" if relative else ""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(f"{base}/{relative}") as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    yield prefix + entry.name, True, None, None
                elif entry.is_file(follow_symlinks=False):
                    about = entry.stat(follow_symlinks=False)
                    yield prefix + entry.name, False, about.st_size, about.st_mtime_ns // 1000
        return
    for entry in store.get_file_info(fs.FileSelector(f"{base}/{relative}".rstrip("/"))):
        if entry.type == fs.FileType.Directory:
            yield prefix + entry.base_name, True, None, None
        elif entry.type == fs.FileType.File:
            yield prefix + entry.base_name, False, entry.size, (entry.mtime_ns or 0) // 1000


def _lister(root: str):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, _LISTED_TYPES, strict=True)],
            names=["path", "folder", "size", "micros", "message"],
        )

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folders in batches:
            for folder in folders.column(0).to_pylist():
                rows: list[tuple] = []
                try:
                    for entry in _entries(root, folder):
                        rows.append((*entry, None))
                        if len(rows) >= 10_000:
                            yield batch(rows)
                            rows = []
                except OSError as error:  # gone or not readable: reported, the rest goes on
                    rows.append((folder, True, None, None, f"{type(error).__name__}: {error}"))
                if rows:
                    yield batch(rows)

    return listed


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """List the indexable files below ``root``, empty ones and any name included; no file is opened.

    Folders are expanded level by level: one job for each level, whose folders are spread over the tasks.
    """
    root = normal_root(root)
    place = f"{shared_dir(spark)}/listing-{uuid.uuid4().hex}"
    folders, level, more = spark.createDataFrame([("",)], "path string"), 0, True
    while more:
        target = f"{place}/level={level}"
        folders.mapInArrow(_lister(root), _LISTED).write.parquet(target)
        found = spark.read.schema(_LISTED).parquet(target)
        if level == 0 and (lost := found.filter(F.col("message").isNotNull() & (F.col("path") == "")).first()):
            raise FileNotFoundError(lost["message"])
        inside = found.filter(F.col("folder") & F.col("message").isNull() & ~is_hidden(F.concat("path", F.lit("/x"))))
        folders = inside.select("path").repartition("path")
        level, more = level + 1, not inside.isEmpty()
    listed = spark.read.schema(_LISTED).parquet(place)
    name = base_name(F.col("path"))
    return listed.filter(~F.col("folder") & ~is_hidden(F.col("path")) & extension(name).isNotNull()).select(
        "path",
        "size",
        F.timestamp_micros("micros").alias("mtime"),
        extension(name).alias("ext"),
        name_warning(name).alias("warning"),
        F.lit(True).alias("readable"),
    )


def _reader(root: str):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, _READ_TYPES, strict=True)],
            names=["path", "size", "micros", "ext", "content", "message"],
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        rows, held = [], 0
        for wanted in batches:
            for listed in zip(*[c.to_pylist() for c in wanted.columns], strict=True):
                try:
                    with store.open_input_stream(f"{base}/{listed[0]}") as file:
                        content = file.read(MAX_FILE_BYTES + 1)
                    large = len(content) > MAX_FILE_BYTES
                    rows.append((*listed, None, TOO_LARGE) if large else (*listed, content, None))
                except OSError as error:  # gone or not readable: reported, the rest goes on
                    rows.append((*listed, None, f"{type(error).__name__}: {error}"))
                held += len(rows[-1][4] or b"")
                if held >= BATCH_BYTES or len(rows) >= 10_000:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    return read


def read_files(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """``path, size, mtime, ext, body, message`` for exactly the files in ``wanted`` (path, size, mtime, ext).

    A file that cannot be read has a message and no body. Names alone are dealt out, to about as many tasks as their
    bytes ask for.
    """
    root = normal_root(root)
    total = wanted.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, total // TASK_BYTES)
    names = wanted.select("path", "size", F.unix_micros("mtime").alias("micros"), "ext")
    return names.repartition(int(tasks), "path").mapInArrow(_reader(root), _READ).select(
        "path", "size", F.timestamp_micros("micros").alias("mtime"), "ext", decode_text(F.col("content")).alias("body"), "message"
    )


def rows_of(read: DataFrame) -> DataFrame:
    """The files that could be read, to be built into documents."""
    return read.filter("message is null").select("path", "size", "mtime", "ext", "body")


def failures(read: DataFrame) -> DataFrame:
    """``path, message`` of the files that could not be read."""
    return read.filter("message is not null").select("path", "message")


def oversized(snapshot: DataFrame) -> DataFrame:
    """Files the size guard turns away, and those listed with a message of their own."""
    own = F.col("message") if "message" in snapshot.columns else F.lit(None).cast("string")
    message = F.coalesce(own, F.when(F.col("size") > MAX_FILE_BYTES, TOO_LARGE))
    return snapshot.filter("readable").select("path", message.alias("message")).filter("message is not null")
