"""Folders and manifests, listed and read by tasks.

Entries are rows, and so are the folders below them: a tree is listed level by
level, each level a job whose tasks list its folders.  Manifests are read in ranges
of bytes.  Names stay in tables, and a plan is as long for one entry as for many.
"""

from __future__ import annotations

import io
import os
import stat
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.sources.files import system_of

#: Folders that a task lists, about; tasks of a level at most for each core.
FOLDERS, TASKS = 64, 8
#: Bytes of a manifest that a task reads, and rows of a batch.
RANGE, ROWS = 32 << 20, 10_000

ENTRY, FOUND = "entry bigint, path string", "entry bigint, path string, folder boolean"


def store(spark: SparkSession, path: str) -> str:
    """What stands before a path without a scheme: nothing on this machine's own file system, else the default store."""
    return "" if "://" in path or (uri := system_of(spark, path)[0].getUri().toString()).startswith("file:") else uri.rstrip("/")


def reachable(address: str) -> bool:
    """Can tasks open what is there without the JVM?"""
    try:
        return address.startswith(("/", "file:")) or fs.FileSystem.from_uri(address) is not None
    except (pa.ArrowException, OSError, ValueError):
        return False


class _Store:
    """Files by address, for tasks: the machine's own through the system, others through Arrow."""

    def __init__(self, before: str):
        self.before = before

    def _at(self, path: str) -> tuple[fs.FileSystem | None, str]:
        if path.startswith("file:"):
            return None, "/" + path.removeprefix("file:").lstrip("/")
        address = self.before + path if path.startswith("/") else path
        return (None, address) if address.startswith("/") else fs.FileSystem.from_uri(address)

    def kind(self, path: str) -> tuple[str, int]:
        """folder, file or none, and the size of a file."""
        system, place = self._at(path)
        if system is not None:
            info = system.get_file_info(place)
            return {fs.FileType.Directory: "folder", fs.FileType.File: "file"}.get(info.type, "none"), info.size or 0
        try:
            told = os.stat(place)
        except OSError:
            return "none", 0
        return "folder" if stat.S_ISDIR(told.st_mode) else "file" if stat.S_ISREG(told.st_mode) else "none", told.st_size

    def names(self, path: str) -> Iterator[tuple[str, bool]]:
        """(name, is it a folder) of what a folder holds; links to folders are not followed."""
        system, place = self._at(path)
        if system is not None:
            for info in system.get_file_info(fs.FileSelector(place)):
                yield info.base_name, info.type == fs.FileType.Directory
            return
        with os.scandir(place) as found:
            for item in found:
                if (below := item.is_dir(follow_symlinks=False)) or item.is_file():
                    yield item.name.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), below

    def open(self, path: str) -> io.BufferedReader:
        system, place = self._at(path)
        return open(place, "rb") if system is None else io.BufferedReader(system.open_input_file(place))


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[Any, ...]]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def kinds(entries: DataFrame, before: str) -> DataFrame:
    """entry, path, kind (folder, manifest, image, none), size of each entry."""
    schema = pa.schema([("entry", pa.int64()), ("path", pa.string()), ("kind", pa.string()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Store(before)
        return _batches(((entry, path, *own.kind(path)) for entry, path in _rows(batches, "entry", "path")), schema)

    named = entries.mapInArrow(run, "entry bigint, path string, kind string, size bigint")
    suffix = C.suffix(F.col("path"))
    kind = F.when(F.col("kind") != "file", F.col("kind")).when(suffix == "txt", "manifest").when(suffix.isin(*C.IMAGE_SUFFIXES), "image").otherwise("none")
    return named.withColumn("kind", kind)


def walk(folders: DataFrame, before: str, place: str) -> DataFrame:
    """entry, path of all files below folders (entry, path), hidden and empty ones too.

    Each level is written below ``place`` and read again by the next.
    """
    spark, number = folders.sparkSession, 0
    schema = pa.schema([("entry", pa.int64()), ("path", pa.string()), ("folder", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Store(before)
        return _batches(((entry, f"{path.rstrip('/')}/{name}", below) for entry, path in _rows(batches, "entry", "path") for name, below in own.names(path)), schema)

    level = folders.select("entry", "path")
    while count := level.count():
        tasks = max(1, min(-(-count // FOLDERS), TASKS * spark.sparkContext.defaultParallelism))
        level.repartition(tasks, "path").mapInArrow(run, FOUND).write.parquet(f"{place}/level={number}")
        level = spark.read.schema(FOUND).parquet(f"{place}/level={number}").where("folder").select("entry", "path")
        number += 1
    if not number:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(FOUND + ", level int").parquet(place).where("not folder").select("entry", "path")


def lines(manifests: DataFrame, before: str) -> DataFrame:
    """entry, path, line: the lines of manifests (entry, path, size) that hold more than white space, without it at their ends."""
    schema = pa.schema([("entry", pa.int64()), ("path", pa.string()), ("line", pa.string())])

    def read(own: _Store, path: str, first: int) -> Iterator[str]:
        """Lines that begin in the range of bytes from ``first`` on."""
        with own.open(path) as file:
            if first:
                file.seek(first - 1)
                file.readline()
            while file.tell() < first + RANGE and (block := file.readline()):
                yield from (clean for line in block.decode().splitlines() if (clean := line.strip()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Store(before)
        return _batches(((entry, path, line) for entry, path, first in _rows(batches, "entry", "path", "first") for line in read(own, path, first)), schema)

    ranges = manifests.select("entry", "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(RANGE).cast("bigint"))).alias("first"))
    tasks = max(1, min(ranges.count(), TASKS * ranges.sparkSession.sparkContext.defaultParallelism))
    return ranges.repartition(tasks, "path", "first").mapInArrow(run, "entry bigint, path string, line string")
