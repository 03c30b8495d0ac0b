"""Folder trees of source files: listed level by level on the executors, read by bytes."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import stage
from .files import EXCLUDED_DIRECTORIES, LANGUAGE_SUFFIXES

SPLIT_BYTES = 64 * 1024 * 1024  # content that one task reads
BATCH_BYTES = 4 * 1024 * 1024  # content that one Arrow batch carries
FOLDERS = 64  # folders that one task lists at least

LISTED = "rel_path string, is_folder boolean, bytes long"


def located(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI as Arrow knows it, and the path inside."""
    return fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root.removeprefix("file:")))


def reachable(root: str) -> bool:
    try:
        located(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _entries(files: fs.FileSystem, base: str, folder: str, excluded: set[str]) -> Iterator[tuple]:
    """What a folder holds that may matter: source files, and folders to go into."""
    suffixes = tuple(s for each in LANGUAGE_SUFFIXES.values() for s in each)
    place = f"{base}/{folder}" if folder else base
    for entry in files.get_file_info(fs.FileSelector(place, allow_not_found=True)):
        rel = f"{folder}/{entry.base_name}" if folder else entry.base_name
        if entry.type == fs.FileType.Directory:
            linked = isinstance(files, fs.LocalFileSystem) and os.path.islink(entry.path)
            if entry.base_name not in excluded and not linked:
                yield rel, True, 0
        elif entry.base_name.lower().endswith(suffixes):
            yield rel, False, entry.size or 0


def list_tree(spark: SparkSession, root: str, excluded: list[str] | None = None) -> DataFrame:
    """``(rel_path, bytes)`` of the source files under ``root``, by Spark rounds.

    A round lists all folders of one depth on the executors; an excluded folder is never
    listed, and links to folders are not followed. The rounds number the depth of the tree,
    and no listing passes the driver.
    """
    names = set(EXCLUDED_DIRECTORIES if excluded is None else excluded)

    def list_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = located(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = list(_entries(files, base.rstrip("/"), folder, names))
                columns = list(zip(*found)) if found else [[], [], []]
                kinds = (pa.string(), pa.bool_(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], names=["rel_path", "is_folder", "bytes"]
                )

    found, folders, n = None, spark.createDataFrame([("",)], "rel_path string"), 1
    while n:
        tasks = max(1, min(-(-n // FOLDERS), 4 * spark.sparkContext.defaultParallelism))
        level = stage(folders.repartition(tasks).mapInArrow(list_all, LISTED), "listed")
        found = level if found is None else found.unionByName(level)
        folders = level.filter("is_folder").select("rel_path")
        n = folders.count()
    return found.filter("NOT is_folder").select("rel_path", "bytes")


def read_files(listed: DataFrame, root: str) -> DataFrame:
    """``(rel_path, content)`` of listed files; null where a file is gone or not UTF-8.

    The files are dealt to as many tasks as their bytes ask for.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = located(root)
        paths: list[str] = []
        contents: list[str | None] = []
        size = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with files.open_input_stream(f"{base.rstrip('/')}/{path}") as stream:
                        raw = stream.read()
                    content = raw.decode()
                except (OSError, UnicodeDecodeError):
                    raw, content = b"", None
                paths.append(path)
                contents.append(content)
                size += len(raw)
                if size >= BATCH_BYTES:
                    yield _contents(paths, contents)
                    paths, contents, size = [], [], 0
        yield _contents(paths, contents)

    total = listed.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(-(-total // SPLIT_BYTES), listed.sparkSession.sparkContext.defaultParallelism)
    return listed.select("rel_path").repartition(tasks, "rel_path").mapInArrow(
        read, "rel_path string, content string"
    )


def _contents(paths: list[str], contents: list[str | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(contents, pa.string())], names=["rel_path", "content"]
    )


def write_files(files: DataFrame, root: str) -> int:
    """Each row ``(rel_path, content)`` as a file under ``root``; returns their number.

    For derived inputs. A file is written again by a repeated task, with equal content.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = located(root)
        n = 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                full = f"{base.rstrip('/')}/{path}"
                target.create_dir(full.rsplit("/", 1)[0], recursive=True)
                with target.open_output_stream(full) as stream:
                    stream.write(content.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = files.select("rel_path", "content").filter("content IS NOT NULL")
    return rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
