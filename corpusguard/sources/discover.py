"""Candidate discovery over tables and file trees."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.functions import paths
from corpusguard.functions.text import digest
from corpusguard.session import materialize

# Entries of a directory, and bytes of files, that a task hands on at once.
LISTED_ROWS, READ_BYTES = 10_000, 32 * 1024 * 1024


def skip_reason(path: Column) -> Column:
    """Why a path is no candidate, null if it is one; the first reason wins."""
    return F.when(paths.hidden_or_temporary(path), "hidden-or-temporary").when(
        paths.extension(path) != ".md", "not-markdown"
    )


def classify_paths(files: DataFrame) -> DataFrame:
    return files.select("path", skip_reason(F.col("path")).alias("reason"))


def _filesystem(root: str):
    """The file system of a root and the root's path in it, for tasks and the driver alike."""
    return fs.FileSystem.from_uri(root)


def _qualified(spark: SparkSession, root: str) -> str:
    location = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = location.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(location).toUri()
    # A local address has no host, so its path follows two slashes.
    return f"file://{uri.getPath()}" if uri.getScheme() == "file" else uri.toString()


def _entries(files: fs.FileSystem, base: str, directory: str) -> Iterator[tuple]:
    """(path, size, modified_at, is a directory) of what a directory holds; links and special files are none of it."""
    local = isinstance(files, fs.LocalFileSystem)
    for info in files.get_file_info(fs.FileSelector(f"{base}/{directory}" if directory else base)):
        if info.type not in (fs.FileType.File, fs.FileType.Directory) or local and os.path.islink(info.path):
            continue
        path = f"{directory}/{info.base_name}" if directory else info.base_name
        yield path, info.size, info.mtime, info.type == fs.FileType.Directory


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, modified_at`` of every file of a tree, whatever its name.

    The directories of a level are a table that tasks list; the driver loops over levels,
    never over files, and each level is stored before the next one is listed.
    """
    qualified = _qualified(spark, root)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(qualified)
        for batch in batches:
            for directory in batch.column("path").to_pylist():
                found = _entries(files, base, directory)
                while rows := list(islice(found, LISTED_ROWS)):
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(columns[0], pa.string()),
                            pa.array(columns[1], pa.int64()),
                            pa.array(columns[2], pa.timestamp("us", "UTC")),
                            pa.array(columns[3], pa.bool_()),
                        ],
                        ["path", "size", "modified_at", "directory"],
                    )

    schema = "path string, size long, modified_at timestamp, directory boolean"
    level, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        stored = materialize(level.mapInArrow(listed, schema), "level")
        levels.append(stored.where("not directory").drop("directory"))
        below = stored.where("directory").select("path")
        if below.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        # Neighbours are listed by different tasks.
        level = below.repartition(F.xxhash64("path"))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, content, size, modified_at`` of a tree; the content of files that are skipped is not read and null.

    ``skipped_paths`` reports the skipped ones with their reasons.  Tasks read the files,
    a bounded number of bytes at a time.
    """
    qualified = _qualified(spark, root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(qualified)
        for batch in batches:
            start, held = 0, []
            size = 0
            for row, (path, wanted) in enumerate(zip(batch.column("path").to_pylist(), batch.column("wanted").to_pylist())):
                content = None
                if wanted:
                    with files.open_input_stream(f"{base}/{path}") as stream:
                        content = stream.read()
                held.append(content)
                size += len(content or b"")
                if size >= READ_BYTES or row + 1 == batch.num_rows:
                    part = batch.slice(start, len(held))
                    columns = [part.column("path"), pa.array(held, pa.binary()), part.column("size"), part.column("modified_at")]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "content", "size", "modified_at"])
                    start, held, size = row + 1, [], 0

    listed = list_tree(spark, root).withColumn("wanted", skip_reason(F.col("path")).isNull())
    spread = listed.repartition(F.xxhash64("path"))
    return spread.mapInArrow(read, "path string, content binary, size long, modified_at timestamp")


def discover_documents(files: DataFrame, content: str = "content") -> DataFrame:
    """Candidates with digest, size and time.  Content is dropped after hashing."""
    size = F.col("size") if "size" in files.columns else F.octet_length(content).cast("long")
    return files.where(skip_reason(F.col("path")).isNull()).select(
        "path", digest(F.col(content)).alias("sha256"), size.alias("size"), "modified_at"
    )


def skipped_paths(files: DataFrame) -> DataFrame:
    return classify_paths(files).where("reason is not null")


def read_stable(files: DataFrame, discovered: DataFrame, content: str = "content") -> DataFrame:
    """Rows whose digest, size and time are still those of discovery.

    The digest is compared inside the join on the path; rows that differ are those
    ``manifest.detect_drift`` lists.
    """
    current = files.withColumn("sha256", digest(F.col(content)))
    if "size" not in files.columns:
        current = current.withColumn("size", F.octet_length(content).cast("long"))
    return current.join(
        discovered.select("path", "sha256", "size", "modified_at"),
        ["path", "sha256", "size", "modified_at"],
        "left_semi",
    )
