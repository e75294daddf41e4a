"""A log of commits: which version of a set of tables is on show.

A commit is one small file ``pointer/sequence-N.json`` that names a version's folders.  It
is written under another name first and renamed, so it is never seen half written; the
rename fails if the sequence is taken, so of two writers that saw the same state one
fails.  A file that holds no commit (left by a writer that died while writing in place)
counts as used: readers pass over it and the next writer takes the number after it.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime

from pyspark.sql import SparkSession

from corpusguard.sources.strict import InvalidTable

_NAME = re.compile(r"sequence-(\d{12})\.json$")


def _path(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    location, files = _path(spark, path)
    return files.exists(location)


def _read(spark: SparkSession, path: str) -> dict | None:
    location, files = _path(spark, path)
    stream = files.open(location)
    try:
        text = bytes(stream.readAllBytes()).decode()
        row = json.loads(text)
        return row if isinstance(row, dict) and "version" in row else None
    except ValueError:
        return None
    finally:
        stream.close()


def state(spark: SparkSession, root: str) -> tuple[int, dict | None]:
    """The last sequence in use and the newest commit.  Only the newest files are read."""
    location, files = _path(spark, f"{root}/pointer")
    if not files.exists(location):
        return 0, None
    names = [status.getPath().getName() for status in files.listStatus(location)]
    used = sorted((int(found[1]) for name in names if (found := _NAME.search(name))), reverse=True)
    for sequence in used:
        row = _read(spark, f"{root}/pointer/sequence-{sequence:012d}.json")
        if row is not None:
            return used[0], {**row, "sequence": sequence}
    return (used[0] if used else 0), None


def versions(spark: SparkSession, root: str) -> set[str]:
    """Every version that a commit names, the present one and those before it."""
    location, files = _path(spark, f"{root}/pointer")
    if not files.exists(location):
        return set()
    names = [status.getPath().getName() for status in files.listStatus(location)]
    rows = (_read(spark, f"{root}/pointer/{name}") for name in names if _NAME.search(name))
    return {row["version"] for row in rows if row is not None}


def remove_abandoned(spark: SparkSession, root: str, before: datetime) -> list[str]:
    """Remove version folders that no commit names and that were last written to before a time; returns them.

    They are left by writers that failed.  A writer still at work keeps its folder if it
    started after ``before`` (an aware time).
    """
    location, files = _path(spark, root)
    if not files.exists(location):
        return []
    # Listed before the commits are read: a version committed meanwhile is among those.
    found = [(status.getPath(), status.getModificationTime()) for status in files.listStatus(location)]
    named = versions(spark, root)
    removed = []
    for path, modified in found:
        version = path.getName().removeprefix("version=")
        if path.getName() != version and version not in named and modified < before.timestamp() * 1000:
            files.delete(path, True)
            removed.append(version)
    return sorted(removed)


def current(spark: SparkSession, root: str) -> dict | None:
    return state(spark, root)[1]


def require(spark: SparkSession, root: str) -> dict:
    row = current(spark, root)
    if row is None:
        raise InvalidTable(f"{root} holds nothing published")
    return row


def create_once(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file whole; fail if another writer was there first."""
    target, files = _path(spark, path)
    pending, _ = _path(spark, f"{target.getParent().toString()}/.pending-{uuid.uuid4().hex}")
    stream = files.create(pending, False)
    stream.write(bytearray((text + "\n").encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        context.rename(pending, target, options)
    except Exception as error:
        files.delete(pending, False)
        raise InvalidTable(f"another publisher was faster: {path}") from error


def advance(spark: SparkSession, root: str, last: int, row: dict) -> dict:
    """Commit a row after the state whose last sequence is ``last``."""
    row = {"sequence": last + 1, **row}
    create_once(spark, f"{root}/pointer/sequence-{last + 1:012d}.json", json.dumps(row))
    return row
