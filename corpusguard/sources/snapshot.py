"""All-or-nothing publication of a file set.

A snapshot is a new version folder.  It becomes visible only when the pointer table
names it, after the staged copy was read back and compared.  Readers filter on the
pointer, so a failed run leaves the previous snapshot in place.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.functions import paths
from corpusguard.functions.text import digest
from corpusguard.operators.manifest import table_digest
from corpusguard.sources.commit import advance, create_once, current, exists, require, state  # noqa: F401
from corpusguard.sources.strict import raise_if_any

# Partition folders of a version: what readers see, and rows kept for the reports.
DOCUMENT, INDEX, HELD = "document", "index", "held"


def version_folder(root: str, version: str) -> str:
    return f"{root}/version={version}"


def read_version(spark: SparkSession, root: str, version: str) -> DataFrame:
    """``path, data, sha256`` of a version; rows held back are pruned by folder."""
    staged = spark.read.parquet(version_folder(root, version))
    return staged.where(F.col("kind").isin(DOCUMENT, INDEX)).select("path", "data", "sha256")


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The visible snapshot."""
    return read_version(spark, root, require(spark, root)["version"])


def read_columns(spark: SparkSession, root: str, kinds: tuple[str, ...], schema: str) -> DataFrame:
    """Some staged columns of the visible version's rows; the text is not read, nor are other kinds."""
    staged = spark.read.schema(f"{schema}, kind string").parquet(version_folder(root, require(spark, root)["version"]))
    return staged.where(F.col("kind").isin(*kinds)).drop("kind")


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """``path, title, lastmod`` of the documents on show."""
    return read_columns(spark, root, (DOCUMENT,), "path string, title string, lastmod timestamp")


def read_candidates(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of every document that the visible version decided on, those held back included."""
    return read_columns(spark, root, (DOCUMENT, HELD), "path string")


def invalid_files(files: DataFrame) -> DataFrame:
    """File rows a snapshot may not hold: bad or repeated paths, text that is not its digest's."""
    valid = paths.valid_snapshot_path(F.col("path"))
    bad = files.where(~valid).select("path", F.lit("path").alias("problem"))
    damaged = files.where(~digest(F.col("data")).eqNullSafe(F.col("sha256")))
    repeated = files.groupBy("path").count().where("count > 1")
    return (
        bad.unionByName(damaged.select("path", F.lit("digest").alias("problem")))
        .unionByName(repeated.select("path", F.lit("duplicate").alias("problem")))
    )


def stage(rows: DataFrame, root: str, version: str | None = None) -> str:
    """Write rows ``path, data, sha256, kind`` (others may follow) into a version folder.

    Call again with the returned version to add rows.
    """
    version = version or uuid.uuid4().hex
    rows.write.mode("append").partitionBy("kind").parquet(version_folder(root, version))
    return version


def activate(
    spark: SparkSession,
    root: str,
    version: str,
    final_validation: Callable[[DataFrame], None] | None = None,
    manifest: DataFrame | None = None,
) -> dict:
    """Read the staged version back, check it, validate, then advance the pointer.

    The version's identity is its files and, if given, the rows of its manifest.  The same
    identity keeps the pointer where it is.  The pointer is a new file named by its sequence: of two
    publishers that read the same state one fails.
    """
    last, visible = state(spark, root)
    staged = read_version(spark, root, version)
    raise_if_any(invalid_files(staged), "staged snapshot failed its integrity check")
    tree = table_digest(staged, ["path", "sha256"]).first()
    if final_validation is not None:
        final_validation(staged)
    tree_sha256 = tree["sha256"] if tree else ""
    if manifest is not None:
        described = manifest.withColumn("approved_rules", F.to_json("approved_rules"))
        rows = table_digest(described, described.columns).first()
        tree_sha256 = hashlib.sha256(f"{tree_sha256} {rows['sha256'] if rows else ''}".encode()).hexdigest()
    if visible is not None and visible["tree_sha256"] == tree_sha256:
        return visible
    return advance(spark, root, last, {"version": version, "tree_sha256": tree_sha256})


def publish_snapshot(
    files: DataFrame, root: str, final_validation: Callable[[DataFrame], None] | None = None
) -> dict:
    """Publish a file set ``path, data``.

    ``files`` may carry the ``sha256`` its producer computed: the staged copy must
    hash to it.
    """
    if "sha256" not in files.columns:
        files = files.withColumn("sha256", digest(F.col("data")))
    version = stage(files.select("path", "data", "sha256", F.lit(DOCUMENT).alias("kind")), root)
    return activate(files.sparkSession, root, version, final_validation)
