"""Validated writers of the local reports, the allowlist and the manifest.

A writer never overwrites: it fills a new folder, and a commit puts the folders of a
version on show together.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard import fixed_values as V
from corpusguard.operators.approvals import sort_entries, validate_allowlist
from corpusguard.operators.manifest import reconcile, validate_manifest
from corpusguard.operators.reports import inventory_header, validate_report
from corpusguard.schemas import INVENTORY, INVENTORY_HEADER
from corpusguard.sources import commit
from corpusguard.sources.strict import load_allowlist, load_report, raise_if_any


def write_exclusion_report(report: DataFrame, path: str) -> None:
    raise_if_any(validate_report(report), "exclusion report is not valid")
    report.repartitionByRange("path").sortWithinPartitions("path").write.mode("errorifexists").json(path)


def inventory_problems(documents: DataFrame, header: DataFrame) -> DataFrame:
    """Header counts that do not reconcile with the documents."""
    counts = ("candidate_count", "passed_count", "excluded_count")
    declared = header.select(*counts, F.lit(0).cast("long").alias("n"))
    actual = documents.select(*(F.lit(0).cast("long").alias(c) for c in counts), F.lit(1).cast("long").alias("n"))
    return (
        declared.unionByName(actual)
        .agg(*(F.sum(c).alias(c) for c in (*counts, "n")))
        .where("candidate_count <> n or passed_count + excluded_count <> candidate_count")
    )


def write_inventory(documents: DataFrame, generated_at: datetime | Column, path: str) -> None:
    header = inventory_header(documents, generated_at)
    raise_if_any(inventory_problems(documents, header), "scan inventory is inconsistent")
    documents.repartitionByRange("path").sortWithinPartitions("path").write.mode("errorifexists").json(
        f"{path}/documents"
    )
    header.write.mode("errorifexists").json(f"{path}/header")


@dataclass(frozen=True)
class Reports:
    """The reports of one commit."""

    exclusions: DataFrame
    documents: DataFrame
    header: DataFrame


def _read_set(spark: SparkSession, root: str, row: dict) -> Reports:
    return Reports(
        load_report(spark, f"{root}/{row['exclusions']}"),
        spark.read.schema(INVENTORY).option("mode", "FAILFAST").json(f"{root}/{row['documents']}"),
        spark.read.schema(INVENTORY_HEADER).option("mode", "FAILFAST").json(f"{root}/{row['header']}"),
    )


def read_reports(spark: SparkSession, root: str) -> Reports:
    """The reports on show; all three tables are of one scan."""
    return _read_set(spark, root, commit.require(spark, root))


def set_problems(reports: Reports) -> DataFrame:
    """Documents on which the stored report and the stored inventory disagree."""
    excluded = reports.documents.where("status = 'excluded'").select("path", "sha256")
    listed = reports.exclusions.select("path", "sha256")
    return reconcile(excluded, listed, ("not_reported", "not_excluded", "digest"), "sha256")


def commit_reports(exclusions: DataFrame, documents: DataFrame, generated_at: datetime | Column, root: str) -> dict:
    """Write report, inventory and header into new folders, read them back, then show them together.

    A writer that fails leaves the earlier set on show.
    """
    spark = documents.sparkSession
    last, _ = commit.state(spark, root)
    version = uuid.uuid4().hex
    folder = f"version={version}"
    row = {
        "version": version,
        "exclusions": f"{folder}/exclusions",
        "documents": f"{folder}/inventory/documents",
        "header": f"{folder}/inventory/header",
    }
    write_exclusion_report(exclusions, f"{root}/{row['exclusions']}")
    write_inventory(documents, generated_at, f"{root}/{folder}/inventory")
    stored = _read_set(spark, root, row)
    raise_if_any(inventory_problems(stored.documents, stored.header), "stored inventory is inconsistent")
    raise_if_any(set_problems(stored), "stored reports disagree")
    return commit.advance(spark, root, last, row)


def save_allowlist(allowlist: DataFrame, path: str) -> None:
    """Write a new version folder; never overwrite the one the frame was read from."""
    raise_if_any(validate_allowlist(allowlist), "allowlist is not valid")
    stored = sort_entries(allowlist).select(F.lit(V.ALLOWLIST_VERSION).alias("version"), *allowlist.columns)
    stored.write.mode("errorifexists").json(path)


def commit_allowlist(allowlist: DataFrame, root: str, last: int) -> dict:
    """Save the allowlist as the version after ``last``; fails if another review was saved meanwhile."""
    version = uuid.uuid4().hex
    save_allowlist(allowlist, f"{root}/version={version}")
    return commit.advance(allowlist.sparkSession, root, last, {"version": version})


def read_allowlist(spark: SparkSession, root: str) -> DataFrame:
    return load_allowlist(spark, f"{root}/version={commit.require(spark, root)['version']}")


def write_manifest(manifest: DataFrame, path: str) -> None:
    raise_if_any(validate_manifest(manifest), "manifest is not valid")
    manifest.repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.mode("errorifexists").json(path)
