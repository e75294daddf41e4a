"""Verify a published snapshot against its manifest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard import fixed_values as V
from corpusguard.functions import paths
from corpusguard.operators import approvals, manifest as manifests, receipts, rules, sides
from corpusguard.plans.publish import Ruleset, ruleset_digest
from corpusguard.session import materialize


def rescan(
    files: DataFrame, allowlist: DataFrame, at: datetime | Column, external: DataFrame | None = None
) -> DataFrame:
    """Published files scanned again; keeps their digest, so text is read once.

    ``external`` holds the receipts of an outside scan of the published files.
    """
    scanned = rules.scan_documents(files, "data").select("path", "sha256", "findings")
    given = {} if external is None else {sides.OUTPUT: external}
    joined = sides.join_sides(scanned, sides.side_table(allowlist, at, given, (sides.OUTPUT,)))
    marked = sides.decide_side(joined, sides.OUTPUT, "sha256", "findings", external is not None)
    return marked.select(
        "path",
        "sha256",
        approvals.has_unapproved().alias("unapproved"),
        F.exists("findings", lambda f: f["level"] == V.BLOCK).alias("blocking"),
        approvals.approved_rules().alias("rules"),
        F.col(sides.problem_column(sides.OUTPUT)).alias("scan_problem"),
    )


def header_problems(manifest: DataFrame, scanner_version: str, ruleset_sha256: str) -> DataFrame:
    problem = F.when(F.col("scanner_version") != scanner_version, "scanner_version_changed").when(
        F.col("ruleset_sha256") != ruleset_sha256, "ruleset_changed"
    )
    return manifest.select(problem.alias("problem")).where("problem is not null").distinct()


def directories_of(files: DataFrame) -> DataFrame:
    """Distinct directories that hold the files of a tree."""
    direct = files.select(paths.directory(F.col("path")).alias("path")).distinct().where("path <> '.'")
    return direct.select(
        F.explode(F.concat(F.array("path"), paths.ancestors(F.col("path")))).alias("path")
    ).distinct()


def verify_corpus(
    files: DataFrame,
    manifest: DataFrame,
    allowlist: DataFrame,
    at: datetime | Column,
    scanner_version: str,
    ruleset: Ruleset,
    directories: DataFrame | None = None,
    external: DataFrame | None = None,
) -> DataFrame:
    """Violations ``check, path, problem`` of published ``path, data``; empty means verified.

    The text is read once: the outcome of the re-scan is written, and every check
    works on that narrow table.  ``external`` are receipts of an outside scan of every
    published file; its findings block like own ones, and a gap in it is a violation.
    """
    ruleset_sha256 = ruleset_digest(ruleset)
    scanned = materialize(rescan(files, allowlist, at, external), "rescan")
    unproved = scanned.where("scan_problem is not null").select("path", F.col("scan_problem").alias("problem"))
    if external is not None:
        unproved = unproved.unionByName(receipts.unknown_receipts(scanned, external))
    if directories is None:
        directories = directories_of(scanned)

    def labelled(check: str, frame: DataFrame, problem: str = "problem") -> DataFrame:
        path = F.col("path") if "path" in frame.columns else F.lit(None).cast("string")
        return frame.select(F.lit(check).alias("check"), path.alias("path"), F.col(problem).alias("problem"))

    return (
        labelled("manifest", manifests.validate_manifest(manifest))
        .unionByName(labelled("header", header_problems(manifest, scanner_version, ruleset_sha256)))
        .unionByName(labelled("digest", manifests.verify_manifest(scanned, manifest), "status"))
        .unionByName(labelled("boundary", manifests.verify_boundary(scanned, directories, manifest)))
        .unionByName(labelled("external", unproved))
        .unionByName(labelled("document", manifests.verify_documents(scanned, manifest)))
    )
