"""Counts, exclusion report and inventory: narrow projections of scan results.

All functions take results whose findings were marked by
``approvals.mark_approved``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard import fixed_values as V
from corpusguard.functions import paths
from corpusguard.functions.fingerprints import document_fingerprint
from corpusguard.operators.approvals import has_unapproved
from corpusguard.operators.findings import safe_reason
from corpusguard.schemas import INVENTORY_FINDING, REPORT_FINDING

_KNOWN_LEVELS = (V.BLOCK, V.WARNING)


def validate_results(results: DataFrame) -> DataFrame:
    """Problems that make scan results unusable for a report.

    Findings produced here have no path of their own; given ones must name their document.
    """
    own_path = "path" not in results.schema["findings"].dataType.elementType.names

    def bad_finding(f: Column) -> Column:
        good = paths.valid_rule_id(f["rule_id"]) & (f["line"] >= 0)
        return ~(good if own_path else good & (f["path"] == F.col("path")))

    unknown_level = lambda f: ~f["level"].isin(*_KNOWN_LEVELS)
    rows = results.select(
        "path",
        F.when(~F.col("completed"), "incomplete")
        .when(~paths.valid_document_path(F.col("path")), "path")
        .when(~paths.valid_sha256(F.col("sha256")), "sha256")
        .when(F.exists("findings", bad_finding), "finding")
        .when(F.exists("findings", unknown_level), "level")
        .alias("problem"),
    ).where("problem is not null")
    repeated = (
        results.groupBy("path").count().where("count > 1").select("path", F.lit("duplicate").alias("problem"))
    )
    return rows.unionByName(repeated)


def scan_counts(results: DataFrame, *by: str) -> DataFrame:
    """Documents passed and excluded, and warning findings over all documents."""
    excluded = has_unapproved().cast("long")
    warnings = F.size(F.filter("findings", lambda f: f["level"] == V.WARNING)).cast("long")
    counted = results.select(*by, excluded.alias("e"), warnings.alias("w"))
    return counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.coalesce(F.sum(1 - F.col("e")), F.lit(0)).cast("long").alias("passed"),
        F.coalesce(F.sum("e"), F.lit(0)).cast("long").alias("excluded"),
        F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("warnings"),
    )


def exclusion_report(results: DataFrame, generated_at: datetime | Column) -> DataFrame:
    """One pending row per document with an unapproved blocking finding.

    Findings are ordered by rule, line and fingerprint; their fingerprints keep the
    scanner's reason, the report shows the canonical one.
    """
    instant = generated_at if isinstance(generated_at, Column) else F.lit(generated_at)
    kept = F.transform(
        F.filter("findings", lambda f: (f["level"] == V.BLOCK) & ~f["approved"]),
        lambda f: F.struct(
            f["rule_id"].alias("rule"),
            f["line"].alias("line"),
            f["fingerprint"].alias("fingerprint"),
            f["level"].alias("level"),
            safe_reason(f["rule_id"]).alias("reason"),
        ),
    )
    return (
        results.select("path", "sha256", F.explode_outer(F.array(F.sort_array(kept))).alias("findings"))
        .where(F.size("findings") > 0)
        .select(
            F.lit(V.REPORT_VERSION).alias("version"),
            instant.alias("generated_at"),
            "path",
            "sha256",
            document_fingerprint(F.col("path"), F.col("sha256"), F.col("findings")).alias("fingerprint"),
            F.col("findings").cast(f"array<{REPORT_FINDING.simpleString()}>").alias("findings"),
            instant.alias("detected_at"),
            F.lit("pending").alias("status"),
        )
    )


def report_findings(report: DataFrame) -> DataFrame:
    """Flat form of the exclusion report."""
    return report.select(
        "path",
        "sha256",
        F.col("fingerprint").alias("document_fingerprint"),
        "status",
        F.explode("findings").alias("f"),
    ).select("path", "sha256", "document_fingerprint", "status", "f.*")


def inventory_documents(results: DataFrame) -> DataFrame:
    """Every document with its status and all findings, warnings included."""
    findings = F.sort_array(
        F.transform(
            "findings",
            lambda f: F.struct(
                f["rule_id"].alias("rule"),
                f["line"].alias("line"),
                f["fingerprint"].alias("fingerprint"),
                f["level"].alias("level"),
                f["approved"].alias("approved"),
            ),
        )
    )
    return results.select(
        "path",
        "sha256",
        F.when(has_unapproved(), "excluded").otherwise("passed").alias("status"),
        findings.cast(f"array<{INVENTORY_FINDING.simpleString()}>").alias("findings"),
    )


def inventory_header(documents: DataFrame, generated_at: datetime | Column) -> DataFrame:
    instant = generated_at if isinstance(generated_at, Column) else F.lit(generated_at)
    passed = (F.col("status") == "passed").cast("long")
    return documents.agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.coalesce(F.sum(passed), F.lit(0)).cast("long").alias("passed_count"),
        F.coalesce(F.sum((F.col("status") == "excluded").cast("long")), F.lit(0))
        .cast("long")
        .alias("excluded_count"),
    ).select(
        F.lit(V.REPORT_VERSION).alias("version"),
        instant.alias("generated_at"),
        "candidate_count",
        "passed_count",
        "excluded_count",
    )


def inventory_findings(documents: DataFrame) -> DataFrame:
    """Flat form of the inventory; documents without findings keep one row."""
    return documents.select("path", "sha256", "status", F.explode_outer("findings").alias("f")).select(
        "path", "sha256", "status", "f.*"
    )


def validate_report(report: DataFrame) -> DataFrame:
    """Violations of a stored exclusion report."""
    findings = F.col("findings")
    bad = lambda f: ~(
        paths.valid_sha256(f["fingerprint"])
        & paths.valid_rule_id(f["rule"])
        & (f["level"] == V.BLOCK)
        & (f["line"] >= 0)
        & (f["reason"] == safe_reason(f["rule"]))
    )
    fingerprints = F.transform(findings, lambda f: f["fingerprint"])
    problem = (
        F.when(F.coalesce(F.col("version") != V.REPORT_VERSION, F.lit(True)), "version")
        .when(F.col("generated_at").isNull(), "generated_at")
        .when(F.coalesce(~paths.valid_document_path(F.col("path")), F.lit(True)), "path")
        .when(F.coalesce(~paths.valid_sha256(F.col("sha256")), F.lit(True)), "sha256")
        .when(F.coalesce(~paths.valid_sha256(F.col("fingerprint")), F.lit(True)), "fingerprint")
        .when(F.coalesce(F.size(findings) <= 0, F.lit(True)), "findings")
        .when(
            ~F.col("detected_at").eqNullSafe(F.col("generated_at"))
            | ~F.col("status").eqNullSafe(F.lit("pending")),
            "status",
        )
        .when(
            F.col("fingerprint") != document_fingerprint(F.col("path"), F.col("sha256"), findings),
            "fingerprint_mismatch",
        )
        .when(F.exists(findings, lambda f: F.coalesce(bad(f), F.lit(True))), "finding")
        .when(F.size(F.array_distinct(fingerprints)) < F.size(findings), "duplicate_finding")
    )
    rows = report.select("path", problem.alias("problem")).where("problem is not null")
    repeated = (
        report.groupBy("path").count().where("count > 1").select("path", F.lit("duplicate").alias("problem"))
    )
    return rows.unionByName(repeated)


def sort_documents(documents: DataFrame) -> DataFrame:
    """Canonical order of report, inventory and manifest rows."""
    return documents.orderBy("path")


def sort_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "line", "rule_id")
