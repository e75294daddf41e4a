"""Decide each document's outcome, publish the passed ones with their manifest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard import fixed_values as V
from corpusguard.functions import paths
from corpusguard.functions.fingerprints import finding_fingerprint
from corpusguard.functions.text import compute_once
from corpusguard.operators import approvals, manifest, receipts, rules, sides, transform
from corpusguard.plans.scan import Scan, store_reports
from corpusguard.session import materialize
from corpusguard.sources import sinks, snapshot
from corpusguard.sources.commit import require
from corpusguard.sources.strict import InvalidTable, raise_if_any

BLOCKED = "blocked"
PUBLISHED = "published"
SOURCE, OUTPUT = sides.SOURCE, sides.OUTPUT
DECIDED = (
    "path",
    "sha256",
    "outcome",
    "findings",
    "output",
    "output_sha256",
    "title",
    "lastmod",
    "approved_rules",
    "scan_problem",
)
# The digest of the rules in force, or a function that reads them anew as ``path, content``.
Ruleset = str | Callable[[], DataFrame]


def decide_outcomes(
    documents: DataFrame,
    allowlist: DataFrame,
    at: datetime | Column,
    external: DataFrame | None = None,
    external_output: DataFrame | None = None,
    content: str = "text",
    modified: str = "modified_at",
) -> DataFrame:
    """Scan, transform and re-scan every document in its own row.

    Adds ``outcome``, ``output``, ``output_sha256``, ``title``, ``lastmod``, ``approved_rules``,
    ``scan_problem`` and the final ``findings``, which include a failed transform.  Approvals and the
    receipts of outside scans (``external`` of the sources, ``external_output`` of what
    ``outputs_to_scan`` gives) come in one side table: text is shuffled once at most, and
    not at all if that table can be broadcast.
    """
    given = {side: frame for side, frame in ((SOURCE, external), (OUTPUT, external_output)) if frame is not None}
    joined = sides.join_sides(documents, sides.side_table(allowlist, at, given))
    marked = sides.decide_side(rules.scan_documents(joined, content), SOURCE, "sha256", "findings", SOURCE in given)
    passed = ~approvals.has_unapproved()
    reserved = paths.base(F.col("path")) == V.INDEX_FILE
    form = F.when(passed & ~reserved, transform.published_form(content, modified))
    first = compute_once(marked, "t", F.struct(passed.alias("passed"), form.alias("form")))
    first = first.select("*", "t.passed", "t.form.title", "t.form.output").drop("t")
    rescanned = rules.scan_documents(first, "output", "output_sha256", "output_findings")
    second = sides.decide_side(rescanned, OUTPUT, "output_sha256", "output_findings", OUTPUT in given)
    unproved = F.when(F.col("output").isNotNull(), F.col(sides.problem_column(OUTPUT)))
    outcome = (
        F.when(~F.col("passed"), BLOCKED)
        .when(reserved, V.RESERVED_INDEX)
        .when(F.col("output").isNull(), V.TRANSFORM_ERROR)
        .when(approvals.has_unapproved("output_findings"), V.OUTPUT_MISMATCH)
        .otherwise(PUBLISHED)
    )
    return second.withColumn("outcome", outcome).select(
        "path",
        "sha256",
        "outcome",
        _with_failure().alias("findings"),
        F.when(F.col("outcome") == PUBLISHED, F.col("output")).alias("output"),
        F.when(F.col("outcome") == PUBLISHED, F.col("output_sha256")).alias("output_sha256"),
        F.when(F.col("outcome") == PUBLISHED, F.col("title")).alias("title"),
        F.timestamp_seconds(F.unix_seconds(modified)).alias("lastmod"),
        F.coalesce(sides.problem_column(SOURCE), unproved).alias("scan_problem"),
        F.when(F.col("outcome") == PUBLISHED, approvals.approved_rules("output_findings")).alias("approved_rules"),
        *(c for c in documents.columns if c not in (*DECIDED, content)),
    )


def outputs_to_scan(
    documents: DataFrame,
    allowlist: DataFrame,
    at: datetime | Column,
    external: DataFrame | None = None,
    content: str = "text",
    modified: str = "modified_at",
) -> DataFrame:
    """``path, output`` of the documents that pass so far: what an outside scanner has to see before they are published."""
    decided = decide_outcomes(documents, allowlist, at, external, content=content, modified=modified)
    return decided.where("output is not null").select("path", "output")


def _with_failure() -> Column:
    """Source findings, plus one line-0 finding where publishing failed."""
    plain = F.struct(
        F.lit(0).cast("long").alias("line"),
        F.col("outcome").alias("rule_id"),
        F.lit(V.BLOCK).alias("level"),
        F.lit(V.REASON_TRANSFORM).alias("reason"),
        F.lit(False).alias("approvable"),
    )
    failure = F.struct(
        plain["line"].alias("line"),
        plain["rule_id"].alias("rule_id"),
        plain["level"].alias("level"),
        plain["reason"].alias("reason"),
        plain["approvable"].alias("approvable"),
        finding_fingerprint(F.col("path"), plain).alias("fingerprint"),
        F.lit(False).alias("approved"),
    )
    failed = F.col("outcome").isin(V.RESERVED_INDEX, V.TRANSFORM_ERROR, V.OUTPUT_MISMATCH)
    return F.when(failed, F.concat("findings", F.array(failure))).otherwise(F.col("findings"))


def select_publishable(documents: DataFrame, unapproved: DataFrame) -> DataFrame:
    """Candidates minus documents with unapproved blocking findings."""
    return documents.join(unapproved.select("path").distinct(), "path", "left_anti")


@dataclass(frozen=True)
class Publication:
    scan: Scan
    files: DataFrame
    indexes: DataFrame
    manifest: DataFrame


def build_snapshot(
    outcomes: DataFrame, candidates: DataFrame, scanner_version: str, ruleset_sha256: str, at: datetime | Column
) -> Publication:
    """Files and manifest of the decided outcomes."""
    published = outcomes.where(F.col("outcome") == PUBLISHED)
    indexes = transform.build_indexes(candidates)
    files = published.select(
        "path", F.col("output").alias("data"), F.col("output_sha256").alias("sha256")
    ).unionByName(indexes.select("path", "data", "sha256"))
    rows = manifest.manifest_rows(
        published.select("path", F.col("sha256").alias("source_sha256"), "output_sha256", "approved_rules"),
        indexes,
        F.lit(scanner_version),
        F.lit(ruleset_sha256),
    )
    proved = F.col("scan_problem").isNull().alias("completed")
    results = outcomes.select("path", "sha256", "findings", "scan_problem", proved)
    return Publication(Scan(results, at), files, indexes, rows)


def ruleset_digest(ruleset: Ruleset) -> str:
    """The digest of the rules as they are now."""
    return ruleset if isinstance(ruleset, str) else manifest.ruleset_fingerprint(ruleset()).first()["ruleset_sha256"]


def require_same_rules(ruleset: Ruleset, before: str) -> None:
    if ruleset_digest(ruleset) != before:
        raise InvalidTable("rules, scanner version or approvals changed during the run")


def publish_corpus(
    documents: DataFrame,
    allowlist: DataFrame,
    at: datetime,
    root: str,
    scanner_version: str,
    ruleset: Ruleset,
    external: DataFrame | None = None,
    external_output: DataFrame | None = None,
    content: str = "text",
    unchanged: DataFrame | None = None,
) -> dict:
    """Run the whole job.  Reports are written before anything becomes visible.

    ``external`` and ``external_output`` are receipts of outside scans; a gap in them stops the
    job before any report.  ``unchanged`` is a second discovery of the sources; any drift
    against the scanned digests stops the publication, as does a ``ruleset`` that reads
    differently at the end.
    """
    spark, content_root = documents.sparkSession, f"{root}/content"
    ruleset_sha256 = ruleset_digest(ruleset)
    decided = decide_outcomes(documents, allowlist, at, external, external_output, content)
    # The one write of the text: outcomes go straight into the new version's folder.
    version = snapshot.stage(staged_rows(decided), content_root)
    outcomes = read_outcomes(spark, content_root, version)
    for given in (external, external_output):
        if given is not None:
            raise_if_any(receipts.unknown_receipts(outcomes, given), "receipts without a document")
    built = build_snapshot(outcomes, outcomes.select("path"), scanner_version, ruleset_sha256, at)
    store_reports(built.scan, f"{root}/reports")
    ordered = materialize(manifest.encode_manifest(built.manifest), "manifest")
    snapshot.stage(
        built.indexes.select("path", "data", "sha256", F.lit(snapshot.INDEX).alias("kind")), content_root, version
    )

    def final_validation(staged: DataFrame) -> None:
        raise_if_any(manifest.verify_manifest(staged, ordered), "snapshot differs from manifest")
        if unchanged is not None:
            drift = manifest.reconcile(
                outcomes.select("path", "sha256"), unchanged, ("removed", "added", "changed"), "sha256"
            )
            raise_if_any(drift, "sources changed during the scan")
        require_same_rules(ruleset, ruleset_sha256)

    # Nothing may fail once the pointer moves, so the manifest is checked and stored before.
    sinks.write_manifest(ordered, f"{root}/manifests/version={version}")
    return snapshot.activate(spark, content_root, version, final_validation, ordered)


def staged_rows(outcomes: DataFrame) -> DataFrame:
    published = F.col("outcome") == PUBLISHED
    return outcomes.select(
        "path",
        F.col("output").alias("data"),
        F.col("output_sha256").alias("sha256"),
        F.col("sha256").alias("source_sha256"),
        "outcome",
        "findings",
        "approved_rules",
        "title",
        "lastmod",
        "scan_problem",
        F.when(published, snapshot.DOCUMENT).otherwise(snapshot.HELD).alias("kind"),
    )


def read_outcomes(spark: SparkSession, root: str, version: str) -> DataFrame:
    """The decided outcomes of a staged version."""
    staged = spark.read.parquet(snapshot.version_folder(root, version))
    return staged.where(F.col("kind") != snapshot.INDEX).select(
        "path",
        F.col("source_sha256").alias("sha256"),
        "outcome",
        "findings",
        F.col("data").alias("output"),
        F.col("sha256").alias("output_sha256"),
        "approved_rules",
        "title",
        "lastmod",
        "scan_problem",
    )


def published_manifest_path(spark: SparkSession, root: str) -> str:
    return f"{root}/manifests/version={require(spark, f'{root}/content')['version']}"
